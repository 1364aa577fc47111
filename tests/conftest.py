"""One local session for all tests."""

import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from sigloom.session import build_session

    with tempfile.TemporaryDirectory() as tmp:
        s = build_session("tests", cpus="4", shuffle_partitions=4, spark__checkpoint__dir=f"file://{tmp}/shared", spark__sql__warehouse__dir=f"{tmp}/warehouse")
        s.sparkContext.setLogLevel("ERROR")
        yield s
        s.stop()


SF = "/root/testdata/sf0.001"
