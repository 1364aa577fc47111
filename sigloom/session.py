"""Session helpers: table access, shared-folder materialisation, partition sizing, broadcast guards."""

from __future__ import annotations

import atexit
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes of its plan statistics, that an operator may broadcast by itself.
BROADCAST_LIMIT_BYTES = 8 * 1024 * 1024

#: Estimates from here on mean that Catalyst doesn't know the size.
UNKNOWN_BYTES = 1 << 60

_written: list[tuple[SparkSession, str]] = []


def build_session(app: str = "sigloom", cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use; a cluster brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SIGLOOM_DRIVER_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session; set here only where it is unset in local mode."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        d = f"/tmp/sigloom-checkpoint-{os.getpid()}"
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def shared_folder(spark: SparkSession) -> str:
    """A new path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/sigloom-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialise(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Cuts the lineage by writing df as a Parquet table into the shared folder and reading it back.

    A written table survives the loss of any executor, is columnar, and gives later plans true sizes. It is removed
    when the driver ends.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._table_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Removes the tables that materialise() wrote for these frames, once nothing reads them any more."""
    for df in frames:
        path = getattr(df, "_table_path", None)
        entry = (df.sparkSession, path)
        if path and entry in _written:
            _delete(*entry)
            _written.remove(entry)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session may be gone already
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        _delete(spark, path)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of df."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().__str__())


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """df with a broadcast hint if its estimated size is within the limit, else df as it is (a shuffled join)."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def input_partitions(df: DataFrame) -> int:
    """Partitions for a wide step: the session's shuffle width, at least two tasks a core."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df on at least two partitions a core, for steps that cost far more than a shuffle of their rows.

    A scan that already has as many partitions (by files and bytes) stays as it is; a smaller one is repartitioned by a
    unique key, so that a few small files don't leave cores idle.
    """
    spark = df.sparkSession
    want = 2 * spark.sparkContext.defaultParallelism
    per = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = plan_bytes(df)
    known = size < UNKNOWN_BYTES
    if known and max(len(df.inputFiles()), size // max(per, 1)) >= want:
        return df
    return df.repartition(want, F.col(key))
