import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from sigloom.operators import units as U


def test_statements(spark):
    rows = [("mm.", None), ("[cm]", None), ("Zoll", None), ('"', None), ("SI (m)", None), ("1e-6 m", None), ("µm", None), (None, "bolt 1/4 inch"), (None, "measured in inches; slice thickness 1 mm"), (None, 'old frame, values in "'), (None, "scale 1 = 1 mm"), (None, "counts of 0.001 mm"), (None, "unit: in."), (None, "seen in theatre"), ("", "")]
    df = spark.createDataFrame(rows, "u string, r string").select(U.stated_unit(F.col("u")).alias("a"), U.remarked_unit(F.col("r")).alias("b"))
    got = [tuple(x) for x in df.collect()]
    assert [a for a, _ in got[:7]] == ["mm", "cm", "in", "in", "m", "um", "um"]
    assert [b for _, b in got[7:13]] == [None, "in", "in", "mm", "um", "in"]
    assert got[13] == (None, None) and got[14] == (None, None)


def test_chunked_viterbi_equals_exhaustive():
    rng = np.random.default_rng(0)
    t = U._steps(rng.normal(3, 2, size=6), np.nan, U.Model(stay=0.9))
    em = rng.normal(size=(6, len(U.STATES)))
    best = max(itertools.product(range(len(U.STATES)), repeat=6), key=lambda p: max(t[0, s, p[0]] for s in range(5)) + em[0, p[0]] + sum(t[i + 1, a, b] + em[i + 1, b] for i, (a, b) in enumerate(zip(p, p[1:]))))
    m1, m2 = U._max_plus_scan(em[:4], t[:4]), U._max_plus_scan(em[4:], t[4:])
    v1 = (np.zeros(5)[:, None] + m1).max(0)
    end = int((v1[:, None] + m2).max(0).argmax())
    mid = int((v1 + m2[:, end]).argmax())
    path = [*U._trace(em[:4], t[:4], np.zeros(5), mid), *U._trace(em[4:], t[4:], v1, end)]
    assert tuple(int(x) for x in path) == best


def _decode(df, **kw):
    return U.decode_units(df, "coord_id", "subj", "loaded_at", ("x", "y", "z"), "unit", "remark", **kw)


SCHEMA = "coord_id bigint, subj string, x double, y double, z double, unit string, remark string, loaded_at string, ent string, rid int"


def test_ranges_statements_and_edges(spark):
    rows = []
    for i in range(40):
        rows.append((i, "s1", 30.0 + i / 10, 10.0, 5.0, None, None, f"t{i:03d}", "e", 1))
    extra = [
        (100, "s1", 0.03, 0.01, 0.02, "mm", None, "t100"), (101, "s1", 30000.0, 1.0, 1.0, None, "bolt 1/4 inch", "t101"), (102, "s1", 2.0, 1.5, 1.0, "inch", None, "t102"), (103, "s1", 2.0, 1.5, 1.0, None, None, "t103"),
        (104, "s1", 1.0, 0.5, 0.3, None, "en pouces", "t104"), (105, "s1", 5.0, 5.0, 1.0, "inch", None, "t105"), (106, "s1", None, 1.0, 1.0, None, None, "t106"), (107, "s1", 0.0, 0.0, 0.0, None, None, "t107"), (108, None, 4.0, 4.0, 4.0, None, None, None), (109, "s1", 1e9, 1.0, 1.0, None, None, "t109"),
    ]
    rows += [(*r, "e", 1) for r in extra] + [(*extra[0], "e", 1)]
    got = {r.coord_id: r for r in _decode(spark.createDataFrame(rows, SCHEMA), chunk=7).collect()}
    assert len(got) == 48  # two rows are no positions, one is repeated
    u = {k: r.unit_decoded for k, r in got.items()}
    assert all(u[i] == "mm" for i in range(40))
    assert (u[100], u[101], u[102], u[103], u[104], u[105], u[108]) == ("m", "um", "in", "cm", "in", "cm", "cm")
    assert abs(got[100].x_mm - 30) < 1e-9 and got[109].unit_decoded in U.STATES
    assert _decode(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def test_chunks_do_not_change_the_result(spark):
    rng = random.Random(1)
    rows = []
    for i in range(300):
        u = rng.choice(["mm", "mm", "mm", "cm", "m"])
        v = [rng.uniform(15, 50) / U.UNITS[u] for _ in range(3)]
        rows.append((i, "a" if i % 3 else "b", *v, u if rng.random() < 0.3 else None, None, f"t{rng.randrange(50):03d}", "e", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    one = {tuple(r) for r in _decode(df, chunk=5).select("coord_id", "unit_decoded").collect()}
    assert one == {tuple(r) for r in _decode(df, chunk=10_000).select("coord_id", "unit_decoded").collect()}


def test_jumps_decide_where_ranges_and_statements_do_not(spark):
    """With a range of 5 to 600 mm nearly every value fits two units or more; one row states a unit, one states a wrong one."""
    rng = random.Random(4)
    rows, want = [], {}
    level, unit = 60.0, "mm"
    for i in range(400):
        level = min(max(level * rng.uniform(0.97, 1.03), 40.0), 90.0)  # a smooth underlying level
        if rng.random() < 0.03:
            unit = "cm" if unit == "mm" else "mm"
        v = level * rng.uniform(0.95, 1.05) / U.UNITS[unit]
        want[i] = unit
        rows.append((i, "s1" if i < 200 else "s2", v, 0.0, 0.0, "mm" if i in (0, 200) else "cm" if i == 30 else None, None, f"t{i:03d}", "e", 1))
    df = spark.createDataFrame(rows, SCHEMA)
    m = U.Model(low_mm=5.0, high_mm=600.0, jump_sd=0.2, level_sd=5.0)
    both = [i for i in want if 5 <= rows[i][2] <= 60]
    assert len(both) > 150  # in range as millimetres and as centimetres
    for chunk in (7, 4096):
        got = {r.coord_id: r.unit_decoded for r in _decode(df, model=m, chunk=chunk).collect()}
        assert got == want
    # without the jumps neither the range nor the statements tell
    blind = {r.coord_id: r.unit_decoded for r in _decode(df, model=U.Model(low_mm=5.0, high_mm=600.0, jump_sd=1e6, level_sd=1e6)).collect()}
    assert sum(blind[i] != want[i] for i in want) > 100


def test_level_follows_time(spark):
    """Two days with another level each: the rows that fit one unit only set it, and it parts those that fit two."""
    rows = []
    for day, mm in ((1, 30.0), (5, 95.0)):
        for i in range(60):
            rows.append((day * 1000 + i, "s", mm / 1000 if i % 2 else mm / 10, 0.0, 0.0, None, None, f"2024-01-0{day} 10:{i:02d}:00", "e", 1))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("loaded_at", F.to_timestamp("loaded_at"))
    m = U.Model(must_say=(), jump_sd=1e6, level_sd=0.3)
    got = {r.coord_id: r.unit_decoded for r in _decode(df, model=m).collect()}
    assert all(got[5000 + i] == ("m" if i % 2 else "cm") for i in range(60))
    assert all(got[1000 + i] == ("m" if i % 2 else "cm") for i in range(60))
