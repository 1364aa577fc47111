import random

from sigloom.operators.intervals import coverage, coverage_gaps, merge_intervals, periods_and_gaps
from pyspark.sql import functions as F


def brute(rows):
    by, out = {}, set()
    for k, s, e in rows:
        if k is not None and s is not None and e is not None and e > s:
            by.setdefault(k, []).append((s, e))
    for k, l in by.items():
        l.sort()
        cur = list(l[0])
        for s, e in l[1:]:
            if s <= cur[1]:
                cur[1] = max(cur[1], e)
            else:
                out.add((k, *cur))
                cur = [s, e]
        out.add((k, *cur))
    return out


def test_merge_matches_brute_force_at_any_shard(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(600):
        s = rng.randrange(-300, 900)
        rows.append((rng.choice([1, 1, 1, 2, 3]), s, s + rng.choice([1, 2, 5, 10, 37, 250, -3, 0])))
    rows += rows[:50] + [(None, 1, 2), (4, None, 3), (5, 10, None), (6, 0, 100), (6, 100, 200), (6, 200, 201), (7, -5, 5000)]
    df = spark.createDataFrame(rows, "k int, s bigint, e bigint")
    want = brute(rows)
    for shard in (10, 64, 100_000):
        got = {(r.ent, r.s, r.e) for r in merge_intervals(df, "k", F.col("s"), F.col("e"), shard).collect()}
        assert got == want, shard


def test_gaps_cross_shards(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 8, 9), (1, 95, 99), (2, 50, 51)], "k int, s bigint, e bigint")
    assert {(r.ent, r.s, r.e) for r in coverage_gaps(df, "k", F.col("s"), F.col("e"), 10).collect()} == {(1, 5, 8), (1, 9, 95)}


def test_carry_over_many_blocks(spark):
    """An interval over all shards swallows what lies in them; ends and gaps are found over empty shards and blocks."""
    rng = random.Random(5)
    rows = [(1, -10_000, 10_000)] + [(1, s, s + 3) for s in range(-9_000, 9_000, 70)] + [(1, 12_345, 12_350), (1, 90_000, 90_007), (1, 90_007, 90_008)]
    rows += [(2, s, s + rng.choice([1, 30, 400])) for s in (rng.randrange(0, 100_000) for _ in range(400))]
    df = spark.createDataFrame(rows, "k int, s bigint, e bigint")
    want = brute(rows)
    for block in (1, 3, 1024):
        got = coverage(df, "k", F.col("s"), F.col("e"), 10, block).collect()
        assert {(r.ent, r.s, r.e) for r in got} == want and len(got) == len(want)
        prev = {}
        for k, s, e in sorted(want):
            prev[k, s] = max((b for j, _, b in want if j == k and b < s), default=None)
        assert {(r.ent, r.s): r.prev for r in got} == prev


def test_seconds_nulls_clashes_and_empty(spark):
    nan = float("nan")
    rows = [(1, 0.0, 1.0, "x"), (1, 1.0000000004, 0.5, None), (1, 2.0, None, "x"), (1, None, 2.0, "x"), (1, 3.0, -1.0, "x"), (1, 4.0, 0.0, "x"), (1, nan, 1.0, "x"), (1, 9.0, 0.0001, "x"), (1, 5.0, 1.0, "x"), (1, 5.0, 1.0, "x")]
    df = spark.createDataFrame(rows, "rec_id bigint, onset double, duration double, ent string")
    got = {tuple(r) for r in periods_and_gaps(df, "rec_id", "onset", "duration").collect()}
    assert got == {(1, "period", 0, 1500), (1, "gap", 1500, 5000), (1, "period", 5000, 6000)}
    assert periods_and_gaps(df.limit(0), "rec_id", "onset", "duration").count() == 0
