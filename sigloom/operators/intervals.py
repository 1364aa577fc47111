"""Interval coverage: merge overlapping, nested and touching intervals per entity and list the gaps between periods.

Two levels, so that no entity has to fit one task: every interval is clipped at the end of the time shard it starts in
and merged with the others of its (entity, shard); what reaches over a shard's end is one number a shard. Those numbers
are carried on from shard to shard, again in two levels (within blocks of shards, then over the blocks), and each shard
is stitched to the coverage that reaches into it. An interval of any length is one row throughout, and nothing is
sorted by entity but one row a block of shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.session import materialise

#: Shards of one block of the carry.
BLOCK = 1024


def round_half_away(value: Column) -> Column:
    """Whole number nearest to value, halves away from zero."""
    return F.round(value).cast("bigint")


def _before(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def coverage(df: DataFrame, entity: str, start: Column, end: Column, shard: int = 600_000, block: int = BLOCK) -> DataFrame:
    """(ent, s, e, prev): the periods of the union of all [start, end] intervals, each with the end of the one before.

    start and end are whole numbers of one unit; prev is null for an entity's first period. Rows with a null entity,
    start or end, or with end <= start, are ignored; repeated rows and ties change nothing; an empty input gives an
    empty result; other columns of df are dropped before anything is named, so their names cannot clash.
    """
    x = df.select(F.col(entity).alias("ent"), start.alias("s"), end.alias("e")).where(F.col("ent").isNotNull() & (F.col("e") > F.col("s")))
    # before any sort, one row for each start: an (entity, shard) then holds at most `shard` rows, however hot it is
    x = materialise(x.groupBy("ent", F.floor(F.col("s") / shard).cast("bigint").alias("b"), "s").agg(F.max("e").alias("e")))

    # within the shard: the starts of its islands, with the furthest end before them; ends may reach over the shard's end
    w = Window.partitionBy("ent", "b").orderBy("s")
    local = x.withColumn("own", F.max("e").over(_before(w)))
    # what reaches into a shard: the furthest end of its block's shards before, and of all blocks before
    reach = x.groupBy("ent", "b").agg(F.max("e").alias("reach")).withColumn("k", F.floor(F.col("b") / block))
    blocks = reach.groupBy("ent", "k").agg(F.max("reach").alias("far"))
    blocks = blocks.select("ent", "k", F.max("far").over(_before(Window.partitionBy("ent").orderBy("k"))).alias("before"), F.max("far").over(Window.partitionBy("ent")).alias("last"))
    carry = reach.withColumn("near", F.max("reach").over(_before(Window.partitionBy("ent", "k").orderBy("b")))).join(blocks, ["ent", "k"])
    carry = carry.select("ent", "b", "k", F.greatest("near", "before").alias("carry"), "last")

    # stitched: a start is a period's only if nothing before it, in its shard or from others, reaches it
    at = local.join(carry, ["ent", "b"]).withColumn("prev", F.greatest("own", "carry"))
    starts = at.where(F.col("prev").isNull() | (F.col("s") > F.col("prev"))).select("ent", "b", "k", "s", "prev", "last", F.lead("prev").over(w).alias("next"))
    # a period ends where the one after it says: in its shard, in its block, in a later block, or it is the last
    first = starts.groupBy("ent", "k", "b").agg(F.min_by("prev", "s").alias("p"))
    later = first.groupBy("ent", "k").agg(F.min_by("p", "b").alias("p"))
    later = later.select("ent", "k", F.lead("p").over(Window.partitionBy("ent").orderBy("k")).alias("later"))
    soon = first.select("ent", "k", "b", F.lead("p").over(Window.partitionBy("ent", "k").orderBy("b")).alias("soon"))
    after = soon.join(later, ["ent", "k"]).select("ent", "b", F.coalesce("soon", "later").alias("after"))
    return starts.join(after, ["ent", "b"]).select("ent", "s", F.coalesce("next", "after", "last").alias("e"), "prev")


def merge_intervals(df: DataFrame, entity: str, start: Column, end: Column, shard: int = 600_000) -> DataFrame:
    """Periods (ent, s, e) of the union of all [start, end] intervals, as coverage() defines them."""
    return coverage(df, entity, start, end, shard).select("ent", "s", "e")


def coverage_gaps(df: DataFrame, entity: str, start: Column, end: Column, shard: int = 600_000) -> DataFrame:
    """Gaps (ent, s, e) between consecutive periods of coverage()."""
    return coverage(df, entity, start, end, shard).where("prev is not null").select("ent", F.col("prev").alias("s"), F.col("s").alias("e"))


def periods_and_gaps(df: DataFrame, entity: str, onset: str, duration: str, shard: int = 600_000) -> DataFrame:
    """(rec_id, kind, start_ms, end_ms) of the periods and gaps, from onset and duration in seconds.

    Each is rounded to whole milliseconds by itself. Rows with a null or NaN in either, or a duration not above 0, are
    ignored, as are those whose duration rounds to no length.
    """
    ok = (F.col(duration) > 0) & ~F.isnan(duration) & ~F.isnan(onset)
    x = df.where(ok).select(F.col(entity).alias("k"), round_half_away(F.col(onset) * 1000).alias("a"), round_half_away(F.col(duration) * 1000).alias("d"))
    period = F.struct(F.lit("period").alias("kind"), F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))
    gap = F.struct(F.lit("gap").alias("kind"), F.col("prev").alias("start_ms"), F.col("s").alias("end_ms"))
    both = coverage(x, "k", F.col("a"), F.col("a") + F.col("d"), shard).select("ent", F.explode(F.when(F.col("prev").isNull(), F.array(period)).otherwise(F.array(gap, period))).alias("q"))
    return both.select(F.col("ent").cast("bigint").alias("rec_id"), "q.kind", "q.start_ms", "q.end_ms")
