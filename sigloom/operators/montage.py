"""Channels: bad and white-matter lists, bipolar pairs, area and region lookup, codes and coordinate repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.functions.dims import BAD_LABELS, WHITE_LABELS
from sigloom.session import broadcast_if_small


def shaft(name: Column) -> Column:
    """A channel name without its digits (FLT17)."""
    return F.regexp_replace(name, "[0-9]", "")


def channel_flags(electrodes: DataFrame, entity: str, electrode: str, label: str, bad_names: DataFrame | None = None) -> DataFrame:
    """(entity, electrode, flag): 'bad' by name or label, else 'white' by label (JN5)."""
    is_bad = F.col(label).isin(*BAD_LABELS)
    x = electrodes.select(entity, electrode, F.when(is_bad, 0).when(F.col(label).isin(*WHITE_LABELS), 1).alias("_f")).where("_f is not null")
    if bad_names is not None:
        x = x.unionByName(bad_names.select(entity, electrode, F.lit(0).alias("_f")))
    return x.groupBy(entity, electrode).agg(F.when(F.min("_f") == 0, "bad").otherwise("white").alias("flag"))


def bipolar_pairs(channels: DataFrame, entity: str, idx: str, name: str, xyz: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Pairs of each channel with the next one in order, where both names are equal but for digits (JN6, WN1).

    (entity, anode_idx, cathode_idx, anode, cathode, pair, x, y, z): the pair's place is the midpoint.
    """
    w = Window.partitionBy(entity).orderBy(idx)
    nxt = {c: F.lead(c).over(w) for c in (idx, name, *xyz)}
    x = channels.select(entity, F.col(idx).alias("anode_idx"), nxt[idx].alias("cathode_idx"), F.col(name).alias("anode"), nxt[name].alias("cathode"), *[((F.col(c) + nxt[c]) / 2).alias(o) for c, o in zip(xyz, "xyz")])
    return x.where(F.col("cathode").isNotNull() & (shaft(F.col("anode")) == shaft(F.col("cathode")))).withColumn("pair", F.concat_ws("_", "anode", "cathode"))


def bipolar_signal(signal: DataFrame, pairs: DataFrame, entity: str, ch: str, value: str, keys: list[str]) -> DataFrame:
    """Anode less cathode at every sample (JN6): (entity, pair, keys..., value).

    Pairs are few and their size is checked; each sample row goes to at most two pairs, and one aggregation subtracts,
    so the signal is shuffled once and never joined with itself.
    """
    ends = pairs.select(entity, "pair", F.explode(F.array(F.struct(F.col("anode_idx").alias("ch"), F.lit(1.0).alias("sign")), F.struct(F.col("cathode_idx").alias("ch"), F.lit(-1.0).alias("sign")))).alias("e"))
    ends = ends.select(entity, "pair", F.col("e.ch").alias(ch), F.col("e.sign").alias("_sign"))
    x = signal.join(broadcast_if_small(ends), [entity, ch])
    g = x.groupBy(entity, "pair", *keys).agg(F.sum(F.col("_sign") * F.col(value)).alias(value), F.count("*").alias("_n"))
    return g.where("_n = 2").drop("_n")


def pair_drop_list(pairs: DataFrame, flags: DataFrame, entity: str, electrode: str) -> DataFrame:
    """Pairs with a flagged end, and the reason: both flags lead to the same list (JN6, FLT4)."""
    ends = pairs.select(entity, "pair", F.explode(F.array("anode", "cathode")).alias(electrode))
    return ends.join(broadcast_if_small(flags), [entity, electrode]).groupBy(entity, "pair").agg(F.min("flag").alias("reason"))


def first_contact(pair: Column) -> Column:
    return F.split(pair, "_")[0]


def area_lookup(pairs: DataFrame, electrodes: DataFrame, entity: str, electrode: str, label: str) -> DataFrame:
    """pairs with area1 of the first contact, area2 (the same, as the readers of this data expect) and area_second of the second contact (JN7)."""
    e = electrodes.groupBy(entity, electrode).agg(F.min(label).alias("_l"))
    one = e.select(entity, F.col(electrode).alias("anode"), F.col("_l").alias("area1"))
    two = e.select(entity, F.col(electrode).alias("cathode"), F.col("_l").alias("area_second"))
    return pairs.join(one, [entity, "anode"], "left").join(two, [entity, "cathode"], "left").withColumn("area2", F.col("area1"))


def region_first_match(df: DataFrame, area: str, dim: DataFrame) -> DataFrame:
    """df with the region of highest priority that lists its area, null if none does (JN8)."""
    best = dim.groupBy(F.col("area").alias("_a")).agg(F.min_by("region", "priority").alias("region"))
    return df.join(broadcast_if_small(best), F.col(area) == F.col("_a"), "left").drop("_a")


def label_codes(df: DataFrame, label: str, first: int = 0) -> DataFrame:
    """df with the code of its label in lexical order (JN9): ranks are made on the distinct labels, not on the rows."""
    codes = df.select(F.col(label).alias("_l")).where("_l is not null").distinct()
    codes = codes.withColumn("code", (F.dense_rank().over(Window.orderBy("_l")) - 1 + first).cast("int"))
    return df.join(broadcast_if_small(codes), F.col(label) == F.col("_l"), "left").drop("_l")


def with_group_count(df: DataFrame, *keys: str) -> DataFrame:
    """df with the number of rows of its group (JN10): counted with map-side combine, then joined."""
    n = df.groupBy(*keys).agg(F.count("*").alias("group_count"))
    return df.join(broadcast_if_small(n), list(keys))


def repair_rows(df: DataFrame, xyz: tuple[str, str, str], limit: float = 100.0, factor: float = 1000.0) -> DataFrame:
    """All three coordinates divided by `factor` on rows whose first exceeds `limit` (FLT12)."""
    far = F.abs(F.col(xyz[0])) > limit
    return df.withColumns({c: F.when(far, F.col(c) / factor).otherwise(F.col(c)) for c in xyz})


def repair_files(df: DataFrame, entity: str, idx: str, xyz: tuple[str, str, str], limit: float = 1000.0, factor: float = 1000.0) -> DataFrame:
    """The same for whole entities whose first row (by idx) exceeds `limit` (FLT12): the first row by aggregation, joined back."""
    first = df.groupBy(entity).agg((F.abs(F.min_by(xyz[0], idx)) > limit).alias("_far"))
    return df.join(broadcast_if_small(first), entity).withColumns({c: F.when(F.col("_far"), F.col(c) / factor).otherwise(F.col(c)) for c in xyz}).drop("_far")
