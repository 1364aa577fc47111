"""Samples that follow target category shares exactly, with minimum counts and a report of unmet targets.

Acceptance probabilities come from target-to-available ratios; rows are accepted independently by a seeded hash with
slight oversampling; then counts are corrected exactly by cutting each category at the right hash value. The cut is
found from per-bucket counts, so no category, however large, is ever ranked in one task. Deficits are what the drawn
sample lacks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.session import broadcast_if_small, materialise

#: Buckets of the accepted hash range in which a category's exact cut is located.
BUCKETS = 4096


def latest_delivery(df: DataFrame, key: str, at: str, *cols: str) -> DataFrame:
    """One row a key with cols of its delivery with the latest `at`; ties take the largest values, nulls come first."""
    return df.groupBy(key).agg(F.max(F.struct(at, *cols)).alias("_d")).select(key, *[F.col(f"_d.{c}").alias(c) for c in cols])


def name_key(text: Column) -> Column:
    """A condition name without case, blanks and kind of separator."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\s*[/_\-|:]\s*|\s+", "/"), r"/+", "/")


def number_key(text: Column) -> Column:
    """A code written as a number ('1', ' 01', '1.0'), as BIGINT; null for anything else."""
    t = F.regexp_replace(text, r"[\s ]+", "")
    digits = F.regexp_extract(t, r"^\+?0*([0-9]{1,15})([.,]0*)?$", 1)
    return F.when(digits != "", digits.cast("bigint"))


def read_codes(df: DataFrame, text: str, reference: DataFrame, code: str, name: str) -> DataFrame:
    """Adds code_read, the reference code that a spelling means (as a number or a name), null where it means none.

    Distinct spellings are read once and joined back; their number is that of ways to write, not of rows.
    """
    ref = reference.select(F.col(code).cast("bigint").alias("_c"), name_key(F.col(name)).alias("_n"))
    ways = df.select(F.col(text).alias("_t")).where(F.col("_t").isNotNull()).distinct().select("_t", number_key(F.col("_t")).alias("_num"), name_key(F.col("_t")).alias("_key"))
    by_number = ways.join(broadcast_if_small(ref), F.col("_num") == F.col("_c"), "left").select("_t", "_key", F.col("_c").alias("_by_number"))
    both = by_number.join(broadcast_if_small(ref), F.col("_key") == F.col("_n"), "left").groupBy("_t").agg(F.min(F.coalesce("_by_number", "_c")).alias("code_read"))
    return df.join(broadcast_if_small(both), df[text] == F.col("_t"), "left").drop("_t")


def plan_needs(plan: DataFrame, reference: DataFrame, code: str = "code", name: str = "condition_name") -> DataFrame:
    """The plan with code_read and need, the larger of min_keep and target_share x sample_size (rounded; null counts as 0)."""
    share = F.round(F.coalesce(F.col("target_share"), F.lit(0.0)) * F.coalesce(F.col("sample_size"), F.lit(0))).cast("bigint")
    return read_codes(plan.select("cohort", "event_id", "target_share", "min_keep", "sample_size"), "event_id", reference, code, name).withColumn(
        "need", F.greatest(F.coalesce(F.col("min_keep"), F.lit(0)).cast("bigint"), share)
    )


def readable_trials(info: DataFrame, reference: DataFrame, code: str = "code", name: str = "condition_name") -> DataFrame:
    """(cohort, rec_id, trial, code_read) of every trial whose element means a code, in each recording's latest delivery."""
    last = latest_delivery(info.where("rec_id is not null"), "rec_id", "loaded_at", "cohort", "event_id")
    each = last.select("cohort", "rec_id", F.posexplode("event_id").alias("trial", "element"))
    return read_codes(each, "element", reference, code, name).where("code_read is not null").select("cohort", "rec_id", "trial", "code_read")


def available(trials: DataFrame) -> DataFrame:
    """(cohort, code_read, n_available)."""
    return trials.groupBy("cohort", "code_read").agg(F.count("*").alias("n_available"))


def goals(trials: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan rows with need, n_available and p, the probability at which each of their trials is accepted.

    p is the target-to-available ratio with oversampling by four standard deviations, at most 1. A null cohort matches
    only a null cohort; a plan row whose code can't be read has no trials.
    """
    a = available(trials)
    return (
        plan.join(a, plan["cohort"].eqNullSafe(a["cohort"]) & (plan["code_read"] == a["code_read"]), "left")
        .select(plan["*"], F.coalesce("n_available", F.lit(0)).cast("bigint").alias("n_available"))
        .withColumn("p", F.least(F.lit(1.0), (F.col("need") + 4 * F.sqrt(F.col("need")) + 8) / F.col("n_available")))
    )


def position(seed: int) -> Column:
    """A number in [0, 1) for each (rec_id, trial), the same in any engine: the first 52 bits of an md5."""
    text = F.concat_ws("-", F.lit(str(seed)), F.col("rec_id").cast("string"), F.col("trial").cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def draw(trials: DataFrame, plan: DataFrame, seed: int = 0, buckets: int = BUCKETS) -> DataFrame:
    """The sample, as (cohort, event_id, code_read, rec_id, trial): `need` trials of every plan row, or all if there are fewer.

    trials and plan come from readable_trials() and plan_needs(). Trials without a plan row are not drawn; an empty
    input gives an empty sample; the draw depends only on seed, rec_id and trial, not on partitioning. Of a plan row's
    trials those with the smallest positions are drawn.
    """
    goal = goals(trials, plan).where("need > 0 and n_available > 0").select(F.col("cohort").alias("_co"), "event_id", F.col("code_read").alias("_cr"), "need", "p")
    x = trials.join(broadcast_if_small(goal), F.col("cohort").eqNullSafe(F.col("_co")) & (F.col("code_read") == F.col("_cr"))).withColumn("u", position(seed))
    # accepted trials are in the first buckets; the others stay behind them, for a plan row that comes out short
    x = x.withColumn("b", F.when(F.col("u") < F.col("p"), F.floor(F.col("u") / F.col("p") * buckets)).otherwise(buckets + F.floor((F.col("u") - F.col("p")) * buckets)).cast("int"))
    x = materialise(x)
    counts = x.groupBy("_co", "_cr", "event_id", "need", "b").agg(F.count("*").alias("c"))
    run = F.sum("c").over(Window.partitionBy("_co", "_cr", "event_id").orderBy("b"))
    # the exact correction: up to which bucket all are kept, and how many of the bucket at the cut (null: keep all)
    cut = (
        counts.withColumn("upto", run)
        .where(F.col("upto") >= F.col("need"))
        .groupBy("_co", "_cr", "event_id")
        .agg(F.min("b").alias("cut"), F.min_by(F.col("need") - F.col("upto") + F.col("c"), "b").alias("from_cut"))
        .select(F.col("_co").alias("_co2"), F.col("_cr").alias("_cr2"), F.col("event_id").alias("_ev2"), "cut", "from_cut")
    )
    y = x.join(broadcast_if_small(cut), F.col("_co").eqNullSafe(F.col("_co2")) & (F.col("_cr") == F.col("_cr2")) & F.col("event_id").eqNullSafe(F.col("_ev2")), "left")
    below = y.where(F.col("cut").isNull() | (F.col("b") < F.col("cut")))
    at = y.where(F.col("b") == F.col("cut")).withColumn("r", F.row_number().over(Window.partitionBy("_co", "_cr", "event_id").orderBy("u", "rec_id", "trial")))
    out = ["cohort", "event_id", "code_read", "rec_id", "trial"]
    return below.select(*out).unionByName(at.where(F.col("r") <= F.col("from_cut")).select(*out))


def plan_report(trials: DataFrame, plan: DataFrame, sample: DataFrame) -> DataFrame:
    """The plan rows with need, n_available, taken (the drawn trials, counted in the sample of draw()) and deficit."""
    n = sample.groupBy(F.col("cohort").alias("_co"), F.col("event_id").alias("_ev")).agg(F.count("*").alias("taken"))
    x = goals(trials, plan)
    return (
        x.join(n, F.col("cohort").eqNullSafe(F.col("_co")) & F.col("event_id").eqNullSafe(F.col("_ev")), "left")
        .drop("_co", "_ev", "p")
        .withColumn("taken", F.coalesce("taken", F.lit(0)).cast("bigint"))
        .withColumn("deficit", F.col("need") - F.col("taken"))
    )
