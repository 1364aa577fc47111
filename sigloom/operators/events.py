"""Events: stimulus recoding, bounded as-of response matching, outcome codes, annotation filters and crop bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigloom.functions.dims import KEY_NEW, KEY_NULL, KEY_OLD
from sigloom.session import broadcast_if_small


def annotation_filter(df: DataFrame, text: str, *parts: str) -> DataFrame:
    """Rows whose text contains any of the parts (FLT1)."""
    cond = F.lit(False)
    for p in parts:
        cond = cond | F.col(text).contains(p)
    return df.where(cond)


def crop_bounds(df: DataFrame, entity: str, onset: str, before: float = 2.0, after: float = 50.0) -> DataFrame:
    """(entity, t_from, t_to): from the first onset less `before` (or the onset itself, if that would be negative) to the last plus `after` (FLT2)."""
    lo = F.min(onset)
    return df.groupBy(entity).agg(F.when(lo - before < 0, lo).otherwise(lo - before).alias("t_from"), (F.max(onset) + after).alias("t_to"))


def recode(df: DataFrame, label: str, mapping: dict[str, int]) -> DataFrame:
    """Stimulus or key rows with their code; labels outside the mapping are dropped (JN2, FLT5)."""
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.where(F.col(label).isin(*mapping)).withColumn("code", F.element_at(pairs, F.col(label)))


def first_response(stimuli: DataFrame, keys: DataFrame, entity: str, t: str, low: float, high: float, tie: str) -> DataFrame:
    """Every stimulus with the first key strictly between `low` and `high` after it, as key_t and key_code (null: none) (JN1).

    A bounded as-of join without a range join: time is cut into bins of `high`, so a key can only lie in its stimulus'
    bin or the next, and an equi-join on (entity, bin) finds it. Ties in time go to the smallest `tie`.
    """
    b = F.floor(F.col(t) / high).cast("bigint")
    s = stimuli.withColumn("_bin", F.explode(F.array(b, b + 1)))
    k = keys.select(F.col(entity).alias("_ent"), F.col(t).alias("_kt"), F.col("code").alias("_kc"), F.col(tie).alias("_ko"), b.alias("_kb"))
    inside = (F.col("_kt") - F.col(t) > low) & (F.col("_kt") - F.col(t) < high)
    hit = s.join(k, (F.col(entity) == F.col("_ent")) & (F.col("_bin") == F.col("_kb")) & inside, "left")
    cols = stimuli.columns
    best = F.min(F.when(F.col("_kt").isNotNull(), F.struct("_kt", "_ko", "_kc")))
    return hit.groupBy(*cols).agg(best.alias("_m")).select(*cols, F.col("_m._kt").alias("key_t"), F.col("_m._kc").alias("key_code"))


def outcome(code: Column, key: Column) -> Column:
    """Condition code from a stimulus code (1 old, 2 new) and its key: wrong key +100, null key +200, else correct (JN3).

    No answer stays correct.
    """
    wrong = ((key == KEY_OLD) & (code == 2)) | ((key == KEY_NEW) & (code == 1))
    return F.when(wrong, code + 100).when(key == KEY_NULL, code + 200).otherwise(code)


def condition_dictionary(items: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(code, condition_name) of every item with every outcome (JN4); both sides are fixed dimensions."""
    return items.crossJoin(broadcast_if_small(outcomes)).select((F.col("item") + 100 * F.col("outcome")).alias("code"), F.concat_ws("/", "item_name", "outcome_name").alias("condition_name"))


def inclusion(trials: DataFrame, entity: str, code: str, least: int = 24, share: float = 0.5) -> DataFrame:
    """(entity, n, n_old, n_new) of entities with enough trials and at least `share` of each item's half correct (AG5)."""
    n = F.count("*")
    old, new = F.count_if(F.col(code) == 1), F.count_if(F.col(code) == 2)
    g = trials.groupBy(entity).agg(n.alias("n"), old.alias("n_old"), new.alias("n_new"))
    return g.where((F.col("n") >= least) & (2 * F.col("n_old") / F.col("n") >= share) & (2 * F.col("n_new") / F.col("n") >= share))


def deny(df: DataFrame, key: str, denied: DataFrame) -> DataFrame:
    """Rows whose key is not on a deny list; entries that are absent from df don't matter (SRC3, ST2)."""
    return df.join(broadcast_if_small(denied.select(F.col(key))), key, "left_anti")
