"""Conversion of positions recorded in unknown units, by a hidden Markov model per entity.

The unit is the hidden state. What a row shows is the logarithm of its distance, and a change of unit is a jump of it:
a step from one unit to another scores by how far the two true distances then lie apart, so the chain follows the
entity's level from row to row. A slower level, by entity and time, draws each row softly; the range of true distances
and the statements add what they say. Viterbi decoding is exact and distributed: rows are range-sorted, cut into chunks
of bounded length, each chunk is reduced to a max-plus transfer matrix, the few matrices of an entity are chained, and
each chunk is traced back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.session import broadcast_if_small, input_partitions, materialise

#: Millimetres in one unit. Fixed values.
UNITS = {"mm": 1.0, "m": 1000.0, "cm": 10.0, "um": 0.001, "in": 25.4}
STATES = list(UNITS)
#: Rows of one range part of the decoder, which one task holds.
PART_ROWS = 200_000

#: A bare unit, as typed into a unit field: lower case, without brackets, blanks and final dots.
BARE_UNIT = {
    "mm": r"mm|millim[eè]t(er|re)s?|millimetern?|mil[ií]metros?|millimetri",
    "cm": r"cm|centim[eè]t(er|re)s?|zentimetern?|cent[ií]metros?|centimetri",
    "um": r"[uµμ]m|microns?|microm[eè]t(er|re)s?|mikrometern?|micr[oó]metros?|1e-6 ?m|0[.,]001 ?mm",
    "in": r"in|inch|inches|zoll|pouces?|pulgadas?|pollici|\"|''|″|”",
    "m": r"m|met(er|re)s?|m[eè]tres?|metern?|metros?|metri|si ?\(?m\)?",
}
#: Words that name a unit inside a remark, tried in this order; a number before the word makes it a measurement.
REMARK_UNIT = {
    "mm": r"\b(mm|millim[eè]t(er|re)s?|millimetern?|mil[ií]metros?|millimetri)\b",
    "um": r"\b([uµμ]m|microns?|microm[eè]t(er|re)s?|mikrometern?|micr[oó]metros?)\b",
    "cm": r"\b(cm|centim[eè]t(er|re)s?|zentimetern?|cent[ií]metros?|centimetri)\b",
    "in": r"\b(inch|inches|zoll|pouces?|pulgadas?|pollici)\b|(unit|einheit|unité)\s*[:=]?\s*in\b|[\"″]",
    "m": r"\b(m|met(er|re)s?|m[eè]tres?|metern?|metros?|metri)\b",
}
#: "scale 1 = 1 mm", "1 = one meter", "counts of 0.001 mm": numbers that state a scale all the same.
SCALE = r"(\b1\s*=\s*(1|one)\s+\S+|counts of\s+(0[.,]001|1)\s+\S+)"


def stated_unit(text: Column) -> Column:
    """Unit that a bare unit field names, else null."""
    t = F.trim(F.regexp_replace(F.lower(text), r"^[\s\[(]+|[\s\]).]+$", ""))
    out = F.lit(None).cast("string")
    for u, p in BARE_UNIT.items():
        out = F.when(t.rlike(f"^({p})$"), F.lit(u)).otherwise(out)
    return out


def remarked_unit(text: Column) -> Column:
    """Unit that some part of a remark (parts end at ; or |) states for the positions, else null.

    A part that only measures something (a number before the unit word) states nothing, unless it states a scale.
    """

    def part_unit(part: Column) -> Column:
        p = F.lower(part)
        scale = p.rlike(SCALE)
        measure = p.rlike(r"[0-9](\s*/\s*[0-9]+)?\s*([a-zµμ]+\b|[\"″])") & ~scale
        inner = F.lit(None).cast("string")
        for u in reversed(list(REMARK_UNIT)):
            inner = F.when(p.rlike(REMARK_UNIT[u]), F.lit(u)).otherwise(inner)
        inner = F.when(p.rlike(r"0[.,]001\s+mm"), F.lit("um")).otherwise(inner)
        return F.when(~measure, inner)

    parts = F.transform(F.split(text, r"[;|]"), part_unit)
    return F.get(F.filter(parts, lambda u: u.isNotNull()), 0)


@dataclass(frozen=True)
class Model:
    """What the hidden Markov model holds likely. Distances are natural logarithms, scores are log probabilities."""

    low_mm: float = 20.0
    high_mm: float = 100.0
    #: probability that the next row is in the same unit
    stay: float = 0.93
    #: spread of the true distance from row to row, and about the entity's level
    jump_sd: float = 0.6
    level_sd: float = 0.6
    #: spread of a jump's or a level's error counts up to so many deviations
    robust: float = 5.0
    #: how sharply a distance outside the range is ruled out, and the most that it can cost
    range_sd: float = 0.01
    range_cost: float = 200.0
    #: what a statement adds to its unit; for units that are never used unstated, what one adds and what lacking one costs
    said: float = 4.0
    must_say: tuple[str, ...] = ("in",)
    must_said: float = 24.0
    must_unsaid: float = 60.0


LOG_UNITS = np.log(np.array(list(UNITS.values())))


def _log_emission(pdf: pd.DataFrame, m: Model) -> np.ndarray:
    """Rows x states log scores: range of the true distance, nearness to the entity's level, statements."""
    d = pdf["ln_dist"].to_numpy(float)[:, None] + LOG_UNITS[None]
    beyond = np.maximum(np.maximum(np.log(m.low_mm) - d, d - np.log(m.high_mm)) - 1e-3, 0.0)  # coordinates are rounded
    out = -np.minimum(0.5 * (beyond / m.range_sd) ** 2, m.range_cost)
    out -= 0.5 * np.minimum(np.abs(d - pdf["level"].to_numpy(float)[:, None]) / m.level_sd, m.robust) ** 2
    stated, remarked = pdf["stated"].to_numpy(object), pdf["remarked"].to_numpy(object)
    for k, u in enumerate(STATES):
        said = (stated == u) | (remarked == u)
        out[:, k] += np.where(said, m.must_said, -m.must_unsaid) if u in m.must_say else np.where(said, m.said, 0.0)
    return out


def _steps(ln: np.ndarray, before: float, m: Model) -> np.ndarray:
    """Rows x states x states log scores of the step to each row: change of unit, and the jump of the true distance.

    before is the log distance of the row before the first (NaN: there is none, and no jump).
    """
    n = len(STATES)
    change = np.full((n, n), np.log((1 - m.stay) / (n - 1)))
    np.fill_diagonal(change, np.log(m.stay))
    dy = np.diff(ln, prepend=before)
    jump = dy[:, None, None] + (LOG_UNITS[None, :] - LOG_UNITS[:, None])[None]
    return change[None] - 0.5 * np.nan_to_num(np.minimum(np.abs(jump) / m.jump_sd, m.robust), nan=0.0) ** 2


def _max_plus_scan(em: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Transfer matrix of a chunk: [i, j] is the best score of entering after state i and ending in state j."""
    m = steps[0] + em[0][None, :]
    for e, t in zip(em[1:], steps[1:]):
        m = (m[:, :, None] + t[None, :, :]).max(1) + e[None, :]
    return m


def _trace(em: np.ndarray, steps: np.ndarray, start: np.ndarray, end_state: int) -> np.ndarray:
    """Viterbi path of a chunk from the scores before it to a given last state."""
    n = len(em)
    back = np.zeros((n, len(STATES)), dtype=np.int8)
    v = start
    for i in range(n):
        s = v[:, None] + steps[i]
        back[i] = s.argmax(0)
        v = s.max(0) + em[i]
    path = np.empty(n, dtype=np.int8)
    path[-1] = end_state
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def _levels(base: DataFrame, m: Model) -> DataFrame:
    """(ent, at, level): the running level of each entity by bucket of time, over the bucket and those beside it.

    It is the mean true log distance of the rows that fit one unit only, drawn towards the entity's mean and that
    towards the middle of the range. Sums by bucket are aggregated first; only they are ordered.
    """
    low, high, mid = float(np.log(m.low_mm)), float(np.log(m.high_mm)), float(np.log((m.low_mm * m.high_mm) ** 0.5))
    fits = [(F.col("ln_dist") + float(f) >= low) & (F.col("ln_dist") + float(f) <= high) for f in LOG_UNITS]
    sure = F.when(sum(f.cast("int") for f in fits) == 1, F.coalesce(*[F.when(f, F.col("ln_dist") + float(k)) for f, k in zip(fits, LOG_UNITS)]))
    by = base.groupBy("ent", "at").agg(F.coalesce(F.sum(sure), F.lit(0.0)).alias("s"), F.count(sure).alias("n"))
    whole = Window.partitionBy("ent")
    beside = whole.orderBy("at").rangeBetween(-1, 1)
    own = (F.sum("s").over(whole) + 10 * mid) / (F.sum("n").over(whole) + 10)
    return by.select("ent", "at", ((F.sum("s").over(beside) + 10 * own) / (F.sum("n").over(beside) + 10)).alias("level"))


def decode_units(
    df: DataFrame,
    row_id: str,
    entity: str,
    order: str,
    xyz: tuple[str, str, str],
    unit: str,
    remark: str,
    model: Model = Model(),
    chunk: int = 4096,
    bucket_s: int = 86_400,
) -> DataFrame:
    """(row_id, entity, x, y, z, unit_decoded, x_mm, y_mm, z_mm), one row for each distinct positioned row.

    A row with a null or NaN coordinate, or with all three zero, is no position and gives no row; repeated rows give
    one. A null entity is an entity of its own. Null or unreadable statements state nothing. Ties in the order column
    are broken by row_id. A row whose distance fits no unit gets what its statements say, or else what its neighbours
    are in. The running level is taken over bucket_s seconds of the order column where that is a time. Other columns of
    df are dropped first. An empty input gives an empty result.
    """
    x, y, z = (F.col(c).cast("double") for c in xyz)
    timed = dict(df.dtypes)[order] in ("timestamp", "timestamp_ntz", "date")
    at = F.floor(F.unix_seconds(F.col(order).cast("timestamp")) / bucket_s).cast("bigint") if timed else F.lit(0).cast("bigint")
    base = df.select(
        F.col(row_id).alias("rid"), F.col(entity).alias("ent"), F.col(order).alias("ord"), F.coalesce(at, F.lit(0).cast("bigint")).alias("at"),
        x.alias("x"), y.alias("y"), z.alias("z"), stated_unit(F.col(unit)).alias("stated"), remarked_unit(F.col(remark)).alias("remarked"),
    ).where("x is not null and y is not null and z is not null and not isnan(x) and not isnan(y) and not isnan(z) and (x <> 0 or y <> 0 or z <> 0)").distinct()
    base = base.withColumn("ln_dist", F.log(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)))
    parts = max(input_partitions(df), -(-df.count() // PART_ROWS))
    rows = materialise(base.repartitionByRange(parts, "ent", "ord", "rid").sortWithinPartitions("ent", "ord", "rid").withColumn("part", F.spark_partition_id()))
    # one row a part: the row before each part's first, for the jump that leads into it
    ends = rows.groupBy("part").agg(F.max(F.struct("ent", "ord", "rid", "ln_dist")).alias("m"))
    w = Window.orderBy("part")
    ends = materialise(ends.select("part", F.lag("m.ent").over(w).alias("ent_before"), F.lag("m.ln_dist").over(w).alias("ln_before")))
    levels = materialise(_levels(rows, model)).withColumnRenamed("ent", "_ent").withColumnRenamed("at", "_at")
    rows_l = rows.join(broadcast_if_small(levels), rows["ent"].eqNullSafe(F.col("_ent")) & (rows["at"] == F.col("_at"))).drop("_ent", "_at", "at")
    rows = rows_l.join(broadcast_if_small(ends), "part")
    n = len(STATES)

    def chunks(part: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame, np.ndarray, np.ndarray]]:
        """Consecutive rows of one entity, at most `chunk` of them, numbered within the part, with their scores."""
        ent = part["ent"].fillna("\0").to_numpy(object)
        ln = part["ln_dist"].to_numpy(float)
        same = len(part) and (part["ent_before"].fillna("\0").iloc[0] == ent[0]) and not np.isnan(part["ln_before"].iloc[0])
        before = float(part["ln_before"].iloc[0]) if same else np.nan
        cuts = np.flatnonzero(ent[1:] != ent[:-1]) + 1
        no = 0
        for a, b in zip([0, *cuts], [*cuts, len(part)]):
            for i in range(a, b, chunk):
                c = part.iloc[i : min(i + chunk, b)]
                first = before if i == 0 else np.nan if i == a else ln[i - 1]
                yield no, c, _log_emission(c, model), _steps(ln[i : i + len(c)], first, model)
                no += 1

    def in_order(part: pd.DataFrame) -> pd.DataFrame:
        return part.sort_values(["ent", "ord", "rid"], na_position="first")

    def transfer(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out = [(c["ent"].iloc[0], int(key[0]), no, _max_plus_scan(em, steps).ravel().tolist()) for no, c, em, steps in chunks(in_order(part))]
        return pd.DataFrame(out, columns=["ent", "part", "no", "m"])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        """Scores before and the state at the end of each chunk, by entity; one call takes many entities."""
        pdf = pdf.sort_values(["ent", "part", "no"], na_position="first")
        ms = np.array(pdf["m"].tolist()).reshape(-1, n, n)
        ent = pdf["ent"].fillna("\0").to_numpy(object)
        cuts = [0, *(np.flatnonzero(ent[1:] != ent[:-1]) + 1), len(ent)]
        starts, lasts = [], []
        for a, b in zip(cuts, cuts[1:]):
            v, backs, ends = np.zeros(n), [], []
            for m in ms[a:b]:
                starts.append(v.tolist())
                s = v[:, None] + m
                backs.append(s.argmax(0))
                v = s.max(0)
                v = v - v.max()
            end = int(v.argmax())
            for back in reversed(backs):
                ends.append(end)
                end = int(back[end])
            lasts += ends[::-1]
        return pd.DataFrame({"part": pdf["part"].to_numpy(), "no": pdf["no"].to_numpy(), "start": starts, "last": lasts})

    matrices = rows.groupBy("part").applyInPandas(transfer, "ent string, part int, no int, m array<double>")
    states = materialise(matrices.groupBy(F.pmod(F.hash("ent"), F.lit(4 * parts))).applyInPandas(chain, "part int, no int, start array<double>, last int"))

    def trace(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = {int(r.no): (np.array(r.start), int(r.last)) for r in right.itertuples()}
        left = in_order(left)
        path = [_trace(em, steps, *known[no]) for no, _, em, steps in chunks(left)]
        left["state"] = np.concatenate(path).astype(int) if path else np.zeros(0, dtype=int)
        return left[["rid", "ent", "x", "y", "z", "state"]]

    got = rows.groupBy("part").cogroup(states.groupBy("part")).applyInPandas(trace, "rid long, ent string, x double, y double, z double, state int")
    factor = F.element_at(F.array(*[F.lit(UNITS[u]) for u in STATES]), F.col("state") + 1)
    name = F.element_at(F.array(*[F.lit(u) for u in STATES]), F.col("state") + 1)
    return got.select(
        F.col("rid").alias(row_id), F.col("ent").alias(entity), "x", "y", "z", name.alias("unit_decoded"),
        (F.col("x") * factor).alias("x_mm"), (F.col("y") * factor).alias("y_mm"), (F.col("z") * factor).alias("z_mm"),
    )
