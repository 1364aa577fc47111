"""Queries of the general data problems (units, intervals) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.operators.intervals import periods_and_gaps
from sigloom.operators.units import decode_units
from sigloom.session import table


def p2_positions_mm(spark: SparkSession, d: str) -> DataFrame:
    """Every position of coords with its decoded unit, in millimetres."""
    return decode_units(table(spark, d, "coords"), "coord_id", "subj", "loaded_at", ("x", "y", "z"), "unit", "remark")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Positions that are not in millimetres, with their unit."""
    got = p2_positions_mm(spark, d).where(F.col("unit_decoded") != "mm")
    return got.select(F.col("coord_id").cast("bigint").alias("coord_id"), F.col("unit_decoded").alias("unit")).distinct()


def p2_unit_counts(spark: SparkSession, d: str) -> DataFrame:
    """Positions and mean distance in millimetres, by decoded unit."""
    dist = F.sqrt(F.col("x_mm") ** 2 + F.col("y_mm") ** 2 + F.col("z_mm") ** 2)
    return p2_positions_mm(spark, d).groupBy("unit_decoded").agg(F.count("*").alias("n"), F.round(F.avg(dist), 3).alias("mean_mm"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous bad periods of every recording, and the gaps between them."""
    return periods_and_gaps(table(spark, d, "bad_segments"), "rec_id", "onset", "duration")


def p3_coverage(spark: SparkSession, d: str) -> DataFrame:
    """By recording: periods, covered milliseconds and the longest gap."""
    x = p3_found(spark, d).withColumn("len", F.col("end_ms") - F.col("start_ms"))
    period = F.col("kind") == "period"
    return x.groupBy("rec_id").agg(
        F.count(F.when(period, 1)).alias("n_periods"), F.sum(F.when(period, F.col("len"))).alias("covered_ms"), F.max(F.when(~period, F.col("len"))).alias("longest_gap_ms")
    )


QUERIES = {"p2_found": p2_found, "p2_positions_mm": p2_positions_mm, "p2_unit_counts": p2_unit_counts, "p3_found": p3_found, "p3_coverage": p3_coverage}

_PERIODS = """
WITH x AS (
  SELECT DISTINCT rec_id, CAST(round(onset * 1000) AS BIGINT) AS s, CAST(round(onset * 1000) AS BIGINT) + CAST(round(duration * 1000) AS BIGINT) AS e
  FROM bad_segments WHERE onset IS NOT NULL AND duration > 0 AND rec_id IS NOT NULL
), v AS (SELECT * FROM x WHERE e > s),
p AS (SELECT *, max(e) OVER (PARTITION BY rec_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM v),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS isl FROM p),
g AS (SELECT rec_id, isl, min(s) AS s, max(e) AS e FROM i GROUP BY rec_id, isl),
h AS (SELECT rec_id, s, e, lag(e) OVER (PARTITION BY rec_id ORDER BY s) AS prev FROM g),
r AS (
  SELECT rec_id, 'period' AS kind, CAST(s AS BIGINT) AS start_ms, CAST(e AS BIGINT) AS end_ms FROM h
  UNION ALL SELECT rec_id, 'gap', CAST(prev AS BIGINT), CAST(s AS BIGINT) FROM h WHERE prev IS NOT NULL
)
"""

# the range a true position lies in leaves one unit, but for centimetres and inches, which a statement parts
_UNITS = r"""
WITH k AS (SELECT DISTINCT coord_id, subj, loaded_at, x, y, z, unit, remark, sqrt(x * x + y * y + z * z) AS n FROM coords WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND (x <> 0 OR y <> 0 OR z <> 0)),
s AS (SELECT *, coalesce(regexp_full_match(lower(unit), '[\s\[(]*(in|inch|inches|zoll|pouces?|pulgadas?|pollici|")[\s\]).]*'), false)
  OR coalesce(len(list_filter(string_split_regex(remark, '[;|]'), lambda p: regexp_matches(lower(p), '\b(inch|inches|zoll|pouces?|pulgadas?|pollici)\b|(unit|einheit|unité)\s*[:=]?\s*in\b|["″]')
    AND NOT regexp_matches(lower(p), '[0-9](\s*/\s*[0-9]+)?\s*([a-zµμ]+\b|["″])'))) > 0, false) AS inch FROM k),
u AS (SELECT coord_id, subj, x, y, z, CASE WHEN inch AND n BETWEEN 20 / 25.4 * 0.999 AND 100 / 25.4 * 1.001 THEN 'in' WHEN n BETWEEN 0.02 * 0.999 AND 0.1 * 1.001 THEN 'm' WHEN n BETWEEN 2 * 0.999 AND 10 * 1.001 THEN 'cm'
  WHEN n BETWEEN 20000 * 0.999 AND 100000 * 1.001 THEN 'um' ELSE 'mm' END AS unit FROM s),
f AS (SELECT *, CASE unit WHEN 'm' THEN 1000 WHEN 'cm' THEN 10 WHEN 'um' THEN 0.001 WHEN 'in' THEN 25.4 ELSE 1 END::DOUBLE AS f FROM u)
"""

SQL = {
    "p2_found": _UNITS + "SELECT DISTINCT coord_id, unit FROM u WHERE unit <> 'mm'",
    "p2_positions_mm": _UNITS + "SELECT coord_id, subj, x, y, z, unit AS unit_decoded, x * f AS x_mm, y * f AS y_mm, z * f AS z_mm FROM f",
    "p2_unit_counts": _UNITS + "SELECT unit AS unit_decoded, count(*) AS n, round(avg(sqrt((x * f) ** 2 + (y * f) ** 2 + (z * f) ** 2)), 3) AS mean_mm FROM f GROUP BY unit",
    "p3_found": _PERIODS + "SELECT * FROM r",
    "p3_coverage": _PERIODS
    + """SELECT rec_id, CAST(count(*) FILTER (kind = 'period') AS BIGINT) AS n_periods,
  CAST(sum(end_ms - start_ms) FILTER (kind = 'period') AS BIGINT) AS covered_ms,
  CAST(max(end_ms - start_ms) FILTER (kind = 'gap') AS BIGINT) AS longest_gap_ms
FROM r GROUP BY rec_id""",
}
