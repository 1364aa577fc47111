"""Logical views over the test tables: signals, trials, stimuli and keys, channels, weights, series, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.session import table

#: Band bridge of the trial view: band -> frequencies; edges overlap, 8 and 9 are in none.
VIEW_BANDS = {"b0": [0, 1, 2], "b1": [2, 3, 4], "b2": [4, 5, 6, 7]}
#: Regions of the channel view in order of priority, with overlaps.
VIEW_REGIONS = {
    "north": [f"NATION_{i}" for i in range(10)],
    "coast": [f"NATION_{i}" for i in range(8, 17)],
    "inner": [f"NATION_{i}" for i in range(15, 23)],
}


def trial_signal(spark: SparkSession, d: str) -> DataFrame:
    """F1 (subj, trial, cond, ch_idx, t_idx, freq, value): 8 channels x 8 time points of every embedding."""
    e = table(spark, d, "embeddings").select(
        F.expr("cast(vec_id div 25 as int)").alias("subj"), (F.col("vec_id") % 25).cast("int").alias("trial"), (1 + F.col("label") % 2).cast("int").alias("cond"), F.col("label").cast("int").alias("freq"), F.posexplode("embedding").alias("p", "v")
    )
    return e.select("subj", "trial", "cond", (F.col("p") % 8).alias("ch_idx"), F.expr("cast(p div 8 as int)").alias("t_idx"), "freq", F.col("v").cast("double").alias("value"))


def trial_code(spark: SparkSession, d: str) -> DataFrame:
    """F2 (subj, event_id, code) from the events' payload."""
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    code = 1 + F.col("k") % 2 + F.when(F.col("k") < 60, 0).when(F.col("k") < 90, 100).otherwise(200)
    return e.select(F.col("user_id").alias("subj"), "event_id", code.cast("int").alias("code"), "value")


def stim_key(spark: SparkSession, d: str) -> DataFrame:
    """F3 (subj, event_id, t, event_type): time in hours since the epoch."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select(F.col("user_id").alias("subj"), "event_id", (us / 3.6e9).alias("t"), "event_type")


def channel_dim(spark: SparkSession, d: str) -> DataFrame:
    """F4 (subj, ch_idx, channel, area, x, y, z) from customers and nations."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("area"))
    c = table(spark, d, "customer").join(F.broadcast(n), "c_nationkey")  # 25 nations
    return c.select(
        F.col("c_nationkey").alias("subj"), F.col("c_custkey").alias("ch_idx"), F.concat(F.substring("c_mktsegment", 1, 2), F.col("c_custkey").cast("string")).alias("channel"), "area",
        (F.col("c_acctbal") / 100).alias("x"), (F.col("c_custkey") % 101 - 50).cast("double").alias("y"), (F.col("c_custkey") % 89 - 44).cast("double").alias("z"),
    )


def weights(spark: SparkSession, d: str) -> DataFrame:
    """F5 (band, compo, gch, area, w): three components of four bands for every embedding."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("gch"), F.col("label").cast("int").alias("area"), F.posexplode("embedding").alias("p", "v")).where("p < 12")
    return e.select(F.expr("cast(p div 3 as int)").alias("band"), (F.col("p") % 3 + 1).alias("compo"), "gch", "area", F.col("v").cast("double").alias("w"))


def series_pair(spark: SparkSession, d: str) -> DataFrame:
    """F6 (i, x, y): the first two embeddings as series of 64 points."""
    e = table(spark, d, "embeddings").where("vec_id in (0, 1)").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return e.groupBy("i").agg(F.max(F.when(F.col("vec_id") == 0, F.col("v").cast("double"))).alias("x"), F.max(F.when(F.col("vec_id") == 1, F.col("v").cast("double"))).alias("y"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """F7 (id, run, y, pred, p2): fixed predictions of several runs."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("event_id") % 7).cast("int").alias("run"), (1 + F.col("event_id") % 2).cast("int").alias("y"), (1 + F.when(k < 50, 0).otherwise(1)).cast("int").alias("pred"), ((k + 0.5) / 100.0).cast("double").alias("p2"))


# the same views in DuckDB's SQL, as common table expressions
SQL = {
    "ts": """ts AS (SELECT CAST(vec_id // 25 AS INTEGER) AS subj, CAST(vec_id % 25 AS INTEGER) AS trial, CAST(1 + label % 2 AS INTEGER) AS cond, CAST((p - 1) % 8 AS INTEGER) AS ch_idx,
 CAST((p - 1) // 8 AS INTEGER) AS t_idx, CAST(label AS INTEGER) AS freq, CAST(embedding[p] AS DOUBLE) AS value FROM embeddings, generate_series(1, 64) AS g(p))""",
    "bm": "bm(band_idx, freq) AS (VALUES (0,0),(0,1),(0,2),(1,2),(1,3),(1,4),(2,4),(2,5),(2,6),(2,7))",
    "tc": """tc AS (SELECT user_id AS subj, event_id, value, CAST(1 + k % 2 + CASE WHEN k < 60 THEN 0 WHEN k < 90 THEN 100 ELSE 200 END AS INTEGER) AS code
 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))""",
    "sk": "sk AS (SELECT user_id AS subj, event_id, epoch_us(ts) / 3.6e9 AS t, event_type FROM events)",
    "cd": """cd AS (SELECT c_nationkey AS subj, c_custkey AS ch_idx, substr(c_mktsegment, 1, 2) || c_custkey AS channel, n_name AS area, c_acctbal / 100 AS x,
 CAST(c_custkey % 101 - 50 AS DOUBLE) AS y, CAST(c_custkey % 89 - 44 AS DOUBLE) AS z FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
    "wt": """wt AS (SELECT CAST((p - 1) // 3 AS INTEGER) AS band, CAST((p - 1) % 3 + 1 AS INTEGER) AS compo, vec_id AS gch, CAST(label AS INTEGER) AS area, CAST(embedding[p] AS DOUBLE) AS w
 FROM embeddings, generate_series(1, 12) AS g(p))""",
    "sp": """sp AS (SELECT CAST(p - 1 AS INTEGER) AS i, CAST(max(CASE WHEN vec_id = 0 THEN embedding[p] END) AS DOUBLE) AS x, CAST(max(CASE WHEN vec_id = 1 THEN embedding[p] END) AS DOUBLE) AS y
 FROM embeddings, generate_series(1, 64) AS g(p) WHERE vec_id IN (0, 1) GROUP BY p)""",
    "pr": """pr AS (SELECT event_id AS id, CAST(event_id % 7 AS INTEGER) AS run, CAST(1 + event_id % 2 AS INTEGER) AS y, CAST(CASE WHEN k < 50 THEN 1 ELSE 2 END AS INTEGER) AS pred,
 (k + 0.5) / 100.0::DOUBLE AS p2 FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))""",
    "vr": "vr(priority, region, area) AS (VALUES " + ", ".join(f"({i}, '{r}', '{a}')" for i, (r, l) in enumerate(VIEW_REGIONS.items()) for a in l) + ")",
}


def with_views(*names: str) -> str:
    """WITH clause of the named views."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
