"""One named query for each operator, over the test tables' views, with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import dims
from sigloom.operators import aggregate as ag
from sigloom.operators import correlation as cc
from sigloom.operators import decoding as dc
from sigloom.operators import events as ev
from sigloom.operators import labelling as cl
from sigloom.operators import linear as la
from sigloom.operators import montage as mo
from sigloom.operators import ranking as rk
from sigloom.operators import shaping as sh
from sigloom.operators import spectral as sp
from sigloom.operators import supersubject as su
from sigloom.session import broadcast_if_small, table
from sigloom.sources import views as v
from sigloom.sources.views import with_views as W

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = unsigned_zeros(sql)
        return f

    return add


def unsigned_zeros(sql: str) -> str:
    """SQL whose rounded columns have one kind of zero."""
    cols = dict.fromkeys(re.findall(r", [3-6]\) AS (\w+)", sql[sql.rfind("SELECT", 0, sql.find("UNION ALL") if "UNION ALL" in sql else None) :]))
    if not cols:
        return sql
    return "SELECT * REPLACE (" + ", ".join(f"CASE WHEN {c} = 0 THEN 0 ELSE {c} END AS {c}" for c in cols) + f") FROM ({sql})"


def r(df: DataFrame, *cols: str, to: int = 5) -> DataFrame:
    """Floating columns rounded for comparison, with one kind of zero."""
    rounded = {c: F.round(c, to) for c in cols}
    return df.withColumns({c: F.when(x == 0, 0.0).otherwise(x) for c, x in rounded.items()})


def bridge(spark: SparkSession) -> DataFrame:
    return dims.band_members(spark, v.VIEW_BANDS).withColumn("freq", F.col("freq").cast("int"))


# ---- spectral and baselines ----


@query(
    W("ts", "bm")
    + """, st AS (SELECT subj, ch_idx, freq, avg(value) FILTER (t_idx <= 3) AS m, stddev_pop(value) FILTER (t_idx <= 3) AS s FROM ts GROUP BY ALL),
z AS (SELECT ts.*, CASE WHEN s > 0 THEN (value - m) / s END AS z FROM ts JOIN st USING (subj, ch_idx, freq))
SELECT subj, cond, ch_idx, CAST(band_idx AS INTEGER) AS band_idx, t_idx, round(avg(z), 5) AS value FROM z JOIN bm USING (freq) GROUP BY ALL"""
)
def flagship_band_condition_mean(spark, d):
    """SP3 + SP6 + AG1: baseline z-score, overlapping bands, condition mean."""
    z = sp.zscore_baseline(v.trial_signal(spark, d), ["subj", "ch_idx", "freq"], "value", F.col("t_idx") <= 3)
    return r(sp.band_means(z, bridge(spark), "freq", ["subj", "cond", "ch_idx", "t_idx"], "value"), "value")


@query(W("ts") + "SELECT subj, trial, ch_idx, t_idx, round(ln(abs(value) + 0.001), 5) AS value FROM ts")
def log_power(spark, d):
    """SP2."""
    x = v.trial_signal(spark, d).withColumn("value", F.abs("value") + 0.001)
    return r(sp.log_power(x, "value"), "value").select("subj", "trial", "ch_idx", "t_idx", "value")


def _baseline_sql(keys: str, expr: str, cond: str = "t_idx <= 3", extra: str = "subj, trial, ch_idx, t_idx") -> str:
    return W("ts") + f", st AS (SELECT {keys}, avg(value) FILTER ({cond}) AS m, stddev_pop(value) FILTER ({cond}) AS s FROM ts GROUP BY ALL) SELECT {extra}, round({expr}, 5) AS value FROM ts JOIN st USING ({keys})"


_Z = "CASE WHEN s > 0 THEN (value - m) / s END"


@query(_baseline_sql("subj, ch_idx, freq", _Z))
def zscore_baseline(spark, d):
    """SP3."""
    z = sp.zscore_baseline(v.trial_signal(spark, d), ["subj", "ch_idx", "freq"], "value", F.col("t_idx") <= 3)
    return r(z, "value").select("subj", "trial", "ch_idx", "t_idx", "value")


@query(_baseline_sql("subj, trial, ch_idx, freq", "value - m"))
def trial_baseline(spark, d):
    """SP4."""
    z = sp.subtract_baseline(v.trial_signal(spark, d), ["subj", "trial", "ch_idx", "freq"], "value", F.col("t_idx") <= 3)
    return r(z, "value").select("subj", "trial", "ch_idx", "t_idx", "value")


@query(_baseline_sql("subj, trial, ch_idx, freq", "value - m", "t_idx < 3"))
def read_baseline_mean(spark, d):
    """SP9 'mean': the boundary sample is outside the baseline."""
    z = sp.read_baseline(v.trial_signal(spark, d), ["subj", "trial", "ch_idx", "freq"], "value", F.col("t_idx") < 3, "mean")
    return r(z, "value").select("subj", "trial", "ch_idx", "t_idx", "value")


@query(_baseline_sql("subj, trial, ch_idx, freq", _Z, "t_idx < 3"))
def read_baseline_z(spark, d):
    """SP9 'z_score'."""
    z = sp.read_baseline(v.trial_signal(spark, d), ["subj", "trial", "ch_idx", "freq"], "value", F.col("t_idx") < 3, "z_score")
    return r(z, "value").select("subj", "trial", "ch_idx", "t_idx", "value")


@query(
    W("ts")
    + """, c AS (SELECT subj, cond, ch_idx, t_idx, avg(value) AS value FROM ts GROUP BY ALL),
b AS (SELECT subj, cond, ch_idx, avg(value) FILTER (t_idx <= 3) AS m FROM c GROUP BY ALL)
SELECT subj, cond, ch_idx, t_idx, round(value - m, 5) AS value FROM c JOIN b USING (subj, cond, ch_idx)"""
)
def condition_baseline(spark, d):
    """SP10: baseline of averaged conditions."""
    c = ag.condition_mean(v.trial_signal(spark, d), "cond", [1, 2], ["subj", "ch_idx", "t_idx"], "value")
    return r(sp.subtract_baseline(c, ["subj", "cond", "ch_idx"], "value", F.col("t_idx") <= 3), "value").select("subj", "cond", "ch_idx", "t_idx", "value")


@query(
    W("ts")
    + """, b AS (SELECT subj, ch_idx, freq, avg(value) FILTER (t_idx <= 3) AS m FROM ts GROUP BY ALL), bt AS (SELECT subj, trial, ch_idx, freq, avg(value) FILTER (t_idx <= 3) AS mt FROM ts GROUP BY ALL)
SELECT subj, ch_idx, t_idx, round(avg(value - mt), 5) AS trial_level, round(avg(value - m), 5) AS mean_level FROM ts JOIN b USING (subj, ch_idx, freq) JOIN bt USING (subj, trial, ch_idx, freq) GROUP BY ALL"""
)
def baseline_levels_compared(spark, d):
    """SP11: trial-level and mean-level baselines side by side."""
    x = v.trial_signal(spark, d)
    a = sp.subtract_baseline(x.withColumn("trial_level", F.col("value")), ["subj", "trial", "ch_idx", "freq"], "trial_level", F.col("t_idx") <= 3)
    b = sp.subtract_baseline(a.withColumn("mean_level", F.col("value")), ["subj", "ch_idx", "freq"], "mean_level", F.col("t_idx") <= 3)
    g = b.groupBy("subj", "ch_idx", "t_idx").agg(F.avg("trial_level").alias("trial_level"), F.avg("mean_level").alias("mean_level"))
    return r(g, "trial_level", "mean_level")


@query(W("ts") + ", m AS (SELECT subj, trial, t_idx, avg(value) AS m FROM ts GROUP BY ALL) SELECT subj, trial, ch_idx, t_idx, round(value - m, 5) AS value FROM ts JOIN m USING (subj, trial, t_idx)")
def centre_across_channels(spark, d):
    """SP12."""
    return r(sp.centre(v.trial_signal(spark, d), ["subj", "trial", "t_idx"], "value"), "value").select("subj", "trial", "ch_idx", "t_idx", "value")


@query(W("ts", "bm") + "SELECT subj, trial, ch_idx, t_idx, CAST(band_idx AS INTEGER) AS band_idx, round(avg(value), 5) AS value FROM ts JOIN bm USING (freq) GROUP BY ALL")
def band_overlap_mean(spark, d):
    """SP6."""
    return r(sp.band_means(v.trial_signal(spark, d), bridge(spark), "freq", ["subj", "trial", "ch_idx", "t_idx"], "value"), "value")


@query(
    W("ts")
    + """, g AS (SELECT freq, ch_idx, t_idx, avg(value) AS m FROM ts WHERE freq < 8 GROUP BY ALL), k AS (SELECT DISTINCT ch_idx, t_idx FROM ts), c AS (SELECT CAST(x AS INTEGER) AS freq FROM range(12) t(x))
SELECT freq, ch_idx, t_idx, round(coalesce(m, 0), 5) AS value FROM k CROSS JOIN c LEFT JOIN g USING (freq, ch_idx, t_idx)"""
)
def band_condition_dense(spark, d):
    """SP7, SP8: means by code, zeros where a code is absent (8 to 11 are)."""
    codes = spark.range(12).select(F.col("id").cast("int").alias("freq"))
    return r(sp.dense_conditions(v.trial_signal(spark, d).where("freq < 8"), codes, "freq", ["ch_idx", "t_idx"], "value"), "value").select("freq", "ch_idx", "t_idx", "value")


# ---- shaping ----


@query(
    """WITH e AS (SELECT DISTINCT rec_id, sample, code FROM event WHERE code IS NOT NULL), a AS (SELECT * FROM e WHERE code IN (1, 2))
SELECT a.rec_id, a.sample AS at_sample, e.sample - a.sample AS rel, e.code FROM a JOIN e ON a.rec_id = e.rec_id AND e.sample BETWEEN a.sample - 900 AND a.sample + 3000"""
)
def epoch_around_event(spark, d):
    """TS1: all events from 1.5 s before to 5 s after each correct answer, at 600 Hz."""
    e = table(spark, d, "event").where("code is not null").select("rec_id", "sample", "code").distinct()
    a = e.where("code in (1, 2)").withColumn("at_sample", F.col("sample")).drop("code")
    return sh.epochs(e, a, "rec_id", "sample", "code", ["at_sample"], "sample", 900, 3000)


@query(_baseline_sql("subj, ch_idx", "CASE WHEN s > 0 THEN (value - m) / s END / 1000 * 1000", "true"))
def epoch_normalise(spark, d):
    """TS4 (scaled back by 1000 for comparison)."""
    z = sh.normalise(v.trial_signal(spark, d), ["subj", "ch_idx"], "value").withColumn("value", F.col("value") * 1000)
    return r(z, "value").select("subj", "trial", "ch_idx", "t_idx", "value")


_GRID = sh.hopping_grid(0.0, 8, 8.0, 0.25, 0.5)


@query(
    W("ts")
    + ", g(c_idx, lo, hi) AS (VALUES "
    + ", ".join(f"({i}, {lo}, {hi})" for i, _, lo, hi in _GRID)
    + ") SELECT subj, trial, ch_idx, CAST(c_idx AS INTEGER) AS c_idx, round(avg(value), 5) AS value FROM ts JOIN g ON t_idx BETWEEN lo AND hi GROUP BY ALL"
)
def smooth_hopping(spark, d):
    """TS5: windows of half a second by a quarter, both ends inclusive."""
    return r(sh.smooth(v.trial_signal(spark, d), ["subj", "trial", "ch_idx"], "t_idx", "value", _GRID), "value").drop("centre")


@query("SELECT event_type, epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS w_us, round(avg(value), 5) AS value FROM events GROUP BY ALL")
def smooth_timestamps(spark, d):
    """TS5, timestamp form: tumbling hours."""
    x = sh.smooth_timestamps(table(spark, d, "events"), ["event_type"], "ts", "value", "1 hour", "1 hour")
    return r(x.select("event_type", F.unix_micros("w_start").alias("w_us"), "value"), "value")


@query(W("ts") + "SELECT subj, trial, ch_idx, t_idx, round(value, 5) AS value FROM ts WHERE t_idx % 5 = 0")
def stride_sample(spark, d):
    """FLT9."""
    return r(sh.stride(v.trial_signal(spark, d), "t_idx"), "value").select("subj", "trial", "ch_idx", "t_idx", "value")


@query(W("ts") + "SELECT subj, trial, ch_idx, t_idx, round(value, 5) AS value FROM ts WHERE t_idx / 8.0 - 0.5 BETWEEN -0.25 - 0.0625 AND 0.25 + 0.0625")
def crop_fixed(spark, d):
    """FLT3: [-0.25, 0.25] s, inclusive, of epochs from -0.5 s at 8 Hz."""
    x = v.trial_signal(spark, d).withColumn("t", F.col("t_idx") / 8.0 - 0.5)
    return r(sh.crop(x, "t", -0.25, 0.25, 8.0), "value").select("subj", "trial", "ch_idx", "t_idx", "value")


@query(W("sp") + "SELECT i, round(lag(x, 3) OVER (ORDER BY i), 5) AS x FROM sp")
def shift_series(spark, d):
    """TS9."""
    return r(sh.shift(v.series_pair(spark, d).withColumn("one", F.lit(1)), ["one"], "i", "x", 3), "x").select("i", "x")


@query(W("sp") + "SELECT CAST((i + 3) % 64 AS INTEGER) AS i, round(x, 5) AS x FROM sp")
def shift_series_wrapped(spark, d):
    """TS9 with wrap."""
    return r(sh.shift(v.series_pair(spark, d).withColumn("one", F.lit(1)), ["one"], "i", "x", 3, wrap=True), "x").select("i", "x")


@query(W("sp") + "SELECT i, CAST(CASE WHEN i < 32 THEN 1 ELSE 2 END AS INTEGER) AS cond, CAST(i % 32 AS INTEGER) AS t_half, round(x, 5) AS x FROM sp")
def split_halves(spark, d):
    """TS7, TS8."""
    return r(sh.split_halves(v.series_pair(spark, d), "i", 32), "x").select("i", "cond", "t_half", "x")


@query("SELECT CAST(min(t_idx) AS INTEGER) AS b_end FROM (SELECT x AS t_idx, -1.5 + x / 40.0 AS t FROM range(177) r(x)) WHERE t >= -0.5")
def baseline_end(spark, d):
    """TS10, WN11 on the smoothed time axis."""
    t = spark.range(177).select(F.col("id").cast("int").alias("t_idx"), (-1.5 + F.col("id") / 40.0).alias("t"))
    return sh.baseline_end(t, "t")


# ---- events ----


@query("SELECT seg_id, rec_id, description FROM (SELECT DISTINCT seg_id, rec_id, description FROM bad_segments) WHERE contains(description, 'spike') OR contains(description, 'cough')")
def annotation_filter(spark, d):
    """FLT1."""
    return ev.annotation_filter(table(spark, d, "bad_segments"), "description", "spike", "cough").select("seg_id", "rec_id", "description").distinct()


@query("SELECT rec_id, round(CASE WHEN min(onset) - 2 < 0 THEN min(onset) ELSE min(onset) - 2 END, 5) AS t_from, round(max(onset) + 50, 5) AS t_to FROM bad_segments WHERE onset IS NOT NULL GROUP BY rec_id")
def crop_bounds(spark, d):
    """FLT2."""
    return r(ev.crop_bounds(table(spark, d, "bad_segments").where("onset is not null"), "rec_id", "onset"), "t_from", "t_to")


_STIM, _KEYS = {"view": 1, "click": 2}, {"signup": 49, "purchase": 50, "error": 48}


def _stim_keys(spark, d):
    x = v.stim_key(spark, d)
    return ev.recode(x, "event_type", _STIM), ev.recode(x, "event_type", _KEYS)


_STIM_SQL = W("sk") + """, s AS (SELECT *, CASE event_type WHEN 'view' THEN 1 ELSE 2 END AS code FROM sk WHERE event_type IN ('view', 'click')),
k AS (SELECT *, CASE event_type WHEN 'signup' THEN 49 WHEN 'purchase' THEN 50 ELSE 48 END AS code FROM sk WHERE event_type IN ('signup', 'purchase', 'error')),
m AS (SELECT s.subj, s.event_id, s.code, arg_min(k.code, (k.t, k.event_id)) AS key_code FROM s LEFT JOIN k ON s.subj = k.subj AND k.t - s.t > 0.1 AND k.t - s.t < 5 GROUP BY ALL)"""


@query(_STIM_SQL + " SELECT subj, event_id, CAST(code AS INTEGER) AS code FROM s")
def stimulus_recode(spark, d):
    """JN2, FLT5."""
    return _stim_keys(spark, d)[0].select("subj", "event_id", "code")


@query(_STIM_SQL + " SELECT subj, event_id, CAST(code AS INTEGER) AS code, CAST(key_code AS INTEGER) AS key_code FROM m")
def response_asof(spark, d):
    """JN1: bounded forward as-of join."""
    s, k = _stim_keys(spark, d)
    return ev.first_response(s, k, "subj", "t", 0.1, 5.0, "event_id").select("subj", "event_id", "code", "key_code")


@query(
    _STIM_SQL
    + """ SELECT subj, event_id, CAST(CASE WHEN (key_code = 49 AND code = 2) OR (key_code = 50 AND code = 1) THEN code + 100 WHEN key_code = 48 THEN code + 200 ELSE code END AS INTEGER) AS condition FROM m"""
)
def outcome_codes(spark, d):
    """JN3."""
    s, k = _stim_keys(spark, d)
    m = ev.first_response(s, k, "subj", "t", 0.1, 5.0, "event_id")
    return m.select("subj", "event_id", ev.outcome(F.col("code"), F.col("key_code")).cast("int").alias("condition"))


@query("SELECT CAST(i + 100 * o AS INTEGER) AS code, ni || '/' || no AS condition_name FROM (VALUES (1, 'old'), (2, 'new')) a(i, ni) CROSS JOIN (VALUES (0, 'correct'), (1, 'incorrect'), (2, 'null')) b(o, no)")
def condition_dictionary(spark, d):
    """JN4."""
    items = spark.createDataFrame([(1, "old"), (2, "new")], "item int, item_name string")
    outs = spark.createDataFrame([(0, "correct"), (1, "incorrect"), (2, "null")], "outcome int, outcome_name string")
    return ev.condition_dictionary(items, outs)


_INCL = W("tc") + ", g AS (SELECT subj, count(*) AS n, count(*) FILTER (code = 1) AS n_old, count(*) FILTER (code = 2) AS n_new FROM tc GROUP BY subj)"


@query(_INCL + " SELECT * FROM g WHERE n >= 24 AND 2 * n_old / n >= 0.5 AND 2 * n_new / n >= 0.5")
def subject_inclusion(spark, d):
    """AG5."""
    return ev.inclusion(v.trial_code(spark, d), "subj", "code")


@query(
    """WITH e AS (SELECT DISTINCT subj, rec_id, sample, code FROM event WHERE code IS NOT NULL), g AS (SELECT rec_id, count(*) AS n, count(*) FILTER (code = 1) AS n_old, count(*) FILTER (code = 2) AS n_new FROM e GROUP BY rec_id)
SELECT * FROM g WHERE n >= 24 AND 2 * n_old / n >= 0.5 AND 2 * n_new / n >= 0.5"""
)
def recording_inclusion(spark, d):
    """AG5 on recordings."""
    e = table(spark, d, "event").where("code is not null").select("subj", "rec_id", "sample", "code").distinct()
    return ev.inclusion(e, "rec_id", "code")


@query(W("tc") + "SELECT subj, count(*) FILTER (code = 1) AS n_1, count(*) FILTER (code = 2) AS n_2, count(*) FILTER (code = 101) AS n_101 FROM tc GROUP BY subj")
def subject_condition_counts(spark, d):
    """AG6."""
    return ag.counts_by_condition(v.trial_code(spark, d), "subj", "code", [1, 2, 101])


@query("SELECT rec_id, code, condition_name, count(*) AS n FROM (SELECT DISTINCT rec_id, sample, code FROM event) JOIN condition_ref USING (code) GROUP BY ALL")
def event_code_counts(spark, d):
    """AG4."""
    e = table(spark, d, "event").select("rec_id", "sample", "code").distinct()
    return ag.code_counts(e, ["rec_id"], "code", table(spark, d, "condition_ref"), "code", "condition_name").select("rec_id", "code", "condition_name", "n")


@query(_INCL + " SELECT subj, n FROM g ORDER BY n, subj LIMIT 3")
def smallest_subjects(spark, d):
    """WN6."""
    n = v.trial_code(spark, d).groupBy("subj").agg(F.count("*").alias("n"))
    return rk.smallest(n, "n", "subj", 3)


@query("SELECT DISTINCT subj FROM info WHERE subj LIKE 'sub-%'")
def subject_names(spark, d):
    """SRC1, SRC2."""
    return table(spark, d, "info").where(F.col("subj").startswith("sub-")).select("subj").distinct()


@query("SELECT DISTINCT subj FROM info WHERE subj NOT IN (SELECT subj FROM bad_segments WHERE description = 'cough' AND subj IS NOT NULL)")
def deny_list(spark, d):
    """SRC3, ST2: guarded deny list."""
    denied = table(spark, d, "bad_segments").where("description = 'cough' and subj is not null").select("subj").distinct()
    return ev.deny(table(spark, d, "info").select("subj").distinct(), "subj", denied)


@query("SELECT DISTINCT subj, trial, TRY_CAST(trim(c) AS INTEGER) AS code FROM (SELECT DISTINCT rec_id AS subj, i - 1 AS trial, event_id[i] AS c FROM info, generate_series(1, 400) g(i) WHERE i <= len(event_id)) WHERE regexp_full_match(c, ' *[0-9]+ *')")
def sidecar_codes(spark, d):
    """SRC6: string codes of the sidecars, those that are whole numbers."""
    from sigloom.sources.readers import exploded_codes

    x = table(spark, d, "info").select(F.col("rec_id").alias("subj"), "event_id").distinct()
    return exploded_codes(x, ["subj"]).where("code is not null").select("subj", F.col("trial").cast("bigint").alias("trial"), "code").distinct()


# ---- channels ----


@query("SELECT subj, electrode, CASE WHEN min(f) = 0 THEN 'bad' ELSE 'white' END AS flag FROM (SELECT subj, electrode, CASE WHEN label IN ('OOB', 'LSN') THEN 0 WHEN label IN ('WM', 'VENT') THEN 1 END AS f FROM electrodes) WHERE f IS NOT NULL GROUP BY ALL")
def bad_channel_lists(spark, d):
    """JN5."""
    return mo.channel_flags(table(spark, d, "electrodes"), "subj", "electrode", "label")


_PAIRS = W("cd") + """, l AS (SELECT subj, ch_idx AS anode_idx, channel AS anode, lead(ch_idx) OVER w AS cathode_idx, lead(channel) OVER w AS cathode, (x + lead(x) OVER w) / 2 AS x, (y + lead(y) OVER w) / 2 AS y, (z + lead(z) OVER w) / 2 AS z
 FROM cd WINDOW w AS (PARTITION BY subj ORDER BY ch_idx)),
p AS (SELECT *, anode || '_' || cathode AS pair FROM l WHERE cathode IS NOT NULL AND regexp_replace(anode, '[0-9]', '', 'g') = regexp_replace(cathode, '[0-9]', '', 'g'))"""


@query(_PAIRS + " SELECT subj, anode_idx, cathode_idx, pair, round(x, 5) AS x, y, z FROM p")
def bipolar_pairs(spark, d):
    """JN6, WN1."""
    p = mo.bipolar_pairs(v.channel_dim(spark, d), "subj", "ch_idx", "channel")
    return r(p, "x").select("subj", "anode_idx", "cathode_idx", "pair", "x", "y", "z")


@query(
    W("ts")
    + """, a AS (SELECT *, chr(65 + ch_idx // 3) AS s FROM ts) SELECT a.subj, a.trial, a.t_idx, a.s || (a.ch_idx % 3 + 1) || '_' || b.s || (b.ch_idx % 3 + 1) AS pair, round(a.value - b.value, 5) AS value
FROM a JOIN a b ON a.subj = b.subj AND a.trial = b.trial AND a.t_idx = b.t_idx AND b.ch_idx = a.ch_idx + 1 AND a.s = b.s"""
)
def bipolar_signal(spark, d):
    """JN6: anode less cathode, channels named on shafts of three."""
    x = v.trial_signal(spark, d)
    name = F.concat(F.chr(65 + F.expr("ch_idx div 3")), (F.col("ch_idx") % 3 + 1).cast("string"))
    ch = x.select("subj", "ch_idx").distinct().select("subj", "ch_idx", name.alias("channel"), *[F.lit(0.0).alias(c) for c in "xyz"])
    p = mo.bipolar_pairs(ch, "subj", "ch_idx", "channel")
    return r(mo.bipolar_signal(x, p, "subj", "ch_idx", "value", ["trial", "t_idx"]), "value").select("subj", "trial", "t_idx", "pair", "value")


@query(
    _PAIRS
    + """, f AS (SELECT subj, channel, CASE WHEN ch_idx % 11 = 0 THEN 'bad' ELSE 'white' END AS flag FROM cd WHERE ch_idx % 11 = 0 OR ch_idx % 13 = 0)
SELECT p.subj, pair, min(flag) AS reason FROM p JOIN f ON p.subj = f.subj AND (f.channel = anode OR f.channel = cathode) GROUP BY ALL"""
)
def drop_flagged(spark, d):
    """FLT4, JN6: pairs with a flagged end."""
    c = v.channel_dim(spark, d)
    flags = c.where("ch_idx % 11 = 0 or ch_idx % 13 = 0").select("subj", "channel", F.when(F.col("ch_idx") % 11 == 0, "bad").otherwise("white").alias("flag"))
    return mo.pair_drop_list(mo.bipolar_pairs(c, "subj", "ch_idx", "channel"), flags, "subj", "channel")


@query(_PAIRS + " SELECT p.subj, pair, a.area AS area1, a.area AS area2, b.area AS area_second FROM p JOIN cd a ON a.subj = p.subj AND a.channel = anode JOIN cd b ON b.subj = p.subj AND b.channel = cathode")
def channel_area_lookup(spark, d):
    """JN7."""
    c = v.channel_dim(spark, d)
    return mo.area_lookup(mo.bipolar_pairs(c, "subj", "ch_idx", "channel"), c, "subj", "channel", "area").select("subj", "pair", "area1", "area2", "area_second")


_REG = W("cd", "vr") + ", g AS (SELECT cd.*, b.region FROM cd LEFT JOIN (SELECT area, arg_min(region, priority) AS region FROM vr GROUP BY area) b USING (area))"


def _with_region(spark, d):
    return mo.region_first_match(v.channel_dim(spark, d), "area", dims.regions(spark, v.VIEW_REGIONS))


@query(_REG + " SELECT ch_idx, area, region FROM g")
def region_first_match(spark, d):
    """JN8."""
    return _with_region(spark, d).select("ch_idx", "area", "region")


@query("SELECT area_code, area_name, region_name AS region FROM area_ref")
def area_regions(spark, d):
    """JN8 with the fixed region lists, against the reference table's own regions."""
    return mo.region_first_match(table(spark, d, "area_ref"), "area_code", dims.regions(spark)).select("area_code", "area_name", "region")


@query(_REG + " SELECT ch_idx, region, CAST(CASE WHEN region IS NOT NULL THEN dense_rank() OVER (ORDER BY region) - 1 END AS INTEGER) AS code FROM g WHERE region IS NOT NULL")
def region_codes(spark, d):
    """JN9."""
    return mo.label_codes(_with_region(spark, d).where("region is not null"), "region").select("ch_idx", "region", "code")


@query(_REG + " SELECT ch_idx, region, count(*) OVER (PARTITION BY region) AS group_count FROM g WHERE region IS NOT NULL")
def region_count_attach(spark, d):
    """JN10, AG7."""
    return mo.with_group_count(_with_region(spark, d).where("region is not null").select("ch_idx", "region"), "region").select("ch_idx", "region", "group_count")


@query(_REG + " SELECT region, round(median(x), 5) AS x, round(median(y), 5) AS y, round(median(z), 5) AS z FROM g WHERE region IS NOT NULL GROUP BY region")
def region_median_coord(spark, d):
    """AG8."""
    return r(ag.median_place(_with_region(spark, d).where("region is not null"), ["region"], ("x", "y", "z")), "x", "y", "z")


_CO = "WITH c AS (SELECT DISTINCT coord_id, subj, x, y, z FROM coords WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL)"


@query(_CO + " SELECT coord_id, round(CASE WHEN abs(x) > 100 THEN x / 1000 ELSE x END, 6) AS x, round(CASE WHEN abs(x) > 100 THEN y / 1000 ELSE y END, 6) AS y, round(CASE WHEN abs(x) > 100 THEN z / 1000 ELSE z END, 6) AS z FROM c")
def coord_unit_repair_row(spark, d):
    """FLT12 (b), FLT11."""
    c = table(spark, d, "coords").select("coord_id", "subj", "x", "y", "z").dropna().distinct()
    return r(mo.repair_rows(c, ("x", "y", "z")), "x", "y", "z", to=6).drop("subj")


@query(_CO + ", f AS (SELECT subj, abs(arg_min(x, coord_id)) > 1000 AS far FROM c GROUP BY subj) SELECT coord_id, round(CASE WHEN far THEN x / 1000 ELSE x END, 6) AS x, round(CASE WHEN far THEN y / 1000 ELSE y END, 6) AS y, round(CASE WHEN far THEN z / 1000 ELSE z END, 6) AS z FROM c JOIN f USING (subj)")
def coord_unit_repair_file(spark, d):
    """FLT12 (a)."""
    c = table(spark, d, "coords").select("coord_id", "subj", "x", "y", "z").dropna().distinct()
    return r(mo.repair_files(c, "subj", "coord_id", ("x", "y", "z")), "x", "y", "z", to=6).drop("subj")


@query("SELECT elec_id, coalesce(label, 'NON') AS label FROM (SELECT DISTINCT elec_id, label FROM electrodes)")
def fill_labels(spark, d):
    """FLT15."""
    return table(spark, d, "electrodes").select("elec_id", "label").distinct().na.fill("NON", ["label"])


@query(W("tc") + ", m AS (SELECT code, avg(value) FILTER (event_id % 5 <> 0) AS m FROM tc GROUP BY code) SELECT event_id, round(CASE WHEN event_id % 5 = 0 THEN m ELSE value END, 5) AS value FROM tc JOIN m USING (code)")
def fill_group_mean(spark, d):
    """FLT16: missing values take their group's mean."""
    x = v.trial_code(spark, d).withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    m = x.groupBy("code").agg(F.avg("value").alias("_m"))
    return r(x.join(broadcast_if_small(m), "code").select("event_id", F.coalesce("value", "_m").alias("value")), "value")


@query("SELECT DISTINCT channel, split_part(channel, '_', 1) AS anode, regexp_replace(split_part(channel, '_', 1), '[0-9]', '', 'g') AS shaft FROM coords WHERE channel IS NOT NULL")
def name_parts(spark, d):
    """FLT17."""
    a = mo.first_contact(F.col("channel"))
    return table(spark, d, "coords").where("channel is not null").select("channel", a.alias("anode"), mo.shaft(a).alias("shaft")).distinct()


@query("SELECT row_id, channel, weight FROM (UNPIVOT (SELECT row_id, COLUMNS('ch_[0-9]+') FROM grp_concat_compo_pca3) ON COLUMNS(* EXCLUDE row_id) INTO NAME channel VALUE weight)")
def unpivot_weights(spark, d):
    """FLT19: wide channels to long rows; null weights give none."""
    x = table(spark, d, "grp_concat_compo_pca3")
    channels = sorted(c for c in x.columns if c.startswith("ch_"))
    return x.select("row_id", *channels).unpivot("row_id", channels, "channel", "weight").where("weight is not null")


# ---- aggregation ----


@query(W("ts") + "SELECT subj, cond, ch_idx, t_idx, round(avg(value), 5) AS value FROM ts GROUP BY ALL")
def condition_mean(spark, d):
    """AG1."""
    return r(ag.condition_mean(v.trial_signal(spark, d), "cond", [1, 2], ["subj", "ch_idx", "t_idx"], "value"), "value")


@query(W("ts") + ", c AS (SELECT subj, cond, ch_idx, t_idx, avg(value) AS m FROM ts GROUP BY ALL) SELECT subj, ch_idx, t_idx, round(avg(m), 5) AS value FROM c GROUP BY ALL")
def grand_mean(spark, d):
    """AG3."""
    return r(ag.grand_mean(v.trial_signal(spark, d), "cond", ["subj", "ch_idx", "t_idx"], "value"), "value")


@query(W("ts") + ", h AS (SELECT subj, cond, arg_min(trial, md5('7|' || subj || '|' || trial)) AS trial FROM (SELECT DISTINCT subj, cond, trial FROM ts) GROUP BY ALL) SELECT subj, cond, ch_idx, t_idx, round(avg(value), 5) AS value FROM ts ANTI JOIN h USING (subj, cond, trial) GROUP BY ALL")
def broadband_condition_mean(spark, d):
    """AG2: condition mean without the held-out trial."""
    x = v.trial_signal(spark, d)
    h = rk.hold_out(x.select("subj", "cond", "trial").distinct(), ["subj", "cond"], ["subj", "trial"], 7)
    kept = x.join(broadcast_if_small(h), ["subj", "cond", "trial"], "left_anti")
    return r(ag.condition_mean(kept, "cond", [1, 2], ["subj", "ch_idx", "t_idx"], "value"), "value")


@query(
    W("ts", "bm")
    + ", b AS (SELECT subj, cond, ch_idx, band_idx, t_idx, avg(value) AS m FROM ts JOIN bm USING (freq) GROUP BY ALL) SELECT CAST(ch_idx % 3 AS INTEGER) AS region, CAST(band_idx AS INTEGER) AS band_idx, t_idx, round(avg(m), 5) AS value FROM b GROUP BY ALL"
)
def region_band_mean(spark, d):
    """AG11."""
    b = sp.band_means(v.trial_signal(spark, d), bridge(spark), "freq", ["subj", "cond", "ch_idx", "t_idx"], "value")
    return r(b.groupBy((F.col("ch_idx") % 3).alias("region"), "band_idx", "t_idx").agg(F.avg("value").alias("value")), "value")


@query(W("ts") + "SELECT t_idx, round(avg(value), 5) AS value FROM ts WHERE ch_idx IN (1, 4) OR ch_idx IN (4, 6) GROUP BY t_idx")
def area_mean_series(spark, d):
    """AG12, ST4: channels of either area list, each once."""
    ids = spark.createDataFrame([(1,), (4,)], "ch_idx int").union(spark.createDataFrame([(4,), (6,)], "ch_idx int")).distinct()
    x = v.trial_signal(spark, d).join(F.broadcast(ids), "ch_idx", "left_semi")  # three rows
    return r(x.groupBy("t_idx").agg(F.avg("value").alias("value")), "value")


@query(W("wt") + "SELECT area, round(avg(abs(w)), 5) AS mean_abs, round(stddev_samp(abs(w)), 5) AS std_abs, round(avg(w), 5) AS mean_signed, count(w) AS n FROM wt GROUP BY area")
def area_weight_stats(spark, d):
    """AG9."""
    return r(ag.weight_stats(v.weights(spark, d), ["area"], "w"), "mean_abs", "std_abs", "mean_signed")


@query(W("wt") + "SELECT area, compo, round(sum(w), 4) AS sum_all, round(sum(w) FILTER (w > 0), 4) AS sum_pos, round(sum(w) FILTER (w < 0), 4) AS sum_neg FROM wt GROUP BY ALL")
def signed_region_sums(spark, d):
    """AG10, FLT14."""
    return r(ag.signed_sums(v.weights(spark, d), ["area", "compo"], "w"), "sum_all", "sum_pos", "sum_neg", to=4)


@query(W("wt") + "SELECT compo, CAST(greatest(0, least(19, floor((w + 4) / 0.4))) AS INTEGER) AS bin, count(*) AS n FROM wt GROUP BY ALL")
def weight_histogram(spark, d):
    """AG17."""
    return ag.histogram(v.weights(spark, d), "w", -4.0, 4.0, 20, ["compo"])


@query(W("wt") + ", b AS (SELECT band, compo, min(w) AS lo, max(w) AS hi FROM wt GROUP BY ALL) SELECT band, compo, gch, round((w - lo) / (hi - lo), 5) AS w FROM wt JOIN b USING (band, compo) WHERE hi > lo")
def minmax_scale(spark, d):
    """AG16."""
    return r(ag.minmax(v.weights(spark, d), ["band", "compo"], "w"), "w").select("band", "compo", "gch", "w")


@query(W("wt") + "SELECT band, compo, round(min(w), 5) AS min_v, round(max(w), 5) AS max_v, round(max(abs(w)), 5) AS max_abs FROM wt GROUP BY ALL")
def weight_extremes(spark, d):
    """AG15."""
    return r(ag.extremes(v.weights(spark, d), ["band", "compo"], "w"), "min_v", "max_v", "max_abs")


@query(W("tc") + "SELECT code, round(quantile_cont(value, 0.25), 5) AS q1, round(quantile_cont(value, 0.5), 5) AS q2, round(quantile_cont(value, 0.75), 5) AS q3 FROM tc GROUP BY code")
def condition_quartiles(spark, d):
    """AG18."""
    return r(ag.quartiles(v.trial_code(spark, d), ["code"], "value"), "q1", "q2", "q3")


@query(W("tc") + "SELECT code, round(avg(value), 5) AS mean_v, round(stddev_pop(value), 5) AS std_v, count(value) AS n FROM tc GROUP BY code")
def condition_mean_std(spark, d):
    """AG13 and the data behind the trial checks."""
    return r(ag.mean_std(v.trial_code(spark, d), ["code"], "value"), "mean_v", "std_v")


# ---- thresholds and ranking ----

_THR = W("wt") + ", t AS (SELECT band, compo, avg(w) + abs(stddev_pop(w)) AS thr FROM wt GROUP BY ALL), k AS (SELECT wt.*, CASE WHEN abs(w) < thr THEN 0 ELSE w END AS kw FROM wt JOIN t USING (band, compo))"


@query(_THR + " SELECT band, compo, gch, round(kw, 5) AS w FROM k")
def component_threshold(spark, d):
    """WN9."""
    return r(rk.component_threshold(v.weights(spark, d), ["band", "compo"], "w"), "w").select("band", "compo", "gch", "w")


@query(W("wt") + ", t AS (SELECT band, avg(w) + abs(stddev_pop(w)) AS thr FROM wt GROUP BY ALL) SELECT band, compo, gch, round(w, 5) AS w FROM wt JOIN t USING (band) WHERE abs(w) > thr")
def component_threshold_global(spark, d):
    """WN10: threshold over all components of a band, strict; the rows that are kept."""
    x = rk.component_threshold(v.weights(spark, d), ["band"], "w", replace=None, strict=True)
    return r(x.where("w is not null"), "w").select("band", "compo", "gch", "w")


_TOP = W("wt") + ", r AS (SELECT *, CAST(row_number() OVER (PARTITION BY band, compo ORDER BY abs(w) DESC, gch) AS INTEGER) AS rank FROM wt)"


@query(_TOP + " SELECT band, compo, gch, rank, round(w, 5) AS w FROM r WHERE rank <= 20")
def top_drivers(spark, d):
    """WN5."""
    return r(rk.top_by_abs(v.weights(spark, d), ["band", "compo"], "w", "gch", 20), "w").select("band", "compo", "gch", "rank", "w")


@query(_TOP + " SELECT DISTINCT band, compo, area FROM r WHERE rank <= 10")
def top_driver_areas(spark, d):
    """WN7."""
    return rk.top_by_abs(v.weights(spark, d), ["band", "compo"], "w", "gch", 10).select("band", "compo", "area").distinct()


@query(W("wt") + "SELECT band, gch, arg_max(compo, (w, -compo)) AS compo, round(max(w), 5) AS w FROM wt GROUP BY ALL")
def dominant_component(spark, d):
    """WN8, WN12."""
    return r(rk.dominant(v.weights(spark, d), ["band", "gch"], "compo", "w"), "w")


@query(W("tc") + "SELECT subj, code, event_id, CAST(row_number() OVER (PARTITION BY subj, code ORDER BY event_id) AS INTEGER) AS slot FROM tc")
def trial_slots(spark, d):
    """WN2."""
    return rk.slots(v.trial_code(spark, d), ["subj", "code"], ["event_id"]).select("subj", "code", "event_id", "slot")


@query(W("sp") + ", b AS (SELECT CAST(s * 10 AS INTEGER) AS start FROM range(10) t(s) WHERE s * 10 + 20 < 64) SELECT start, count(*) AS n, round(avg(x), 5) AS mean_x FROM sp JOIN b ON i >= start AND i < start + 20 GROUP BY start")
def rolling_blocks(spark, d):
    """WN13."""
    x = rk.rolling_blocks(v.series_pair(spark, d), "i", 20, 10, 64)
    return r(x.groupBy("start").agg(F.count("*").alias("n"), F.avg("x").alias("mean_x")), "mean_x")


@query(W("ts") + "SELECT subj, cond, arg_min(trial, md5('42|' || subj || '|' || trial)) AS trial FROM (SELECT DISTINCT subj, cond, trial FROM ts) GROUP BY ALL")
def holdout_trials(spark, d):
    """WN3."""
    return rk.hold_out(v.trial_signal(spark, d).select("subj", "cond", "trial").distinct(), ["subj", "cond"], ["subj", "trial"], 42)


@query(W("ts") + ", u AS (SELECT DISTINCT subj, cond, trial FROM ts), o AS (SELECT *, row_number() OVER (PARTITION BY subj, cond ORDER BY md5('42|' || subj || '|' || trial), trial) AS r FROM u) SELECT subj, cond, trial FROM o WHERE r <= 5")
def random_trials(spark, d):
    """WN4: five trials in seeded hash order, for a view of raw trials."""
    return rk.hold_out(v.trial_signal(spark, d).select("subj", "cond", "trial").distinct(), ["subj", "cond"], ["subj", "trial"], 42, k=5)


# ---- labels ----

_QUAD = _THR + """, p AS (SELECT band, gch, max(area) AS area, max(kw) FILTER (compo = 1) AS a, max(kw) FILTER (compo = 2) AS b FROM k GROUP BY ALL),
q AS (SELECT *, CAST(CASE WHEN a > 0 AND b > 0 THEN 0 WHEN a < 0 AND b > 0 THEN 1 WHEN a < 0 AND b < 0 THEN 2 WHEN a > 0 AND b < 0 THEN 3 WHEN a < 0 AND b = 0 THEN 4 WHEN a = 0 AND b > 0 THEN 5 WHEN a = 0 AND b < 0 THEN 6 WHEN a > 0 AND b = 0 THEN 7 ELSE 8 END AS INTEGER) AS label FROM p)"""


def _quadrants(spark, d):
    x = rk.component_threshold(v.weights(spark, d), ["band", "compo"], "w")
    w = {c: F.max(F.when(F.col("compo") == c, F.col("w"))).alias(n) for c, n in ((1, "a"), (2, "b"))}
    return x.groupBy("band", "gch").agg(F.max("area").alias("area"), *w.values()).withColumn("label", cl.quadrant(F.col("a"), F.col("b")))


@query(_QUAD + " SELECT band, gch, label FROM q")
def quadrant_labels(spark, d):
    """CL1."""
    return _quadrants(spark, d).select("band", "gch", "label")


@query(_QUAD + " SELECT band, area, label, count(*) AS n FROM q WHERE label <> 8 GROUP BY ALL")
def quadrant_by_region(spark, d):
    """CL2, AG17."""
    return cl.label_histogram(_quadrants(spark, d), ["band", "area"], "label")


@query(_QUAD + " SELECT gch, label, count(DISTINCT band) AS n_bands, string_agg(CAST(band AS VARCHAR), ',' ORDER BY band) AS bands FROM q GROUP BY ALL HAVING count(DISTINCT band) >= 2")
def shared_label_bands(spark, d):
    """CL3."""
    return cl.shared_labels(_quadrants(spark, d), "gch", "band", "label")


@query(
    """WITH p AS (SELECT vec_id AS k, label AS l, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.k, a.l, b.l AS l2, avg(list_distance(a.v, b.v)) AS d FROM p a JOIN p b ON a.k <> b.k GROUP BY ALL),
s AS (SELECT k, max(d) FILTER (l = l2) AS a, min(d) FILTER (l <> l2) AS b FROM d GROUP BY k) SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM s"""
)
def silhouette(spark, d):
    """CL8, with the given labels."""
    return r(cl.silhouette(table(spark, d, "embeddings"), "vec_id", "embedding", "label"), "silhouette")


def _group_weights(spark, d):
    x = v.weights(spark, d)
    return x.groupBy("band", "gch").pivot("compo", [1, 2, 3]).agg(F.max("w")).withColumnsRenamed({"1": "c1", "2": "c2", "3": "c3"})


def _select_clusters(method):
    def f(spark, d):
        return cl.select_clusters(_group_weights(spark, d), ["band"], "gch", ["c1", "c2", "c3"], method).groupBy("band", "k", "cluster").agg(F.count("*").alias("n"), F.round(F.max("silhouette"), 5).alias("silhouette"))

    return f


QUERIES["kmeans_select"] = _select_clusters("kmeans")  # CL4, CL9
QUERIES["ward_select"] = _select_clusters("ward")  # CL6, CL7
QUERIES["spectral_select"] = _select_clusters("spectral")  # CL5


# ---- correlation ----

_LAG = W("sp") + ", l AS (SELECT CAST(x AS INTEGER) AS lag FROM range(-20, 21) t(x)), c AS (SELECT lag, corr(a.x, b.y) AS c, count(*) AS n FROM l JOIN sp b ON true JOIN sp a ON a.i = b.i + lag GROUP BY lag)"


@query(_LAG + " SELECT lag, round(c, 5) AS corr, n FROM c")
def lag_correlation(spark, d):
    """CC1."""
    return r(cc.lag_correlation(v.series_pair(spark, d), [], "i", "x", "y", range(-20, 21)), "corr")


@query(W("sp") + ", l AS (SELECT CAST(x AS INTEGER) AS lag FROM range(-20, 21) t(x)) SELECT lag, round(corr(a.x, b.y), 5) AS corr, count(*) AS n FROM l JOIN sp b ON true JOIN sp a ON a.i = (b.i + lag + 64) % 64 GROUP BY lag")
def lag_correlation_wrapped(spark, d):
    """CC1 with wrap."""
    return r(cc.lag_correlation(v.series_pair(spark, d), [], "i", "x", "y", range(-20, 21), wrap=True), "corr")


@query(_LAG + " SELECT lag, round(c, 5) AS corr FROM c ORDER BY c DESC, lag LIMIT 1")
def best_lag(spark, d):
    """CC2."""
    x = cc.lag_correlation(v.series_pair(spark, d), [], "i", "x", "y", range(-20, 21)).withColumn("one", F.lit(1))
    return r(cc.best_lag(x, ["one"]), "corr").drop("one")


@query(
    W("sp")
    + """, b AS (SELECT CAST(s * 8 AS INTEGER) AS start FROM range(10) t(s) WHERE s * 8 + 30 < 64), w AS (SELECT start, i, x, y FROM sp JOIN b ON i >= start AND i < start + 30), l AS (SELECT CAST(x AS INTEGER) AS lag FROM range(-5, 6) t(x))
SELECT a.start, lag, round(corr(a.x, c.y), 5) AS corr, count(*) AS n FROM l JOIN w c ON true JOIN w a ON a.start = c.start AND a.i = c.i + lag GROUP BY ALL"""
)
def rolling_lag_correlation(spark, d):
    """CC3, WN13."""
    x = rk.rolling_blocks(v.series_pair(spark, d), "i", 30, 8, 64)
    return r(cc.lag_correlation(x, ["start"], "i", "x", "y", range(-5, 6)), "corr")


_RANK = W("wt") + ", k AS (SELECT *, rank() OVER (PARTITION BY band, compo ORDER BY w) + (count(*) OVER (PARTITION BY band, compo, w) - 1) / 2.0 AS r FROM wt), s AS (SELECT 10 * band + compo AS s, gch, r FROM k), c AS (SELECT a.s AS i, b.s AS j, corr(a.r, b.r) AS rho FROM s a JOIN s b USING (gch) WHERE a.s {op} b.s GROUP BY ALL)"


def _rhos(spark, d, self=False):
    return cc.spearman(v.weights(spark, d).withColumn("s", 10 * F.col("band") + F.col("compo")), "s", "gch", "w", include_self=self)


@query(_RANK.format(op="<") + " SELECT round(avg(abs(rho)), 5) AS stability, count(*) AS n_pairs FROM c WHERE rho <> 0")
def spearman_stability(spark, d):
    """CC4."""
    return r(cc.stability(_rhos(spark, d)), "stability")


@query(_RANK.format(op="<=") + " SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(rho, 5) AS rho FROM c")
def spearman_matrix(spark, d):
    """CC5: rank correlations of all component pairs."""
    return r(_rhos(spark, d, self=True), "rho")


@query(
    W("ts")
    + """, k AS (SELECT subj, trial, ch_idx * 8 + t_idx AS i, rank() OVER (PARTITION BY subj, trial ORDER BY value) + (count(*) OVER (PARTITION BY subj, trial, value) - 1) / 2.0 AS r FROM ts),
c AS (SELECT a.subj, a.trial AS i, b.trial AS j, corr(a.r, b.r) AS rho FROM k a JOIN k b ON a.subj = b.subj AND a.i = b.i AND a.trial <= b.trial GROUP BY ALL)
SELECT subj, round(sum(CASE WHEN i = j THEN rho ELSE 2 * rho END) / count(DISTINCT i) ** 2, 5) AS mean_rho FROM c GROUP BY subj"""
)
def trial_spearman_mean(spark, d):
    """CC6: mean of the full matrix of a subject's trials, diagonal included."""
    x = v.trial_signal(spark, d).withColumn("i", F.col("ch_idx") * 8 + F.col("t_idx"))
    c = cc.spearman(x, "trial", "i", "value", ["subj"], include_self=True)
    return r(c.groupBy("subj").agg((F.sum(F.when(F.col("i") == F.col("j"), F.col("rho")).otherwise(2 * F.col("rho"))) / F.countDistinct("i") ** 2).alias("mean_rho")), "mean_rho")


@query(
    W("wt")
    + """, e AS (SELECT gch // 25 AS subj, avg(w) FILTER (band = 0 AND compo = 1) AS r11, avg(w) FILTER (band = 0 AND compo = 2) AS r12, avg(w) FILTER (band = 0 AND compo = 3) AS r13, avg(w) FILTER (band = 1 AND compo = 1) AS r21, avg(w) FILTER (band = 1 AND compo = 2) AS r22,
 avg(w) FILTER (band = 1 AND compo = 3) AS r23, avg(w) FILTER (band = 2 AND compo = 1) AS r31, avg(w) FILTER (band = 2 AND compo = 2) AS r32, avg(w) FILTER (band = 2 AND compo = 3) AS r33 FROM wt GROUP BY 1)
SELECT subj, CAST(CASE WHEN abs(r11) * 5 >= 0.7 THEN 1 WHEN greatest(abs(r11), abs(r12), abs(r13)) * 5 >= 0.6 THEN 3 WHEN greatest(abs(r21), abs(r22), abs(r23), abs(r31), abs(r32), abs(r33)) * 5 >= 0.6 THEN 2 ELSE 4 END AS INTEGER) AS category FROM e"""
)
def subject_category(spark, d):
    """CC7: the cascade on nine numbers of each subject."""
    cell = lambda b, c: F.avg(F.when((F.col("band") == b) & (F.col("compo") == c), F.col("w"))) * 5
    x = v.weights(spark, d).groupBy(F.expr("gch div 25").alias("subj")).agg(*[cell(b, c).alias(f"r{b + 1}{c}") for b in range(3) for c in (1, 2, 3)])
    return x.select("subj", cc.category({f"r{b}{c}": F.col(f"r{b}{c}") for b in (1, 2, 3) for c in (1, 2, 3)}).alias("category"))


@query(W("sp") + "SELECT a.i, b.i AS j, round(abs(a.x - b.x), 5) AS distance, abs(a.x - b.x) < 0.1 AS recurrent FROM sp a JOIN sp b ON true WHERE a.i < 63 AND b.i < 63")
def recurrence_matrix(spark, d):
    """CC8, JN13."""
    return r(cc.recurrence(v.series_pair(spark, d), [], "i", "x", 64), "distance")


@query(W("sp") + "SELECT a.i, b.i AS j, CAST(abs(a.x - b.x) < 0.1 AS INTEGER) - CAST(abs(a.y - b.y) < 0.1 AS INTEGER) AS diff FROM sp a JOIN sp b ON true WHERE a.i < 63 AND b.i < 63")
def recurrence_difference(spark, d):
    """CC9."""
    s = v.series_pair(spark, d)
    a = cc.recurrence(s, [], "i", "x", 64).select("i", "j", F.col("recurrent").cast("int").alias("r1"))
    b = cc.recurrence(s, [], "i", "y", 64).select("i", "j", F.col("recurrent").cast("int").alias("r2"))
    return a.join(b, ["i", "j"]).select("i", "j", (F.col("r1") - F.col("r2")).alias("diff"))


@query("SELECT a.vec_id, b.vec_id AS other, round(list_sum(list_transform(generate_series(1, 64), lambda i: abs(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE)))), 4) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE b.vec_id % 20 = 0")
def manhattan_pairs(spark, d):
    """CC11: every vector against the stated query set (ids divisible by 20)."""
    e = table(spark, d, "embeddings")
    return r(cc.manhattan(e, "vec_id", "embedding", e.where("vec_id % 20 = 0")), "distance", to=4)


def dtw_path(spark, d):
    """CC10: distance and path length for the series of neighbouring vectors."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return r(cc.dtw_pairs(e.join(nxt, "vec_id"), ["vec_id"], "a", "b"), "distance")


QUERIES["dtw_path"] = dtw_path


@query(
    W("sp")
    + ", g AS (SELECT i, CASE WHEN i % 4 = 0 THEN x END AS v FROM sp), f AS (SELECT i, v, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER a AS pi, last_value(v IGNORE NULLS) OVER a AS pv, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ni, first_value(v IGNORE NULLS) OVER b AS nv FROM g WINDOW a AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT i, round(coalesce(v, CASE WHEN ni IS NULL THEN pv ELSE pv + (nv - pv) * (i - pi) / (ni - pi) END), 5) AS value FROM f"
)
def gap_filled(spark, d):
    """CC10: linear filling of missing points."""
    x = v.series_pair(spark, d).select("i", F.when(F.col("i") % 4 == 0, F.col("x")).alias("value"), F.lit(1).alias("one"))
    return r(cc.fill_gaps(x, ["one"], "i", "value"), "value").select("i", "value")


# ---- set operations ----

_SETS = "WITH a AS (SELECT DISTINCT subj FROM electrodes), b AS (SELECT DISTINCT subj FROM bad_segments WHERE description = 'spike')"


@query(_SETS + " SELECT subj, 'a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT subj, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def symmetric_difference(spark, d):
    """ST1, ST2, ST3."""
    a = table(spark, d, "electrodes").select("subj").distinct()
    b = table(spark, d, "bad_segments").where("description = 'spike'").select("subj").distinct()
    one = a.where("subj is not null").join(b, "subj", "left_anti").withColumn("side", F.lit("a"))
    return one.unionByName(b.where("subj is not null").join(a, "subj", "left_anti").withColumn("side", F.lit("b")))


# ---- pseudo-trials and decoding ----

_SLOT = W("ts") + """, u AS (SELECT DISTINCT subj, cond, trial FROM ts), o AS (SELECT *, row_number() OVER (PARTITION BY subj, cond ORDER BY trial) AS slot FROM u), n AS (SELECT subj, cond, count(*) AS n FROM o WHERE slot <= 23 GROUP BY ALL),
g AS (SELECT subj, cond, n, s AS slot FROM n, generate_series(1, 23) t(s)), x AS (SELECT ts.*, slot FROM ts JOIN o USING (subj, cond, trial) WHERE slot <= 23)"""


def _pad(method):
    def f(spark, d):
        x = dc.pad(v.trial_signal(spark, d), "subj", "cond", "trial", ["ch_idx", "t_idx"], "value", 23, method)
        return r(x, "value").withColumn("slot", F.col("slot").cast("int")).select("subj", "cond", "slot", "ch_idx", "t_idx", "value", "is_real")

    return f


QUERIES["pad_mean"], QUERIES["pad_pooled"], QUERIES["pad_duplicate"] = _pad("mean"), _pad("pooled"), _pad("duplicate")
_REAL = " SELECT subj, cond, CAST(slot AS INTEGER) AS slot, ch_idx, t_idx, round(value, 5) AS value, true AS is_real FROM x UNION ALL "
SQL["pad_mean"] = unsigned_zeros(_SLOT + _REAL + "SELECT g.subj, g.cond, CAST(g.slot AS INTEGER), ch_idx, t_idx, round(m, 5), false FROM g JOIN (SELECT subj, cond, ch_idx, t_idx, avg(value) AS m FROM ts GROUP BY ALL) q USING (subj, cond) WHERE g.slot > n")
SQL["pad_pooled"] = unsigned_zeros(_SLOT + _REAL + "SELECT g.subj, g.cond, CAST(g.slot AS INTEGER), ch_idx, t_idx, round(m, 5), false FROM g JOIN (SELECT subj, ch_idx, t_idx, avg(value) AS m FROM ts GROUP BY ALL) q USING (subj) WHERE g.slot > n")
SQL["pad_duplicate"] = unsigned_zeros(_SLOT + " SELECT g.subj, g.cond, CAST(g.slot AS INTEGER) AS slot, ch_idx, t_idx, round(value, 5) AS value, g.slot <= n AS is_real FROM g JOIN x ON x.subj = g.subj AND x.cond = g.cond AND x.slot = (g.slot - 1) % n + 1")


@query(W("ts") + "SELECT subj, cond, count(DISTINCT trial) AS n_trials, greatest(count(DISTINCT trial) - 23, 0) AS n_beyond FROM ts GROUP BY ALL")
def slot_overflow(spark, d):
    """DC1: trials of each condition, and those beyond its slots, which padding leaves out."""
    n = F.countDistinct("trial")
    return v.trial_signal(spark, d).groupBy("subj", "cond").agg(n.alias("n_trials"), F.greatest(n - 23, F.lit(0)).alias("n_beyond"))


@query(_SLOT + " SELECT subj, cond, round(avg(CASE WHEN slot <= n THEN 1.0 ELSE 0.0 END), 5) AS real_share FROM g GROUP BY ALL")
def truth_share(spark, d):
    """AG14."""
    x = dc.pad(v.trial_signal(spark, d), "subj", "cond", "trial", ["ch_idx", "t_idx"], "value")
    return r(ag.real_share(x.select("subj", "cond", "slot", "is_real").distinct(), ["subj", "cond"], "is_real"), "real_share")


_GW = ", gw AS (SELECT CAST(gch AS INTEGER) AS ch_idx, compo, w AS weight FROM wt WHERE band = 0 AND gch < 8)"


def _given_weights(spark, d):
    return v.weights(spark, d).where("band = 0 and gch < 8").select(F.col("gch").cast("int").alias("ch_idx"), "compo", F.col("w").alias("weight"))


@query(W("ts", "wt") + _GW + ", c AS (SELECT subj, cond, ch_idx, t_idx, avg(value) AS v FROM ts GROUP BY ALL) SELECT subj, compo, cond, t_idx, round(sum(weight * v), 4) AS score FROM c JOIN gw USING (ch_idx) GROUP BY ALL")
def project_conditions(spark, d):
    """LA6."""
    c = ag.condition_mean(v.trial_signal(spark, d), "cond", [1, 2], ["subj", "ch_idx", "t_idx"], "value")
    return r(la.project(c, _given_weights(spark, d), ["ch_idx"], ["subj", "compo", "cond", "t_idx"], "value"), "score", to=4)


@query(_SLOT.replace(W("ts"), W("ts", "wt") + _GW) + " SELECT compo, cond, CAST(slot AS INTEGER) AS slot, t_idx, round(sum(weight * value), 3) AS score FROM x JOIN gw USING (ch_idx) GROUP BY ALL")
def project_trials(spark, d):
    """LA7, JN12: slots of all subjects side by side."""
    x = v.trial_signal(spark, d)
    ids = rk.slots(x.select("subj", "cond", "trial").distinct(), ["subj", "cond"], ["trial"]).where("slot <= 23")
    return r(la.project(x.join(broadcast_if_small(ids), ["subj", "cond", "trial"]), _given_weights(spark, d), ["ch_idx"], ["compo", "cond", "slot", "t_idx"], "value"), "score", to=3)


@query(W("ts", "wt") + _GW + " SELECT subj, trial, compo, t_idx, round(sum(weight * value), 4) AS score FROM ts JOIN gw USING (ch_idx) GROUP BY ALL")
def project_subject(spark, d):
    """LA8."""
    return r(la.project(v.trial_signal(spark, d), _given_weights(spark, d), ["ch_idx"], ["subj", "trial", "compo", "t_idx"], "value"), "score", to=4)


@query(
    W("ts")
    + """, h AS (SELECT subj, cond, arg_min(trial, md5('42|' || subj || '|' || trial)) AS trial, true AS held FROM (SELECT DISTINCT subj, cond, trial FROM ts) GROUP BY ALL), a AS (SELECT ts.*, coalesce(held, false) AS held FROM ts LEFT JOIN h USING (subj, cond, trial)),
m AS (SELECT t_idx, avg(value) AS m, stddev_pop(value) AS s FROM a WHERE NOT held GROUP BY ALL) SELECT subj, trial, ch_idx, t_idx, round((value - m) / s, 5) AS value FROM a JOIN m USING (t_idx) WHERE held"""
)
def standardise_train_test(spark, d):
    """DC18."""
    x = v.trial_signal(spark, d)
    h = broadcast_if_small(rk.hold_out(x.select("subj", "cond", "trial").distinct(), ["subj", "cond"], ["subj", "trial"], 42))
    z = dc.standardise(x.join(h, ["subj", "cond", "trial"], "left_anti"), x.join(h, ["subj", "cond", "trial"], "left_semi"), "t_idx", "value")
    return r(z, "value").select("subj", "trial", "ch_idx", "t_idx", "value")


_MET = """avg(CAST(y = pred AS DOUBLE)) AS accuracy, 2.0 * count(*) FILTER (y = 1 AND pred = 1) / (count(*) FILTER (y = 1) + count(*) FILTER (pred = 1)) AS f1,
 (2.0 * count(*) FILTER (y = 1 AND pred = 1) / (count(*) FILTER (y = 1) + count(*) FILTER (pred = 1)) + 2.0 * count(*) FILTER (y = 2 AND pred = 2) / (count(*) FILTER (y = 2) + count(*) FILTER (pred = 2))) / 2 AS macro_f1,
 -avg(ln(CASE WHEN y = 2 THEN p2 ELSE 1 - p2 END)) AS log_loss"""


@query(W("pr") + f"SELECT run, round(accuracy, 5) AS accuracy, round(f1, 5) AS f1, round(macro_f1, 5) AS macro_f1, round(log_loss, 5) AS log_loss FROM (SELECT run, {_MET} FROM pr GROUP BY run)")
def decode_metrics(spark, d):
    """DC16."""
    return r(dc.metrics(v.predictions(spark, d), ["run"], "y", "pred", "p2"), "accuracy", "f1", "macro_f1", "log_loss")


@query(W("pr") + f"SELECT round(avg(accuracy), 5) AS acc_mean, round(stddev_pop(accuracy), 5) AS acc_std, round(avg(macro_f1), 5) AS f1_mean, round(stddev_pop(macro_f1), 5) AS f1_std FROM (SELECT run, {_MET} FROM pr GROUP BY run)")
def classifier_summary(spark, d):
    """DC12."""
    m = dc.metrics(v.predictions(spark, d), ["run"], "y", "pred", "p2")
    return r(m.agg(F.avg("accuracy").alias("acc_mean"), F.stddev_pop("accuracy").alias("acc_std"), F.avg("macro_f1").alias("f1_mean"), F.stddev_pop("macro_f1").alias("f1_std")), "acc_mean", "acc_std", "f1_mean", "f1_std")


_PERM = W("pr") + """, x AS (SELECT perm, id, y, pred, p2 FROM pr, range(5) t(perm)), a AS (SELECT perm, id, pred, p2, row_number() OVER (PARTITION BY perm ORDER BY id) AS r FROM x),
b AS (SELECT perm, y, row_number() OVER (PARTITION BY perm ORDER BY md5('0|' || perm || '|' || id), id) AS r FROM x), m AS (SELECT a.perm, avg(CAST(b.y = pred AS DOUBLE)) AS acc, -avg(ln(CASE WHEN b.y = 2 THEN p2 ELSE 1 - p2 END)) AS ent FROM a JOIN b ON a.perm = b.perm AND a.r = b.r GROUP BY a.perm)"""


def _null_metrics(spark, d):
    p = v.predictions(spark, d)
    x = dc.permuted_labels(p, "id", "y", 5).join(p.select("id", "pred", "p2"), "id")
    return dc.metrics(x, ["perm"], "y_perm", "pred", "p2")


@query(_PERM + " SELECT CAST(perm AS INTEGER) AS perm, round(acc, 5) AS accuracy FROM m")
def null_accuracy(spark, d):
    """DC14, DC6, DC19."""
    return r(_null_metrics(spark, d).select("perm", "accuracy"), "accuracy")


@query(_PERM + " SELECT CAST(perm AS INTEGER) AS perm, round(ent, 5) AS log_loss FROM m")
def null_entropy(spark, d):
    """DC14."""
    return r(_null_metrics(spark, d).select("perm", "log_loss"), "log_loss")


@query(_PERM + ", o AS (SELECT avg(CAST(y = pred AS DOUBLE)) AS acc FROM pr) SELECT round(avg(CAST(m.acc >= o.acc AS DOUBLE)), 5) AS raw, round((1.0 + count(*) FILTER (m.acc >= o.acc)) / (1 + count(*)), 5) AS corrected FROM m, o")
def perm_pvalue(spark, d):
    """DC17."""
    return r(dc.p_value(_null_metrics(spark, d), dc.metrics(v.predictions(spark, d), [], "y", "pred"), [], "accuracy"), "raw", "corrected")


@query("SELECT band, CAST(pc AS INTEGER) AS pc_use FROM (VALUES ('delta'), ('theta'), ('alpha'), ('low_beta'), ('high_beta'), ('low_gamma'), ('high_gamma'), ('broadband')) b(band) CROSS JOIN range(3) t(pc)")
def parameter_grid(spark, d):
    """OR3: combinations of band and component that runs are keyed by."""
    bands = spark.createDataFrame([(b,) for b in [*dims.BANDS, "broadband"]], "band string")
    return bands.crossJoin(F.broadcast(spark.range(3).select(F.col("id").cast("int").alias("pc_use"))))  # fixed dimensions


@query("SELECT subj, CASE WHEN n_rec = 0 THEN 'no events' WHEN n < 24 THEN 'too few events' ELSE 'ok' END AS status FROM (SELECT i.subj, count(e.rec_id) AS n_rec, count(e.code) AS n FROM (SELECT DISTINCT subj FROM info) i LEFT JOIN (SELECT DISTINCT subj, rec_id, sample, code FROM event) e ON e.subj = i.subj GROUP BY i.subj)")
def subject_status(spark, d):
    """OR2: status rows instead of exceptions."""
    e = table(spark, d, "event").select("subj", "rec_id", "sample", "code").distinct()
    g = table(spark, d, "info").select("subj").distinct().join(e, "subj", "left").groupBy("subj").agg(F.count("rec_id").alias("n_rec"), F.count("code").alias("n"))
    return g.select("subj", F.when(F.col("n_rec") == 0, "no events").when(F.col("n") < 24, "too few events").otherwise("ok").alias("status"))


@query(W("wt") + "SELECT band, compo, round(sum(w * cos(2 * pi() * gch / n)), 4) AS x, round(sum(w * sin(2 * pi() * gch / n)), 4) AS y FROM wt, (SELECT count(DISTINCT gch) AS n FROM wt) GROUP BY ALL")
def polar_sums(spark, d):
    """LA9, FG: angle-weighted sums behind the polar views."""
    w = v.weights(spark, d)
    return r(la.polar(w, ["band", "compo"], "gch", "w", w.select("gch").distinct().count()), "x", "y", to=4)


# ---- models: checked by invariants in the tests ----


def _concat(spark, d):
    """Condition means by subject, with condition and time as one axis (TS7)."""
    c = ag.condition_mean(v.trial_signal(spark, d), "cond", [1, 2], ["subj", "ch_idx", "t_idx"], "value")
    return c.withColumn("tt", ((F.col("cond") - 1) * 8 + F.col("t_idx")).cast("int"))


@query()
def pca_components(spark, d):
    """LA1, LA2."""
    return r(la.pca(_concat(spark, d), ["subj"], "ch_idx", "tt", "value")[0], "weight")


@query(W("ts") + ", s AS (SELECT DISTINCT subj FROM ts) SELECT subj, CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, CASE WHEN a = b THEN 1.0 ELSE 0.0 END::DOUBLE AS dot FROM s, generate_series(1, 3) i(a), generate_series(1, 3) j(b)")
def pca_orthogonality(spark, d):
    """LA1: the components' weights are of unit length and at right angles."""
    w = la.pca(_concat(spark, d), ["subj"], "ch_idx", "tt", "value")[0]
    a = w.select("subj", "ch_idx", F.col("compo").alias("a"), F.col("weight").alias("wa"))
    b = w.select("subj", "ch_idx", F.col("compo").alias("b"), F.col("weight").alias("wb"))
    return r(a.join(b, ["subj", "ch_idx"]).groupBy("subj", "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot")), "dot")


@query(
    W("ts")
    + """, m AS (SELECT subj, ch_idx, (cond - 1) * 8 + t_idx AS tt, avg(value) AS v FROM ts GROUP BY ALL), c AS (SELECT subj, ch_idx, v - avg(v) OVER (PARTITION BY subj, ch_idx) AS v FROM m)
SELECT subj, round(sum(v * v), 4) AS variance FROM c GROUP BY subj"""
)
def pca_total_variance(spark, d):
    """LA1, LA10: all components' squared scores add up to the centred channels' sum of squares."""
    s = la.pca(_concat(spark, d), ["subj"], "ch_idx", "tt", "value", 8)[1]
    return r(s.groupBy("subj").agg(F.sum(F.col("score") ** 2).alias("variance")), "variance", to=4)


@query()
def pca_scores(spark, d):
    """LA1."""
    return r(la.pca(_concat(spark, d), ["subj"], "ch_idx", "tt", "value")[1], "score")


@query()
def pca_explained(spark, d):
    """LA10: explained variance, conditions concatenated and averaged."""
    a = la.pca(_concat(spark, d), ["subj"], "ch_idx", "tt", "value", 5)[2].withColumn("input", F.lit("concat"))
    g = ag.grand_mean(v.trial_signal(spark, d), "cond", ["subj", "ch_idx", "t_idx"], "value")
    b = la.pca(g, ["subj"], "ch_idx", "t_idx", "value", 5)[2].withColumn("input", F.lit("mean"))
    return r(a.unionByName(b), "ratio")


@query()
def group_pca(spark, d):
    """LA3: all subjects' channels in one matrix; the Gram matrix is time x time."""
    x = _concat(spark, d).withColumn("one", F.lit(1)).withColumn("gch", (F.col("subj") * 8 + F.col("ch_idx")).cast("int"))
    return r(la.pca(x, ["one"], "gch", "tt", "value")[0], "weight").drop("one")


@query()
def pca_project_back(spark, d):
    """LA5, LA6: weights fitted on the grand mean, each condition projected."""
    g = ag.grand_mean(v.trial_signal(spark, d), "cond", ["subj", "ch_idx", "t_idx"], "value")
    w = la.pca(g, ["subj"], "ch_idx", "t_idx", "value")[0]
    c = ag.condition_mean(v.trial_signal(spark, d), "cond", [1, 2], ["subj", "ch_idx", "t_idx"], "value")
    return r(la.project(c, w, ["subj", "ch_idx"], ["subj", "compo", "cond", "t_idx"], "value"), "score")


@query()
def pca_trajectory(spark, d):
    """LA11."""
    return r(la.trajectory(la.pca(_concat(spark, d), ["subj"], "ch_idx", "tt", "value")[1], ["subj"], "tt"), "x", "y")


@query()
def nmf_components(spark, d):
    """LA4."""
    return r(la.nmf(_concat(spark, d), ["subj"], "ch_idx", "tt", "value")[0], "weight", "error")


@query()
def nmf_scores(spark, d):
    """LA4: the components over time."""
    return r(la.nmf(_concat(spark, d), ["subj"], "ch_idx", "tt", "value")[1], "score")


#: Iterations of the decoding runs, each with its own held-out trials; the reference's number.
ITERATIONS = 100


def _super(spark, d, iterations=ITERATIONS, **kw):
    """Series, hold-outs, features and PCA weights of the super-subject (DC3)."""
    s = su.trial_series(v.trial_signal(spark, d))
    h = su.hold_outs(s, iterations)
    return s, h, *su.super_features(s, h, **kw)


_BOTH = """, e AS (SELECT subj FROM (SELECT DISTINCT subj, cond, trial FROM ts) GROUP BY subj HAVING count(*) FILTER (cond = 1) >= 2 AND count(*) FILTER (cond = 2) >= 2),
h AS (SELECT CAST(i AS INTEGER) AS iter, subj, cond, arg_min(trial, md5(i || '|' || subj || '|' || trial)) AS trial FROM (SELECT DISTINCT subj, cond, trial FROM ts JOIN e USING (subj)), range({n}) r(i) GROUP BY ALL)"""


@query(W("ts") + _BOTH.format(n=ITERATIONS) + " SELECT * FROM h")
def super_hold_outs(spark, d):
    """DC3: the trials that each iteration holds out."""
    return su.hold_outs(su.trial_series(v.trial_signal(spark, d)), ITERATIONS)


@query(
    W("ts", "wt") + _GW + _BOTH.format(n=3)
    + """, u AS (SELECT DISTINCT iter, ts.subj, ts.cond, ts.trial FROM ts JOIN e USING (subj), range(3) r(iter)), l AS (SELECT u.* FROM u ANTI JOIN h ON u.iter = h.iter AND u.subj = h.subj AND u.cond = h.cond AND u.trial = h.trial),
o AS (SELECT *, row_number() OVER (PARTITION BY iter, subj, cond ORDER BY trial) AS slot FROM l), n AS (SELECT iter, subj, cond, least(count(*), 23) AS n FROM o GROUP BY ALL),
m AS (SELECT iter, subj, cond, ch_idx, t_idx, avg(value) AS value FROM l JOIN ts USING (subj, cond, trial) GROUP BY ALL),
x AS (SELECT iter, subj, cond, slot - 1 + 23 * (cond - 1) AS row, ch_idx, t_idx, value FROM o JOIN ts USING (subj, cond, trial) WHERE slot <= 23
 UNION ALL SELECT n.iter, n.subj, n.cond, s - 1 + 23 * (n.cond - 1), ch_idx, t_idx, value FROM n JOIN m USING (iter, subj, cond), generate_series(1, 23) g(s) WHERE s > n
 UNION ALL SELECT iter, subj, cond, 45 + cond, ch_idx, t_idx, value FROM h JOIN ts USING (subj, cond, trial))
SELECT CAST(iter AS INTEGER) AS iter, CAST(compo - 1 AS INTEGER) AS compo, CAST(row AS INTEGER) AS row, t_idx, round(sum(weight * value), 4) AS score FROM x JOIN gw USING (ch_idx) GROUP BY ALL"""
)
def super_given_weights(spark, d):
    """DC1, DC3: pseudo-trials and held-out trials of three iterations, projected with given weights."""
    s = su.trial_series(v.trial_signal(spark, d))
    given = {}
    for w in _given_weights(spark, d).collect():  # eight channels of three components
        given.setdefault(w.ch_idx, [0.0] * 3)[w.compo - 1] = w.weight
    f, _ = su.super_features(s, su.hold_outs(s, 3), given=given)
    return r(f.select("iter", "compo", "row", F.posexplode("series").alias("t_idx", "score")), "score", to=4)


@query()
def super_weights(spark, d):
    """DC3: the group PCA's weights of every iteration, by subject."""
    return _super(spark, d)[3].where("perm = 0").select("iter", "compo", "subj", F.posexplode("weights").alias("channel", "weight"), "real_share")


@query()
def decode_lr(spark, d):
    """DC5, DC6: one model an iteration and component, features are time points; one refit with shuffled labels in each."""
    return r(su.decode_iterations(_super(spark, d)[2], perms=1), "accuracy", "log_loss", "p2_1", "p2_2")


@query()
def decode_lr_summary(spark, d):
    """DC5, CC4: by component, with the stability of its weights over iterations."""
    _, _, f, w = _super(spark, d)
    runs = su.decode_iterations(f)
    # each iteration predicts one trial of either condition, so hits and predictions of label 1 give the F1
    hit1, pred1 = F.sum((F.col("pred_1") == 1).cast("int")), F.sum((F.col("pred_1") == 1).cast("int") + (F.col("pred_2") == 1).cast("int"))
    s = runs.groupBy("compo").agg(
        F.count("*").cast("int").alias("nb_iter"), (2 * hit1 / (F.count("*") + pred1)).alias("f1"), F.avg("accuracy").alias("accuracy"), F.avg("log_loss").alias("log_loss"),
        pred1.alias("predicted_1"), (2 * F.count("*") - pred1).alias("predicted_2"),
    )
    truth = w.where("perm = 0").groupBy("compo").agg(F.avg("real_share").alias("trial_truth"))
    return r(s.join(F.broadcast(su.stability(w)), "compo").join(F.broadcast(truth), "compo"), "f1", "accuracy", "log_loss", "mean_cor", "trial_truth")  # one row a component


@query()
def decode_per_time(spark, d):
    """DC7: one model a time point and component, over all iterations."""
    return r(su.decode_times(_super(spark, d)[2]), "accuracy", "accuracy_std")


@query()
def decode_per_time_components(spark, d):
    """DC8: one model a time point, features are the three components."""
    return r(su.decode_times(_super(spark, d, pca="mean")[2], together=True), "accuracy", "accuracy_std")


@query()
def decode_per_time_raw(spark, d):
    """DC8, DC4: one model a time point, features are all subjects' channels."""
    s = su.trial_series(v.trial_signal(spark, d))
    return r(su.decode_times_raw(s, su.hold_outs(s, ITERATIONS)), "accuracy", "accuracy_std")


@query()
def temporal_generalisation(spark, d):
    """DC9: fitted at one time, scored at all, by four folds and component."""
    return r(su.generalisation(su.component_rows(_super(spark, d, 1)[2]), ["compo"], 4), "accuracy")


@query()
def temporal_generalisation_raw(spark, d):
    """DC10, DC4: the same with all subjects' channels and five folds."""
    s = su.trial_series(v.trial_signal(spark, d))
    return r(su.generalisation(su.raw_rows(s, su.hold_outs(s, 1)), [], 5), "accuracy")


@query()
def compare_classifiers(spark, d):
    """DC11: five tuned classifiers in every iteration, on the first component."""
    return r(su.compare_models(_super(spark, d)[2].where("compo = 0")), "accuracy", "macro_f1")


@query()
def compare_classifiers_summary(spark, d):
    """DC12: mean and deviation by classifier, true labels beside shuffled ones."""
    f = _super(spark, d)[2].where("compo = 0")
    both = su.compare_models(f).withColumn("labels", F.lit("true")).unionByName(su.compare_models(f, shuffled=True).withColumn("labels", F.lit("shuffled")))
    s = both.groupBy("model", "labels").agg(F.avg("accuracy").alias("acc_mean"), F.stddev_pop("accuracy").alias("acc_std"), F.avg("macro_f1").alias("f1_mean"), F.stddev_pop("macro_f1").alias("f1_std"))
    return r(s, "acc_mean", "acc_std", "f1_mean", "f1_std")


@query()
def permutation_distribution(spark, d):
    """DC13: accuracy and entropy of repeated runs, true labels beside shuffled ones; a repeat is a block of iterations."""
    runs = su.decode_iterations(_super(spark, d, 3 * ITERATIONS)[2].where("compo = 0"), perms=1)
    by = runs.withColumn("repeat", F.floor(F.col("iter") / ITERATIONS).cast("int")).groupBy("repeat", "perm").agg(F.avg("accuracy").alias("accuracy"), F.avg("log_loss").alias("entropy"))
    pick = lambda j, c: F.max(F.when(F.col("perm") == j, F.col(c)))
    return r(by.groupBy("repeat").agg(pick(0, "accuracy").alias("acc"), pick(1, "accuracy").alias("acc_p"), pick(0, "entropy").alias("entropy"), pick(1, "entropy").alias("entropy_p")), "acc", "acc_p", "entropy", "entropy_p")


@query()
def permutation_final(spark, d):
    """DC15: z-scaled features, group PCA and labels of the permuted run both dealt again, in every iteration and component."""
    f = _super(spark, d, perms=1)[2]
    return r(su.decode_iterations(f, perms=1, refit_pca=True, scale=True), "accuracy", "log_loss", "p2_1", "p2_2")


def _series(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("series"))


@query(
    """WITH e AS (SELECT vec_id, CAST(p - 1 AS INTEGER) AS i, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, generate_series(1, 64) g(p)), f AS (SELECT * FROM (VALUES (0, 10.0::DOUBLE), (1, 20.0::DOUBLE), (2, 40.0::DOUBLE)) t(freq_idx, f)),
s AS (SELECT freq_idx, f, 4.0 / (2 * pi() * f) AS s FROM f), k AS (SELECT freq_idx, f, s, CAST(u AS INTEGER) AS u, exp(-((u / 200.0) ** 2) / (2 * s * s)) AS g FROM s, generate_series(-400, 400) r(u) WHERE abs(u) <= ceil(5 * s * 200)),
n AS (SELECT freq_idx, sqrt(0.5) * sqrt(sum(g * g)) AS norm FROM k GROUP BY 1),
w AS (SELECT freq_idx, u, g / norm * cos(2 * pi() * f * u / 200.0) AS re, g / norm * sin(2 * pi() * f * u / 200.0) AS im FROM k JOIN n USING (freq_idx))
SELECT vec_id, CAST(freq_idx AS INTEGER) AS freq_idx, CAST(t AS INTEGER) AS t_idx, round(sum(v * re) ** 2 + sum(v * im) ** 2, 5) AS power FROM e, generate_series(0, 63) r(t) JOIN w ON w.u = t - e.i GROUP BY ALL"""
)
def morlet_power(spark, d):
    """SP1: each vector as a series at 200 Hz."""
    fs = [10.0, 20.0, 40.0]
    return r(sp.tfr(_series(spark, d), ["vec_id"], 200.0, fs, [4.0] * 3).select("vec_id", "freq_idx", F.posexplode("power").alias("t_idx", "power")), "power")


@query(
    """WITH e AS (SELECT vec_id, p - 1 AS i, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, generate_series(1, 64) g(p)),
k AS (SELECT i, j, (1 + sum(2 * cos(2 * pi() * q * (j / 21.0 - i / 64.0)))) / 64 AS w FROM generate_series(0, 63) a(i), generate_series(0, 20) b(j), generate_series(1, 10) c(q) GROUP BY ALL)
SELECT vec_id, CAST(j AS INTEGER) AS t_idx, round(sum(v * w), 5) AS value FROM e JOIN k USING (i) GROUP BY ALL"""
)
def resample_fft(spark, d):
    """TS2: to a third of the points."""
    return r(sp.resampled(_series(spark, d), ["vec_id"], 1 / 3).select("vec_id", F.posexplode("series").alias("t_idx", "value")), "value")


@query()
def notch_filter(spark, d):
    """TS3: high-pass and line harmonics."""
    return sp.filtered(_series(spark, d), ["vec_id"], 600.0, 0.1, sh.line_harmonics(300.0, 50.0)).select("vec_id", F.posexplode("series").alias("t_idx", "value")).withColumn("value", F.round("value", 5))


_PEAK = """WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS file, CAST(p - 1 AS INTEGER) AS i, CAST(embedding[p] AS DOUBLE) AS a FROM embeddings, generate_series(1, 64) g(p)),
s AS (SELECT file, i, (-3 * lag(a, 2) OVER w + 12 * lag(a) OVER w + 17 * a + 12 * lead(a) OVER w - 3 * lead(a, 2) OVER w) / 35 AS a FROM e WINDOW w AS (PARTITION BY file ORDER BY i)),
r AS (SELECT arg_max(i, a) AS ref_peak, max(a) AS ref_value FROM s WHERE file = '0'), x AS (SELECT *, lag(a) OVER w AS b, lead(a) OVER w AS c FROM s WINDOW w AS (PARTITION BY file ORDER BY i)),
g AS (SELECT file, ref_peak, min(CASE WHEN a > b AND a > c AND a >= ref_value - 1 THEN i END) AS peak FROM x, r GROUP BY ALL),
d AS (SELECT file, peak, CASE WHEN abs(ref_peak - peak) < 2 THEN 0 ELSE ref_peak - peak END AS delay FROM g)"""


def _peaks(spark, d):
    from sigloom.operators import audio

    x = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("file"), F.posexplode("embedding").alias("i", "a")).withColumn("a", F.col("a").cast("double"))
    return x, audio.peak_delay(audio.savgol(x, ["file"], "i", "a", 5, 2), "file", "i", "a", "0", tolerance=1.0, least=2)


@query(_PEAK + " SELECT file, peak, delay FROM d")
def peak_delay(spark, d):
    """TS11: delays of every series against vector 0, after smoothing."""
    return _peaks(spark, d)[1]


@query(_PEAK + " SELECT file, i - abs(delay) AS i, round(a, 5) AS a FROM e JOIN d USING (file) WHERE i - abs(delay) >= 0")
def aligned_series(spark, d):
    """TS12: every series moved by its delay."""
    from sigloom.operators import audio

    x, delays = _peaks(spark, d)
    return r(audio.align(x, delays, "file", "i"), "a").select("file", "i", "a")


# ---- further projections and sources ----


@query("SELECT DISTINCT row_id, compo, freq FROM grp_concat_compo_pca3 WHERE compo = 'compo1' AND freq IN ('theta', 'alpha')")
def select_components(spark, d):
    """FLT5, FLT6, FLT7: conjunctions of equality and membership."""
    x = table(spark, d, "grp_concat_compo_pca3").where("compo = 'compo1'").where(F.col("freq").isin("theta", "alpha"))
    return x.select("row_id", "compo", "freq").distinct()


@query(W("ts") + "SELECT subj, trial, ch_idx, t_idx, round(value, 5) AS value FROM ts SEMI JOIN (SELECT DISTINCT subj, CAST(subj % 8 AS INTEGER) AS ch_idx FROM ts) k USING (subj, ch_idx)")
def select_channels(spark, d):
    """FLT8: channels picked by an index list of each subject."""
    x = v.trial_signal(spark, d)
    picks = x.select("subj", (F.col("subj") % 8).alias("ch_idx")).distinct()
    return r(x.join(broadcast_if_small(picks), ["subj", "ch_idx"], "left_semi"), "value").select("subj", "trial", "ch_idx", "t_idx", "value")


_POSITIONED = "x is not null and y is not null and z is not null"


@query(f"SELECT DISTINCT coord_id, channel AS contact, x * 1000 AS x_um, y * 1000 AS y_um, z * 1000 AS z_um FROM coords WHERE {_POSITIONED}")
def derive_columns(spark, d):
    """FLT10, FLT11: rename, drop, scale."""
    x = table(spark, d, "coords").where(_POSITIONED)
    return x.select("coord_id", F.col("channel").alias("contact"), *[(F.col(c) * 1000).alias(f"{c}_um") for c in "xyz"]).distinct()


_NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"


@query(
    f"SELECT DISTINCT coord_id, TRY_CAST(n[1] AS DOUBLE) AS x, TRY_CAST(n[2] AS DOUBLE) AS y, TRY_CAST(n[3] AS DOUBLE) AS z FROM (SELECT coord_id, regexp_extract_all('<point | contact : (' || x || ', ' || y || ', ' || z || ') mm>', '{_NUMBER}') AS n FROM coords WHERE {_POSITIONED})"
)
def printed_points(spark, d):
    """SRC10: coordinates read back from printed points, small and large ones with an exponent."""
    from sigloom.sources.readers import decimals

    p = F.concat(F.lit("<point | contact : ("), F.col("x").cast("string"), F.lit(", "), F.col("y").cast("string"), F.lit(", "), F.col("z").cast("string"), F.lit(") mm>"))
    return table(spark, d, "coords").where(_POSITIONED).select("coord_id", *decimals(p)).distinct()


@query("SELECT DISTINCT freq, regexp_extract('TFR_' || freq || '_all.parquet', 'TFR_(.+)_all', 1) AS band FROM grp_concat_compo_pca3 WHERE freq IS NOT NULL AND regexp_full_match(freq, '[a-z_]+')")
def band_from_file_name(spark, d):
    """SRC9: the band's name in a file's name."""
    from sigloom.sources.readers import name_part

    x = table(spark, d, "grp_concat_compo_pca3").where("freq rlike '^[a-z_]+$'").select("freq").distinct()
    return x.select("freq", name_part(F.concat(F.lit("/data/TFR_"), F.col("freq"), F.lit("_all.parquet")), r"TFR_(.+)_all").alias("band"))


@query("SELECT subj, label, count(DISTINCT electrode) AS n FROM electrodes WHERE label IN (SELECT area_code FROM area_ref) GROUP BY ALL")
def contacts_by_area(spark, d):
    """AG7, JN11: counts by area after a key join."""
    ref = table(spark, d, "area_ref").select(F.col("area_code").alias("label"))
    x = table(spark, d, "electrodes").join(broadcast_if_small(ref), "label", "left_semi")
    return x.groupBy("subj", "label").agg(F.countDistinct("electrode").alias("n"))


@query()
def preprocess_pipeline(spark, d):
    """OR1: raw signal to condition means by band, one job over all subjects."""
    from sigloom.plans import pipeline

    return r(pipeline.condition_means(pipeline.preprocess(*pipeline.raw_views(spark, d))), "value")


@query(
    """WITH s AS (SELECT DISTINCT CAST(vec_id // 25 AS INTEGER) AS subj FROM embeddings), a(onset, code) AS (VALUES (0.12, 1), (0.28, 102), (0.44, 1))
SELECT subj, CAST(row_number() OVER (PARTITION BY subj ORDER BY onset) - 1 AS INTEGER) AS trial, CAST(onset AS DOUBLE) AS onset, code FROM s, a"""
)
def pipeline_trials(spark, d):
    """OR1, FLT1, JN1-JN3: the stimuli of the raw recording with their outcomes (right, wrong, no answer)."""
    from sigloom.plans import pipeline

    _, _, _, annotations, s = pipeline.raw_views(spark, d)
    return pipeline.trials_of(annotations, s)


@query(
    """WITH c AS (SELECT CAST(vec_id // 25 AS INTEGER) AS subj, CAST(vec_id % 25 AS INTEGER) AS ch, CAST(p - 1 AS INTEGER) AS sample, CAST(embedding[p] AS DOUBLE) AS v FROM embeddings, generate_series(1, 64) g(p) WHERE p - 1 >= 2 AND p - 1 <= 64),
n AS (SELECT *, chr(65 + ch // 3) || (ch % 3 + 1) AS name FROM c WHERE ch < 24) SELECT a.subj, a.name || '_' || b.name AS pair, a.sample, round(a.v - b.v, 5) AS value
FROM n a JOIN n b ON a.subj = b.subj AND a.sample = b.sample AND b.ch = a.ch + 1 AND b.ch // 3 = a.ch // 3 WHERE a.ch % 10 <> 9 AND b.ch % 10 <> 9"""
)
def pipeline_montage(spark, d):
    """OR1, SRC4, FLT2, FLT4, JN6: the recording of the kept types, cropped about its stimuli, in bipolar pairs without flagged ends."""
    from sigloom.plans import pipeline

    *raw, s = pipeline.raw_views(spark, d)
    from dataclasses import replace

    x = pipeline.cleaned(*raw, replace(s, new_fs=s.fs, high_pass=None, line=1e9)).select("subj", "pair", "start", F.posexplode("series").alias("i", "value"))
    return r(x.select("subj", "pair", (F.round(F.col("start") * s.fs) + F.col("i")).cast("int").alias("sample"), "value"), "value")


@query("SELECT DISTINCT CAST(vec_id // 25 AS INTEGER) AS subj, 'ok' AS status, CAST(3 AS BIGINT) AS n_events FROM embeddings")
def subject_pipeline_report(spark, d):
    """OR2: one status row a subject from the pipeline's own inputs."""
    from sigloom.plans import pipeline

    return pipeline.report(*pipeline.raw_views(spark, d))


@query()
def cluster_profile(spark, d):
    """CL9: clusters by area, and by subject (25 channels each)."""
    x = cl.select_clusters(_group_weights(spark, d), ["band"], "gch", ["c1", "c2", "c3"], "kmeans")
    areas = table(spark, d, "embeddings").select(F.col("vec_id").alias("gch"), F.col("label").alias("area"))
    y = x.join(broadcast_if_small(areas), "gch")
    by_area = y.groupBy("band", "cluster", F.lit("area").alias("kind"), F.col("area").cast("bigint").alias("of")).agg(F.count("*").alias("n"))
    return by_area.unionByName(y.groupBy("band", "cluster", F.lit("subject").alias("kind"), F.expr("gch div 25").alias("of")).agg(F.count("*").alias("n")))


# ---- sources and sinks: written to the shared folder and read back ----


def _folder(spark) -> str:
    from sigloom.session import shared_folder

    return shared_folder(spark)


@query("SELECT channel, x, y, z, subj FROM coords WHERE channel IS NOT NULL AND subj IS NOT NULL")
def csv_round_trip(spark, d):
    """SNK3, SRC5, FLT13: positions as CSV files with a surplus leading column, and read back without it."""
    from sigloom.sources import readers

    path = _folder(spark)
    c = table(spark, d, "coords").where("channel is not null and subj is not null")
    readers.write_csv(c.select(F.col("coord_id").alias("_c0"), "channel", "x", "y", "z", "subj"), path)
    return readers.normalise_coords(spark, path)


@query("SELECT rec_id, CAST(t AS INTEGER) - 1 AS trial, event_id[t] AS code FROM (SELECT rec_id, event_id, unnest(generate_series(1, len(event_id))) AS t FROM info WHERE event_id IS NOT NULL)")
def json_round_trip(spark, d):
    """SNK2, SRC6: trial codes as JSON and read back."""
    from sigloom.sources import readers

    path = _folder(spark)
    readers.write_json(table(spark, d, "info").where("event_id is not null").select("rec_id", "event_id"), path)
    return spark.read.schema("rec_id bigint, event_id array<string>").json(path).select("rec_id", F.posexplode("event_id").alias("trial", "code"))


@query(W("ts") + "SELECT subj, trial, ch_idx, t_idx, round(value, 5) AS value FROM ts")
def tensor_round_trip(spark, d):
    """SNK1, SNK4, SRC7: signals as Parquet by subject; a second, guarded write adds only the subjects that are missing."""
    from sigloom.sources import readers

    path = _folder(spark)
    x = v.trial_signal(spark, d).select("subj", "trial", "ch_idx", "t_idx", "value")
    readers.write_tensors(x.where("subj % 2 = 0"), path, "subj")
    readers.write_missing(x, path, "subj")
    return r(spark.read.parquet(path), "value").select("subj", "trial", "ch_idx", "t_idx", "value")
