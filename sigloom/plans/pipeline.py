"""The whole preprocessing of a recording as one lazy plan over all subjects (OR1)."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.functions import dims
from sigloom.functions.dims import KEY_NEW, KEY_NULL, KEY_OLD
from sigloom.operators import events as ev
from sigloom.operators import montage as mo
from sigloom.operators import shaping as sh
from sigloom.operators import spectral as sp
from sigloom.session import broadcast_if_small, table


@dataclass(frozen=True)
class Settings:
    """Parameters of preprocess(), with the reference's values. Times are in seconds, rates and frequencies in Hz."""

    fs: float = 600.0
    new_fs: float = 600.0
    high_pass: float | None = 0.1
    line: float = 50.0
    before: float = 1.5
    after: float = 5.0
    crop: tuple[float, float] = (-1.5, 4.0)
    baseline: tuple[float, float] = (-1.5, 4.0)
    step: float = 0.025
    width: float = 0.1
    pad: tuple[float, float] = (2.0, 50.0)
    answer: tuple[float, float] = (0.1, 5.0)
    part: str = "bach"
    freqs: tuple[float, ...] = tuple(map(float, dims.FREQS))
    n_cycles: tuple[float, ...] = tuple(f * 2.0 / b for f, b in zip(dims.FREQS, dims.BANDWIDTHS))
    bands: dict = field(default_factory=lambda: dims.BANDS)
    types: tuple[str, ...] = ("seeg", "ecog")


def trials_of(annotations: DataFrame, s: Settings) -> DataFrame:
    """(subj, trial, onset, code) of every stimulus, with the first key pressed within the answer's limits (JN1-JN3).

    annotations is (subj, onset, description); a description that holds s.part and ends in old or new is a stimulus, one
    that is a key's code is a key press.
    """
    stim = ev.annotation_filter(annotations, "description", s.part)
    item = F.when(F.col("description").endswith("old"), 1).when(F.col("description").endswith("new"), 2)
    stim = stim.select("subj", F.col("onset").alias("t"), item.alias("code")).where("code is not null")
    keys = annotations.select("subj", F.col("onset").alias("t"), F.expr("try_cast(description as int)").alias("code")).where(F.col("code").isin(KEY_OLD, KEY_NEW, KEY_NULL))
    got = ev.first_response(stim, keys.withColumn("tie", F.col("code")), "subj", "t", *s.answer, "tie")
    x = got.select("subj", F.col("t").alias("onset"), ev.outcome(F.col("code"), F.col("key_code")).alias("code"))
    # trials are numbered in time by their rank among a subject's few hundred stimuli
    order = F.array_sort(F.collect_list(F.struct("onset", "code")))
    return x.groupBy("subj").agg(order.alias("o")).select("subj", F.posexplode("o").alias("trial", "p")).select("subj", "trial", "p.onset", "p.code")


def cleaned(signal: DataFrame, channels: DataFrame, flags: DataFrame, annotations: DataFrame, s: Settings) -> DataFrame:
    """(subj, pair, start, series): cropped, bipolar, resampled and filtered recordings; start is the first sample's time."""
    kept = channels.where(F.lower("ch_type").isin(*s.types)) if "ch_type" in channels.columns else channels
    pairs = mo.bipolar_pairs(kept, "subj", "ch_idx", "channel")
    pairs = pairs.join(broadcast_if_small(mo.pair_drop_list(pairs, flags, "subj", "channel")), ["subj", "pair"], "left_anti")
    bounds = ev.crop_bounds(ev.annotation_filter(annotations, "description", s.part), "subj", "onset", *s.pad)
    inside = (F.col("sample") / s.fs >= F.col("t_from")) & (F.col("sample") / s.fs <= F.col("t_to"))
    x = mo.bipolar_signal(signal.join(broadcast_if_small(bounds), "subj").where(inside).drop("t_from", "t_to"), pairs, "subj", "ch_idx", "value", ["sample"])
    begin = x.groupBy("subj", "pair").agg((F.min("sample") / s.fs).alias("start"))
    series = sp.as_series(x, ["subj", "pair"], "sample", "value").join(begin, ["subj", "pair"])
    if s.new_fs != s.fs:
        series = sp.resampled(series, ["subj", "pair", "start"], s.new_fs / s.fs)
    return sp.filtered(series, ["subj", "pair", "start"], s.new_fs, s.high_pass, sh.line_harmonics(s.new_fs / 2, s.line))


def preprocess(signal: DataFrame, channels: DataFrame, flags: DataFrame, annotations: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(subj, trial, code, pair, band_idx, c_idx, value): smoothed, z-scored band power of bipolar pairs by trial.

    signal (subj, ch_idx, sample, value), channels (subj, ch_idx, channel[, ch_type], x, y, z), flags (subj, channel,
    flag), annotations (subj, onset, description). Other channel types and pairs with a flagged end are dropped; the
    recording is cropped about its stimuli, resampled and filtered; epochs are normalised by pair; incomplete epochs at a
    recording's edges are left out; power is z-scored over the baseline of all trials of a pair and frequency.
    """
    rate = s.new_fs
    clean = cleaned(signal, channels, flags, annotations, s)
    x = clean.select("subj", "pair", "start", F.posexplode("series").alias("i", "value"))
    x = x.select("subj", "pair", (F.round(F.col("start") * rate) + F.col("i")).cast("bigint").alias("sample"), "value")
    before, after = round(s.before * rate), round(s.after * rate)
    t = trials_of(annotations, s).select("subj", "trial", "code", F.round(F.col("onset") * rate).cast("bigint").alias("at"))
    e = sh.epochs(x.withColumn("_v", F.struct("pair", "value")), t, "subj", "sample", "_v", ["trial", "code"], "at", before, after)
    e = e.select("subj", "trial", "code", F.col("_v.pair").alias("pair"), (F.col("rel") + before).alias("t_idx"), F.col("_v.value").alias("value"))
    keys = ["subj", "trial", "code", "pair"]
    series = sp.as_series(sh.normalise(e, ["subj", "pair"], "value"), keys, "t_idx", "value").where(F.size("series") == before + after + 1)
    power = sp.tfr(series, keys, rate, list(s.freqs), list(s.n_cycles)).select(*keys, "freq_idx", F.posexplode("power").alias("t_idx", "value"))
    time = (F.col("t_idx") - before) / rate
    half = 0.5 / rate
    in_base = time.between(s.baseline[0] - half, s.baseline[1] + half)
    z = sp.zscore_baseline(sp.log_power(power, "value"), ["subj", "pair", "freq_idx"], "value", in_base).where(time.between(s.crop[0] - half, s.crop[1] + half))
    first = max(0, round((s.crop[0] + s.before) * rate))
    n = min(before + after, round((s.crop[1] + s.before) * rate)) - first + 1
    smooth = sh.smooth(z.withColumn("t_idx", F.col("t_idx") - first), [*keys, "freq_idx"], "t_idx", "value", sh.hopping_grid(s.crop[0], n, rate, s.step, s.width))
    bridge = dims.band_members(signal.sparkSession, s.bands)
    idx = signal.sparkSession.createDataFrame([(i, float(f)) for i, f in enumerate(s.freqs)], "freq_idx int, freq double")
    return sp.band_means(smooth.join(F.broadcast(idx), "freq_idx"), bridge, "freq", [*keys, "c_idx"], "value")  # one row a frequency


def condition_means(trials: DataFrame) -> DataFrame:
    """(subj, code, pair, band_idx, c_idx, value): means of preprocess() by condition."""
    return trials.groupBy("subj", "code", "pair", "band_idx", "c_idx").agg(F.avg("value").alias("value"))


def report(signal: DataFrame, channels: DataFrame, flags: DataFrame, annotations: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(subj, status, n_events): what would keep a subject out, instead of an exception."""
    n = trials_of(annotations, s).groupBy("subj").agg(F.count("*").alias("n_events"))
    x = signal.select("subj").distinct().join(n, "subj", "left")
    return x.select("subj", F.when(F.col("n_events").isNull(), "no events").otherwise("ok").alias("status"), F.coalesce("n_events", F.lit(0)).alias("n_events"))


def raw_views(spark: SparkSession, d: str) -> tuple:
    """A raw recording from the embeddings: 25 channels of 64 samples a subject, three stimuli and two key presses each."""
    e = table(spark, d, "embeddings")
    signal = e.select(F.expr("cast(vec_id div 25 as int)").alias("subj"), (F.col("vec_id") % 25).cast("int").alias("ch_idx"), F.posexplode("embedding").alias("sample", "value")).withColumn("value", F.col("value").cast("double"))
    ids = e.select(F.expr("cast(vec_id div 25 as int)").alias("subj"), (F.col("vec_id") % 25).cast("int").alias("ch_idx"))
    kind = F.when(F.col("ch_idx") == 24, "ecg").otherwise("seeg").alias("ch_type")
    channels = ids.select("subj", "ch_idx", F.concat(F.chr(65 + F.expr("ch_idx div 3")), (F.col("ch_idx") % 3 + 1).cast("string")).alias("channel"), kind, *[F.lit(0.0).alias(c) for c in "xyz"])
    flags = channels.where("ch_idx % 10 = 9").select("subj", "channel", F.lit("bad").alias("flag"))
    said = [(0.12, "bach/1 old"), (0.15, str(KEY_OLD)), (0.28, "bach/2 new"), (0.30, str(KEY_OLD)), (0.44, "bach/3 old"), (0.50, "noise")]
    at = F.explode(F.array(*[F.struct(F.lit(t).alias("onset"), F.lit(x).alias("description")) for t, x in said]))
    annotations = ids.select("subj").distinct().select("subj", at.alias("e")).select("subj", "e.onset", "e.description")
    s = Settings(fs=100.0, new_fs=200.0, high_pass=1.0, line=50.0, before=0.08, after=0.15, crop=(-0.08, 0.12), baseline=(-0.08, 0.12), step=0.025, width=0.05, pad=(0.1, 0.2), answer=(0.01, 0.1),
                 freqs=(10.0, 20.0, 30.0), n_cycles=(2.0, 3.0, 4.0), bands={"low": [10.0, 20.0], "high": [20.0, 30.0]})
    return signal, channels, flags, annotations, s
