"""Sources and sinks: recordings, sidecars, audio, names taken from paths, guarded and idempotent writes."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "bad_channels": "name string",
    "bad_segments": "onset double, duration double",
    "electrodes": "electrode string, label string",
    "coords": "channel string, x double, y double, z double, subj string",
    "info": "chnames array<string>, time_tfr array<double>, time_epoch array<double>, event_count array<array<string>>, event_id array<string>",
}


def read_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A CSV with a header and a fixed schema (SRC5)."""
    return spark.read.csv(path, header=True, schema=SCHEMAS[kind])


def normalise_coords(spark: SparkSession, path: str) -> DataFrame:
    """Coordinate files with or without a surplus leading column (FLT13)."""
    df = spark.read.csv(path, header=True)
    names = df.columns
    if len(names) == 6:
        df = df.drop(names[0])
        names = names[1:]
    return df.select(F.col(names[0]).alias("channel"), *[F.col(c).cast("double").alias(n) for c, n in zip(names[1:4], "xyz")], F.col(names[4]).alias("subj"))


def read_info(spark: SparkSession, path: str) -> DataFrame:
    """JSON sidecars, one a subject, with subj from the file name (SRC6)."""
    return spark.read.schema(SCHEMAS["info"]).json(path, multiLine=True).withColumn("subj", name_part(F.col("_metadata.file_path"), r"([^/]+)_info\.json$"))


def exploded_codes(info: DataFrame, keys: list[str], codes: str = "event_id") -> DataFrame:
    """(keys..., trial, code INT) of string codes (SRC6); unreadable ones are null."""
    return info.select(*keys, F.posexplode(codes).alias("trial", "_c")).withColumn("code", F.expr("try_cast(_c as int)")).drop("_c")


def name_part(path: Column, pattern: str) -> Column:
    """First group of a pattern in a path (SRC1, SRC2, SRC9); null without a match."""
    x = F.regexp_extract(path, pattern, 1)
    return F.when(x != "", x)


def subjects(spark: SparkSession, path: str, pattern: str = r"(sub-[^/_]+)") -> DataFrame:
    """Distinct subjects named in file paths (SRC1, SRC2); contents are not read."""
    return spark.read.format("binaryFile").load(path).select(name_part(F.col("path"), pattern).alias("subj")).where("subj is not null").distinct()


def decimals(text: Column, names: tuple[str, ...] = ("x", "y", "z")) -> list[Column]:
    """Signed decimals of a printed point, in order, with or without an exponent (SRC10)."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"([-+]?\d+\.\d+(?:[eE][-+]?\d+)?)")), lambda s: s.cast("double"))
    return [F.get(found, i).alias(n) for i, n in enumerate(names)]


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(file, rate, sample_idx, amp) of 16-bit PCM files (SRC8): each file is decoded where it is read."""

    def decode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for p, content in zip(pdf["path"], pdf["content"]):
                with wave.open(io.BytesIO(content)) as w:
                    a = np.frombuffer(w.readframes(w.getnframes()), dtype=np.int16)
                    rate, ch = w.getframerate(), w.getnchannels()
                yield pd.DataFrame({"file": p.rsplit("/", 1)[-1], "rate": rate, "sample_idx": np.arange(len(a[::ch]), dtype=np.int32), "amp": a[::ch]})

    src = spark.read.format("binaryFile").load(path).select("path", "content")
    return src.mapInPandas(decode, "file string, rate int, sample_idx int, amp smallint")


def sensors(df: DataFrame, ch_type: str = "ch_type") -> DataFrame:
    """Channels of the kept recording types (SRC4)."""
    return df.where(F.lower(ch_type).isin("seeg", "ecog"))


def write_tensors(df: DataFrame, path: str, *partitions: str) -> None:
    """Parquet by entity (SNK1); rows of a partition are brought together first, so that files stay few."""
    df.repartition(*[F.col(p) for p in partitions]).write.mode("overwrite").partitionBy(*partitions).parquet(path)


def write_missing(df: DataFrame, path: str, key: str) -> None:
    """Appends only entities that the target doesn't have yet (SNK4)."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(key).distinct()
        df = df.join(done, key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("append").partitionBy(key).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV results (SNK3)."""
    df.write.mode("overwrite").csv(path, header=True)


def write_json(df: DataFrame, path: str) -> None:
    """JSON sidecars (SNK2)."""
    df.write.mode("overwrite").json(path)
