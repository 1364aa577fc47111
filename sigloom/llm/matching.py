"""Maps freely typed values to the closest entry of a reference list.

Distinct values are normalised; words that stand beside many entries' names without belonging to any are learned as
noise and dropped. An inverted index of character n-grams retrieves every entry that may be meant, scored by weighted
cosine. A value is accepted above a score and a margin; what stays between the thresholds is settled by an exact
alignment against all its candidates, or reported as unmatched.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigloom.session import broadcast_if_small, materialise

_TOKEN = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """Lower case without accents and width forms."""
    t = unicodedata.normalize("NFKD", text).casefold()
    return "".join(c for c in t if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")


def tokens(text: str) -> list[list[str]]:
    """Folded runs of letters and digits of any script, by the parts that commas make."""
    return [_TOKEN.findall(p) for p in re.split("[,，、]", fold(text))]


@lru_cache(maxsize=1 << 16)
def edit_similarity(a: str, b: str) -> float:
    """1 - optimal string alignment distance / longer length."""
    if a == b:
        return 1.0
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    before, prev = None, list(range(m + 1))
    for i in range(1, n + 1):
        cur = [i] + [0] * m
        for j in range(1, m + 1):
            c = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (a[i - 1] != b[j - 1]))
            if before is not None and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                c = min(c, before[j - 2] + 1)
            cur[j] = c
        before, prev = prev, cur
    return 1 - prev[m] / max(n, m)


def shortened(value: str, entry: str) -> bool:
    """Whether the value has the entry's words, each whole or cut to four letters or more."""
    v, e = value.split(), entry.split()
    return len(v) == len(e) and all(y.startswith(x) and len(x) >= min(4, len(y)) for x, y in zip(v, e))


def alignment(value: str, entry: str) -> float:
    """Similarity of a normal form to an entry's: whole strings without blanks, or word by word with shortened words."""
    best = edit_similarity(value.replace(" ", ""), entry.replace(" ", ""))
    return max(best, 0.97) if shortened(value, entry) else best


def word_alignment(value: str, entry: str) -> float:
    """Mean similarity word by word, to part entries that whole strings don't; 0 for different numbers of words."""
    v, e = value.split(), entry.split()
    return sum(map(edit_similarity, v, e)) / len(v) if v and len(v) == len(e) else 0.0


def similarity_bound(a: list[str], b: list[str]) -> np.ndarray:
    """An upper bound of edit_similarity for each pair: letters of one string that the other lacks must be edited."""
    known: dict[str, int] = {}
    ia, ib = (np.array([known.setdefault(s, len(known)) for s in x], dtype=np.int64) for x in (a, b))
    bags = np.zeros((len(known), 64), dtype=np.int32)
    for s, i in known.items():
        bags[i] = np.bincount(np.frombuffer(s.encode("utf-32-le"), dtype=np.uint32) % 64, minlength=64)
    size = bags.sum(1)
    diff = bags[ia] - bags[ib]
    edits = np.maximum(np.maximum(diff, 0).sum(1), np.maximum(-diff, 0).sum(1))
    return 1 - edits / np.maximum(np.maximum(size[ia], size[ib]), 1)


def grams(form: Column, n: int = 3) -> Column:
    """Character n-grams of each word of a form, with its borders, so that word order doesn't matter."""

    def of(word: Column) -> Column:
        p = F.concat(F.lit(" "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - (n - 1), F.lit(1))), lambda i: F.substring(p, i, F.lit(n)))

    return F.array_distinct(F.flatten(F.transform(F.split(form, " "), of)))


def retrieval_keys(form: Column) -> Column:
    """Keys of which any two strings of an edit similarity over 0.7 share one.

    They are the n-grams by word, those of the whole string without blanks, and its ends. k edits destroy at most 3k of
    the whole string's n-grams, a transposition of neighbours 4; all are destroyed only where transpositions lie one or
    two letters from either end and four apart, and these leave the end letter or the end pair but for its order.
    """
    whole = F.regexp_replace(form, " ", "")

    def pair(at: int) -> Column:
        return F.array_join(F.array_sort(F.split(F.substring(whole, at, 2), "")), "")

    ends = [F.concat(F.lit(k), a, F.lit("-"), b) for k, a, b in (
        ("1:", F.substring(whole, 1, 1), F.substring(whole, -1, 1)), ("2:", pair(1), F.substring(whole, -1, 1)), ("3:", F.substring(whole, 1, 1), pair(-2)), ("4:", pair(1), pair(-2)),
    )]
    return F.array_distinct(F.concat(F.transform(grams(form), lambda g: F.concat(F.lit("w:"), g)), F.transform(grams(whole), lambda g: F.concat(F.lit("s:"), g)), F.array(*ends)))


def _words(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, part, place, word) of every folded word."""

    def parse(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"k": pdf["k"], "parts": [tokens(t) for t in pdf["t"]]})

    x = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInPandas(parse, "k string, parts array<array<string>>")
    x = x.select("k", F.posexplode("parts").alias("part", "ws")).select("k", "part", F.posexplode("ws").alias("place", "word"))
    return x.withColumnRenamed("k", key)


def _joined(words: Column) -> Column:
    return F.concat_ws(" ", F.transform(words, lambda t: t["word"]))


def _entries(ref: DataFrame) -> DataFrame:
    """(code, name) with the name as a form; entries without a name have none."""
    w = _words(ref.where("name is not null"), "code", "name")
    return w.groupBy("code").agg(_joined(F.array_sort(F.collect_list(F.struct("part", "place", "word")))).alias("name"))


def noise_words(words: DataFrame, ref: DataFrame, min_entries: int = 3) -> DataFrame:
    """Words (word) that say nothing about the entry meant: sides, doubts and remarks, as the values themselves show.

    A word is noise if it is part of no entry's name or code, and stands in values whose other words are just the name
    or the code of an entry, for at least min_entries entries. words is (v, part, place, word) of the distinct values.
    """
    own = _words(ref.where("name is not null"), "code", "name").select("code", "word")
    codes = _words(ref.select("code", F.col("code").alias("name")), "code", "name").select("code", "word")
    sorted_words = F.concat_ws(" ", F.array_sort(F.collect_list("word")))
    alias = own.groupBy("code").agg(sorted_words.alias("key")).unionByName(codes.groupBy("code").agg(sorted_words.alias("key"))).distinct()
    vocabulary = own.select("word").unionByName(codes.select("word")).distinct().withColumn("known", F.lit(True))
    of = words.join(broadcast_if_small(vocabulary), "word", "left")
    by = of.groupBy("v").agg(F.concat_ws(" ", F.array_sort(F.collect_list(F.when(F.col("known"), F.col("word"))))).alias("key"), F.collect_set(F.when(F.col("known").isNull(), F.col("word"))).alias("extra"))
    votes = by.where(F.size("extra") > 0).join(broadcast_if_small(alias), "key").select("code", F.explode("extra").alias("word"))
    return votes.groupBy("word").agg(F.countDistinct("code").alias("n")).where(F.col("n") >= min_entries).select("word")


def normal_forms(words: DataFrame, noise: DataFrame) -> DataFrame:
    """(v, form): the words but noise (all of them if nothing else is left), and with the parts around one comma exchanged."""
    marked = words.join(broadcast_if_small(noise.withColumn("noise", F.lit(True))), "word", "left")
    t = marked.groupBy("v").agg(F.array_sort(F.collect_list(F.struct("part", "place", "word", F.col("noise").isNotNull().alias("noise")))).alias("all"))
    t = t.withColumn("kept", F.filter("all", lambda x: ~x["noise"])).withColumn("kept", F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.col("all")))
    first = F.filter("kept", lambda x: x["part"] == 0)
    second = F.filter("kept", lambda x: x["part"] == 1)
    swapped = F.when(F.size("kept") == F.size(first) + F.size(second), _joined(F.concat(second, first)))
    return t.select("v", F.explode(F.array_distinct(F.array_compact(F.array(_joined(F.col("kept")), swapped)))).alias("form")).where("form <> ''")


def reference_index(entries: DataFrame, n_entries: int) -> DataFrame:
    """Inverted index (key, code, name, idf, weight): weights are inverse document frequencies, scaled to unit length by entry.

    Keys that only retrieve weigh nothing.
    """
    g = entries.select("code", "name", F.explode(retrieval_keys(F.col("name"))).alias("key"))
    df = g.groupBy("key").agg(F.countDistinct("code").alias("df"))
    g = g.join(df, "key").withColumn("idf", F.when(F.col("key").startswith("w:"), F.log(1 + n_entries / F.col("df"))).otherwise(0.0))
    norm = g.groupBy("code").agg(F.sqrt(F.sum(F.col("idf") ** 2)).alias("norm"))
    return g.join(norm, "code").select("key", "code", "name", "idf", (F.col("idf") / F.col("norm")).alias("weight"))


def match_values(
    values: DataFrame,
    value: str,
    ref: DataFrame,
    code: str,
    name: str,
    accept: float = 0.86,
    margin: float = 0.12,
    check_accept: float = 0.72,
    check_margin: float = 0.02,
    min_entries: int = 3,
    none: str = "none",
) -> DataFrame:
    """(value, code, score): for every distinct non-null value the entry that is meant, or `none`.

    A value that is an entry's code but for case, punctuation and noise words is that entry. Empty and unreadable values
    are `none`; ties between entries beyond the margin are broken by the alignment, then reported as `none`; repeated
    rows count once; an empty input gives an empty result. All scripts are read. Every entry that shares a retrieval key
    is a candidate, and every candidate that can reach check_accept is aligned: there is no limit on their number.
    """
    floor = check_accept - check_margin
    small = materialise(ref.select(F.col(code).cast("string").alias("code"), F.col(name).cast("string").alias("name")).where("code is not null"))
    distinct = materialise(values.select(F.col(value).cast("string").alias("v")).where("v is not null").distinct())
    words = materialise(_words(distinct.withColumn("t", F.col("v")), "v", "t"))
    forms = materialise(normal_forms(words, noise_words(words, small, min_entries)))
    n_entries = small.where("name is not null").count()
    index = materialise(reference_index(_entries(small), n_entries))

    keys = forms.select("v", "form", F.explode(retrieval_keys(F.col("form"))).alias("key"))
    known = index.groupBy("key").agg(F.max("idf").alias("idf"))
    rare = float(np.log(1 + max(n_entries, 1)))
    weighed = keys.join(broadcast_if_small(known), "key", "left").withColumn("w", F.when(F.col("key").startswith("w:"), F.coalesce("idf", F.lit(rare))).otherwise(0.0))
    weighed = weighed.withColumn("own", F.col("w") ** 2)
    length = weighed.groupBy("v", "form").agg(F.sqrt(F.sum("own")).alias("len"))
    hits = weighed.where("idf is not null").join(broadcast_if_small(index.select("key", "code", "name", "weight")), "key")
    pairs = hits.groupBy("v", "form", "code", "name").agg(F.sum(F.col("w") * F.col("weight")).alias("dot")).join(length, ["v", "form"])
    pairs = pairs.select("v", "form", "code", "name", (F.col("dot") / F.col("len")).alias("cosine"))

    def align(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            f, e = pdf["form"].tolist(), pdf["name"].tolist()
            bare_f, bare_e = [x.replace(" ", "") for x in f], [x.replace(" ", "") for x in e]
            may = similarity_bound(bare_f, bare_e) >= floor if len(pdf) else []
            sim, by_word = np.zeros(len(pdf)), np.zeros(len(pdf))
            for k, ok in enumerate(may):
                if ok:
                    sim[k] = edit_similarity(bare_f[k], bare_e[k])
                if f[k][0] == e[k][0] and shortened(f[k], e[k]):
                    sim[k] = max(sim[k], 0.97)
                if sim[k] >= floor:
                    by_word[k] = word_alignment(f[k], e[k])
            yield pd.DataFrame({"v": pdf["v"], "code": pdf["code"], "cosine": pdf["cosine"], "sim": sim, "by_word": by_word})

    scored = pairs.mapInPandas(align, "v string, code string, cosine double, sim double, by_word double")
    scored = scored.groupBy("v", "code").agg(F.max("cosine").alias("cosine"), F.max("sim").alias("sim"), F.max("by_word").alias("by_word"))
    of_value = Window.partitionBy("v")
    ranked = scored.withColumn("rc", F.row_number().over(of_value.orderBy(F.desc("cosine"), F.desc("code")))).withColumn("top", F.max("sim").over(of_value))
    ranked = ranked.withColumn("near", (F.col("top") >= check_accept) & (F.col("top") - F.col("sim") < check_margin))
    ranked = ranked.withColumn("rw", F.row_number().over(of_value.orderBy(F.desc("near"), F.desc("by_word"), F.desc("code"))))
    at = lambda rank, k, c: F.max(F.when(F.col(rank) == k, F.col(c)))
    best = ranked.groupBy("v").agg(
        at("rc", 1, "cosine").alias("c1"), at("rc", 2, "cosine").alias("c2"), at("rc", 1, "code").alias("by_cosine"), F.max("top").alias("top"),
        F.count(F.when(F.col("near"), 1)).alias("n_near"), at("rw", 1, "by_word").alias("w1"), at("rw", 2, "by_word").alias("w2"), at("rw", 1, "code").alias("by_alignment"),
    )
    bare = lambda c: F.regexp_replace(c, r"[^\p{L}\p{N}]", "")
    by_code = small.select(bare(F.lower("code")).alias("ckey"), "code").where("ckey <> ''").groupBy("ckey").agg(F.min("code").alias("exact"))
    exact = forms.select("v", F.regexp_replace("form", " ", "").alias("ckey")).join(broadcast_if_small(by_code), "ckey").groupBy("v").agg(F.min("exact").alias("exact"))
    sure = (F.col("c1") >= accept) & (F.col("c2").isNull() | (F.col("c1") - F.col("c2") >= margin))
    parted = (F.col("n_near") == 1) | ((F.col("n_near") > 1) & (F.col("w1") - F.col("w2") >= check_margin))
    got = distinct.join(best, "v", "left").join(exact, "v", "left")
    return got.select(
        F.col("v").alias(value),
        F.coalesce("exact", F.when(sure, F.col("by_cosine")), F.when(parted, F.col("by_alignment")), F.lit(none)).alias(code),
        F.when(F.col("exact").isNotNull(), 1.0).when(sure, F.col("c1")).otherwise(F.coalesce("top", F.lit(0.0))).alias("score"),
    )
