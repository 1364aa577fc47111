"""Packs texts of varying token length into containers of fixed capacity.

A text longer than a container is cut into full containers and a rest; no other text is split. Pieces go to packing
tasks by hash, so that every task holds a bounded number of them whatever the corpus' size; within a task each piece,
longest first, takes the open container whose residual capacities (tokens, documents, attention cost) it fills best.
Containers that stay under-filled are opened again in a second round, so that what tasks leave over is combined.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.session import materialise, spread

#: Folder of public tokenizer vocabularies, and the one used by default.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Splitting pattern of byte-level BPE vocabularies of this family. Fixed value.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of a container, and its attention cost as a share of capacity squared, by default.
MAX_DOCS = 16
COST_SHARE = 0.5
#: Pieces a packing task holds.
TASK_PIECES = 8192

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The byte-level BPE encoder of a .tiktoken file, once a worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("texts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(df: DataFrame, doc_id: str, text: str, tokenizer: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """(doc_id, n_tokens) of every row with a non-null text; an empty text has 0 tokens. Whole texts are encoded."""

    def count(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(tokenizer)
        for pdf in it:
            yield pd.DataFrame({"doc": pdf["doc"], "n_tokens": [len(e.encode_ordinary(t)) for t in pdf["text"]]})

    x = df.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    return spread(x, "doc").mapInPandas(count, "doc bigint, n_tokens bigint").withColumnRenamed("doc", doc_id)


def pieces(counts: DataFrame, doc_id: str, capacity: int) -> DataFrame:
    """(doc_id, piece_no, start_token, n_tokens) with at most `capacity` tokens each; only longer texts have several."""
    cut = F.sequence(F.lit(0), F.floor((F.col("n_tokens") - 1) / capacity).cast("bigint"))
    x = counts.where("n_tokens > 0").select(doc_id, F.col("n_tokens").alias("_n"), F.posexplode(cut).alias("piece_no", "_k"))
    start = (F.col("_k") * capacity).cast("bigint")
    return x.select(doc_id, F.col("piece_no").cast("int").alias("piece_no"), start.alias("start_token"), F.least(F.lit(capacity).cast("bigint"), F.col("_n") - start).alias("n_tokens"))


def cost_limit(longest: float, capacity: int, max_cost: float) -> float:
    """Attention cost that a container may have, given its longest piece.

    A piece whose own cost is over max_cost still needs a container. Beside it, and beside any piece that leaves less
    than half of max_cost, the rest may cost half of what one piece of that length would: it must be two pieces or more.
    """
    return max(max_cost, longest * longest + (capacity - longest) ** 2 / 2)


def best_fit(lengths: np.ndarray, capacity: int, max_docs: int, max_cost: float) -> np.ndarray:
    """Container number of each piece: vector best fit, longest first (ties in the given order).

    Capacities are tokens, documents and attention cost (the sum of squared lengths, see cost_limit). Of the open
    containers that hold a piece under every constraint, it takes that with the smallest norm of the residual after it,
    each residual as a share of its capacity.
    """
    n = len(lengths)
    out = np.empty(n, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    w = 1 / np.array([capacity, max_docs, max_cost])
    res = np.empty((256, 3))
    ids = np.empty(256, dtype=np.int64)
    used = opened = 0
    smallest = float(lengths.min()) if n else 0.0
    for k in order:
        x = float(lengths[k])
        need = np.array([x, 1.0, x * x])
        r = res[:used]
        ok = np.flatnonzero((r >= need).all(1))
        if len(ok):
            left = (r[ok] - need) * w
            j = ok[int((left * left).sum(1).argmin())]
            res[j] -= need
        else:
            if used == len(res):
                res, ids = np.vstack([res, np.empty_like(res)]), np.concatenate([ids, np.empty_like(ids)])
            res[used] = np.array([capacity, max_docs, cost_limit(x, capacity, max_cost)]) - need
            ids[used] = opened
            j, opened, used = used, opened + 1, used + 1
        out[k] = ids[j]
        if res[j, 0] < smallest or res[j, 1] < 1 or res[j, 2] < smallest * smallest:  # closed: nothing fits any more
            used -= 1
            res[j], ids[j] = res[used], ids[used]
    return out


def pack(
    items: DataFrame,
    doc_id: str,
    capacity: int = 1024,
    max_docs: int = MAX_DOCS,
    cost_share: float = COST_SHARE,
    task_pieces: int = TASK_PIECES,
    refill_below: float = 0.97,
) -> DataFrame:
    """(container_id, doc_id, piece_no, start_token, n_tokens) of every piece, from the pieces() of a corpus.

    A container holds at most `capacity` tokens and `max_docs` pieces, and its attention cost (the sum of squared piece
    lengths) at most cost_limit() of cost_share x capacity squared. An empty input gives an empty result. Equal lengths
    are placed in the order of (doc_id, piece_no).
    """
    if max_docs < 1 or capacity < 1 or cost_share <= 0:
        raise ValueError("capacity, max_docs and cost_share must be positive")
    cost = cost_share * capacity * capacity
    items = materialise(items.select(F.col(doc_id).alias("doc"), "piece_no", "start_token", "n_tokens"))

    def place(df: DataFrame, salt: int) -> DataFrame:
        n_tasks = max(1, -(-df.count() // task_pieces))

        def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["doc", "piece_no"])
            b = best_fit(pdf["n_tokens"].to_numpy(), capacity, max_docs, cost)
            fill = np.bincount(b, weights=pdf["n_tokens"].to_numpy(float))
            return pd.DataFrame({"task": int(key[0]), "bin": b, "fill": fill[b] / capacity, "doc": pdf["doc"], "piece_no": pdf["piece_no"], "start_token": pdf["start_token"], "n_tokens": pdf["n_tokens"]})

        g = df.withColumn("_t", F.pmod(F.xxhash64(F.lit(salt), "doc", "piece_no"), F.lit(n_tasks)).cast("int"))
        return g.groupBy("_t").applyInPandas(one, "task int, bin bigint, fill double, doc bigint, piece_no int, start_token bigint, n_tokens bigint")

    # full pieces fill a container each and need no search
    full = items.where(F.col("n_tokens") == capacity)
    first = materialise(place(items.where(F.col("n_tokens") < capacity), 1))
    second = place(first.where(F.col("fill") < refill_below).select("doc", "piece_no", "start_token", "n_tokens"), 2)
    cols = [F.col("doc").alias(doc_id), "piece_no", "start_token", "n_tokens"]

    def named(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.concat_ws("-", F.lit(kind), "task", "bin").alias("container_id"), *cols)

    return (
        full.select(F.concat_ws("-", F.lit("full"), "doc", "piece_no").alias("container_id"), *cols)
        .unionByName(named(first.where(F.col("fill") >= refill_below), "a"))
        .unionByName(named(second, "b"))
    )
