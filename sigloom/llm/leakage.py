"""Finds evaluation passages inside corpus documents by greedy string tiling.

Words of documents and items are folded alike. Documents and items are joined by the short word runs (seeds) that they
share; each pair is tiled greedily by its longest common runs, found with rolling hashes. Tiles that lie in line are
chained over altered words, and a pair leaks if the stretch of the item that they cover is long enough, or if tiles in
any order cover enough of the whole item. A small set of items travels to the documents; a larger one meets them in one
shuffled join of seeds.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.session import materialise, spread

#: Letters of other scripts that look like Latin ones. Fixed values, position by position.
LOOKS_FROM = "авекмнорстухіјѕһԁԛԝү" + "αβγενικορτυχωη" + "ıɡɑ"
LOOKS_TO = "abekmhopctyxijshdqwy" + "abyevikoptuxwn" + "iga"
_LOOKS = {ord(a): b for a, b in zip(LOOKS_FROM, LOOKS_TO)}
_DROP = {c: None for c in [*range(0x300, 0x370), 0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF]}
_TABLE = {**_LOOKS, **_DROP}
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[" + "".join(re.escape(chr(c)) for c in _DROP) + "]")
_CJK = re.compile(r"[⺀-ヿ㐀-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff々〆]")
#: Items that are sent to all tasks: at most so many bytes of text. More are joined by shuffle.
BLOCK_BYTES = 8 * 1024 * 1024


@lru_cache(maxsize=1 << 16)
def fold(text: str) -> str:
    """Case, width, accents, look-alike letters and invisible characters taken away."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKD", text).translate(_DROP).casefold()).translate(_TABLE)


def words_of(text: str) -> list[str]:
    """Folded units of a whole text: characters that no word may keep go first, then each word is folded, once a worker."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKD", text))
    return [w for u in _WORD.findall(text) for w in ((u.lower(),) if u.isascii() else _WORD.findall(fold(u)))]


def units(text: str) -> tuple[list[str], list[int], bool]:
    """Comparison units of a text, the word each belongs to, and whether they are letters.

    Units are runs of letters and digits; words are parted by white space, so that left-handed is one word of two
    units. Where most letters are Chinese or Japanese, each letter is a unit and a word.
    """
    runs = [(u, no) for no, w in enumerate(text.split()) for u in words_of(w)]
    letters = sum(len(u) for u, _ in runs)
    if letters and sum(len(_CJK.findall(u)) for u, _ in runs) * 2 > letters:
        chars = [c for u, _ in runs for c in u]
        return chars, list(range(len(chars))), True
    nos = {no: k for k, no in enumerate(dict.fromkeys(no for _, no in runs))}  # marks alone are no words
    return [u for u, _ in runs], [nos[no] for _, no in runs], False


class ItemIndex:
    """Seed index over items."""

    def __init__(self, items: list[tuple[int, str]], word_seed: int, char_seed: int):
        self.seed = {False: word_seed, True: char_seed}
        self.word_no: dict[int, list[int]] = {}
        self.cjk: dict[int, bool] = {}
        self.vocab: dict[str, int] = {}
        self.ids: dict[int, np.ndarray] = {}
        self.seeds: dict[bool, dict[tuple, list[tuple[int, int]]]] = {False: defaultdict(list), True: defaultdict(list)}
        for item, text in items:
            u, nos, cjk = units(text)
            self.word_no[item], self.cjk[item] = nos, cjk
            k = self.seed[cjk]
            ids = [self.vocab.setdefault(x, len(self.vocab)) for x in u]
            self.ids[item] = np.array(ids, dtype=np.int64)
            for i in range(len(u) - k + 1):
                self.seeds[cjk][tuple(ids[i : i + k])].append((item, i))

    def numbers(self, units_: list[str]) -> list[int]:
        """Units as numbers of the items' vocabulary, -1 for all others."""
        get = self.vocab.get
        return [get(u, -1) for u in units_]

    def candidates(self, ids: list[int], cjk: bool) -> dict[int, set[int]]:
        """Items that share two seeds or more, with the diagonals (place in the text less place in the item) of their seeds.

        A stretch that counts has two at least: n units with a tenth altered (rounded up) leave runs that hold
        (unaltered units) - (seed - 1) x (runs) seeds, which is smallest, 2, for 21 words with 3 altered.
        """
        found: dict[int, set[int]] = {}
        once: set[int] = set()
        s, k, run = self.seeds[cjk], self.seed[cjk], 0
        if s:
            for e, x in enumerate(ids, 1):
                run = run + 1 if x >= 0 else 0
                if run >= k:
                    for item, i in s.get(tuple(ids[e - k : e]), ()):
                        if item in found:
                            once.discard(item)
                            found[item].add(e - k - i)
                        else:
                            found[item] = {e - k - i}
                            once.add(item)
        for item in once:
            del found[item]
        return found


@lru_cache(maxsize=1 << 18)
def _number(unit: str) -> int:
    return xxhash.xxh64_intdigest(unit)


def seed_hashes(units_: list[str], k: int, cjk: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count) of the runs of k units, as signed 64-bit numbers; runs of letters and of words don't meet."""
    n = len(units_) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    x = np.array([_number(u) for u in units_], dtype=np.uint64)
    h = np.full(n, 1 + cjk, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + x[j : j + n]
    got, count = np.unique(h, return_counts=True)
    return got.view(np.int64), count.astype(np.int64)


def may_cover(a: np.ndarray, b: np.ndarray, diagonals: set[int], least: int, altered: float, coverage: float) -> bool:
    """Whether some window of `least` units of a can be covered on the seeds' diagonals and those beside them, or the
    share `coverage` of a on the seeds' diagonals.

    An upper bound: a stretch of `least` units or more has a window of that size with at most twice its share altered,
    and every tile as long as a seed lies on a diagonal that has one.
    """
    if len(a) < least:
        return False
    reach = int(np.ceil(altered * least)) + 1
    own = np.fromiter(diagonals, dtype=np.int64, count=len(diagonals))
    d = np.unique(own[:, None] + np.arange(-reach, reach + 1)[None])
    at = d[:, None] + np.arange(len(a))[None]
    inside = (at >= 0) & (at < len(b))
    hit = ((b[np.clip(at, 0, len(b) - 1)] == a[None]) & inside).any(0)
    if hit.mean() >= coverage:
        return True
    c = np.concatenate([[0], np.cumsum(hit)])
    return bool((c[least:] - c[:-least]).max() >= least - int(np.ceil(2 * altered * least)))


def common_runs(a: np.ndarray, b: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Maximal common runs (start in a, start in b, length) of at least k units, by Karp-Rabin hashes of k units."""
    if len(a) < k or len(b) < k:
        return []
    base = np.uint64(0x9E3779B97F4A7C15)
    ha = np.zeros(len(a) - k + 1, dtype=np.uint64)
    hb = np.zeros(len(b) - k + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            ha = ha * base + a[j : j + len(ha)].astype(np.uint64)
            hb = hb * base + b[j : j + len(hb)].astype(np.uint64)
    where: dict[int, list[int]] = defaultdict(list)
    for i, h in enumerate(ha.tolist()):
        where[h].append(i)
    diagonals: dict[int, list[int]] = defaultdict(list)
    for j, h in enumerate(hb.tolist()):
        for i in where.get(h, ()):
            if (a[i : i + k] == b[j : j + k]).all():
                diagonals[j - i].append(i)
    runs = []
    for d, at in diagonals.items():
        start = last = at[0]
        for i in at[1:]:
            if i != last + 1:
                runs.append((start, start + d, last - start + k))
                start = i
            last = i
        runs.append((start, start + d, last - start + k))
    return runs


def tiles(a: np.ndarray, b: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: the longest common runs first, on parts of a and b that no tile has taken yet."""
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    todo = sorted(common_runs(a, b, k), key=lambda r: (-r[2], r[0], r[1]))
    out = []
    while todo:
        again = []
        for i, j, n in todo:
            ok = free_a[i : i + n] & free_b[j : j + n]
            if ok.all():
                free_a[i : i + n] = False
                free_b[j : j + n] = False
                out.append((i, j, n))
            elif ok.any():  # what is left of a run goes back, to be marked in its turn
                s = 0
                for e in [*np.flatnonzero(~ok), n]:
                    if e - s >= k:
                        again.append((i + s, j + s, int(e - s)))
                    s = e + 1
        todo = sorted(again, key=lambda r: (-r[2], r[0], r[1]))
    return sorted(out)


def longest_stretch(t: list[tuple[int, int, int]], word_no: list[int], altered: float, a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(words, altered words) of the longest stretch of the item that tiles in line cover, at most `altered` of it altered.

    A gap costs the item's words in it. In one that is as long on both sides, units of a and b that are equal (too short
    for a tile) cost nothing.
    """

    def cost_of(i: int, di: int, j: int, dj: int) -> int:
        if di == dj:
            return len({word_no[i + q] for q in range(di) if a[i + q] != b[j + q]})
        return max(len({word_no[i + q] for q in range(di)}), dj)

    best, why = 0, 0
    words = lambda a, b: word_no[b - 1] - word_no[a] + 1
    for s in range(len(t)):
        i0, j_end, i_end, gap = t[s][0], t[s][1] + t[s][2], t[s][0] + t[s][2], 0
        if words(i0, i_end) > best:
            best, why = words(i0, i_end), 0
        cur = s
        while True:
            # the next tile in line: ahead in both texts, with the smallest gap
            nxt, cost = None, None
            for q in range(cur + 1, len(t)):
                di, dj = t[q][0] - i_end, t[q][1] - j_end
                if di > 6:
                    break
                if 0 <= dj <= 6 and di >= 0:
                    c = max(di, dj)
                    if cost is None or c < cost:
                        nxt, cost = q, c
            if nxt is None:
                break
            gap += cost_of(i_end, t[nxt][0] - i_end, j_end, t[nxt][1] - j_end)
            cur, i_end, j_end = nxt, t[nxt][0] + t[nxt][2], t[nxt][1] + t[nxt][2]
            n = words(i0, i_end)
            if gap <= max(1, int(np.ceil(altered * n))) and n > best:
                best, why = n, gap
    return best, why


class Rule:
    """When a pair of an item (a) and a document (b), as unit numbers, is a leak."""

    def __init__(self, min_words: int, min_chars: int, altered: float, coverage: float, word_seed: int, char_seed: int, word_tile: int, char_tile: int):
        self.least, self.seed, self.tile = {False: min_words, True: min_chars}, {False: word_seed, True: char_seed}, {False: word_tile, True: char_tile}
        self.altered, self.coverage = altered, coverage

    def judge(self, a: np.ndarray, word_no: list[int], b: np.ndarray, diagonals: set[int], cjk: bool) -> tuple[int, int, bool, float] | None:
        """(stretch, altered, in_line, coverage) of a leak, else None. Coverage is by tiles as long as a seed, in any order."""
        least = self.least[cjk]
        if not may_cover(a, b, diagonals, least, self.altered, self.coverage):
            return None
        t = tiles(a, b, self.tile[cjk])
        n, gap = longest_stretch(t, word_no, self.altered, a, b)
        covered = sum(r[2] for r in t if r[2] >= self.seed[cjk]) / len(a)
        return (n, gap, n >= least, covered) if n >= least or covered >= self.coverage else None


def find_leaks(
    docs: DataFrame,
    doc_id: str,
    text: str,
    items: DataFrame,
    item_id: str,
    item_text: str,
    min_words: int = 20,
    min_chars: int = 40,
    altered: float = 0.1,
    min_coverage: float = 0.8,
    word_seed: int = 5,
    char_seed: int = 6,
    word_tile: int = 2,
    char_tile: int = 3,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, item_id, stretch, altered, in_line, coverage) of every document that holds enough of an item.

    Enough are min_words consecutive words of the item (min_chars letters where it is Chinese or Japanese) in line, with
    at most the share `altered` of them changed, or the share min_coverage of the whole item in unchanged runs of at
    least a seed, in any order; in_line tells that the stretch is enough. Any such stretch holds two unchanged runs of word_seed words (char_seed letters) at
    least, so the seeds miss none. Null and empty texts give nothing; repeated rows give one row; an item shorter than
    the minimum never leaks. Items of at most block_bytes go to all tasks and documents stream by, never shuffled; more
    items are joined with the documents by seed, in one pass over either. Both ways give the same rows.
    """
    rule = Rule(min_words, min_chars, altered, min_coverage, word_seed, char_seed, word_tile, char_tile)
    x = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null and text <> ''")
    its = items.select(F.col(item_id).cast("bigint").alias("item"), F.col(item_text).alias("text")).where("item is not null and text is not null").distinct()
    if (its.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= block_bytes:
        rows = sorted((int(r.item), r.text) for r in its.collect())  # block_bytes at most
        out = _scan(spread(x, "doc"), rows, rule)
    else:
        out = _by_seed(x, its, rule)
    return out.groupBy("doc", "item").agg(F.max("stretch").alias("stretch"), F.max_by("altered", "stretch").alias("altered"), F.max("in_line").alias("in_line"), F.max("coverage").alias("coverage")).select(
        F.col("doc").alias(doc_id), F.col("item").alias(item_id), "stretch", "altered", "in_line", "coverage"
    )


LEAKS = "doc bigint, item bigint, stretch int, altered int, in_line boolean, coverage double"


def _scan(x: DataFrame, rows: list, rule: Rule) -> DataFrame:
    def scan(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = ItemIndex(rows, rule.seed[False], rule.seed[True])
        has_cjk = any(index.cjk.values())
        for pdf in it:
            out = []
            for doc, text in zip(pdf["doc"], pdf["text"]):
                words = words_of(text)
                for cjk in (False, True):
                    if cjk and not (has_cjk and _CJK.search(text)):
                        continue
                    ids = index.numbers(list("".join(words)) if cjk else words)
                    mine = index.candidates(ids, cjk)
                    if not mine:
                        continue
                    b = np.array(ids, dtype=np.int64)
                    for i, diagonals in mine.items():
                        leak = rule.judge(index.ids[i], index.word_no[i], b, diagonals, cjk)
                        if leak:
                            out.append((doc, i, *leak))
            yield pd.DataFrame(out, columns=["doc", "item", "stretch", "altered", "in_line", "coverage"])

    return x.mapInPandas(scan, LEAKS)


def _by_seed(docs: DataFrame, items: DataFrame, rule: Rule) -> DataFrame:
    """The leaks by a shuffled join of seeds; a seed of many documents is split by adaptive execution."""

    def doc_seeds(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for doc, text in zip(pdf["doc"], pdf["text"]):
                words = words_of(text)
                h, n = seed_hashes(words, rule.seed[False], False)
                yield pd.DataFrame({"h": h, "doc": doc, "n": n})
                if _CJK.search(text):
                    h, n = seed_hashes(list("".join(words)), rule.seed[True], True)
                    yield pd.DataFrame({"h": h, "doc": doc, "n": n})

    def item_seeds(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for item, text in zip(pdf["item"], pdf["text"]):
                u, _, cjk = units(text)
                h, n = seed_hashes(u, rule.seed[cjk], cjk)
                yield pd.DataFrame({"h": h, "item": item, "m": n})

    left = spread(docs, "doc").mapInPandas(doc_seeds, "h bigint, doc bigint, n bigint")
    right = items.mapInPandas(item_seeds, "h bigint, item bigint, m bigint")
    pairs = left.join(right, "h").groupBy("doc", "item").agg(F.sum(F.col("n") * F.col("m")).alias("shared")).where("shared >= 2").select("doc", "item")
    pairs = materialise(pairs)
    both = docs.withColumnRenamed("text", "b").join(pairs, "doc").join(items.withColumnRenamed("text", "a"), "item")
    both = both.repartition("doc").sortWithinPartitions("doc", "b")  # a document's words are folded once

    def judge(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, words = None, []
        for pdf in it:
            out = []
            for doc, item, b, a in zip(pdf["doc"], pdf["item"], pdf["b"], pdf["a"]):
                if b is not last and b != last:
                    last, words = b, words_of(b)
                index = ItemIndex([(item, a)], rule.seed[False], rule.seed[True])
                cjk = index.cjk[item]
                ids = index.numbers(list("".join(words)) if cjk else words)
                for diagonals in index.candidates(ids, cjk).values():
                    leak = rule.judge(index.ids[item], index.word_no[item], np.array(ids, dtype=np.int64), diagonals, cjk)
                    if leak:
                        out.append((doc, item, *leak))
            yield pd.DataFrame(out, columns=["doc", "item", "stretch", "altered", "in_line", "coverage"])

    return both.select("doc", "item", "b", "a").mapInPandas(judge, LEAKS)
