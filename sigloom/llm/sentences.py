"""Splits texts of any language and script into sentences with a linear-chain sequence model over characters.

Every character is tagged as a sentence's last or as inside one. Only a few can be the last (end marks with their closing
quotes, what stands before a blank line, before a blank beside a Thai letter); all others are inside with certainty, so
the chain is decoded exactly over these places alone. A place is scored by a log-linear chain model with Viterbi
decoding, from what stands there: marks, kinds of letters, blanks, and the words on either side. There are no lists of
abbreviations or openers: the labels for training come from the corpus itself. Ends and starts of paragraphs are ends
and starts of sentences; a word that often stands before a mark but never ends a paragraph is no end, and a word that
often follows a mark but never opens a paragraph is no start. For scripts written without end marks the training texts
are stripped of them, so that the model learns from blanks and neighbouring letters alone.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigloom.session import spread

#: End marks: by script. Fixed values.
DOT = "."
ELLIPSIS = "…"
SURE = "。｡！？؟۔।॥።፧፨։။។៕᙮꓿"
MARKS = "!?" + SURE
GREEK_QUESTION = ";;"
OPEN, CLOSE = "«„「『（([【〈《‹", "»」』）)]】〉》›"
PAIR = {"«": "»", "„": "“”\"", "「": "」", "『": "』", "（": "）", "(": ")", "[": "]", "【": "】", "〈": "〉", "《": "》", "‹": "›", "“": "”", '"': '"'}
BRACKETS = "（([【"
_TOKEN = re.compile(
    r"(?P<blank>(?:\r\n|[\n\r \x85])[^\S\n\r \x85]*(?:(?:\r\n|[\n\r \x85])\s*)+| \s*)"
    rf"|(?P<end>(?!(?<=\d)\.(?=\d))[.…{MARKS}]+)|(?P<gq>[{GREEK_QUESTION}])|(?P<q>[{re.escape(OPEN + CLOSE)}“”\"])"
    r"|(?P<thai>(?<=[฀-๏])[^\S\n\r \x85]+(?=[^\W_])|(?<=[^\W_])[^\S\n\r \x85]+(?=[฀-๏]))"
)
#: Characters that are seen by nobody and part nothing (Unicode category Cf).
UNSEEN = frozenset(chr(c) for c in (*range(0xAD, 0xAE), *range(0x600, 0x606), 0x61C, 0x6DD, 0x70F, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0xFEFF, *range(0xFFF9, 0xFFFC)))
_MARKER = re.compile(r"[\s\W]*(?:\d{1,3}|[^\W\d_])[.)]\Z")
#: Letters of scripts that part no words.
_UNSPACED = "฀-໿က-႟ក-៿぀-ヿ㐀-鿿豈-﫿"
_RIGHT = re.compile(rf"[{re.escape(OPEN)}“”\"'‘\[¿¡\s]*([぀-ゟ]|[{_UNSPACED}][^\s.]?|\d{{1,9}}[.)]?|[^\W{_UNSPACED}][^\W{_UNSPACED}'’\-]{{0,23}}|.)", re.S)
_LEFT = re.compile(rf"(?:[{_UNSPACED}{SURE}!?]|^)([^{_UNSPACED}{SURE}!?]*)\Z", re.S)
_DIGITS = re.compile(r"\d+")
_LATE = "(«„“\"[¿¡（'‘「『"


def left_word(before: str) -> str:
    """The word that a mark follows, in lower case, with runs of digits as 0; in scripts without blanks two letters."""
    if not before or before[-1].isspace():
        return ""
    w = before[-24:].rsplit(None, 1)[-1]
    if not w.isascii():
        m = _LEFT.search(w)
        w = (m.group(1) or w[-2:]) if m else w[-2:]
    w = w.lower()
    return w if w.isalpha() else _DIGITS.sub("0", w.lstrip(_LATE))


def right_word(text: str, at: int) -> str:
    """The word that stands at an offset, behind what opens it, with runs of digits as 0; empty at the end."""
    m = _RIGHT.match(text, at)
    return _DIGITS.sub("0", m.group(1)) if m else ""


@lru_cache(maxsize=65536)
def char_class(c: str) -> str:
    """Upper, lower, digit, mark of a script without case, opener or other."""
    if not c:
        return "end"
    if c.isdigit():
        return "d"
    if c in "ºª":
        return "l"
    if c.isalpha():
        if c.isupper() or c.istitle():
            return "U"
        if c.islower():
            return "l"
        return "h" if "぀" <= c <= "ゟ" else "k"
    if unicodedata.category(c) in ("Mn", "Mc"):
        return "k"
    if c in "¿¡" or c in OPEN or c in "“\"":
        return "o"
    if c in ",;:、，；：—–-·،؛)»”’]}/":
        return "p"
    return "s"


class Place:
    """A place where a sentence may end: its offset, its observations, and what holds only after a boundary before."""

    __slots__ = ("end", "sure", "obs", "marker_here", "quote_here")

    def __init__(self, end: int, sure: int, obs: tuple, marker_here: bool = False, quote_here: bool = False):
        self.end, self.sure, self.obs, self.marker_here, self.quote_here = end, sure, obs, marker_here, quote_here


def _matched(tokens: list) -> dict[int, tuple[str, int]]:
    """Offsets of paired quotes and brackets -> (role, partner); pairs do not reach over a blank line."""
    roles: dict[int, tuple[str, int]] = {}
    stack: list[tuple[int, str]] = []
    for m in tokens:
        if m.lastgroup == "blank":
            stack.clear()
        elif m.lastgroup == "q":
            c, at = m.group(), m.start()
            hit = None
            for d in range(len(stack) - 1, -1, -1):
                if c in PAIR[stack[d][1]]:
                    hit = d
                    break
            if hit is not None and not (c == "“" and stack[hit][1] != "„"):
                o = stack[hit][0]
                del stack[hit:]
                roles[o], roles[at] = ("open", at), ("close", o)
            elif c in PAIR:
                stack.append((at, c))
    return roles


def places(text: str) -> list[Place]:
    """Every place of a text where a sentence may end, with what can be seen around it. A dot between digits is none."""
    tokens = list(_TOKEN.finditer(text))
    quotes = [m for m in tokens if m.lastgroup in ("q", "blank")]
    roles = _matched(quotes) if any(m.lastgroup == "q" for m in quotes) else {}
    out: list[Place] = []
    n = len(text)
    depth_end = -1  # no place before this offset: it lies within quotation marks or brackets
    last_end = 0
    para = 0
    skip_to = 0
    for m in tokens:
        kind, s, e = m.lastgroup, m.start(), m.end()
        if kind == "blank":
            out.append(Place(s, 1, ("blank", right_word(text, e))))
            para, last_end, depth_end = e, e, -1
            continue
        if kind == "q":
            role = roles.get(s)
            if role and role[0] == "open" and role[1] > depth_end:
                depth_end = role[1]
            continue
        if s < skip_to:
            continue
        if kind == "thai":
            if s >= depth_end:
                out.append(Place(s, 0, ("thai", "ws", char_class(text[e]), "", text[s - 1], "", text[e])))
            continue
        closed_quote = closed_bracket = False
        opener = -1
        breaks = 0
        after = text[e : e + 2]
        if len(after) == 2 and after[0] == " " and after[1].isalnum():  # most places: one blank, then a word
            if e <= depth_end:
                continue
            p = skip_to = e
            k, nxt = e + 1, after[1]
        else:
            # closing marks after the end mark, also after a blank where their partner is open
            p = e
            while p < n:
                k = p
                while k < n and (text[k].isspace() or text[k] in UNSEEN):
                    k += 1
                gap = text[p:k]
                if k < n and roles.get(k, ("", 0))[0] == "close" and (not gap or (len(gap) <= 2 and text[k] in "»")):
                    closed_bracket |= text[k] in "）)]】"
                    closed_quote |= text[k] not in "）)]】"
                    opener = roles[k][1]
                    p = k + 1
                    continue
                break
            if p <= depth_end:
                continue
            while p < n and text[p] in UNSEEN:
                p += 1
            skip_to = k = p
            while k < n and (text[k].isspace() or text[k] in UNSEEN):
                breaks += text[k] in "\n\r\u2028\u2029\x85"
                k += 1
            nxt = text[k] if k < n else ""
            if breaks and nxt:
                m2 = _TOKEN.match(text, p) if breaks > 1 or text[p] == "\u2029" else None
                if m2 is None and breaks > 1:  # blanks may stand before the line's end
                    m2 = _TOKEN.match(text, p + len(text[p:k]) - len(text[p:k].lstrip(" \t\xa0")))
                if m2 is not None and m2.lastgroup == "blank":
                    nxt = ""
        before = text[max(para, s - 60) : s]
        if kind == "gq":
            letters = [c for c in text[max(last_end, s - 60) : s] if c.isalpha()]
            if not letters or sum("Ͱ" <= c <= "Ͽ" or "ἀ" <= c <= "῿" for c in letters) * 2 <= len(letters):
                if m.group() != ";":
                    continue
            mark = "gq"
        else:
            run = m.group()
            if run == ".":
                mark = "dot"
            elif set(run) <= {".", "…"}:
                mark = "ell"
            else:
                mark = "bang" if set(run) <= set(".!?…") else "sure"
        gap = "" if not nxt else "nl" if breaks else "ws" if k > p else "x"
        cls = char_class(nxt)
        role = roles.get(k, ("", 0))[0] if nxt and roles else ""
        cls = "o" if role == "open" else "p" if role == "close" else "s" if cls == "o" and nxt in '"“' and k not in roles else cls
        word = left_word(before)
        tail = before.rsplit(None, 2) if word and len(word) <= 2 else ()
        before_word = left_word(tail[-2]) if len(tail) > 1 and tail[-2] else ""
        marker = bool(mark == "dot" and not closed_quote and s - last_end < 12 and _MARKER.match(text[last_end : s + 1]))
        here = bool(closed_quote and opener >= 0 and not text[last_end:opener].strip())
        out.append(Place(p, 0, (mark, gap, cls, "Q" if closed_quote else "B" if closed_bracket else "", word, before_word, right_word(text, k) if nxt else ""), marker, here))
        last_end = p
    return out


def _keys(p: Place) -> tuple[tuple, tuple]:
    """What tells about an end (the word before a full stop, else the mark), and what about a start (the word after)."""
    mark, gap, _, closed, word, _, right = p.obs
    return ((word,) if mark == "dot" and not closed else (mark, closed)), (right, gap == "x" and right[:1].isdigit())


def _ratios(found: Counter, of: Counter, doubt: float, most: float = 0.7) -> dict[tuple, float]:
    """Logarithm of each key's count against what the share over all keys makes expected, at most `most`."""
    share = sum(found.values()) / max(sum(of.values()), 1)
    return {k: min(math.log((found[k] + doubt) / (n * share + doubt)), most) for k, n in of.items()}


def weak_labels(texts: list[list[Place]], openers: list[str], bias: float = 2.6, doubt: float = 0.2, rounds: int = 2) -> list[list[int]]:
    """Labels that the texts themselves give, from the places of each and its first word: 1 where a sentence ends.

    At the end of a paragraph a sentence ends. Elsewhere two ratios are added: how often what stands before is found at
    ends of paragraphs, and how often what stands after is found at their starts, each against how often it would be if
    it ended or began sentences as often as others do. Their sum of logarithms and `bias` must be positive; `doubt` is
    added to counts, so that rare words say little. In each further round a place that one side explains better as no
    boundary no longer counts against the other side: a name isn't blamed for the title before it. A list number belongs
    to what follows. A blank between two Thai letters ends a sentence, one beside a digit or another letter doesn't.
    """
    ends, starts = Counter(), Counter((w, False) for w in openers)
    inner: Counter = Counter()  # pairs of what stands before and after, within paragraphs
    for ps in texts:
        for p in ps:
            if p.sure:
                starts[p.obs[1], False] += 1
            elif p.obs[0] != "thai":
                before, after = _keys(p)
                if p.obs[1]:
                    inner[before, after] += 1
                else:
                    ends[before] += 1
    end: dict[tuple, float] = {}
    start: dict[tuple, float] = {}
    for _ in range(rounds + 1):
        ends_all, starts_all = Counter(ends), Counter(starts)
        for (before, after), n in inner.items():
            e, s = end.get(before, 0.0), start.get(after, 0.0)
            if not (s < 0 and s < e - 1):
                ends_all[before] += n
            if not (e < 0 and e < s - 1):
                starts_all[after] += n
        end, start = _ratios(ends, ends_all, doubt), _ratios(starts, starts_all, doubt)

    def score(before: tuple, after: tuple) -> float:
        e = end.get(before, 0.0)
        if "." in before[0] and ends_all[before] < 5:  # written together with the word before: its last part is known better
            e = min(e, end.get((before[0].rsplit(".", 1)[1],), 0.0))
        return e + start.get(after, 0.0)

    out = []
    for ps in texts:
        tags, prev = [], 1
        for p in ps:
            if p.sure or not p.obs[1]:
                prev = 1
            elif p.obs[0] == "thai":
                prev = int("฀" <= p.obs[4] <= "๏" and "฀" <= p.obs[6] <= "๏")
            elif prev and p.marker_here:
                prev = 0
            else:
                prev = int(score(*_keys(p)) + bias > 0)
            tags.append(prev)
        out.append(tags)
    return out


def _shape(word: str) -> str:
    """Digits, one letter, few letters, with an inner mark, or other."""
    if not word:
        return ""
    if word == "0":
        return "0"
    if "." in word:
        return "."
    return str(min(len(word), 4)) if word.isalpha() else "x"


def _place_features(mark: str, gap: str, cls: str, closed: str) -> list[str]:
    return [f"m={mark}|{gap}|{cls}|{closed}", f"m={mark}|{cls}", f"c={closed}|{cls}", f"m={mark}|{gap}"]


def _left_features(mark: str, gap: str, cls: str, word: str, before: str) -> list[str]:
    s = _shape(word)
    x = [f"s={mark}|{s}|{gap}|{cls}", f"e={mark}|{word[-3:]}"]
    if mark not in ("dot", "thai"):
        return x
    if "." in word[:-1]:
        x.append(f"l={mark}|{word.rsplit('.', 1)[1]}")
    return [f"l={mark}|{word}", f"l={word}|{cls}", f"b={before}|{word}", *x]


def _right_features(right: str, closed: str, gap: str) -> list[str]:
    return [f"r={right}", f"r={right}|{closed}", f"p={right[:3]}", f"h={_shape(right)}|{gap}"]


def _features(p: Place) -> list[str]:
    """Features of a place, whatever the tag before."""
    if p.sure:
        return ["sure"]
    mark, gap, cls, closed, word, before, right = p.obs
    return _place_features(mark, gap, cls, closed) + _left_features(mark, gap, cls, word, before) + _right_features(right, closed, gap)


def _chain_features(p: Place, prev: int) -> list[str]:
    """Features of a place and the tag before; a quotation right at a sentence's start is one of its own kind."""
    return [f"t={prev}", f"q={prev}|{p.obs[2]}|{p.obs[3]}", f"q={prev}|{p.obs[6]}"] if p.quote_here else [f"t={prev}"]


class Potentials:
    """Scores of places under fixed weights, kept by part: what is seen, the word before, the word after."""

    def __init__(self, w: dict[str, float]):
        self.w = w
        self.kept: tuple[dict, dict, dict] = ({}, {}, {})
        self.plain = tuple(w.get(f"t={prev}", 0.0) for prev in (0, 1))

    def _part(self, n: int, make, key: tuple) -> float:
        got = self.kept[n].get(key)
        if got is None:
            if len(self.kept[n]) > 500_000:
                self.kept[n].clear()
            got = self.kept[n][key] = sum(self.w.get(f, 0.0) for f in make(*key))
        return got

    def of(self, p: Place) -> tuple[float, float]:
        """Score of a boundary against inside, after a tag 0 and after a tag 1."""
        if p.sure:
            return 0.0, 0.0
        mark, gap, cls, closed, word, before, right = p.obs
        b = self._part(0, _place_features, (mark, gap, cls, closed)) + self._part(1, _left_features, (mark, gap, cls, word, before)) + self._part(2, _right_features, (right, closed, gap))
        if not p.quote_here:
            return b + self.plain[0], b + self.plain[1]
        get = self.w.get
        return b + sum(get(f, 0.0) for f in _chain_features(p, 0)), b + sum(get(f, 0.0) for f in _chain_features(p, 1))


def viterbi(ps: list[Place], pots: list[tuple[float, float]], gold: list[int] | None = None, margin: float = 0.0) -> list[int]:
    """Best tags (1: boundary) by the places' potentials, of a boundary against inside after either tag.

    Two constraints are hard: a blank line is a boundary, and a list number right after a boundary is none.
    With gold, every wrong tag gets `margin` on top, for training.
    """
    if not ps:
        return []
    NEG = float("-inf")
    s0, s1 = NEG, 0.0  # a text begins after a boundary
    back: list[tuple[int, int]] = []
    for k, p in enumerate(ps):
        p0, p1 = pots[k]
        outside = inside = 0.0
        if gold is not None:
            outside, inside = margin * (1 - gold[k]), margin * gold[k]
        a, b = s0 + outside + p0, (s1 + outside + p1 if not p.marker_here else NEG)  # a list number belongs to what follows
        n1, from1 = (a, 0) if a > b else (b, 1)
        n0, from0 = (NEG, 1) if p.sure else (s0 + inside, 0) if s0 > s1 else (s1 + inside, 1)
        back.append((from0, from1))
        s0, s1 = n0, n1
    tag = 1 if s1 >= s0 else 0
    tags = [tag]
    for k in range(len(ps) - 1, 0, -1):
        tag = back[k][tag]
        tags.append(tag)
    return tags[::-1]


def train(texts: list[list[Place]], labels: list[list[int]], epochs: int = 8, margin: float = 2.0) -> dict[str, float]:
    """Averaged structured perceptron with a margin, over the places of texts and their labels."""
    names: dict[str, int] = {}
    number = lambda fs: [names.setdefault(f, len(names)) for f in fs]
    data = [([number(_features(p)) for p in ps], [(number(_chain_features(p, 0)), number(_chain_features(p, 1))) for p in ps], ps, gold) for ps, gold in zip(texts, labels) if ps]
    w, total, step = [0.0] * len(names), [0.0] * len(names), 1
    for _ in range(epochs):
        wrong = 0
        for base, chain, ps, gold in data:
            pots = []
            for fs, (c0, c1) in zip(base, chain):
                b = sum([w[f] for f in fs])
                pots.append((b + sum([w[f] for f in c0]), b + sum([w[f] for f in c1])))
            got = viterbi(ps, pots, gold, margin)
            if got != gold:
                wrong += 1
                pg = pr = 1
                for fs, c, g, r in zip(base, chain, gold, got):
                    if g != r or pg != pr:
                        for tag, prev, sign in ((g, pg, 1.0), (r, pr, -1.0)):
                            if tag:
                                for f in fs + c[prev]:
                                    w[f] += sign
                                    total[f] += sign * step
                    pg, pr = g, r
            step += 1
        if not wrong:
            break
    return {f: w[i] - total[i] / step for f, i in names.items() if w[i] - total[i] / step}


def strip_thai_marks(text: str) -> str:
    """Text with its end marks taken away where the script writes none, for training on blanks alone."""
    return re.sub(r"(?<=[฀-๏])[.!?…]+(?=\s|$)", "", text)


def sentence_spans(text: str, model: Potentials) -> list[tuple[int, int]]:
    """(start, end) of every sentence in code points, without surrounding white space."""
    out = []
    start = 0
    ps = places(text)
    for p, tag in zip(ps, viterbi(ps, [model.of(p) for p in ps])):
        if tag:
            out.append((start, p.end))
            start = p.end
    out.append((start, len(text)))
    spans = []
    for a, b in out:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            spans.append((a, b))
    return spans


def fit(docs: DataFrame, doc_id: str, text: str, sample: int = 5000, longest: int = 200_000) -> dict[str, float]:
    """Weights trained on about `sample` whole texts, those whose ids have the smallest hashes.

    The bounds of the training rows are these two parameters, whatever the corpus' size: texts over `longest` characters
    are not trained on. The corpus is counted by its ids alone; the places of the sample are found by the tasks.
    """
    x = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("d is not null and t is not null and t <> ''")
    n = docs.select(doc_id).where(F.col(doc_id).isNotNull()).count()
    share = min(1.0, sample / max(n, 1))
    chosen = x.where((F.pmod(F.xxhash64("d"), F.lit(1 << 30)) < int(share * (1 << 30))) & (F.length("t") <= longest))

    def read(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            ts = [strip_thai_marks(t) for t in pdf["t"]]
            yield pd.DataFrame({"d": pdf["d"].astype(str), "p": [pickle.dumps((right_word(t, 0), places(t))) for t in ts]})

    rows = sorted(spread(chosen, "d").mapInPandas(read, "d string, p binary").collect(), key=lambda r: (r.d, r.p))
    got = [pickle.loads(r.p) for r in rows]
    texts = [ps for _, ps in got]
    return train(texts, weak_labels(texts, [w for w, _ in got]))


def split_sentences(docs: DataFrame, doc_id: str, text: str, weights: dict[str, float] | None = None, sample: int = 5000) -> DataFrame:
    """(doc_id, sent_no, start_char, end_char): the sentences of every document, numbered from 1 in text order.

    Offsets count code points, the end is exclusive. Together the sentences cover all characters that are not white
    space. Null, empty and blank texts give no row; repeated rows give repeated sentences; whole texts are read.
    """
    w = fit(docs, doc_id, text, sample) if weights is None else weights

    def split(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Potentials(w)
        for pdf in it:
            out = [(d, i, a, b) for d, t in zip(pdf["d"], pdf["t"]) for i, (a, b) in enumerate(sentence_spans(t, model), 1)]
            yield pd.DataFrame(out, columns=["d", "sent_no", "start_char", "end_char"])

    x = docs.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).alias("t")).where("d is not null and t is not null")
    return spread(x, "d").mapInPandas(split, "d bigint, sent_no int, start_char int, end_char int").withColumnRenamed("d", doc_id)
