import random
import unicodedata

from sigloom.llm import leakage as L

WORDS = "the patient caretaker slowed down an unfinished prelude beside humming fridge until untrained technician nearby needed four attempts elderly choir member anticipated muted melody during third visit so that seasoned left-handed student wrote single word while rain hit roof".split()


def _find(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id bigint, text string, doc string, item int")
    e = spark.createDataFrame([(i, t) for i, t in items], "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r for r in L.find_leaks(d, "doc_id", "text", e, "item_id", "text", **kw).collect()}


def test_disguises_and_limits(spark):
    rng = random.Random(0)
    item = [rng.choice(WORDS) + str(i) for i in range(40)]
    text = " ".join(item)
    altered = list(item)
    for i in (4, 13, 24, 33):
        altered[i] = "changed"
    cyr = text.translate(str.maketrans("aeocp", "аеоср"))
    docs = [
        (1, text), (2, "Before. " + text.upper().replace(" ", ",\n") + " after"), (3, " ".join(altered)), (4, cyr), (5, "".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in text)), (6, text.replace("t", "t­").replace("e", "e​")),
        (7, "x " + " ".join(item[5:25]) + " y"), (8, "x " + " ".join(item[5:24]) + " y"), (9, " ".join(item[:10] + ["zz"] * 30 + item[10:19])), (10, ""), (11, None), (12, "nothing here " * 3000), (13, "filler " * 20000 + text), (14, unicodedata.normalize("NFD", text)),
        (15, " ".join(w if i % 4 else "changed" for i, w in enumerate(item))),
    ]
    got = {d for d, _ in _find(spark, docs + docs[:2], [(1, text), (2, "too short to leak"), (3, None), (4, "")])}
    assert got == {1, 2, 3, 4, 5, 6, 7, 13, 14}


def test_letters_of_scripts_without_blanks(spark):
    rng = random.Random(1)
    item = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(80))
    got = _find(spark, [(1, "前文。" + item[10:50] + "。后文"), (2, item[10:49]), (3, "\n".join(item[i : i + 7] for i in range(0, 80, 7)))], [(9, item)])
    assert {d for d, _ in got} == {1, 3}


def _by(rows):
    return {k: (r.stretch, r.altered, r.in_line, round(r.coverage, 6)) for k, r in rows.items()}


def test_join_of_seeds_equals_broadcast_and_empty(spark):
    rng = random.Random(2)
    items = [(i, " ".join(f"{rng.choice(WORDS)}{rng.randrange(99)}" for _ in range(30))) for i in range(12)]
    items.append((50, "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(80))))
    docs = [(100 + i, "start " + t + " end") for i, t in items] + [(300, "a b c"), (301, None), (302, ""), (303, items[3][1] + " and " + items[4][1]), (304, "前文。" + items[-1][1][5:60])]
    docs += [(305, " ".join(items[7][1].split()[:18])), (306, "same closing words of all " * 30), docs[0]]
    want = _find(spark, docs, items)
    assert {(100 + i, i) for i, _ in items} | {(303, 3), (303, 4), (304, 50)} == set(want)
    assert _by(_find(spark, docs, items, block_bytes=0)) == _by(want)
    assert _find(spark, [], items) == {} and _find(spark, docs, []) == {}
    assert _find(spark, [], items, block_bytes=0) == {}


def test_reordered_passages(spark):
    """Four pieces of ten words in another order cover the whole item, though no stretch in line is long enough."""
    item = [f"{w}{i}" for i, w in enumerate((WORDS * 2)[:40])]
    pieces = [item[i : i + 10] for i in (20, 0, 30, 10)]
    docs = [(1, " filler ".join(" ".join(p) for p in pieces)), (2, " ".join(pieces[0] + ["x"] * 9 + pieces[1])), (3, " ".join(item))]
    for block in (L.BLOCK_BYTES, 0):
        got = _by(_find(spark, docs, [(1, " ".join(item))], block_bytes=block))
        assert got == {(1, 1): (10, 0, False, 1.0), (3, 1): (40, 0, True, 1.0)}


def test_tiles_equal_brute_force():
    """Greedy tiling against the textbook form that scans for the longest unmarked match each time."""
    import numpy as np

    rng = random.Random(3)
    for _ in range(60):
        a = np.array([rng.randrange(4) for _ in range(25)])
        b = np.array([rng.randrange(4) for _ in range(30)])
        ma, mb, brute = [False] * 25, [False] * 30, 0
        while True:
            best = (0, 0, 0)
            for i in range(25):
                for j in range(30):
                    n = 0
                    while i + n < 25 and j + n < 30 and a[i + n] == b[j + n] and not ma[i + n] and not mb[j + n]:
                        n += 1
                    best = max(best, (n, -i, -j))
            n, i, j = best[0], -best[1], -best[2]
            if n < 3:
                break
            for q in range(n):
                ma[i + q] = mb[j + q] = True
            brute += n
        t = L.tiles(a, b, 3)
        assert all((a[i : i + n] == b[j : j + n]).all() for i, j, n in t)
        assert abs(sum(n for _, _, n in t) - brute) <= 4


def test_single_words_between_altered_ones(spark):
    item = [f"{w}{i}" for i, w in enumerate(WORDS[:20])]
    two, three = list(item), list(item)
    for i in (9, 11):
        two[i] = "changed"
    for i in (7, 9, 11):
        three[i] = "changed"
    deaf = [*item[:9], "tone-deaf", *item[10:]]
    docs = [(1, " ".join(two)), (2, " ".join(three))]
    assert {d for d, _ in _find(spark, docs, [(1, " ".join(item))])} == {1}
    other = [w if w != "tone-deaf" else "red-blue" for w in deaf]
    other[14] = "changed"  # two altered words, one of them of two units
    assert {d for d, _ in _find(spark, [(4, " ".join(other))], [(1, " ".join(deaf))])} == {4}
