from pyspark.sql import functions as F

from sigloom.llm import matching as M

REF = [("HPC", "hippocampus"), ("PHG", "parahippocampal gyrus"), ("PHC", "parahippocampal cortex"), ("WM", "white matter"), ("TPJ", "temporoparietal junction"), ("MFG", "middle frontal gyrus"), ("IFG", "inferior frontal gyrus"), ("IFS", "inferior frontal sulcus"), ("OOB", "out of brain"), ("THAL", "thalamus")]


def _match(spark, labels):
    ref = spark.createDataFrame(REF, "area_code string, area_name string")
    df = spark.createDataFrame([(x, "clash", 1.0, 3) for x in labels], "label string, v string, score double, cosine int")
    return {r.label: r.area_code for r in M.match_values(df, "label", ref, "area_code", "area_name").collect()}


#: Sides and remarks beside three names each, from which the operator learns that they say nothing.
BESIDE = [f"{n} {w}" for w in ("rh", "L", "R", "deep contact") for n in ("hippocampus", "HPC", "TPJ", "thalamus", "middle frontal gyrus")]


def test_meanings(spark):
    want = {
        "wm": "WM", " WM. ": "WM", "rh-WM": "WM", "WM, deep contact": "WM", "WHITE  MATTER (L)": "WM", "matter, white": "WM", "whit ematter": "WM", "Whitematter": "WM", "hipocampus": "HPC", "R hippocampus": "HPC",
        "parahi gyrus": "PHG", "parah cortex": "PHC", "tempo. junct.": "TPJ", "gyrus, middle frontal": "MFG", "inferior frontal uslcus": "IFS", "Inferor Frontal Gyrsu": "IFG", "thalmaus": "THAL",
        "putamen": "none", "brainstem": "none", "?": "none", "": "none", "-": "none", "dead contact": "none", "unknown": "none", "x" * 5000: "none",
    }
    got = _match(spark, [*want, *BESIDE, None, "wm"])
    assert {k: v for k, v in got.items() if k in want} == want
    assert [got[x] for x in BESIDE[:5]] == ["HPC", "HPC", "TPJ", "THAL", "MFG"]


def test_noise_is_learned_not_listed(spark):
    """Words of any language become noise beside three entries' names, and not beside two, nor as part of a name."""
    names = ["hippocampus", "thalamus", "TPJ"]
    values = [f"{n} zzyx" for n in names] + [f"{n} qqq" for n in names[:2]] + [f"matter {n}" for n in names] + ["putamen zzyx", "white matter zzyx"]
    ref = spark.createDataFrame(REF, "code string, name string")
    words = M._words(spark.createDataFrame([(v, v) for v in values], "v string, t string"), "v", "t")
    assert [r.word for r in M.noise_words(words, ref).collect()] == ["zzyx"]
    got = _match(spark, values)
    assert got["white matter zzyx"] == "WM" and got["putamen zzyx"] == "none"


def test_any_script(spark):
    ref = spark.createDataFrame([("HPC", "гиппокамп"), ("AMY", "扁桃体"), ("THAL", "θάλαμος"), ("CTX", "قشرة الدماغ")], "area_code string, area_name string")
    want = {"Гиппокамп": "HPC", "гипокамп": "HPC", "扁桃体": "AMY", "ΘΑΛΑΜΟΣ": "THAL", "قشرة  الدماغ!": "CTX", "海馬": "none", "hpc": "HPC"}
    df = spark.createDataFrame([(x,) for x in want], "label string")
    assert {r.label: r.area_code for r in M.match_values(df, "label", ref, "area_code", "area_name").collect()} == want


def test_no_limit_on_candidates(spark):
    """The entry meant shares fewer n-grams by word than many others, and is still aligned."""
    names = [f"anterior ventral area {chr(97 + i)}{chr(97 + j)}x" for i in range(6) for j in range(6)] + ["anteroventral areas"]
    ref = spark.createDataFrame([(f"C{i}", n) for i, n in enumerate(names)], "area_code string, area_name string")
    df = spark.createDataFrame([("antero ventral area s",)], "label string")
    assert [r.area_code for r in M.match_values(df, "label", ref, "area_code", "area_name").collect()] == ["C36"]


def test_ties_and_empty(spark):
    ref = spark.createDataFrame([("A", "left one"), ("B", "left two"), (None, "nothing"), ("C", None)], "area_code string, area_name string")
    df = spark.createDataFrame([("left",), ("c",)], "label string")
    got = {r.label: r.area_code for r in M.match_values(df, "label", ref, "area_code", "area_name").collect()}
    assert got["left"] == "none" and got["c"] == "C"
    assert M.match_values(df.limit(0), "label", ref, "area_code", "area_name").count() == 0
    assert {r.area_code for r in M.match_values(df, "label", ref.limit(0), "area_code", "area_name").collect()} == {"none"}


def test_retrieval_misses_no_alignment(spark):
    """Strings of a similarity over 0.7 always share a retrieval key, and the bound is one."""
    import random

    rng = random.Random(0)
    rows = []
    for n in range(4, 15):
        for _ in range(250):
            s = [rng.choice("abcdefghijkl") for _ in range(n)]
            t = list(s)
            for _ in range(int(0.3 * n)):
                i = rng.randrange(len(t) - 1)
                t[i : i + 2] = rng.choice([[t[i + 1], t[i]], [t[i], "z", t[i + 1]], ["z", t[i + 1]], [t[i + 1]]])
            rows.append(("".join(s), "".join(t)))
        for i in range(1, n - 2):  # transpositions four apart
            t = list("abcdefghijklmn"[:n])
            for j in range(i, n - 2, 4):
                t[j], t[j + 1] = t[j + 1], t[j]
            rows.append(("abcdefghijklmn"[:n], "".join(t)))
    rows += [("white matter", "whitem atter"), ("hippocampus", "hip po cam pus")]
    keys = spark.createDataFrame(rows, "a string, b string").select("a", "b", F.arrays_overlap(M.retrieval_keys(F.col("a")), M.retrieval_keys(F.col("b"))).alias("hit")).collect()
    a, b = [r.a.replace(" ", "") for r in keys], [r.b.replace(" ", "") for r in keys]
    bound = M.similarity_bound(a, b)
    near = 0
    for r, x, y, most in zip(keys, a, b, bound):
        s = M.edit_similarity(x, y)
        assert s <= most + 1e-9
        if s >= 0.7 and y:
            near += 1
            assert r.hit, (x, y, s)
    assert near > 1500
