"""Queries of the training-data problems, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigloom.llm import clusters, leakage, matching, packing, sampling, sentences
from sigloom.session import broadcast_if_small, materialise, table


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "grp_concat_compo_pca3")
    return clusters.weight_vectors(x, "row_id", "compo", "freq", sorted(c for c in x.columns if c.startswith("ch_")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of every group of alike weights but its smallest, with the smallest."""
    g = clusters.similar_groups(_vectors(spark, d))
    return g.where("row_id <> group_id").select(F.col("group_id").alias("row_id_a"), F.col("row_id").alias("row_id_b"))


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Density clusters with size, stability and most typical rows."""
    return clusters.density_clusters(_vectors(spark, d))[1]


def _plan(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ref = table(spark, d, "condition_ref")
    trials = materialise(sampling.readable_trials(table(spark, d, "info"), ref))  # read for the counts and for the draw
    plan = materialise(sampling.plan_needs(table(spark, d, "sample_plan"), ref))
    return trials, plan, sampling.draw(trials, plan)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Plan rows that the drawn sample can't fill."""
    return sampling.plan_report(*_plan(spark, d)).where("deficit > 0").select("cohort", "event_id").distinct()


def p4_deficits(spark: SparkSession, d: str) -> DataFrame:
    """Every plan row with its need, the trials available, those drawn and the deficit."""
    return sampling.plan_report(*_plan(spark, d)).select("cohort", "event_id", "need", "n_available", "taken", "deficit")


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    """The drawn trials."""
    return _plan(spark, d)[2].select("cohort", "event_id", "rec_id", "trial")


def p4_sample_counts(spark: SparkSession, d: str) -> DataFrame:
    """Drawn trials by plan row."""
    return p4_sample(spark, d).groupBy("cohort", "event_id").agg(F.count("*").alias("n_drawn"))


def p5_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every typed label with the entry it means and the score."""
    e, ref = table(spark, d, "electrodes"), table(spark, d, "area_ref")
    return matching.match_values(e, "label", ref, "area_code", "area_name")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Electrode rows whose label is not an area code, with the entry that is meant."""
    e, ref = table(spark, d, "electrodes"), table(spark, d, "area_ref")
    typed = e.where("label is not null").join(broadcast_if_small(ref.select(F.col("area_code").alias("label"))), "label", "left_anti")
    # distinct values are far fewer than rows: while they fit, a value that a third of the rows hold is not shuffled; a
    # larger table of them is joined by shuffle, where adaptive execution splits such a value's rows
    m = materialise(matching.match_values(typed, "label", ref, "area_code", "area_name").select("label", "area_code"))
    return typed.join(broadcast_if_small(m), "label").select(F.col("elec_id").cast("bigint").alias("elec_id"), "area_code").distinct()


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Typed values that mean no entry, with the rows that hold them."""
    e = table(spark, d, "electrodes")
    m = p5_labels(spark, d).where("area_code = 'none'")
    n = e.groupBy("label").agg(F.count("*").alias("n_rows"))
    return m.join(n, "label").select("label", "n_rows")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return packing.pieces(packing.token_counts(table(spark, d, "documents"), "doc_id", "text"), "doc_id", 1024)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that packing had to split: those of which it placed a second piece."""
    return p6_containers(spark, d).where("piece_no = 1").select("doc_id").distinct()


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every piece with its container."""
    return packing.pack(_pieces(spark, d), "doc_id", 1024)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers and their fill, with the limits of documents and attention cost, without either, and without both."""
    pieces = materialise(_pieces(spark, d))
    out = None
    for limits, docs, share in (("both", packing.MAX_DOCS, packing.COST_SHARE), ("documents", packing.MAX_DOCS, 1.0), ("cost", 1024, packing.COST_SHARE), ("none", 1024, 1.0)):
        by = packing.pack(pieces, "doc_id", 1024, docs, share).groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
        row = by.agg(
            F.count("*").alias("containers"), F.sum("n").alias("pieces"), F.max("tokens").alias("fullest"), F.round(F.avg(F.col("tokens") / 1024), 4).alias("mean_fill"),
            F.count(F.when(F.col("n") >= packing.MAX_DOCS, 1)).alias("containers_of_16_or_more"),
        ).select(F.lit(limits).alias("limits"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every leak, by a stretch in line or by the item's coverage in any order, with both."""
    return leakage.find_leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the items of which they hold a long enough stretch in line."""
    return p7_leaks(spark, d).where("in_line").select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the number of documents that hold them."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count("*").alias("n_documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every document."""
    return sentences.split_sentences(table(spark, d, "documents"), "doc_id", "text")


def p8_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Sentences by document, and the longest."""
    return p8_found(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.col("end_char") - F.col("start_char")).alias("longest"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_clusters, p4_found, p4_deficits, p4_sample, p4_sample_counts, p5_found, p5_labels, p5_unmatched, p6_found, p6_containers, p6_fill, p7_found, p7_leaks, p7_items, p8_found, p8_lengths)
}

_P4 = r"""
WITH ref AS (SELECT CAST(code AS BIGINT) AS c, condition_name AS n FROM condition_ref),
d AS (SELECT rec_id, max_by(cohort, loaded_at) AS cohort, max_by(event_id, loaded_at) AS ev FROM info WHERE rec_id IS NOT NULL GROUP BY rec_id),
t AS (SELECT cohort, unnest(ev) AS e FROM d),
k AS (SELECT cohort, lower(trim(e)) AS e, regexp_replace(regexp_replace(lower(trim(e)), '\s*[/_-]\s*|\s+', '/', 'g'), '/+', '/', 'g') AS nm FROM t),
r AS (SELECT cohort, CASE WHEN regexp_full_match(e, '0*[0-9]{1,15}(\.0*)?') THEN CAST(split_part(e, '.', 1) AS BIGINT) ELSE (SELECT min(c) FROM ref WHERE n = nm) END AS c FROM k),
a AS (SELECT cohort, c, count(*) AS n FROM r GROUP BY 1, 2),
p AS (SELECT cohort, event_id, greatest(coalesce(min_keep, 0), CAST(round(target_share * sample_size) AS BIGINT)) AS need FROM sample_plan),
x AS (SELECT p.cohort, p.event_id, CAST(p.need AS BIGINT) AS need, CAST(coalesce(a.n, 0) AS BIGINT) AS n_available FROM p LEFT JOIN a ON p.cohort = a.cohort AND CAST(p.event_id AS BIGINT) = a.c)
"""

# all pairs of a group and the closure of its links: for small tables
_P1 = r"""
WITH RECURSIVE t AS (SELECT *, lower(trim(compo)) AS c, regexp_replace(lower(trim(freq)), '[^\p{L}]', '', 'g') AS f FROM grp_concat_compo_pca3),
k AS (SELECT *, CASE WHEN regexp_matches(c, '[0-9]') THEN regexp_replace(regexp_extract(c, '[0-9]+'), '^0+([0-9])', '\1') ELSE nullif(regexp_replace(c, '[^\p{L}]', '', 'g'), '') END AS comp,
  nullif(regexp_extract(f, '(delta|theta|alpha|beta|gamma)', 1), '') AS root, regexp_replace(regexp_replace(f, 'delta|theta|alpha|beta|gamma', '', 'g'), 'band|range|freq(uency)?', '', 'g') AS side FROM t),
g AS (SELECT *, comp || '|' || CASE WHEN root IS NULL THEN nullif(f, '') WHEN regexp_full_match(side, 'h|hi|high|upper') THEN 'high_' || root WHEN regexp_full_match(side, 'l|lo|low|lower') THEN 'low_' || root
  WHEN side <> '' THEN side || '_' || root ELSE root END AS grp FROM k),
r AS (SELECT DISTINCT row_id, grp, COLUMNS('ch_[0-9]+') FROM g WHERE grp IS NOT NULL),
l AS (UNPIVOT r ON COLUMNS('ch_[0-9]+') INTO NAME ch VALUE w),
e AS (SELECT a.row_id AS a, b.row_id AS b FROM l a JOIN l b ON a.grp = b.grp AND a.ch = b.ch AND a.row_id < b.row_id GROUP BY ALL HAVING sum(a.w ** 2) * sum(b.w ** 2) > 0 AND abs(sum(a.w * b.w)) >= 0.9 * sqrt(sum(a.w ** 2) * sum(b.w ** 2))),
b AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
x AS (SELECT DISTINCT a AS v, a AS o FROM b UNION SELECT b.b, x.o FROM x JOIN b ON b.a = x.v WHERE x.o < b.b)
SELECT min(o) AS row_id_a, v AS row_id_b FROM x GROUP BY v HAVING min(o) <> v"""

SQL = {
    "p1_found": _P1,
    "p4_found": _P4 + "SELECT cohort, event_id FROM x WHERE need > n_available",
    "p4_deficits": _P4 + "SELECT cohort, event_id, need, n_available, least(need, n_available) AS taken, need - least(need, n_available) AS deficit FROM x",
    # the trials of a plan row with the smallest positions, as the operator draws them
    "p4_sample": r"""
WITH ref AS (SELECT CAST(code AS BIGINT) AS c, condition_name AS n FROM condition_ref),
d AS (SELECT rec_id, max_by(cohort, loaded_at) AS cohort, max_by(event_id, loaded_at) AS ev FROM info WHERE rec_id IS NOT NULL GROUP BY rec_id),
t AS (SELECT rec_id, cohort, unnest(ev) AS e, generate_subscripts(ev, 1) - 1 AS trial FROM d),
k AS (SELECT *, lower(trim(e)) AS l, regexp_replace(regexp_replace(lower(trim(e)), '\s*[/_-]\s*|\s+', '/', 'g'), '/+', '/', 'g') AS nm FROM t),
r AS (SELECT rec_id, cohort, trial, CASE WHEN regexp_full_match(l, '0*[0-9]{1,15}(\.0*)?') THEN CAST(split_part(l, '.', 1) AS BIGINT) ELSE (SELECT min(c) FROM ref WHERE n = nm) END AS c FROM k),
p AS (SELECT cohort, event_id, greatest(coalesce(min_keep, 0), CAST(round(target_share * sample_size) AS BIGINT)) AS need FROM sample_plan),
u AS (SELECT *, CAST(('0x' || substr(md5('0-' || rec_id || '-' || trial), 1, 13)) AS BIGINT) AS u FROM r WHERE c IS NOT NULL),
x AS (SELECT p.cohort, p.event_id, p.need, u.rec_id, u.trial, row_number() OVER (PARTITION BY p.cohort, p.event_id ORDER BY u, rec_id, trial) AS pos
  FROM p JOIN u ON p.cohort = u.cohort AND CAST(p.event_id AS BIGINT) = u.c)
SELECT cohort, event_id, rec_id, CAST(trial AS INTEGER) AS trial FROM x WHERE pos <= need""",
    "p4_sample_counts": _P4 + "SELECT cohort, event_id, least(need, n_available) AS n_drawn FROM x WHERE least(need, n_available) > 0",
}
