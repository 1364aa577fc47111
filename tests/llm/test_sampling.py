from sigloom.llm import sampling as S

INFO = "rec_id bigint, cohort string, event_id array<string>, loaded_at string, code int, need int"
PLAN = "cohort string, event_id string, target_share double, min_keep int, sample_size int, n_available int"


def _ref(spark):
    return spark.createDataFrame([(1, "old/correct"), (2, "new/correct"), (101, "old/incorrect")], "code int, condition_name string")


def _run(spark, info, plan):
    trials = S.readable_trials(spark.createDataFrame(info, INFO), _ref(spark))
    needs = S.plan_needs(spark.createDataFrame(plan, PLAN), _ref(spark))
    return trials, needs


def test_spellings_deliveries_and_deficits(spark):
    info = [
        (1, "a", ["1", " 01", "1.0", "OLD / Correct", "old_correct", "2", None, "?", "999", "", "0101"], "t2", 9, 9),
        (1, "a", ["2"] * 50, "t1", 9, 9),
        (1, "a", ["1", " 01", "1.0", "OLD / Correct", "old_correct", "2", None, "?", "999", "", "0101"], "t2", 9, 9),
        (2, "a", None, "t1", 9, 9), (3, None, ["1"], None, 9, 9), (None, "a", ["1"], "t9", 9, 9),
    ]
    plan = [("a", "1", 0.5, 2, 10, 0), ("a", "2", 0.1, 3, 10, 0), ("a", "101", None, 1, None, 0), ("b", "1", 0.5, 0, 10, 0), (None, "1", 0.0, 1, 1, 0)]
    trials, needs = _run(spark, info, plan)
    sample = S.draw(trials, needs)
    report = S.plan_report(trials, needs, sample)
    got = {(r.cohort, r.event_id): (r.need, r.n_available, r.taken, r.deficit) for r in report.collect()}
    assert got == {("a", "1"): (5, 5, 5, 0), ("a", "2"): (3, 1, 1, 2), ("a", "101"): (1, 1, 1, 0), ("b", "1"): (5, 0, 0, 5), (None, "1"): (1, 1, 1, 0)}
    drawn = sample.groupBy("cohort", "event_id").count().collect()
    assert {(r.cohort, r.event_id): r["count"] for r in drawn} == {("a", "1"): 5, ("a", "2"): 1, ("a", "101"): 1, (None, "1"): 1}


def test_exact_counts_at_any_bucket_number(spark):
    info = [(i, "a" if i % 3 else "b", [str(1 + (i + j) % 2) for j in range(40)], "t", 0, 0) for i in range(200)]
    plan = [("a", "1", 0.5, 0, 2000, 0), ("a", "2", 0.1, 0, 50, 0), ("b", "1", 1.0, 0, 1340, 0), ("b", "2", 0.3, 0, 10, 0)]
    trials, needs = _run(spark, info, plan)
    want = {(r.cohort, r.event_id): min(r.need, r.n_available) for r in S.goals(trials, needs).collect()}
    for buckets in (1, 7, 4096):
        d = S.draw(trials, needs, seed=5, buckets=buckets)
        assert {(r.cohort, r.event_id): r["count"] for r in d.groupBy("cohort", "event_id").count().collect()} == want
        assert d.select("rec_id", "trial").distinct().count() == sum(want.values())


def test_empty(spark):
    trials, needs = _run(spark, [], [])
    sample = S.draw(trials, needs)
    assert sample.count() == 0 and S.plan_report(trials, needs, sample).count() == 0


def test_deficits_are_those_of_the_sample(spark):
    """A trial that the sample lacks is a deficit, whatever is available."""
    trials, needs = _run(spark, [(i, "a", ["1", "2"], "t", 0, 0) for i in range(10)], [("a", "1", 1.0, 0, 10, 0), ("a", "2", 0.5, 0, 10, 0)])
    sample = S.draw(trials, needs)
    assert [r.deficit for r in S.plan_report(trials, needs, sample).collect()] == [0, 0]
    less = S.plan_report(trials, needs, sample.where("not (event_id = '1' and rec_id < 3)"))
    assert {r.event_id: (r.taken, r.deficit) for r in less.collect()} == {"1": (7, 3), "2": (5, 0)}
