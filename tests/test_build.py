"""Staged corpus build with its cache, and evaluation over time."""

import inspect

import pytest
from pyspark.sql import functions as F

from msgrisk.plans import build, temporal

ROWS = "row_ord long, source string, group_id string, label int, text string"


def corpora(spark):
    one = [(i, "a", f"g{i % 10}", i % 2, f"first text number {'abcdefghij'[i % 10]} {'klmnopqrst'[i // 10]}") for i in range(60)]
    two = [(i, "b", f"h{i % 5}", i % 2, f"second text {'abcdefghij'[i % 10]} {'klmnopqrst'[i // 10]}") for i in range(30)]
    two += [(90, "b", "h1", 0, one[0][4]), (91, "b", "h2", 1, one[2][4]), (92, "b", "h3", 1, one[1][4])]  # a copy, a conflict, a copy
    extra = [(1, "x", "e1", 1, "extra one"), (2, "x", "e1", 0, "EXTRA  one"), (3, "x", "e2", 1, two[0][4]), (4, "x", "e3", 0, "reserved text")]
    hard = [(1, "n", "g0", 0, "hard zero"), (2, "n", "new", 0, "hard two"), (3, "n", "new", 0, "extra one")]
    frame = lambda rows: spark.createDataFrame(rows, ROWS)
    return [frame(one), frame(two)], frame(extra), frame(hard), spark.createDataFrame([("Reserved text",)], "text string")


def test_build_and_cache(spark, tmp_path):
    inputs = corpora(spark)
    corpus, stages = build.build_corpus_pipeline(*inputs, build.StageCache(spark, str(tmp_path)))
    rows = {r.stage: r for r in stages.collect()}
    assert not any(r.cached for r in rows.values())
    assert rows["united"].rows == 93 and rows["deduplicated"].rows == 89  # two copies go, and both rows of the conflict
    assert rows["extra"].rows == 1 and rows["with_extra"].rows == 90
    table = corpus.collect()
    assert rows["corpus"].rows == len(table) == len({r.row_ord for r in table if r.side}) and 0 < rows["corpus"].held_out < 90
    sides = {}
    for r in table:
        sides.setdefault(r.group_id, set()).add(r.side)
    assert all(len(s) == 1 for s in sides.values())
    assert {r.text for r in table if r.source == "n"} == ({"hard zero", "hard two"} if sides["g0"] == {"train"} else {"hard two"})
    again = {r.stage: r for r in build.build_corpus_pipeline(*inputs, build.StageCache(spark, str(tmp_path)))[1].collect()}
    assert all(r.cached for r in again.values()) and {n: r.lineage for n, r in again.items()} == {n: r.lineage for n, r in rows.items()}
    # Other hard negatives: only what depends on them runs again. Another seed: everything from the split on.
    other = (*inputs[:2], inputs[2].where("row_ord > 1"), inputs[3])
    changed = {r.stage: r.cached for r in build.build_corpus_pipeline(*other, build.StageCache(spark, str(tmp_path)))[1].collect()}
    assert [n for n, c in changed.items() if not c] == ["hard_negatives", "corpus"]
    reseeded = {r.stage: r.cached for r in build.build_corpus_pipeline(*inputs, build.StageCache(spark, str(tmp_path)), seed=7)[1].collect()}
    assert [n for n, c in reseeded.items() if c] == ["united", "deduplicated"]


def test_unfinished_stage_runs_again(spark, tmp_path):
    cache = build.StageCache(spark, str(tmp_path))
    source = cache.source("t", spark.range(5))
    _, key = cache.stage("s", doubled, source)
    (tmp_path / f"s-{key}" / "_SUCCESS").unlink()
    again = build.StageCache(spark, str(tmp_path))
    table, _ = again.stage("s", doubled, source)
    assert again.runs[0][2] is False and table.count() == 5
    # The digest of a table knows its rows, not their order or partitions, and counts copies.
    same = cache.source("t", spark.range(5).orderBy(F.desc("id")).repartition(3))[1]
    assert same == source[1] != cache.source("t", spark.range(5).unionByName(spark.range(1)))[1]
    assert "id * 2" in inspect.getsource(doubled)


def doubled(df):
    return df.selectExpr("id * 2 AS id")


@pytest.fixture(scope="module")
def dated(spark):
    rows = [(f"2020-0{1 + i % 6}-01", int(i % 5 == 0), (i % 7) / 7 + (0.05 if i % 5 == 0 else 0), f"g{i % 7}") for i in range(120)]
    rows += [(None, 1, 0.9, "g1"), ("2020-04-01", None, 0.5, "g2"), ("2020-06-01", 1, None, None)]
    return spark.createDataFrame(rows, "d string, label int, score double, grp string").withColumn("observed_at", F.col("d").cast("timestamp"))


def test_temporal_evaluation(dated):
    out = {r["slice"]: r for r in temporal.temporal_evaluation(dated, "2020-03-01", "2020-05-01", 0.2, group="grp").collect()}
    rows = [r for r in dated.collect() if r.label is not None and r.d]
    valid, later = [r for r in rows if "2020-03-01" <= r.d < "2020-05-01"], [r for r in rows if r.d >= "2020-05-01"]

    def rates(part, t):
        alert = [r for r in part if r.score is not None and r.score >= t]
        return sum(r.label for r in alert), sum(1 - r.label for r in alert), sum(r.label for r in part), sum(1 - r.label for r in part)

    offered = sorted({r.score for r in valid})
    best = max((t for t in offered if rates(valid, t)[1] / rates(valid, t)[3] <= 0.2), key=lambda t: (rates(valid, t)[0], -rates(valid, t)[1], -t))
    for name, part in (("validation", valid), ("holdout", later)):
        tp, fp, p, n = rates(part, best)
        r = out[name]
        assert (r.threshold, r.tp, r.false_positives, r.positives, r.negatives) == (best, tp, fp, p, n)
        assert r.fpr_low <= r.fpr <= r.fpr_high and r.recall_low <= r.recall <= r.recall_high and 0 < r.pr_auc <= 1
    assert out["validation"].fpr <= 0.2
    old = {r.grp for r in rows if r.d < "2020-03-01"} | {"g1"}
    assert out["validation"].group_overlap == len(old & {r.grp for r in valid}) and out["holdout"].group_overlap == 7


def test_slices_without_a_choice(dated):
    one_class = temporal.temporal_evaluation(dated.where("label = 1 OR d < '2020-03-01'"), "2020-03-01", "2020-05-01", 0.1).collect()
    assert one_class[0].status == "unavailable" and one_class[0].threshold == 0.5 and one_class[1].status == "evaluated" and one_class[0].fpr is None
    nothing = temporal.temporal_evaluation(dated.limit(0), "2020-03-01", "2020-05-01", 0.1).collect()
    assert [(r.n, r.status, r.recall) for r in nothing] == [(0, "unavailable", None)] * 2
    # No false positive is allowed and the best score is one: the threshold lies above every score.
    strict = dated.sparkSession.createDataFrame([("2020-03-01", 0, 1.0), ("2020-03-01", 1, 1.0), ("2020-06-01", 1, 1.0)], "d string, label int, score double")
    top = temporal.temporal_evaluation(strict.withColumn("observed_at", F.col("d").cast("timestamp")), "2020-03-01", "2020-05-01", 0.0).collect()
    assert top[0].threshold > 1.0 and top[1].tp == 0


def test_frozen_threshold_of_a_fitted_model(spark):
    """Trained on old rows, threshold from later ones, judged on the newest."""
    from msgrisk.plans import training

    bad, good = "urgent verify your account password", "meeting notes for the project plan"
    rows = [(i, f"g{i}", i % 2, f"{bad if i % 2 else good} {'abcdefghij'[i % 10]}", f"2020-0{1 + i // 20}-01") for i in range(80)]
    docs = spark.createDataFrame(rows, "id long, grp string, label int, text string, d string").withColumn("observed_at", F.col("d").cast("timestamp"))
    train = docs.where("d < '2020-03-01'")
    fitted = training.Vectorizer.fit(train, "id", min_df={"word": 2, "char": 3})
    model = training.fit_candidate(fitted.transform(train, "id"), "complement_nb", "grp")
    scores = training.scored(model, fitted.transform(docs, "id")).select("id", "label", "score", "observed_at", "grp")
    out = temporal.temporal_evaluation(scores, "2020-03-01", "2020-04-01", 0.05, group="grp").collect()
    assert [(r.slice, r.n, r.recall, r.fpr, r.group_overlap) for r in out] == [("validation", 20, 1.0, 0.0, 0), ("holdout", 20, 1.0, 0.0, 0)]
