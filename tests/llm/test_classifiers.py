import numpy as np
import pytest

from ledgerloom.llm import labelled, quality, queries, toxicity

DATA = "/root/testdata/sf0.1"
ODD = [(None, "x"), (1, None), (1, ""), (2, "\n \t"), (3, "word " * 30_000), (3, "word " * 30_000), (4, "!!!")]


def auc(score, label):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    n = label.sum()
    return (rank[label == 1].sum() - n * (n - 1) / 2) / (n * (len(label) - n))


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}


def test_toxicity_on_held_out_rows(spark, labels):
    got = [r for r in queries.op2_toxicity(spark, DATA).collect() if r.held_out and r.doc_id in labels]
    score, toxic = np.array([r.score for r in got]), np.array([labels[r.doc_id].toxic for r in got])
    assert auc(score, toxic) > 0.95 and ((score >= 0.5) == toxic).mean() > 0.95
    assert all(r.predicted == (r.score >= 0.5) for r in got)


def test_quality_on_held_out_rows(spark, labels):
    got = [r for r in queries.op3_quality_ordinal(spark, DATA).collect() if r.held_out and r.doc_id in labels]
    good = np.array([labels[r.doc_id].quality for r in got])
    assert (np.array([r.keep for r in got]) == good).mean() > 0.97
    assert all(0 <= r.tail_probability <= 1 and 0 <= r.expected_grade <= 2 for r in got)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in ODD], "doc_id long, text string, score string")
    rated = spark.createDataFrame([(k, k % 2, k % 2) for k in range(6)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    net = toxicity.fit(docs, rated)
    got = toxicity.scored(docs, net).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    model = quality.fit(docs, rated, rated.quality, 2)
    assert len(quality.graded(docs, model).collect()) == len(ODD)
    none = docs.limit(0)
    assert toxicity.scored(none, toxicity.fit(none, rated)).count() == 0 == quality.graded(none, quality.fit(none, rated, rated.quality, 2)).count()


def test_sample_leaves_held_out_rows_alone(spark):
    docs = spark.range(2000).selectExpr("id as doc_id", "'t' as text")
    rated = spark.range(2000).selectExpr("id as doc_id", "cast(id % 3 = 0 as int) as toxic")
    got = labelled.sample(docs, rated, rated.toxic, 50, 2)
    assert sorted(r["count"] for r in got.groupBy("grade").count().collect()) == [50, 50]
    assert got.filter(labelled.held_out()).count() == 0


def test_thresholds_stay_ordered():
    rng = np.random.default_rng(0)
    grades = rng.integers(0, 4, 300)
    texts = [(np.array([g, 10], np.int32), np.ones(2, np.float32)) for g in grades]
    model = quality.train(texts, grades, 4)
    assert (np.diff(model.thresholds) > 0).all()
    z = np.array([quality.sums(model, np.array([g, 10], np.int32), np.ones(2, np.float32), np.array([0, 2]))[0] for g in range(4)])
    assert (np.diff(quality.tails(model, z).sum(axis=1)) > 0).all()


def test_toxicity_learns_from_rows_beyond_the_sample(spark):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 8)) for _ in range(300)]
    made = [(k, k % 2, " ".join([*rng.choice(words[:180], 12), words[180 + 60 * (k % 2) + int(rng.integers(60))]])) for k in range(4000)]
    docs = spark.createDataFrame([(k, t) for k, _, t in made], "doc_id long, text string")
    rated = spark.createDataFrame([(k, t) for k, t, _ in made], "doc_id long, toxic int")
    net = toxicity.fit(docs, rated, per_class=10)
    got = toxicity.scored(docs, net).collect()
    score, toxic = np.array([r.score for r in got]), np.array([r.doc_id % 2 for r in got])
    assert auc(score, toxic) > 0.95 and ((score >= 0.5) == toxic).mean() > 0.9


def test_texts_move_once_to_their_labels(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"word{k} " * 9 + "bad " * (k % 2)) for k in range(400)], "doc_id long, text string")
    rated = spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, toxic int")
    plans, cut = [], toxicity.cut_lineage
    monkeypatch.setattr(toxicity, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        toxicity.fit(docs, rated, per_class=10)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plans[0].count("Exchange hashpartitioning(labelled_id") == 2  # one of the texts, one of the labels
    assert plans[0].count("Exchange ") == 2
