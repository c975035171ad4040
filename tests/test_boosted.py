"""Boosted trees against MLlib's, and occlusion against scoring each variant."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerloom.operators import credit_models
from ledgerloom.operators.credit import FEATURES


def table(n, seed=1):
    rng = np.random.default_rng(seed)
    x = {f: rng.normal(size=n) for f in FEATURES}
    x[FEATURES[0]] = rng.integers(0, 5, n).astype(float)  # few values, zeros among them
    x[FEATURES[1]] = np.where(rng.random(n) < 0.7, 0.0, x[FEATURES[1]])
    x[FEATURES[2]] = np.zeros(n)
    label = (x[FEATURES[0]] + x[FEATURES[3]] * x[FEATURES[4]] + rng.normal(size=n) > 2).astype(int)
    return pd.DataFrame({"invoice_id": np.arange(n), **x, "label": label})


@pytest.mark.parametrize("n, rounds", [(700, 10), (25, 3), (12_000, 3)])
def test_scores_are_those_of_mllib(spark, n, rounds):
    df = spark.createDataFrame(table(n)).repartition(3, "invoice_id").cache()
    model = credit_models.fit_boosted(df, rounds=rounds)
    assert sum(len(x) for x in model.limits) < 32 * len(FEATURES) and len(model.trees) == rounds
    got = credit_models.score_boosted(df, model).toPandas().set_index("invoice_id").score.sort_index()
    seen = VectorAssembler(inputCols=FEATURES, outputCol="vec").transform(df).withColumn("label", F.col("label").cast("double"))
    plain = GBTClassifier(featuresCol="vec", labelCol="label", maxIter=rounds, stepSize=0.06, maxDepth=3, seed=42).fit(seen)
    want = plain.transform(seen).select("invoice_id", vector_to_array("probability")[1].alias("p")).toPandas().set_index("invoice_id").p.sort_index()
    assert np.allclose(got, want, atol=1e-9)


def test_no_feature_differs_and_more_bins_than_expected(spark, monkeypatch):
    flat = spark.createDataFrame(table(40).assign(**{f: 1.0 for f in FEATURES}))
    model = credit_models.fit_boosted(flat, rounds=2)
    assert len({r.score for r in credit_models.score_boosted(flat, model).collect()}) == 1
    df = spark.createDataFrame(table(500))
    cut = credit_models._limits
    monkeypatch.setattr(credit_models, "_limits", lambda values, n, bins: cut(values, n, 40))
    assert max(len(x) for x in credit_models.fit_boosted(df, rounds=2).limits) > 32


def test_a_missing_feature_is_refused(spark):
    pdf = table(50)
    df = spark.createDataFrame(pdf).withColumn(FEATURES[5], F.when(F.col("invoice_id") != 7, F.col(FEATURES[5])))
    with pytest.raises(Exception, match="missing or not a number"):
        credit_models.fit_boosted(df, rounds=1)


def test_hidden_features(spark):
    pdf = table(300)
    df = spark.createDataFrame(pdf)
    model = credit_models.fit_boosted(df, rounds=5)
    means = {f: float(pdf[f].mean()) for f in FEATURES}
    found = credit_models.occlusion(df, model, means)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = found.toPandas().set_index(["invoice_id", "feature"]).contribution
    odds = lambda d: d.set_index("invoice_id").score.sort_index().map(lambda p: np.log(p / (1 - p)))
    full = odds(credit_models.score_boosted(df, model).toPandas())
    assert len(got) == 300 * len(FEATURES)
    for f in FEATURES:
        other = odds(credit_models.score_boosted(df.withColumn(f, F.lit(means[f])), model).toPandas())
        assert np.allclose(got.xs(f, level="feature").sort_index(), full - other, atol=1e-9)
