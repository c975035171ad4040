"""Skew helpers against numpy and pandas, with one key holding most rows."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ledgerloom.functions import spread


def skewed(n=4000, seed=3):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"k": np.where(rng.random(n) < 0.8, 0, rng.integers(1, 6, n)), "i": np.arange(n), "v": np.round(rng.lognormal(3, 1, n), 2)})


def test_exact_quantiles_match_linear_interpolation(spark):
    pdf = skewed()
    got = spread.exact_quantiles(spark.createDataFrame(pdf), ["k"], "v", {"a": 0.05, "b": 0.5, "c": 0.93}, parts=16).toPandas().set_index("k")
    for k, g in pdf.groupby("k"):
        want = np.quantile(g["v"], [0.05, 0.5, 0.93])
        assert np.allclose(got.loc[k, ["a", "b", "c"]].astype(float), want)


def test_quantiles_of_odd_values(spark):
    """Ties, signs, tiny and huge values, infinities, null keys and one hot key; few parts make many passes."""
    rng = np.random.default_rng(4)
    sets = {
        0: np.concatenate((np.full(3000, 7.25), rng.normal(0, 1, 40))), 1: rng.normal(0, 1e-12, 501), 2: np.sign(rng.normal(0, 1, 300)) * 10.0 ** rng.uniform(-300, 300, 300),
        3: np.array([5.0]), 4: np.array([-1.0, 1.0]), 5: np.arange(-500, 501) / 4.0, None: np.array([1.0, 2.0, 4.0, -0.0]),
    }
    pdf = [(k, float(x)) for k, values in sets.items() for x in values] + [(6, None)]
    probs = {"lo": 0.0, "a": 0.1, "m": 0.5, "z": 0.999, "hi": 1.0}
    for parts in (64, 4096):
        got = {r.k: r for r in spread.exact_quantiles(spark.createDataFrame(pdf, "k long, v double"), ["k"], "v", probs, parts=parts).collect()}
        assert got.keys() == sets.keys()
        for k, values in sets.items():
            want = np.quantile(values, list(probs.values()))
            assert got[k].n == len(values) and all(np.isclose(got[k][n], w, rtol=1e-12, atol=0) for n, w in zip(probs, want)), (k, parts)
    every = spread.exact_quantiles(spark.createDataFrame(pdf, "k long, v double"), [], "v", {"m": 0.5}).first()
    assert every.m == np.median(np.concatenate(list(sets.values())))
    assert spread.exact_quantiles(spark.createDataFrame([], "k long, v double"), ["k"], "v", probs).count() == 0


def test_running_totals_across_blocks(spark):
    pdf = skewed()
    got = spread.running_totals(spark.createDataFrame(pdf), ["k"], [], "i", {"n": F.lit(1)}, inclusive=False, block_rows=64).toPandas().sort_values("i")
    want = pdf.groupby("k").cumcount()
    assert (got["n"].to_numpy() == want.to_numpy()).all()


def test_previous_rows_across_blocks(spark):
    pdf = skewed()
    pdf["idx"] = pdf.groupby("k").cumcount()
    got = spread.previous_rows(spark.createDataFrame(pdf), ["k"], "idx", ["v"], depth=2, block_rows=16).toPandas().sort_values("i")
    assert len(got) == len(pdf)
    for d in (1, 2):
        want = pdf.groupby("k")["v"].shift(d)
        assert np.allclose(got[f"prev{d}_v"].to_numpy(float), want.to_numpy(float), equal_nan=True)


def test_lookup_join_with_hot_and_missing_keys(spark):
    pdf = skewed()
    sizes = pdf.groupby("k").size().rename("n").reset_index()
    sizes["label"] = "L" + sizes["k"].astype(str)
    lookup = spark.createDataFrame(sizes[sizes.k != 3])
    got = spread.lookup_join(spark.createDataFrame(pdf), lookup, ["k"], "n").toPandas()
    assert len(got) == len(pdf)
    assert got[got.k == 3]["label"].isna().all()
    assert (got[got.k != 3]["label"] == "L" + got[got.k != 3]["k"].astype(str)).all()
    inner = spread.lookup_join(spark.createDataFrame(pdf), lookup, ["k"], "n", how="inner")
    assert inner.count() == (pdf.k != 3).sum()
