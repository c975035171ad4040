"""Small cases with known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import special, text
from ledgerloom.operators import allocation, anomaly, audit, credit, forecast, ledger, scenarios


def test_rmse_and_mape(spark):
    df = spark.createDataFrame([(100.0, 110.0), (200.0, 180.0), (300.0, 330.0)], "a double, p double")
    r = df.agg(forecast.rmse("a", "p").alias("r"), forecast.mape("a", "p").alias("m")).first()
    assert r.r == pytest.approx(math.sqrt(1400 / 3)) and r.m == pytest.approx(10.0)


@pytest.mark.parametrize("n, rank, achieved", [(5, 6, False), (70, 68, True)])
def test_conformal_rank(spark, n, rank, achieved):
    df = spark.range(n).select(F.lit(1).alias("business_id"), F.lit("m").alias("model"), (F.col("id") + 1.0).alias("residual"), F.lit(1.0).alias("scale"))
    r = forecast.conformal_multiplier(df).first()
    assert (r["rank"], r.achieved) == (rank, achieved) and r.q_hat == (68.0 if achieved else 5.0)


def test_first_passage_is_absorbing(spark):
    path = [(1, 0, d, float(b)) for d, b in enumerate([100, 10, -5, 40, 500], 1)] + [(1, 1, d, 50.0) for d in range(1, 6)]
    out = scenarios.outcomes(spark.createDataFrame(path, "business_id long, scenario_id long, day long, balance double"))
    curve = {r.horizon_days: r.ruin_probability for r in scenarios.ruin_curve(out, 5, (1, 2, 3, 4)).collect()}
    assert curve == {1: 0.0, 2: 0.0, 3: 0.5, 4: 0.5, 5: 0.5}
    hazards = scenarios.hazard_table(out, 5, 2).toPandas()
    assert 1 - np.prod(1 - hazards["hazard"]) == pytest.approx(0.5)


def obligations(spark, rows):
    cols = "business_id long, as_of string, obligation_id string, amount double, penalty_rate double, flexibility string, days_until_due long"
    return spark.createDataFrame([(1, "d", *r, 5) for r in rows], cols)


def cash(spark, c):
    return spark.createDataFrame([(1, "d", float(c))], "business_id long, as_of string, available_cash double")


def penalty(df):
    return df.agg(F.sum("penalty")).first()[0]


def test_two_rigid_bills(spark):
    o = obligations(spark, [("A", 60.0, 1.0, "rigid"), ("B", 50.0, 0.5, "rigid")])
    assert penalty(allocation.exact_allocation(o, cash(spark, 100))) == pytest.approx(25.0)
    assert penalty(allocation.greedy_allocation(o, cash(spark, 100))) == pytest.approx(25.0)


def random_instance(seed, n):
    rng = np.random.default_rng(seed)
    rows = [(f"o{i:02d}", float(rng.integers(50, 900)), round(float(rng.uniform(0.01, 0.3)), 4), "rigid" if rng.random() < 0.4 else "flexible") for i in range(n)]
    return rows, float(round(sum(r[1] for r in rows) * rng.uniform(0.2, 0.8), 2))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_exact_methods_agree_and_bound_the_others(spark, seed, monkeypatch):
    rows, c = random_instance(seed, 9)
    o, i = obligations(spark, rows), cash(spark, c)
    enumerated = penalty(allocation.exact_allocation(o, i))
    grid = allocation.grid_dp(o, i)
    assert bool(allocation.solver_agreement(o, allocation.exact_allocation(o, i), grid).first().agree)
    assert penalty(allocation.greedy_allocation(o, i)) >= enumerated - 1e-6
    monkeypatch.setattr(allocation, "SUBSET_LIMIT", -1)
    assert penalty(allocation.exact_allocation(o, i)) == pytest.approx(enumerated, abs=1e-5)


def test_streamed_budget_equals_folded_budget(spark, monkeypatch):
    rows, c = random_instance(7, 12)
    o, i = obligations(spark, rows), cash(spark, c)
    folded = {r.obligation_id: r.allocated_amount for r in allocation.greedy_allocation(o, i).collect()}
    monkeypatch.setattr(allocation, "ARRAY_LIMIT", 0)
    assert {r.obligation_id: r.allocated_amount for r in allocation.greedy_allocation(o, i).collect()} == folded


AMOUNTS = [("12,34,567.89", 1234567.89), ("(1,234.56)", -1234.56), ("1,234.56 Dr", -1234.56), ("1,234.56 Cr", 1234.56), ("", None), ("NIL", None), ("12x", None), ("₹ 500", 500.0)]


def test_amount_cells(spark):
    got = spark.createDataFrame([(c,) for c, _ in AMOUNTS], "c string").select(text.parse_amount(F.col("c")).cast("double").alias("v")).collect()
    assert [r.v for r in got] == [v for _, v in AMOUNTS]


def test_narratives_and_noisy_values(spark):
    n = [("NEFT DR ACME SUPPLIES INV449182", "Acme Supplies"), ("UPI/P2M/ORION TEXTILES/CR/771823", "Orion Textiles"), ("GST CHALLAN 889211", "UNKNOWN")]
    got = spark.createDataFrame([(a,) for a, _ in n], "c string").select(text.counterparty_name(F.col("c")).alias("v")).collect()
    assert [r.v for r in got] == [b for _, b in n]
    t = spark.createDataFrame([("TOTAL INR 159 312 98",), ("Amt l35,Oll",)], "c string").select(text.noisy_amount(F.col("c")).cast("double").alias("v")).collect()
    assert [r.v for r in t] == [159312.98, 135011.0]


def test_name_uuid_is_version_five(spark):
    import uuid

    got = spark.range(1).select(text.name_uuid(text.URL_NAMESPACE, F.lit("some/key")).alias("u")).first().u
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, "some/key"))


def test_no_look_ahead(spark):
    cols = "business_id long, invoice_id long, counterparty_id long, issue_date date, due_date date, amount double, delay_days long, paid boolean, paid_date date"
    import datetime as dt

    d = dt.date
    base = [(1, 1, 1, d(2024, 1, 1), d(2024, 1, 31), 10.0, 5, True, d(2024, 2, 5)), (1, 2, 1, d(2024, 1, 5), d(2024, 2, 4), 20.0, 9, True, d(2024, 2, 13))]
    later = [(1, 3, 1, d(2024, 3, 1), d(2024, 3, 31), 99.0, 1, True, d(2024, 4, 1))]
    view = lambda rows: [tuple(r) for r in ledger.outstanding(spark.createDataFrame(rows, cols), "2024-02-07").collect()]
    assert view(base) == view(base + later) == [(1, 2, 1, 20.0, -3)]


def test_credit_features_split_days_and_blocks(spark, monkeypatch):
    from ledgerloom.functions import spread

    rng = np.random.default_rng(5)
    n = 300
    pdf = pd.DataFrame({
        "business_id": 1, "counterparty_id": rng.choice([1, 2], n, p=[0.9, 0.1]), "invoice_id": np.arange(n) * 50_000,
        "issue_date": pd.to_datetime("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 20, n)), unit="D"), "amount": np.round(rng.uniform(10, 99, n), 2),
        "delay_days": rng.integers(1, 60, n), "paid": rng.random(n) < 0.8,
    })
    pdf["due_date"] = (pdf["issue_date"] + pd.to_timedelta(30, unit="D")).dt.date
    pdf["issue_date"] = pdf["issue_date"].dt.date
    got = credit.credit_features(spark.createDataFrame(pdf)).toPandas().set_index("invoice_id")
    for cp, g in pdf.groupby("counterparty_id"):
        g = g.sort_values(["issue_date", "invoice_id"]).reset_index(drop=True)
        for i in range(3, len(g)):
            past = g.iloc[:i]
            d = past[past.paid]["delay_days"].to_numpy(float)
            r = got.loc[g.loc[i, "invoice_id"]]
            assert r.n_prior_invoices == i and r.prior_default_rate == pytest.approx(1 - past.paid.mean())
            if len(d) > 1:
                assert r.std_prior_delay == pytest.approx(d.std(ddof=1)) and r.delay_trend == pytest.approx(np.polyfit(np.arange(len(d)), d, 1)[0], abs=1e-8)
    assert spread.BLOCK_ROWS == 65_536


def test_density_clusters_match_brute_force(spark):
    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(0, 0.15, (60, 2)), rng.normal(2, 0.15, (40, 2)), rng.uniform(-3, 5, (25, 2)), np.repeat([[9.0, 9.0]], 30, axis=0)])
    pdf = pd.DataFrame({"id": np.arange(len(x)), "a": x[:, 0], "b": x[:, 1]})
    got = anomaly.dbscan(spark.createDataFrame(pdf), "id", ["a", "b"], eps=0.3).toPandas().set_index("id").sort_index()
    near = ((x[:, None] - x[None]) ** 2).sum(-1) <= 0.09
    core = near.sum(1) >= 3
    label = np.full(len(x), -1)
    for s in np.flatnonzero(core):
        if label[s] >= 0:
            continue
        stack = [s]
        while stack:
            p = stack.pop()
            if label[p] < 0:
                label[p] = s
                stack += [q for q in np.flatnonzero(near[p] & core) if label[q] < 0]
    assert (got["core"].to_numpy() == core).all()
    assert (got["cluster"].to_numpy()[core] == label[core]).all()
    assert ((got["cluster"].to_numpy() >= 0) == (near & core).any(1)).all()


def test_first_duplicates_never_build_pairs(spark):
    rows = [(i, 1, 500, 10) for i in range(50)] + [(100, 1, 501, 13), (101, 1, 503, 10), (102, 2, 500, 10)]
    df = spark.createDataFrame(rows, "id long, v long, c long, d long")
    got = {r.id: r.duplicate_of for r in anomaly.first_duplicates(df, "v", "c", "d", "id").collect()}
    assert got[0] is None and all(got[i] == 0 for i in range(1, 50)) and got[100] == 0 and got[101] is None and got[102] is None


def test_tampered_entry_is_found(spark):
    rows = [(1, i, f"t{i}", "a", "x", "e", str(i), '{"v":%d}' % i) for i in range(6)]
    e = spark.createDataFrame(rows, "chain_id long, sequence long, timestamp string, actor_id string, action string, entity_type string, entity_id string, payload string")
    chain = audit.append(e).cache()
    assert audit.verify(chain).first().intact
    bad = chain.withColumn("payload", F.when(F.col("sequence") == 3, '{"v":9}').otherwise(F.col("payload")))
    r = audit.verify(bad).first()
    assert (r.first_broken, r.failure) == (3, "contents")
    gap = audit.verify(chain.filter("sequence <> 2")).first()
    assert (gap.first_broken, gap.failure) == (3, "link")


@pytest.mark.parametrize("family, a, b", [("gamma", 2.5, 8.0), ("weibull", 1.7, 20.0), ("lognormal", 0.6, 12.0)])
def test_delay_families_recover_parameters(family, a, b):
    u = (np.arange(4000) + 0.5) / 4000
    x = special.ppf(family, u, a, b)
    assert np.allclose(special.cdf(family, x, a, b), u, atol=1e-9)
    fa, fb = special.fit(family, x, np.ones_like(x))
    assert fa == pytest.approx(a, rel=0.02) and fb == pytest.approx(b, rel=0.02)


def test_special_functions():
    assert special.t_two_sided_p(2.0, 10.0) == pytest.approx(0.0733880, abs=1e-6)
    assert special.digamma(1.0) == pytest.approx(-0.5772156649, abs=1e-9)
    assert special.gamma_p(1.0, np.array([2.0]))[0] == pytest.approx(1 - math.exp(-2))


def test_first_passage_closed_form_against_simulation():
    rng = np.random.default_rng(0)
    walk = 3000 + np.cumsum(rng.normal(-20, 300, (20000, 90)), axis=1)
    p = special.first_passage_probability(np.array([3000.0]), np.array([-20.0]), np.array([300.0]), 90.0)[0]
    assert p == pytest.approx((walk.min(axis=1) <= 0).mean(), abs=0.015)


def test_first_duplicates_offer_each_cell_to_few_others(spark, monkeypatch):
    import random

    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2]), rng.choice([None, *range(6)]), rng.choice([None, *range(25)]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "v long, c long, d long, id long")
    looked, join = [], anomaly.lookup_join
    monkeypatch.setattr(anomaly, "lookup_join", lambda facts, lookup, *rest: looked.append(lookup) or join(facts, lookup, *rest))
    got = {r.id: r.duplicate_of for r in anomaly.first_duplicates(df, "v", "c", "d", "id").collect()}
    near = lambda a, b: None not in (*a, *b) and a[0] == b[0] and abs(a[1] - b[1]) <= 1 and abs(a[2] - b[2]) <= 3
    assert got == {r[3]: min((o[3] for o in rows if o[3] < r[3] and near(o[:3], r[:3])), default=None) for r in rows}
    offered = looked[0]._jdf.queryExecution().optimizedPlan().toString().split("explode(")[1].split(")")[0]
    assert offered == "[-1,0,1]"
