"""Payment-delay panel, rank correlation, summaries and distribution fits."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import special

MIN_DELAYS = 10
MIN_SHARED = 5
KEYS = ["business_id", "counterparty_id"]


def usable_delays(settled: DataFrame) -> DataFrame:
    """Count of finite, non-negative delays per payer and the refusal below ten."""
    ok = F.col("delay_days").isNotNull() & (F.col("delay_days") >= 0) & (F.col("delay_days") < float("inf"))
    n = F.col("n_delays")
    return (
        settled.filter(ok)
        .groupBy(*KEYS)
        .agg(F.count(F.lit(1)).alias("n_delays"))
        .withColumn("usable", n >= MIN_DELAYS)
        .withColumn(
            "reject_reason",
            F.when(n < MIN_DELAYS, F.concat(n.cast("string"), F.lit(" usable delays; need >= 10"))),
        )
    )


def period_of(grain: str = "day") -> Column:
    """Period of an invoice: its issue date, or the week, month, quarter or year that holds it."""
    return F.col("issue_date") if grain == "day" else F.trunc("issue_date", grain)


def delay_panel(payments: DataFrame, grain: str = "day") -> DataFrame:
    """Mean paid delay by issue period and payer, in long form; a default is a missing cell, not a delay."""
    return (
        payments.filter("paid")
        .groupBy("business_id", period_of(grain).alias("issue_period"), "counterparty_id")
        .agg(F.avg("delay_days").alias("delay_days"))
    )


def asof_panel(payments: DataFrame, decisions: DataFrame, grain: str = "day") -> DataFrame:
    """The panel as it was known at every decision date: business_id, as_of, issue_period, counterparty_id, delay_days.

    Settlements, summed by day, and decision dates are one timeline for each (payer, period); running sums
    along it are read off at the decisions.  So history rows are shuffled once, and nothing but the
    cells of the answer is made for a decision date.  A payment counts from its pay date on.
    """
    cell = ["business_id", "counterparty_id", "issue_period"]
    settled = payments.filter("paid").groupBy("business_id", "counterparty_id", period_of(grain).alias("issue_period"), F.col("paid_date").alias("at")).agg(
        F.sum("delay_days").alias("s"), F.count(F.lit(1)).alias("n")
    )
    known = settled.groupBy(*cell).agg(F.min("at").alias("since"))
    reads = known.join(decisions.select("business_id", F.col("as_of").alias("at")), "business_id").filter(F.col("at") >= F.col("since"))
    timeline = settled.withColumn("is_read", F.lit(0)).unionByName(reads.drop("since").withColumn("is_read", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy(*cell).orderBy("at", "is_read").rowsBetween(Window.unboundedPreceding, 0)
    mean = F.sum("s").over(upto) / F.sum("n").over(upto)
    return timeline.withColumn("delay_days", mean).filter("is_read = 1").select("business_id", F.col("at").alias("as_of"), "issue_period", "counterparty_id", "delay_days")


def tie_rank(keys: list[str], value: str) -> Column:
    """Average rank over ties within small groups."""
    r = F.rank().over(Window.partitionBy(*keys).orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return r + (ties - 1) / 2.0


def spearman_pairs(panel: DataFrame) -> DataFrame:
    """Copula parameter 2 sin(pi rs / 6) for every payer pair of a business.

    The output itself is one row per pair.  The panel is already reduced to one cell
    per (period, payer), and the join key includes the period, so a business with many
    invoices costs no more than one with few.  Ranks are taken within the pair, over
    the periods both payers have.
    """
    a = panel.select("business_id", "issue_period", F.col("counterparty_id").alias("cp_i"), F.col("delay_days").alias("x"))
    b = panel.select("business_id", "issue_period", F.col("counterparty_id").alias("cp_j"), F.col("delay_days").alias("y"))
    pair = ["business_id", "cp_i", "cp_j"]
    both = a.join(b, ["business_id", "issue_period"]).filter(F.col("cp_i") < F.col("cp_j"))
    ranked = both.withColumn("rx", tie_rank(pair, "x")).withColumn("ry", tie_rank(pair, "y"))
    n, sx, sy = F.count(F.lit(1)), F.sum("rx"), F.sum("ry")
    agg = ranked.groupBy(*pair).agg(
        n.alias("n_shared"),
        (n * F.sum(F.col("rx") * F.col("ry")) - sx * sy).alias("cov"),
        (n * F.sum(F.col("rx") * F.col("rx")) - sx * sx).alias("vx"),
        (n * F.sum(F.col("ry") * F.col("ry")) - sy * sy).alias("vy"),
    )
    valid = (F.col("n_shared") >= MIN_SHARED) & (F.col("vx") > 0) & (F.col("vy") > 0)
    rs = F.col("cov") / F.sqrt(F.col("vx") * F.col("vy"))
    return agg.select(
        *pair,
        "n_shared",
        F.when(valid, 2.0 * F.sin(F.lit(math.pi) * rs / 6.0)).otherwise(0.0).alias("rho"),
    )


def _repair(pdf: pd.DataFrame) -> pd.DataFrame:
    names = sorted(set(pdf["cp_i"]) | set(pdf["cp_j"]))
    at = {c: i for i, c in enumerate(names)}
    m = np.eye(len(names))
    i = pdf["cp_i"].map(at).to_numpy()
    j = pdf["cp_j"].map(at).to_numpy()
    m[i, j] = m[j, i] = pdf["rho"].to_numpy()
    w, v = np.linalg.eigh((m + m.T) / 2.0)
    fixed = (v * np.maximum(w, 1e-8)) @ v.T
    s = np.sqrt(np.diag(fixed))
    fixed = fixed / np.outer(s, s)
    chol = np.linalg.cholesky(fixed)
    r, c = np.indices(fixed.shape)
    return pd.DataFrame(
        {
            "business_id": pdf["business_id"].iloc[0],
            "cp_i": np.array(names)[r.ravel()],
            "cp_j": np.array(names)[c.ravel()],
            "rho": fixed.ravel(),
            "chol": chol.ravel(),
        }
    )


def nearest_positive_definite(pairs: DataFrame) -> DataFrame:
    """Symmetric repair per business: eigenvalues floored at 1e-8, unit diagonal, Cholesky rows.

    A group holds one row per payer pair; that matrix is the unit of the decomposition.
    """
    return pairs.select("business_id", "cp_i", "cp_j", "rho").groupBy("business_id").applyInPandas(
        _repair, "business_id long, cp_i long, cp_j long, rho double, chol double"
    )


def delay_counts(payments: DataFrame) -> DataFrame:
    """Delay histogram per payer: integer days, so its size is bounded by the longest delay."""
    return payments.filter("paid").groupBy(*KEYS, "delay_days").agg(F.count(F.lit(1)).alias("n"))


def empirical_summary(counts: DataFrame) -> DataFrame:
    """n, mean, median, p90, P(<=7 days), P(<=30 days) from the delay histogram."""
    n = F.sum("n")
    return counts.groupBy(*KEYS).agg(
        n.alias("n_delays"),
        (F.sum(F.col("delay_days") * F.col("n")) / n).alias("mean_delay"),
        F.percentile("delay_days", F.lit(0.5), F.col("n")).alias("median_delay"),
        F.percentile("delay_days", F.lit(0.9), F.col("n")).alias("p90_delay"),
        (F.sum(F.when(F.col("delay_days") <= 7, F.col("n")).otherwise(0)) / n).alias("p_within_7"),
        (F.sum(F.when(F.col("delay_days") <= 30, F.col("n")).otherwise(0)) / n).alias("p_within_30"),
    )


def trust_tiers(summary: DataFrame) -> DataFrame:
    """Payers by median delay with the four trust labels."""
    m = F.col("median_delay")
    label = (
        F.when(m <= 5, "Pays quickly").when(m <= 10, "Usually within two weeks")
        .when(m <= 16, "Often runs late").otherwise("Consistently late")
    )
    w = Window.partitionBy("business_id").orderBy("median_delay", "counterparty_id")
    return summary.select(*KEYS, "median_delay", label.alias("trust"), F.row_number().over(w).cast("long").alias("place"))


def delay_profile(payments: DataFrame) -> DataFrame:
    """Skewness of delays and lag-1 autocorrelation of the monthly mean delay."""
    skew = payments.filter("paid").groupBy("business_id").agg(
        F.count(F.lit(1)).alias("n_delays"), F.skewness(F.col("delay_days").cast("double")).alias("skewness")
    )
    monthly = (
        payments.filter("paid")
        .groupBy("business_id", F.trunc("issue_date", "month").alias("m"))
        .agg(F.avg("delay_days").alias("d"))
    )
    w = Window.partitionBy("business_id").orderBy("m")
    lagged = monthly.withColumn("p", F.lag("d").over(w))
    auto = lagged.groupBy("business_id").agg(F.corr("d", "p").alias("lag1_autocorrelation"))
    return skew.join(auto, "business_id")


# --- distribution fits ------------------------------------------------------------------


def delay_moments(counts: DataFrame) -> DataFrame:
    """Sufficient statistics of positive delays per payer, from the histogram."""
    pos = counts.filter(F.col("delay_days") > 0)
    lx = F.log(F.col("delay_days").cast("double"))
    n = F.sum("n")
    return pos.groupBy(*KEYS).agg(
        n.alias("n"),
        (F.sum(F.col("delay_days") * F.col("n")) / n).alias("mean"),
        (F.sum(lx * F.col("n")) / n).alias("mean_log"),
        (F.sum(lx * lx * F.col("n")) / n).alias("mean_log_sq"),
    ).filter(F.col("n") >= MIN_DELAYS)


def fit_lognormal(counts: DataFrame) -> DataFrame:
    """Closed-form lognormal fit with location zero: s, scale, log-likelihood, AIC."""
    m = delay_moments(counts)
    s2 = F.col("mean_log_sq") - F.col("mean_log") * F.col("mean_log")
    loglik = -F.col("n") * (F.col("mean_log") + 0.5 * F.log(2.0 * F.lit(math.pi) * s2) + 0.5)
    return m.select(
        *KEYS, "n", F.sqrt(s2).alias("s"), F.exp("mean_log").alias("scale"),
        loglik.alias("log_likelihood"), (4.0 - 2.0 * loglik).alias("aic"),
    )


def _fit_group(pdf: pd.DataFrame) -> pd.DataFrame:
    x = pdf["delay_days"].to_numpy(float)
    k = pdf["n"].to_numpy(float)
    keep = x > 0
    x, k = x[keep], k[keep]
    order = np.argsort(x)
    x, k = x[order], k[order]
    n = k.sum()
    if n < MIN_DELAYS:
        return pd.DataFrame(columns=FIT_COLUMNS)
    rows = []
    for family in special.FAMILIES:
        a, b = special.fit(family, x, k)
        cdf = special.cdf(family, x, a, b)
        upto = np.cumsum(k)
        d = float(max(np.max(upto / n - cdf), np.max(cdf - (upto - k) / n)))
        ll = float(np.sum(k * special.logpdf(family, x, a, b)))
        rows.append((family, a, b, ll, 4.0 - 2.0 * ll, d, special.kolmogorov_p(d, n)))
    out = pd.DataFrame(rows, columns=["family", "shape", "scale", "log_likelihood", "aic", "ks_statistic", "ks_pvalue"])
    out["selected"] = out["aic"] == out["aic"].min()
    out["mean_delay"] = [special.mean(f, a, b) for f, a, b in zip(out.family, out["shape"], out["scale"])]
    q = [special.ppf(f, np.array([0.5, 0.9]), a, b) for f, a, b in zip(out.family, out["shape"], out["scale"])]
    out["median_delay"], out["p90_delay"] = [float(v[0]) for v in q], [float(v[1]) for v in q]
    for name, day in (("p_within_7", 7.0), ("p_within_30", 30.0)):
        out[name] = [float(special.cdf(f, np.array([day]), a, b)[0]) for f, a, b in zip(out.family, out["shape"], out["scale"])]
    out.insert(0, "n_observations", int(n))
    out.insert(0, "counterparty_id", pdf["counterparty_id"].iloc[0])
    out.insert(0, "business_id", pdf["business_id"].iloc[0])
    return out[FIT_COLUMNS]


FIT_SCHEMA = (
    "business_id long, counterparty_id long, n_observations long, family string, shape double, scale double, "
    "log_likelihood double, aic double, ks_statistic double, ks_pvalue double, selected boolean, mean_delay double, "
    "median_delay double, p90_delay double, p_within_7 double, p_within_30 double"
)
FIT_COLUMNS = [c.split()[0] for c in FIT_SCHEMA.split(", ")]


def fit_delays(counts: DataFrame) -> DataFrame:
    """Gamma, Weibull and lognormal by maximum likelihood; lowest AIC selected, all kept.

    The grouped function sees the payer's delay histogram (at most one row per day of
    delay), never its invoices.
    """
    return counts.select(*KEYS, "delay_days", "n").groupBy(*KEYS).applyInPandas(_fit_group, FIT_SCHEMA)


def _quantile_grid(points: int):
    def grid(batches):
        u = (np.arange(points) + 0.5) / points
        u = np.concatenate([[1e-10], u, [1 - 1e-10]])
        for pdf in batches:
            out = [special.ppf(f, u, a, b) for f, a, b in zip(pdf["family"], pdf["shape"], pdf["scale"])]
            yield pd.DataFrame(
                {"business_id": pdf["business_id"], "counterparty_id": pdf["counterparty_id"], "quantiles": out}
            )

    return grid


def quantile_grid(fits: DataFrame, points: int = 512) -> DataFrame:
    """Inverse CDF of the selected family on an even grid, for interpolation in the scenario join."""
    chosen = fits.filter("selected").select(*KEYS, "family", "shape", "scale")
    return chosen.mapInPandas(_quantile_grid(points), "business_id long, counterparty_id long, quantiles array<double>")
