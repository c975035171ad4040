"""Delay panel, dependence, summaries and fits."""

from __future__ import annotations

from ledgerloom.operators import delays
from ledgerloom.operators.ledger import settled
from ledgerloom.plans.base_sql import AS_OF, CTES, GRAIN, cte, twin
from ledgerloom.plans.registry import query, shown
from ledgerloom.sources import tables

cte(
    "panel",
    """SELECT business_id, CAST(date_trunc('month', issue_date) AS DATE) AS issue_month, counterparty_id, avg(delay_days) AS delay_days
FROM payments WHERE paid GROUP BY 1, 2, 3""",
    "payments",
)
cte(
    "pairs",
    """
SELECT business_id, cp_i, cp_j, count(*) AS n_shared,
  CASE WHEN count(*) >= 5 AND var_pop(rx) > 0 AND var_pop(ry) > 0 THEN 2 * sin(pi() * corr(rx, ry) / 6) ELSE 0.0 END AS rho
FROM (SELECT business_id, cp_i, cp_j,
        rank() OVER (PARTITION BY business_id, cp_i, cp_j ORDER BY x) + (count(*) OVER (PARTITION BY business_id, cp_i, cp_j, x) - 1) / 2.0::DOUBLE AS rx,
        rank() OVER (PARTITION BY business_id, cp_i, cp_j ORDER BY y) + (count(*) OVER (PARTITION BY business_id, cp_i, cp_j, y) - 1) / 2.0::DOUBLE AS ry
      FROM (SELECT a.business_id, a.counterparty_id AS cp_i, b.counterparty_id AS cp_j, a.delay_days AS x, b.delay_days AS y
            FROM panel a JOIN panel b ON a.business_id = b.business_id AND a.issue_month = b.issue_month AND a.counterparty_id < b.counterparty_id))
GROUP BY 1, 2, 3
""",
    "panel",
)


cte("panel_days", "SELECT business_id, issue_date AS issue_period, counterparty_id, avg(delay_days) AS delay_days FROM payments WHERE paid GROUP BY 1, 2, 3", "payments")
cte(
    "panel_weeks",
    "SELECT business_id, CAST(date_trunc('week', issue_date) AS DATE) AS issue_month, counterparty_id, avg(delay_days) AS delay_days FROM payments WHERE paid GROUP BY 1, 2, 3",
    "payments",
)
CTES["pairs_weeks"] = (("panel_weeks",), CTES["pairs"][1].replace("panel a JOIN panel b", "panel_weeks a JOIN panel_weeks b"))


@query(
    "delay_panel",
    twin(
        "SELECT business_id, CAST(issue_month AS VARCHAR) AS issue_month, counterparty_id, round(delay_days, 6) AS delay_days FROM panel",
        "panel",
    ),
)
def delay_panel(spark, sf):
    return shown(delays.delay_panel(tables.invoices(spark, sf), GRAIN).withColumnRenamed("issue_period", "issue_month"))


@query(
    "delay_panel_issue_dates",
    twin("SELECT business_id, CAST(issue_period AS VARCHAR) AS issue_period, counterparty_id, round(delay_days, 6) AS delay_days FROM panel_days", "panel_days"),
)
def delay_panel_issue_dates(spark, sf):
    return shown(delays.delay_panel(tables.invoices(spark, sf)))


@query(
    "delay_spearman_weeks",
    twin("SELECT business_id, cp_i, cp_j, n_shared, round(rho, 6) + 0.0 AS rho FROM pairs_weeks", "pairs_weeks"),
)
def delay_spearman_weeks(spark, sf):
    return shown(delays.spearman_pairs(delays.delay_panel(tables.invoices(spark, sf), "week")))


@query(
    "delay_spearman",
    twin("SELECT business_id, cp_i, cp_j, n_shared, round(rho, 6) + 0.0 AS rho FROM pairs", "pairs"),
)
def delay_spearman(spark, sf):
    return shown(delays.spearman_pairs(delays.delay_panel(tables.invoices(spark, sf), GRAIN)))


@query("delay_correlation_matrix")
def delay_correlation_matrix(spark, sf):
    pairs = delays.spearman_pairs(delays.delay_panel(tables.invoices(spark, sf), GRAIN))
    return shown(delays.nearest_positive_definite(pairs))


SUMMARY = """SELECT business_id, counterparty_id, count(*) AS n_delays, round(avg(delay_days), 6) AS mean_delay,
  CAST(quantile_cont(delay_days, 0.5) AS DOUBLE) AS median_delay, round(quantile_cont(delay_days, 0.9), 6) AS p90_delay,
  round(avg(CASE WHEN delay_days <= 7 THEN 1.0::DOUBLE ELSE 0 END), 6) AS p_within_7,
  round(avg(CASE WHEN delay_days <= 30 THEN 1.0::DOUBLE ELSE 0 END), 6) AS p_within_30
FROM payments WHERE paid GROUP BY 1, 2"""


@query("delay_empirical_summary", twin(SUMMARY, "payments"))
def delay_empirical_summary(spark, sf):
    return shown(delays.empirical_summary(delays.delay_counts(tables.invoices(spark, sf))))


@query(
    "trust_tiers",
    twin(
        f"""SELECT business_id, counterparty_id, median_delay,
  CASE WHEN median_delay <= 5 THEN 'Pays quickly' WHEN median_delay <= 10 THEN 'Usually within two weeks'
       WHEN median_delay <= 16 THEN 'Often runs late' ELSE 'Consistently late' END AS trust,
  row_number() OVER (PARTITION BY business_id ORDER BY median_delay, counterparty_id) AS place FROM ({SUMMARY})""",
        "payments",
    ),
)
def trust_tiers(spark, sf):
    return shown(delays.trust_tiers(delays.empirical_summary(delays.delay_counts(tables.invoices(spark, sf)))))


@query(
    "delay_profile",
    twin(
        """SELECT s.business_id, n_delays, round(g, 6) AS skewness, round(r, 6) AS lag1_autocorrelation FROM
(SELECT business_id, count(*) AS n_delays, (avg(pow(d - m, 3))) / pow(avg(pow(d - m, 2)), 1.5) AS g
 FROM (SELECT business_id, delay_days::DOUBLE AS d, avg(delay_days) OVER (PARTITION BY business_id) AS m FROM payments WHERE paid) GROUP BY 1) s
JOIN (SELECT business_id, corr(d, p) AS r FROM (SELECT business_id, d, lag(d) OVER (PARTITION BY business_id ORDER BY m) AS p FROM (
  SELECT business_id, date_trunc('month', issue_date) AS m, avg(delay_days) AS d FROM payments WHERE paid GROUP BY 1, 2)) GROUP BY 1) a
ON a.business_id = s.business_id""",
        "payments",
    ),
)
def delay_profile(spark, sf):
    return shown(delays.delay_profile(tables.invoices(spark, sf)))


@query(
    "delay_fit_lognormal",
    twin(
        """SELECT business_id, counterparty_id, n, round(sqrt(v), 6) AS s, round(exp(m), 6) AS scale,
  round(-n * (m + 0.5 * ln(2 * pi() * v) + 0.5), 4) AS log_likelihood, round(4 + 2 * n * (m + 0.5 * ln(2 * pi() * v) + 0.5), 4) AS aic
FROM (SELECT business_id, counterparty_id, count(*) AS n, avg(ln(delay_days)) AS m, var_pop(ln(delay_days)) AS v
      FROM payments WHERE paid AND delay_days > 0 GROUP BY 1, 2) WHERE n >= 10""",
        "payments",
    ),
)
def delay_fit_lognormal(spark, sf):
    return shown(delays.fit_lognormal(delays.delay_counts(tables.invoices(spark, sf))), log_likelihood=4, aic=4)


@query("delay_fit_families")
def delay_fit_families(spark, sf):
    return shown(delays.fit_delays(delays.delay_counts(settled(tables.invoices(spark, sf), AS_OF))))
