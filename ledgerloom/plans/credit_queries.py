"""Credit features, rule score, calibration and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import credit
from ledgerloom.plans.base_sql import AS_OF, cte, twin
from ledgerloom.plans.registry import query, shown
from ledgerloom.session import cut_lineage
from ledgerloom.sources import tables

# Prior invoices are found by a self-join here, where the engine under test uses running sums.
cte(
    "prior",
    """
SELECT a.business_id, a.counterparty_id, a.invoice_id, a.amount, a.issue_date, a.due_date, a.paid,
  b.invoice_id AS p_id, b.issue_date AS p_issue, b.paid AS p_paid, b.delay_days AS p_delay, b.amount AS p_amount,
  row_number() OVER (PARTITION BY a.invoice_id, b.paid ORDER BY b.issue_date, b.invoice_id) - 1 AS p_seq
FROM payments a JOIN payments b ON a.business_id = b.business_id AND a.counterparty_id = b.counterparty_id
  AND (b.issue_date < a.issue_date OR (b.issue_date = a.issue_date AND b.invoice_id < a.invoice_id))
""",
    "payments",
)
cte(
    "features",
    """
SELECT business_id, counterparty_id, invoice_id, CAST(count(*) AS DOUBLE) AS n_prior_invoices,
  avg(CASE WHEN p_paid THEN 0.0::DOUBLE ELSE 1.0 END) AS prior_default_rate,
  coalesce(avg(p_delay) FILTER (WHERE p_paid), 0.0) AS mean_prior_delay,
  coalesce(stddev_samp(p_delay) FILTER (WHERE p_paid), 0.0) AS std_prior_delay,
  coalesce(CAST(max(p_delay) FILTER (WHERE p_paid) AS DOUBLE), 0.0) AS max_prior_delay,
  coalesce(CASE WHEN count(*) FILTER (WHERE p_paid) > 1 THEN
    covar_pop(p_delay, p_seq) FILTER (WHERE p_paid) / var_pop(p_seq) FILTER (WHERE p_paid) END, 0.0) AS delay_trend,
  CAST(date_diff('day', max(p_issue), any_value(issue_date)) AS DOUBLE) AS days_since_last_invoice,
  ln(1 + any_value(amount)) AS log_amount, any_value(amount) / avg(p_amount) AS amount_vs_counterparty_mean,
  CAST(date_diff('day', any_value(issue_date), any_value(due_date)) AS DOUBLE) AS payment_terms_days,
  CASE WHEN any_value(paid) THEN 0::BIGINT ELSE 1 END AS label
FROM prior GROUP BY 1, 2, 3 HAVING count(*) >= 3
""",
    "prior",
)
cte(
    "scored",
    """
SELECT f.*, CASE WHEN hi > lo THEN (mean_prior_delay * log_amount - lo) / (hi - lo) ELSE 0.0 END AS score
FROM features f CROSS JOIN (SELECT min(mean_prior_delay * log_amount) AS lo, max(mean_prior_delay * log_amount) AS hi FROM features)
""",
    "features",
)


def features(spark, sf):
    return credit.credit_features(tables.invoices(spark, sf))


def scored(spark, sf):
    """Scores rounded to nine places, so that ties are ties in every engine."""
    s = credit.rule_score(cut_lineage(features(spark, sf)))
    return s.withColumn("score", F.round("score", 9))


cte("scored9", "SELECT * REPLACE (round(score, 9) AS score) FROM scored", "scored")


@query(
    "credit_features",
    twin(
        "SELECT business_id, counterparty_id, invoice_id, "
        + ", ".join(f"round({f}, 6) + 0.0 AS {f}" for f in credit.FEATURES)
        + ", label FROM features",
        "features",
    ),
)
def credit_features(spark, sf):
    return shown(features(spark, sf))


cte("settle_order", "SELECT *, row_number() OVER (PARTITION BY business_id, counterparty_id ORDER BY paid_date, invoice_id) - 1 AS seq FROM payments WHERE paid", "payments")
cte(
    "strict_known",
    """
SELECT a.invoice_id, count(*) AS k, avg(b.delay_days) AS mean_d, stddev_samp(b.delay_days) AS std_d, max(b.delay_days) AS max_d,
  CASE WHEN count(*) > 1 THEN covar_pop(b.delay_days, b.seq) / var_pop(b.seq) END AS trend
FROM payments a JOIN settle_order b ON a.business_id = b.business_id AND a.counterparty_id = b.counterparty_id AND b.paid_date < a.issue_date GROUP BY 1
""",
    "payments",
    "settle_order",
)
cte(
    "strict_due",
    """
SELECT a.invoice_id, avg(CASE WHEN b.paid AND b.paid_date < a.issue_date THEN 0.0::DOUBLE ELSE 1.0 END) AS rate
FROM payments a JOIN payments b ON a.business_id = b.business_id AND a.counterparty_id = b.counterparty_id AND b.due_date < a.issue_date GROUP BY 1
""",
    "payments",
)


@query(
    "credit_features_strict",
    twin(
        """SELECT f.business_id, f.counterparty_id, f.invoice_id, f.n_prior_invoices, round(coalesce(d.rate, 0.0), 6) AS prior_default_rate, round(coalesce(k.mean_d, 0.0), 6) AS mean_prior_delay,
  round(coalesce(k.std_d, 0.0), 6) AS std_prior_delay, coalesce(CAST(k.max_d AS DOUBLE), 0.0) AS max_prior_delay, round(coalesce(k.trend, 0.0), 6) + 0.0 AS delay_trend,
  f.days_since_last_invoice, round(f.log_amount, 6) AS log_amount, round(f.amount_vs_counterparty_mean, 6) AS amount_vs_counterparty_mean, f.payment_terms_days, f.label
FROM features f LEFT JOIN strict_known k ON k.invoice_id = f.invoice_id LEFT JOIN strict_due d ON d.invoice_id = f.invoice_id""",
        "features",
        "strict_known",
        "strict_due",
    ),
)
def credit_features_strict(spark, sf):
    """Features from outcomes that were known when the invoice was issued."""
    return shown(credit.strict_features(tables.invoices(spark, sf)))


@query("rule_score", twin("SELECT business_id, counterparty_id, invoice_id, round(score, 6) AS score FROM scored", "scored"))
def rule_score(spark, sf):
    return shown(credit.rule_score(features(spark, sf)).select("business_id", "counterparty_id", "invoice_id", "score"))


AUC = """SELECT {keys} CAST(p AS BIGINT) AS n_pos, CAST(q AS BIGINT) AS n_neg,
  round(CASE WHEN p = 0 OR q = 0 THEN 0.5 ELSE (rs - p * (p + 1) / 2.0) / (p::DOUBLE * q) END, 6) AS auc FROM (
  SELECT {keys} sum(label) AS p, sum(1 - label) AS q, sum(CASE WHEN label = 1 THEN rk END) AS rs FROM (
    SELECT {keys} label, rank() OVER ({part} ORDER BY score) + (count(*) OVER (PARTITION BY {keys} score) - 1) / 2.0::DOUBLE AS rk FROM scored9) {group})"""


@query("auc_rule_score", twin(AUC.format(keys="", part="", group=""), "scored9"))
def auc_rule_score(spark, sf):
    return shown(credit.roc_auc(scored(spark, sf)))


@query(
    "auc_by_business",
    twin(AUC.format(keys="business_id,", part="PARTITION BY business_id", group="GROUP BY business_id"), "scored9"),
)
def auc_by_business(spark, sf):
    return shown(credit.roc_auc(scored(spark, sf), ["business_id"], buckets=64))


EQUAL = """SELECT bin, bin / 10.0::DOUBLE AS lower, (bin + 1) / 10.0::DOUBLE AS upper, n, round(mp, 6) AS mean_predicted, round(ob, 6) AS observed FROM (
  SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bin, count(*) AS n, avg(score) AS mp, avg(label) AS ob FROM scored9 GROUP BY 1)"""


@query("calibration_equal_width", twin(EQUAL, "scored9"))
def calibration_equal_width(spark, sf):
    return shown(credit.calibration_equal_width(scored(spark, sf)))


@query(
    "calibration_error",
    twin(
        """SELECT round(sum(n * abs(ob - mp)) / sum(n), 6) AS ece, CAST(sum(n) AS BIGINT) AS n FROM (
  SELECT least(floor(score * 10), 9) AS bin, count(*) AS n, avg(score) AS mp, avg(label) AS ob FROM scored9 GROUP BY 1)""",
        "scored9",
    ),
)
def calibration_error(spark, sf):
    return shown(credit.expected_calibration_error(credit.calibration_equal_width(scored(spark, sf))))


@query(
    "calibration_quantile",
    twin(
        """SELECT i - 1 AS bucket, round(lo, 6) AS bucket_lower, round(hi, 6) AS bucket_upper, n, round(mp, 6) AS mean_predicted, round(ob, 6) AS observed_rate
FROM (SELECT i, lo, hi, count(*) AS n, avg(score) AS mp, avg(label) AS ob FROM scored9 JOIN (
    SELECT e AS lo, lead(e) OVER (ORDER BY e) AS hi, row_number() OVER (ORDER BY e) AS i, count(*) OVER () AS ne FROM (
      SELECT DISTINCT unnest(quantile_cont(score, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS e FROM scored9))
  ON score >= lo AND (score < hi OR (i = ne - 1 AND score <= hi)) WHERE hi IS NOT NULL GROUP BY 1, 2, 3) WHERE n >= 2""",
        "scored9",
    ),
)
def calibration_quantile(spark, sf):
    return shown(credit.calibration_quantile(scored(spark, sf)))


BRIER = """SELECT count(*) AS n, round(avg(pow(score - label, 2)), 6) AS brier, round(avg(label), 6) AS base_rate, round(avg(score), 6) AS mean_predicted,
  round(1 - avg(pow(score - label, 2)) / (avg(label) * (1 - avg(label))), 6) AS skill FROM scored9"""


@query("brier_skill", twin(BRIER, "scored9"))
def brier_skill(spark, sf):
    return shown(credit.brier_skill(scored(spark, sf)))


# A second given-coefficient score, so that lift and verdict have two models to compare.
LINEAR = {"prior_default_rate": (1.5, 1.1, 1.9), "mean_prior_delay": (0.4, 0.1, 0.7), "std_prior_delay": (-0.2, -0.5, 0.1),
          "max_prior_delay": (0.3, 0.0, 0.6), "delay_trend": (0.25, -0.05, 0.55), "n_prior_invoices": (-0.1, -0.3, 0.1),
          "days_since_last_invoice": (0.15, -0.1, 0.4), "log_amount": (0.35, 0.05, 0.65),
          "amount_vs_counterparty_mean": (0.05, -0.2, 0.3), "payment_terms_days": (0.45, 0.2, 0.7)}
SCALES = {"prior_default_rate": (0.1313, 0.0813), "mean_prior_delay": (30.0, 6.0), "std_prior_delay": (12.0, 4.0),
          "max_prior_delay": (50.0, 9.0), "delay_trend": (0.03, 1.517), "n_prior_invoices": (26.0, 15.0),
          "days_since_last_invoice": (48.3, 51.7), "log_amount": (12.0, 0.9),
          "amount_vs_counterparty_mean": (1.0, 0.6), "payment_terms_days": (37.7, 16.77)}
INTERCEPT = -1.9


def logit_expr():
    z = F.lit(INTERCEPT)
    for f in credit.FEATURES:
        mean, sd = SCALES[f]
        z = z + (F.col(f) - mean) / sd * LINEAR[f][0]
    return 1.0 / (1.0 + F.exp(-z))


_CON = {f: f"(({f} - {SCALES[f][0]}::DOUBLE) / {SCALES[f][1]}::DOUBLE * {LINEAR[f][0]}::DOUBLE)" for f in credit.FEATURES}
cte(
    "linear",
    f"SELECT *, round(1 / (1 + exp(-({INTERCEPT}::DOUBLE + {' + '.join(_CON[f] for f in credit.FEATURES)}))), 9) AS prob FROM features",
    "features",
)


def linear_scored(spark, sf):
    return features(spark, sf).withColumn("score", F.round(logit_expr(), 9))


@query(
    "model_lift",
    twin(
        """SELECT 'linear' AS model, round(b.auc, 6) AS baseline_auc, round(m.auc, 6) AS auc, round(m.auc - b.auc, 6) AS auc_lift,
  CASE WHEN m.auc - b.auc > 0.05 THEN 'complexity earned' WHEN m.auc - b.auc > 0 THEN 'marginal' ELSE 'not justified' END AS verdict
FROM (SELECT (sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label)::DOUBLE * sum(1 - label)) AS auc FROM (
   SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM scored9)) b,
 (SELECT (sum(CASE WHEN label = 1 THEN rk END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label)::DOUBLE * sum(1 - label)) AS auc FROM (
   SELECT label, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0::DOUBLE AS rk FROM linear)) m""",
        "scored9",
        "linear",
    ),
)
def model_lift(spark, sf):
    both = (
        scored(spark, sf).select(F.lit("rules").alias("model"), "score", "label")
        .unionByName(linear_scored(spark, sf).select(F.lit("linear").alias("model"), "score", "label"))
    )
    return shown(credit.lift_over_baseline(credit.roc_auc(both, ["model"]), "rules"))


@query(
    "model_scorecard",
    twin(
        """SELECT model, count(*) AS n, round(avg(pow(s - label, 2)), 6) AS brier,
  round(avg(-CASE WHEN label = 1 THEN ln(greatest(1e-9, least(1 - 1e-9, s))) ELSE ln(1 - greatest(1e-9, least(1 - 1e-9, s))) END), 6) AS log_loss
FROM (SELECT 'rules' AS model, score AS s, label FROM scored9 UNION ALL SELECT 'linear', prob, label FROM linear) GROUP BY 1""",
        "scored9",
        "linear",
    ),
)
def model_scorecard(spark, sf):
    both = (
        scored(spark, sf).select(F.lit("rules").alias("model"), "score", "label")
        .unionByName(linear_scored(spark, sf).select(F.lit("linear").alias("model"), "score", "label"))
    )
    y = F.col("label").cast("double")
    return shown(
        both.groupBy("model").agg(
            F.count(F.lit(1)).alias("n"),
            F.avg((F.col("score") - y) * (F.col("score") - y)).alias("brier"),
            credit.log_loss(F.col("score"), F.col("label")).alias("log_loss"),
        )
    )


@query(
    "linear_attribution",
    twin(
        f"""SELECT invoice_id, string_agg(feature || '=' || CAST(CAST(round(con * 1000) AS BIGINT) AS VARCHAR) || '/' || CAST(CAST(round(lo * 1000) AS BIGINT) AS VARCHAR)
    || '/' || CAST(CAST(round(hi * 1000) AS BIGINT) AS VARCHAR), ';' ORDER BY ab DESC, no) AS drivers
FROM (SELECT *, round(abs(con), 9) AS ab FROM (
  {' UNION ALL '.join(f"SELECT invoice_id, {i} AS no, '{f}' AS feature, {_CON[f]} AS con, ({f} - {SCALES[f][0]}::DOUBLE) / {SCALES[f][1]}::DOUBLE * {LINEAR[f][1]}::DOUBLE AS lo, ({f} - {SCALES[f][0]}::DOUBLE) / {SCALES[f][1]}::DOUBLE * {LINEAR[f][2]}::DOUBLE AS hi FROM features" for i, f in enumerate(credit.FEATURES))}))
GROUP BY 1""",
        "features",
    ),
)
def linear_attribution(spark, sf):
    rows = credit.linear_attribution(features(spark, sf), SCALES, LINEAR)
    milli = lambda c: F.round(c * 1000).cast("long").cast("string")
    text = F.transform("contributions", lambda c: F.concat_ws("/", F.concat(c["feature"], F.lit("="), milli(c["contribution"])), milli(c["ci_lower"]), milli(c["ci_upper"])))
    return rows.select("invoice_id", F.array_join(text, ";").alias("drivers"))


@query("score_rationale")
def score_rationale(spark, sf):
    rows = credit.linear_attribution(linear_scored(spark, sf), SCALES, LINEAR)
    return rows.select("invoice_id", credit.rationale(F.col("score"), "contributions").alias("rationale"))


@query(
    "rule_rationale",
    twin(
        """SELECT invoice_id, 'default chance ' || printf('%.1f', score * 100) || ' % from ' ||
  CASE WHEN abs(mean_prior_delay) >= abs(log_amount) THEN
   '+mean_prior_delay=' || printf('%.2f', mean_prior_delay) || ', +log_amount=' || printf('%.2f', log_amount)
  ELSE '+log_amount=' || printf('%.2f', log_amount) || ', +mean_prior_delay=' || printf('%.2f', mean_prior_delay) END AS rationale
FROM (SELECT invoice_id, round(score, 4) + 0.00001 AS score, round(mean_prior_delay, 4) + 0.00001 AS mean_prior_delay, round(log_amount, 4) + 0.00001 AS log_amount FROM scored)""",
        "scored",
    ),
)
def rule_rationale(spark, sf):
    s = credit.rule_score(features(spark, sf))
    for c in ("score", "mean_prior_delay", "log_amount"):
        s = s.withColumn(c, F.round(c, 4) + 0.00001)
    return credit.rule_attribution(s).select("invoice_id", credit.rationale(F.col("score"), "contributions").alias("rationale"))


@query(
    "obligation_scores",
    twin(
        f"""SELECT s.invoice_id, round(score, 6) AS score, round(greatest(0.0, least(1.0, 1 - date_diff('day', DATE '{AS_OF}', p.due_date) / 90.0::DOUBLE)), 6) AS urgency,
  round(least(1.0, p.amount / mx), 6) AS impact, round(least(1.0, score * (0.5 + 0.5 * least(1.0, p.amount / mx))), 6) AS composite
FROM scored s JOIN payments p ON p.invoice_id = s.invoice_id
JOIN (SELECT p.business_id, max(p.amount) AS mx FROM scored s JOIN payments p ON p.invoice_id = s.invoice_id GROUP BY 1) m ON m.business_id = s.business_id""",
        "scored",
    ),
)
def obligation_scores(spark, sf):
    inv = tables.invoices(spark, sf).select(
        "invoice_id", "amount", F.datediff("due_date", F.lit(AS_OF).cast("date")).alias("days_until_due")
    )
    s = credit.rule_score(features(spark, sf)).select("business_id", "invoice_id", "score").join(inv, "invoice_id")
    return shown(credit.obligation_scores(s).select("invoice_id", "score", "urgency", "impact", "composite"))


@query("training_fingerprint")
def training_fingerprint(spark, sf):
    return credit.training_fingerprint(features(spark, sf), "rules")
