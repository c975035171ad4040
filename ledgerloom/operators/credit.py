"""Prior-history credit features, scores, attribution and probability metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.spread import block_of, lookup_join, running_totals
from ledgerloom.session import cut_lineage

FEATURES = [
    "n_prior_invoices", "prior_default_rate", "mean_prior_delay", "std_prior_delay", "max_prior_delay",
    "delay_trend", "days_since_last_invoice", "log_amount", "amount_vs_counterparty_mean", "payment_terms_days",
]
PAYER = ["business_id", "counterparty_id"]
MIN_PRIOR = 3


def credit_features(payments: DataFrame, min_history: int = MIN_PRIOR) -> DataFrame:
    """Ten features per invoice from strictly earlier invoices of the same payer.

    Order is (issue_date, invoice_id).  A payer is cut into (issue_date, id block)
    pieces: every piece is windowed on its own, and the totals of the pieces before
    it come from a small aggregate.  All pieces carry mergeable sums (count, sum,
    sum of squares, maximum, sum of sequence number times delay), so one payer with a
    third of all invoices is spread over many tasks.
    """
    piece = [*PAYER, "issue_date", "_blk"]
    paid = F.col("paid")
    delay = F.when(paid, F.col("delay_days").cast("double"))
    rows = payments.select(
        *PAYER, "invoice_id", "issue_date", "due_date", "amount", "paid", delay.alias("_d"),
        block_of("invoice_id").alias("_blk"),
    )
    inside = Window.partitionBy(*piece).orderBy("invoice_id").rowsBetween(Window.unboundedPreceding, -1)
    cents = F.round(F.col("amount") * 100).cast("long")
    zero = F.lit(0)

    def run(expr: Column, name: str) -> Column:
        return F.coalesce(F.sum(expr).over(inside), zero).alias(name)

    is_paid = paid.cast("long")
    local = rows.withColumn("_seq", F.coalesce(F.sum(is_paid).over(inside), zero)).select(
        "*",
        run(F.lit(1), "l_n"), run(is_paid, "l_k"), run(cents, "l_amt"),
        run(F.col("_d"), "l_d"), run(F.col("_d") * F.col("_d"), "l_dd"), run(F.col("_seq") * F.col("_d"), "l_sd"),
        F.max("_d").over(inside).alias("l_max"),
        F.lag("issue_date").over(Window.partitionBy(*piece).orderBy("invoice_id")).alias("l_last"),
    )
    totals = local.groupBy(*piece).agg(
        F.count(F.lit(1)).alias("n"), F.sum(is_paid).alias("k"), F.sum(cents).alias("amt"),
        F.coalesce(F.sum("_d"), F.lit(0.0)).alias("d"),
        F.coalesce(F.sum(F.col("_d") * F.col("_d")), F.lit(0.0)).alias("dd"),
        F.coalesce(F.sum(F.col("_seq") * F.col("_d")), F.lit(0.0)).alias("sd"),
        F.max("_d").alias("mx"),
    )
    before = Window.partitionBy(*PAYER).orderBy("issue_date", "_blk").rowsBetween(Window.unboundedPreceding, -1)

    def prefix(expr: Column | str, name: str) -> Column:
        return F.coalesce(F.sum(expr).over(before), zero).alias(name)

    first = totals.select(
        "*", prefix("n", "o_n"), prefix("k", "o_k"), prefix("amt", "o_amt"), prefix("d", "o_d"), prefix("dd", "o_dd"),
        F.max("mx").over(before).alias("o_max"),
        F.lag("issue_date").over(Window.partitionBy(*PAYER).orderBy("issue_date", "_blk")).alias("o_last"),
    )
    offsets = first.select(
        *piece, "o_n", "o_k", "o_amt", "o_d", "o_dd", "o_max", "o_last",
        prefix(F.col("sd") + F.col("o_k") * F.col("d"), "o_sd"),
    )
    j = local.join(offsets, piece)
    n = F.col("o_n") + F.col("l_n")
    k = (F.col("o_k") + F.col("l_k")).cast("double")
    d = F.col("o_d") + F.col("l_d")
    dd = F.col("o_dd") + F.col("l_dd")
    sd = F.col("o_sd") + F.col("l_sd") + F.col("o_k") * F.col("l_d")
    s1 = k * (k - 1) / 2
    s2 = (k - 1) * k * (2 * k - 1) / 6
    mean_amount = (F.col("o_amt") + F.col("l_amt")) / 100.0 / n
    return (
        j.filter(n >= min_history)
        .select(
            *PAYER,
            "invoice_id",
            n.cast("double").alias("n_prior_invoices"),
            ((n - k) / n).alias("prior_default_rate"),
            F.when(k > 0, d / k).otherwise(0.0).alias("mean_prior_delay"),
            F.when(k > 1, F.sqrt(F.greatest(F.lit(0.0), k * dd - d * d) / (k * (k - 1)))).otherwise(0.0).alias("std_prior_delay"),
            F.coalesce(F.greatest("o_max", "l_max"), F.lit(0.0)).alias("max_prior_delay"),
            F.when(k > 1, (k * sd - s1 * d) / (k * s2 - s1 * s1)).otherwise(0.0).alias("delay_trend"),
            F.coalesce(F.datediff("issue_date", F.coalesce("l_last", "o_last")), F.lit(0)).cast("double").alias("days_since_last_invoice"),
            F.log1p("amount").alias("log_amount"),
            F.when(mean_amount > 0, F.col("amount") / mean_amount).otherwise(1.0).alias("amount_vs_counterparty_mean"),
            F.datediff("due_date", "issue_date").cast("double").alias("payment_terms_days"),
            (1 - is_paid).alias("label"),
        )
    )


def strict_features(payments: DataFrame, min_history: int = MIN_PRIOR) -> DataFrame:
    """The ten features from what was known when the invoice was issued: an outcome counts from the day after its pay date.

    Invoices of a payer settle out of order, so issues, due dates and settlements are events of one timeline:
    running sums over a payer's days give what was known before each day, and invoices of one day
    follow each other by id.  Numbers of earlier invoices and their amounts are as in ``credit_features``.  Delays, their
    trend (in order of pay date, then id) and the largest come from settlements before the issue date.  The default
    rate is the share of invoices due by then that are not settled; 0 while none is due.
    Days are sums that combine before they are shuffled; a payer's window holds one row per day.
    """
    day = [*PAYER, "day"]
    cents = F.round(F.col("amount") * 100).cast("long")
    paid = payments.filter(F.col("paid") & F.col("paid_date").isNotNull())
    settled = running_totals(paid.select(*PAYER, F.col("paid_date").alias("day"), "invoice_id", F.col("delay_days").cast("double").alias("d")), day, [], "invoice_id", {"seq": F.lit(1)}, inclusive=False)
    d = F.col("d")
    parts = [
        settled.groupBy(*day).agg(F.count(F.lit(1)).alias("k"), F.sum(d).alias("d"), F.sum(d * d).alias("dd"), F.sum(F.col("seq") * d).alias("sd"), F.max(d).alias("mx")),
        payments.groupBy(*PAYER, F.col("due_date").alias("day")).agg(F.count(F.lit(1)).alias("due")),
        paid.groupBy(*PAYER, F.greatest("due_date", "paid_date").alias("day")).agg(F.count(F.lit(1)).alias("met")),
        payments.groupBy(*PAYER, F.col("issue_date").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(cents).alias("amt")),
    ]
    events = parts[0]
    for more in parts[1:]:
        events = events.unionByName(more, allowMissingColumns=True)
    sums = ["k", "d", "dd", "sd", "due", "met", "n", "amt"]
    days = events.groupBy(*day).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], F.max("mx").alias("mx"))
    before = Window.partitionBy(*PAYER).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    known = days.withColumns({f"o_{c}": total(c) for c in sums if c != "sd"} | {"o_mx": F.max("mx").over(before), "o_last": F.max(F.when(F.col("n") > 0, F.col("day"))).over(before)})
    known = known.withColumn("o_sd", total(F.col("sd") + F.col("o_k") * F.col("d"))).filter("n > 0")
    known = known.select(*PAYER, F.col("day").alias("issue_date"), F.col("n").alias("_n"), *[f"o_{c}" for c in (*sums, "mx", "last")])
    rows = running_totals(payments.select(*PAYER, "invoice_id", "issue_date", "due_date", "amount", "paid"), [*PAYER, "issue_date"], [], "invoice_id", {"l_n": F.lit(1), "l_amt": cents}, inclusive=False)
    j = lookup_join(rows, known, [*PAYER, "issue_date"], "_n")
    n, k = F.col("o_n") + F.col("l_n"), F.col("o_k").cast("double")
    s1, s2 = k * (k - 1) / 2, (k - 1) * k * (2 * k - 1) / 6
    mean_amount = (F.col("o_amt") + F.col("l_amt")) / 100.0 / n
    last = F.when(F.col("l_n") > 0, F.col("issue_date")).otherwise(F.col("o_last"))
    return j.filter(n >= min_history).select(
        *PAYER, "invoice_id", n.cast("double").alias("n_prior_invoices"),
        F.when(F.col("o_due") > 0, (F.col("o_due") - F.col("o_met")) / F.col("o_due")).otherwise(0.0).alias("prior_default_rate"),
        F.when(k > 0, F.col("o_d") / k).otherwise(0.0).alias("mean_prior_delay"),
        F.when(k > 1, F.sqrt(F.greatest(F.lit(0.0), k * F.col("o_dd") - F.col("o_d") * F.col("o_d")) / (k * (k - 1)))).otherwise(0.0).alias("std_prior_delay"),
        F.coalesce("o_mx", F.lit(0.0)).alias("max_prior_delay"),
        F.when(k > 1, (k * F.col("o_sd") - s1 * F.col("o_d")) / (k * s2 - s1 * s1)).otherwise(0.0).alias("delay_trend"),
        F.coalesce(F.datediff("issue_date", last), F.lit(0)).cast("double").alias("days_since_last_invoice"),
        F.log1p("amount").alias("log_amount"),
        F.when(mean_amount > 0, F.col("amount") / mean_amount).otherwise(1.0).alias("amount_vs_counterparty_mean"),
        F.datediff("due_date", "issue_date").cast("double").alias("payment_terms_days"),
        (1 - F.col("paid").cast("long")).alias("label"),
    )


def rule_score(features: DataFrame) -> DataFrame:
    """mean_prior_delay * log_amount, min-max scaled over the scored set; 0 if flat."""
    raw = features.withColumn("_raw", F.col("mean_prior_delay") * F.col("log_amount"))
    span = raw.agg(F.min("_raw").alias("_lo"), F.max("_raw").alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    return raw.crossJoin(F.broadcast(span)).select(
        *features.columns, F.when(hi > lo, (F.col("_raw") - lo) / (hi - lo)).otherwise(0.0).alias("score")
    )


# --- probability metrics --------------------------------------------------------------------


def roc_auc(scored: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label", buckets: int = 256) -> DataFrame:
    """AUC with tie-averaged ranks; 0.5 when a class is missing.

    Equal scores are counted together before anything is ordered.  The distinct scores
    are split at sketch quantiles, so the ordering runs per bucket and only bucket
    totals are ordered across buckets.
    """
    keys = list(keys)
    pos = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    by_score = cut_lineage(
        scored.groupBy(*keys, F.col(score).alias("_s")).agg(pos.alias("p"), (F.count(F.lit(1)) - pos).alias("q"))
    )
    grid = [i / buckets for i in range(1, buckets)]
    cuts = by_score.groupBy(*keys).agg(F.percentile_approx("_s", grid, 4 * buckets).alias("_cuts"))
    # coarse step over every 32nd cut, then inside the 32 cuts that follow it
    step = 32
    below = lambda arr: F.size(F.filter(arr, lambda c: c < F.col("_s")))
    coarse = F.transform(F.sequence(F.lit(step), F.lit(max(step, buckets - 1)), F.lit(step)), lambda i: F.get("_cuts", i.cast("int") - 1))
    cut_rows = cuts.withColumn("_coarse", F.array_compact(coarse))
    joined = by_score.join(cut_rows, keys) if keys else by_score.crossJoin(F.broadcast(cut_rows))
    near = joined.withColumn("_g", below("_coarse"))
    placed = near.withColumn("_b", F.col("_g") * step + below(F.slice("_cuts", F.col("_g") * step + 1, F.lit(step)))).drop("_cuts", "_coarse", "_g")
    per_bucket = placed.groupBy(*keys, "_b").agg(F.sum("q").alias("_bq"))
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = per_bucket.select(*keys, "_b", F.coalesce(F.sum("_bq").over(earlier), F.lit(0)).alias("_below"))
    within = Window.partitionBy(*keys, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.withColumn("_in", F.coalesce(F.sum("q").over(within), F.lit(0))).join(base, [*keys, "_b"])
    wins = F.sum((F.col("p") * (F.col("_below") + F.col("_in") + F.col("q") / 2.0)).cast("double"))
    np_, nq = F.sum("p"), F.sum("q")
    return ranked.groupBy(*keys).agg(
        np_.alias("n_pos"),
        nq.alias("n_neg"),
        F.when((np_ == 0) | (nq == 0), 0.5).otherwise(wins / (np_.cast("double") * nq.cast("double"))).alias("auc"),
    )


def brier_skill(scored: DataFrame, keys: Sequence[str] = (), score: str = "score", label: str = "label") -> DataFrame:
    """Brier score, skill against the base rate, base rate and mean prediction in one pass."""
    p, y = F.col(score), F.col(label).cast("double")
    brier, base = F.avg((p - y) * (p - y)), F.avg(y)
    ref = base * (1.0 - base)
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), brier.alias("brier"), base.alias("base_rate"), F.avg(p).alias("mean_predicted"),
        F.when(ref > 0, 1.0 - brier / ref).otherwise(0.0).alias("skill"),
    )


def log_loss(score: Column, label: Column, eps: float = 1e-9) -> Column:
    p = F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), score))
    return F.avg(-F.when(label == 1, F.log(p)).otherwise(F.log(1.0 - p)))


def calibration_equal_width(scored: DataFrame, bins: int = 10, score: str = "score", label: str = "label") -> DataFrame:
    """Equal-width bins, the last one closed on the right; empty bins do not appear."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("long")
    return scored.groupBy(b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("observed")
    ).select(
        "bin", (F.col("bin") / float(bins)).alias("lower"), ((F.col("bin") + 1) / float(bins)).alias("upper"),
        "n", "mean_predicted", "observed",
    )


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    n = F.sum("n")
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("observed") - F.col("mean_predicted"))) / n).alias("ece"), n.alias("n"))


def calibration_quantile(scored: DataFrame, buckets: int = 10, score: str = "score", label: str = "label") -> DataFrame:
    """Quantile bins on the distinct edges of the exact quantiles; bins with fewer than two rows are dropped."""
    from ledgerloom.functions.spread import exact_quantiles

    probs = {f"q{i:02d}": i / buckets for i in range(buckets + 1)}
    q = exact_quantiles(scored, [], score, probs)
    edges = q.select(F.array_distinct(F.array(*probs)).alias("_edges"))
    s = F.col(score)
    inner = F.slice("_edges", 2, F.greatest(F.lit(0), F.size("_edges") - 2))
    idx = F.size(F.filter(inner, lambda e: e <= s))
    return (
        scored.crossJoin(F.broadcast(edges))
        .withColumn("_i", idx)
        .groupBy("_i", "_edges")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean_predicted"), F.avg(F.col(label).cast("double")).alias("observed_rate"))
        .filter((F.col("n") >= 2) & (F.size("_edges") > 1))
        .select(
            F.col("_i").cast("long").alias("bucket"), F.col("_edges")[F.col("_i")].alias("bucket_lower"),
            F.col("_edges")[F.col("_i") + 1].alias("bucket_upper"), "n", "mean_predicted", "observed_rate",
        )
    )


def lift_over_baseline(metrics: DataFrame, baseline: str) -> DataFrame:
    """AUC lift of every model over the named baseline, with the verdict."""
    base = metrics.filter(F.col("model") == baseline).select(F.col("auc").alias("baseline_auc"))
    lift = F.col("auc") - F.col("baseline_auc")
    verdict = F.when(lift > 0.05, "complexity earned").when(lift > 0.0, "marginal").otherwise("not justified")
    return metrics.filter(F.col("model") != baseline).crossJoin(F.broadcast(base)).select(
        "model", "baseline_auc", "auc", lift.alias("auc_lift"), verdict.alias("verdict")
    )


# --- scores and attribution -----------------------------------------------------------------


def obligation_scores(rows: DataFrame, probability: str = "score") -> DataFrame:
    """Urgency, impact and composite score; the largest amount per business is a small aggregate."""
    top = rows.groupBy("business_id").agg(F.max("amount").alias("max_amount"))
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    impact = F.when(F.col("max_amount") > 0, clamp(F.col("amount") / F.col("max_amount"))).otherwise(0.0)
    return rows.join(top, "business_id").select(
        *rows.columns,
        clamp(1.0 - F.col("days_until_due") / 90.0).alias("urgency"),
        impact.alias("impact"),
        F.least(F.lit(1.0), F.col(probability) * (0.5 + 0.5 * impact)).alias("composite"),
    )


def linear_attribution(features: DataFrame, scaler: Mapping[str, tuple[float, float]], coefs: Mapping[str, tuple[float, float, float]]) -> DataFrame:
    """coef * standardized value with its interval, sorted by absolute contribution.

    ``scaler`` holds (mean, population sd) and ``coefs`` (coef, lower, upper) per feature:
    ten entries, carried as literals.
    """
    parts = []
    for i, f in enumerate(FEATURES):
        mean, sd = scaler[f]
        z = (F.col(f) - mean) / (sd if sd > 0 else 1.0)
        c, lo, hi = coefs[f]
        con = z * c
        parts.append(
            F.struct(
                (-F.round(F.abs(con), 9)).alias("sort"), F.lit(i).alias("no"), F.lit(f).alias("feature"), F.col(f).alias("value"),
                con.alias("contribution"), (z * lo).alias("ci_lower"), (z * hi).alias("ci_upper"),
                F.when(con > 0, "increases_risk").otherwise("decreases_risk").alias("direction"),
            )
        )
    return features.withColumn("contributions", F.array_sort(F.array(*parts)))


def rule_attribution(features: DataFrame) -> DataFrame:
    """The rules baseline is explained by its own two inputs."""
    parts = [
        F.struct(
            (-F.abs(F.col(f))).alias("sort"), F.lit(i).alias("no"), F.lit(f).alias("feature"), F.col(f).alias("value"),
            F.col(f).alias("contribution"), F.lit(None).cast("double").alias("ci_lower"),
            F.lit(None).cast("double").alias("ci_upper"), F.lit("increases_risk").alias("direction"),
        )
        for i, f in enumerate(("mean_prior_delay", "log_amount"))
    ]
    return features.withColumn("contributions", F.array_sort(F.array(*parts)))


def rationale(probability: Column, contributions: str, top_k: int = 3) -> Column:
    """The strongest contributions by name and value; a sign tells which way each moves the chance of default."""
    named = F.transform(
        F.slice(contributions, 1, top_k),
        lambda c: F.concat(F.when(c["direction"] == "increases_risk", "+").otherwise("-"), c["feature"], F.lit("="), F.format_number(c["value"], 2)),
    )
    chance = F.format_string("default chance %.1f %%", probability * 100.0)
    return F.when(F.size(contributions) > 0, F.concat(chance, F.lit(" from "), F.array_join(named, ", "))).otherwise(F.concat(chance, F.lit(", no inputs")))


def training_fingerprint(features: DataFrame, model: str) -> DataFrame:
    """Order-independent fingerprint of the training table: model, hash, row count."""
    h = F.xxhash64(*[F.col(c) for c in FEATURES], "label")
    return features.agg(F.bit_xor(h).alias("_h"), F.sum(h.cast("decimal(38,0)")).alias("_s"), F.count(F.lit(1)).alias("n")).select(
        F.concat_ws(
            ":", F.lit(model),
            F.concat(F.lit("train-"), F.substring(F.sha2(F.concat_ws("|", F.col("_h").cast("string"), F.col("_s").cast("string")), 256), 1, 12)),
            F.concat(F.lit("n"), F.col("n").cast("string")),
        ).alias("version"),
        "n",
    )
