"""Payment allocation for many instances at once.

An instance is one business on one decision date.  ``obligations`` has the instance
keys plus obligation_id, amount, penalty_rate, flexibility, days_until_due;
``instances`` has the keys plus available_cash.  Money is compared in whole
ten-thousandths, so a budget is met or missed exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.money import amount, units

KEYS = ("business_id", "as_of")
ARRAY_LIMIT = 4_096
SUBSET_LIMIT = 12

# Fixed values of the monthly obligation template: name, share of trailing outflow in
# percent, late fee per day, flexibility.
CATEGORIES = (
    ("payroll", 35, 0.0020, "rigid"),
    ("rent", 15, 0.0015, "rigid"),
    ("loan_emi", 12, 0.0025, "rigid"),
    ("vendor_payment", 25, 0.0006, "flexible"),
    ("tax", 8, 0.0018, "moderate"),
    ("utilities", 5, 0.0008, "flexible"),
)
LABELS = {
    "payroll": "Wages", "rent": "Premises", "loan_emi": "Loan instalment", "vendor_payment": "Purchases", "tax": "Taxes", "utilities": "Power and water",
}


def penalty_rate(fee_per_day: Column, days_overdue: Column, weight: Column | float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), fee_per_day * days_overdue * weight)


def template_obligations(decisions: DataFrame, period_days: int = 30) -> DataFrame:
    """Six obligations per decision date from the trailing outflow; due day from id arithmetic."""
    cats = F.array(*[
        F.struct(F.lit(i).cast("long").alias("no"), F.lit(n).alias("name"), F.lit(s).cast("long").alias("share"), F.lit(f).alias("fee"), F.lit(x).alias("flexibility"))
        for i, (n, s, f, x) in enumerate(CATEGORIES)
    ])
    day_no = F.datediff("as_of", F.lit("1970-01-01").cast("date"))
    spread = decisions.select("business_id", "as_of", units("trailing_outflow").alias("trail_u"), day_no.alias("day_no"), F.explode(cats).alias("c"))
    due = (1 + F.pmod(F.col("business_id") * 7 + F.col("c.no") * 11 + F.col("day_no"), F.lit(period_days - 1))).cast("long")
    cents = F.expr("(trail_u * c.share + 5000) div 10000")
    return spread.select(
        "business_id", "as_of",
        F.concat_ws("-", F.col("c.name"), F.col("as_of").cast("string")).alias("obligation_id"),
        (cents / 100.0).alias("amount"),
        penalty_rate(F.col("c.fee"), (F.lit(period_days) - due).cast("double")).alias("penalty_rate"),
        F.col("c.flexibility").alias("flexibility"),
        due.alias("days_until_due"),
    )


def template_instances(decisions: DataFrame) -> DataFrame:
    return decisions.select("business_id", "as_of", F.greatest(F.lit(0.0), F.col("opening_balance")).alias("available_cash"))


def is_rigid(col: str = "flexibility") -> Column:
    return F.col(col) == "rigid"


def priority_rank(obligations: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Penalty rate down, due day up, amount down, id as the last tie-break.

    An instance may have any number of obligations; ranking is the one step that needs
    them in order, and it stays inside the instance.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("penalty_rate").desc(), "days_until_due", F.col("amount").desc(), "obligation_id")
    reason = F.concat(
        F.lit("penalty rate "), F.format_string("%.5f", "penalty_rate"), F.lit(" per unit, due in "),
        F.col("days_until_due").cast("string"), F.lit(" days, amount "), F.format_number("amount", 0),
        F.when(is_rigid(), F.lit(" (RIGID: all-or-nothing)")).otherwise(F.lit("")),
    )
    return obligations.withColumn("rank", F.row_number().over(w).cast("long")).withColumn("reason", reason)


def _spend(acc: Column, x: Column) -> Column:
    """One step of an in-order budget: a rigid item is funded in full or skipped."""
    left = acc["left"]
    fits = left >= x["need"]
    take = F.when(left <= 0, F.lit(0).cast("long")).when(
        x["rigid"], F.when(fits, x["need"]).otherwise(F.lit(0).cast("long"))
    ).otherwise(F.least(x["need"], left))
    return F.struct((left - take).alias("left"), F.concat(acc["out"], F.array(F.struct(x["id"].alias("id"), take.alias("take")))).alias("out"))


def _stream_fold(keys: list[str]) -> Callable[[Iterable[pd.DataFrame]], Iterable[pd.DataFrame]]:
    def fold(batches):
        current, left = None, 0
        for pdf in batches:
            takes = np.zeros(len(pdf), dtype=np.int64)
            for i, (key, need, rigid, cash) in enumerate(
                zip(pdf[keys].itertuples(index=False, name=None), pdf["_need"], pdf["_rigid"], pdf["_cash"])
            ):
                if key != current:
                    current, left = key, cash
                if left <= 0:
                    continue
                take = (need if left >= need else 0) if rigid else min(need, left)
                takes[i] = take
                left -= take
            yield pdf[[*keys, "obligation_id"]].assign(_take=takes)

    return fold


def ordered_budget(items: DataFrame, instances: DataFrame, order: Sequence[Column], keys: Sequence[str] = KEYS, need: str = "amount", cash: str = "available_cash") -> DataFrame:
    """Spend each instance's cash down its ordered items; rigid items are skipped when they do not fit.

    A skip makes this different from a running sum.  Small instances are folded inside
    the JVM; instances above 4096 items stream through a sorted partition with constant
    memory, carrying only the cash left.
    """
    keys = list(keys)
    sized = instances.select(*keys, units(cash).alias("_cash")).join(
        items.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")), keys
    )
    j = items.select(*keys, "obligation_id", *[c.alias(f"_o{i}") for i, c in enumerate(order)], units(need).alias("_need"), is_rigid().alias("_rigid")).join(sized, keys)
    sort_cols = [f"_o{i}" for i in range(len(order))]
    item = F.struct(*sort_cols, F.col("obligation_id").alias("id"), F.col("_need").alias("need"), F.col("_rigid").alias("rigid"))
    start = F.struct(F.first("_cash").alias("left"), F.expr("cast(array() as array<struct<id:string,take:bigint>>)").alias("out"))
    small = (
        j.filter(F.col("_size") <= ARRAY_LIMIT)
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(item)).alias("items"), start.alias("start"))
        .select(*keys, F.explode(F.aggregate("items", F.col("start"), _spend, lambda a: a["out"])).alias("x"))
        .select(*keys, F.col("x.id").alias("obligation_id"), F.col("x.take").alias("_take"))
    )
    types = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", obligation_id string, _take long"
    large = (
        j.filter(F.col("_size") > ARRAY_LIMIT)
        .repartition(*keys)
        .sortWithinPartitions(*keys, *sort_cols, "obligation_id")
        .mapInPandas(_stream_fold(keys), schema)
    )
    return small.unionByName(large)


def finish(obligations: DataFrame, taken: DataFrame, strategy: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Allocations with two-place amounts, the funded flag and the penalty incurred."""
    keys = list(keys)
    paid = F.coalesce("_take", F.lit(0))
    unpaid = F.greatest(F.lit(0), units("amount") - paid)
    return obligations.join(taken, [*keys, "obligation_id"], "left").select(
        *keys, F.lit(strategy).alias("strategy"), "obligation_id", "amount", "penalty_rate", "flexibility", "days_until_due",
        F.round(amount(paid), 2).alias("allocated_amount"),
        (F.abs(units("amount") - paid) == 0).alias("fully_funded"),
        (F.col("penalty_rate") * amount(unpaid)).alias("penalty"),
    )


def greedy_order() -> list[Column]:
    return [-F.col("penalty_rate"), F.col("days_until_due").cast("double"), -F.col("amount")]


def greedy_allocation(obligations: DataFrame, instances: DataFrame, strategy: str = "rules_baseline", keys: Sequence[str] = KEYS) -> DataFrame:
    return finish(obligations, ordered_budget(obligations, instances, greedy_order(), keys), strategy, keys)


def _exact_small(packed: DataFrame, keys: list[str]) -> DataFrame:
    """Best rigid subset by enumeration inside the row; the rest is a fractional fill."""
    n_masks = (F.pow(F.lit(2.0), F.size("rigid")) - 1).cast("int")
    zero = F.lit(0).cast("long")

    def bit(m: Column, x: Column) -> Column:
        return m.bitwiseAND(x["bit"]) != 0

    def cost(m: Column) -> Column:
        return F.aggregate("rigid", zero, lambda a, x: a + F.when(bit(m, x), x["need"]).otherwise(zero))

    def score(m: Column) -> Column:
        left = F.col("_cash") - cost(m)
        missed = F.aggregate("rigid", F.lit(0.0), lambda a, x: a + F.when(bit(m, x), 0.0).otherwise(x["rate"] * amount(x["need"])))
        short = F.aggregate(
            "flex", F.lit(0.0), lambda a, x: a + x["rate"] * amount(x["need"] - F.greatest(zero, F.least(x["need"], left - x["before"])))
        )
        return F.struct(F.round(missed + short, 6).alias("objective"), m.alias("mask"), left.alias("left"))

    masks = F.filter(F.transform(F.sequence(F.lit(0), n_masks), score), lambda s: s["left"] >= 0)
    best = packed.withColumn("best", F.array_min(masks))
    picked = F.concat(
        F.transform("rigid", lambda x: F.struct(x["id"].alias("id"), F.when(bit(F.col("best.mask"), x), x["need"]).otherwise(zero).alias("take"))),
        F.transform("flex", lambda x: F.struct(x["id"].alias("id"), F.greatest(zero, F.least(x["need"], F.col("best.left") - x["before"])).alias("take"))),
    )
    return best.select(*keys, F.explode(picked).alias("x")).select(*keys, F.col("x.id").alias("obligation_id"), F.col("x.take").alias("_take"))


def _pareto(keys: list[str]):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        cash = int(pdf["_cash"].iloc[0])
        rigid = pdf[pdf["_rigid"]].sort_values("obligation_id")
        flex = pdf[~pdf["_rigid"]].sort_values(["rate", "obligation_id"], ascending=[False, True])
        cost, gain = np.array([0], dtype=np.int64), np.array([0.0])
        trail = []
        for need, rate in zip(rigid["_need"], rigid["rate"]):
            with_cost, with_gain = cost + need, gain + rate * need / 1e4
            ok = with_cost <= cash
            all_cost = np.concatenate([cost, with_cost[ok]])
            all_gain = np.concatenate([gain, with_gain[ok]])
            src = np.concatenate([np.arange(len(cost)), np.flatnonzero(ok)])
            took = np.concatenate([np.zeros(len(cost), bool), np.ones(int(ok.sum()), bool)])
            order = np.lexsort((-all_gain, all_cost))
            best = np.maximum.accumulate(all_gain[order])
            keep = order[np.concatenate([[True], all_gain[order][1:] > best[:-1]])]
            trail.append((src[keep], took[keep]))
            cost, gain = all_cost[keep], all_gain[keep]
        need, rate = flex["_need"].to_numpy(np.int64), flex["rate"].to_numpy(float)
        before = np.concatenate([[0], np.cumsum(need)])
        saved = np.concatenate([[0.0], np.cumsum(rate * need / 1e4)])
        left = cash - cost
        k = np.searchsorted(before, left, side="right") - 1
        part = np.where(k < len(need), (left - before[np.minimum(k, len(need))]) / 1e4 * np.append(rate, 0.0)[k], 0.0)
        i = int(np.argmax(gain + saved[k] + part))
        fill = np.clip(int(left[i]) - before[:-1], 0, need)
        mask = np.zeros(len(rigid), bool)
        j = i
        for n in range(len(rigid) - 1, -1, -1):
            src, took = trail[n]
            mask[n] = took[j]
            j = src[j]
        out = pd.concat([
            rigid[[*keys, "obligation_id"]].assign(_take=np.where(mask, rigid["_need"], 0)),
            flex[[*keys, "obligation_id"]].assign(_take=fill),
        ])
        out["_take"] = out["_take"].astype("int64")
        return out

    return solve


def exact_take(obligations: DataFrame, instances: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Minimum-penalty allocation: sum of takes within cash, rigid items all or nothing.

    Once the funded rigid subset is fixed, filling the others by penalty rate is optimal.
    Up to twelve rigid items the subsets are enumerated in the row; above that a grouped
    function keeps the undominated (cost, saving) pairs, which is exact as well.
    """
    keys = list(keys)
    sizes = obligations.groupBy(*keys).agg(F.count(F.when(is_rigid(), 1)).alias("_r"), F.count(F.lit(1)).alias("_size"))
    cash = instances.select(*keys, F.greatest(F.lit(0).cast("long"), units("available_cash")).alias("_cash")).join(sizes, keys)
    j = obligations.select(*keys, "obligation_id", units("amount").alias("_need"), F.col("penalty_rate").alias("rate"), is_rigid().alias("_rigid")).join(cash, keys)
    small_ok = (F.col("_r") <= SUBSET_LIMIT) & (F.col("_size") <= ARRAY_LIMIT)
    row = F.struct((-F.col("rate")).alias("sort"), F.col("obligation_id").alias("id"), F.col("_need").alias("need"), F.col("rate").alias("rate"))
    arrays = j.filter(small_ok).groupBy(*keys).agg(
        F.first("_cash").alias("_cash"),
        F.array_sort(F.collect_list(F.when(F.col("_rigid"), F.struct(F.col("obligation_id").alias("id"), F.col("_need").alias("need"), F.col("rate").alias("rate"))))).alias("r0"),
        F.array_sort(F.collect_list(F.when(~F.col("_rigid"), row))).alias("f0"),
    )
    packed = arrays.select(
        *keys, "_cash",
        F.transform("r0", lambda x, i: F.struct(F.pow(F.lit(2.0), i).cast("int").alias("bit"), x["id"].alias("id"), x["need"].alias("need"), x["rate"].alias("rate"))).alias("rigid"),
        F.transform("f0", lambda x, i: F.struct(
            x["id"].alias("id"), x["need"].alias("need"), x["rate"].alias("rate"),
            F.aggregate(F.slice("f0", 1, i), F.lit(0).cast("long"), lambda a, y: a + y["need"]).alias("before"),
        )).alias("flex"),
    )
    types = {f.name: f.dataType.simpleString() for f in obligations.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", obligation_id string, _take long"
    large = j.filter(~small_ok).groupBy(*keys).applyInPandas(_pareto(keys), schema)
    return _exact_small(packed, keys).unionByName(large)


def exact_allocation(obligations: DataFrame, instances: DataFrame, strategy: str = "exact", keys: Sequence[str] = KEYS) -> DataFrame:
    return finish(obligations, exact_take(obligations, instances, keys), strategy, keys)


def chance_constrained(obligations: DataFrame, instances: DataFrame, limits: DataFrame, strategy: str = "chance_constrained", keys: Sequence[str] = KEYS) -> DataFrame:
    """Exact allocation within min(cash, safe spend): spending is monotone, so one cap is the constraint."""
    capped = instances.join(limits.select(*keys, "safe_spend"), list(keys)).withColumn(
        "available_cash", F.least("available_cash", "safe_spend")
    )
    return exact_allocation(obligations, capped, strategy, keys)


# --- grid dynamic programme ---------------------------------------------------------------


def grid_unit(cash: float, target_cells: int = 4000) -> float:
    if cash <= 0:
        return 1000.0
    return max(10.0 ** np.floor(np.log10(max(cash / target_cells, 1e-9))), 1.0)


def _sliding_max(g: np.ndarray, k: int) -> np.ndarray:
    """max(g[c-k..c]) for every c, by block prefix and suffix maxima."""
    n, w = len(g), k + 1
    padded = np.concatenate([np.full(k, -np.inf), g, np.full((-(n + k)) % w, -np.inf)])
    blocks = padded.reshape(-1, w)
    prefix = np.maximum.accumulate(blocks, axis=1).ravel()
    suffix = np.maximum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(suffix[:n], prefix[k:k + n])


def _grid_dp(keys: list[str], unit: float | None):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("obligation_id")
        cash = float(pdf["_cash"].iloc[0])
        u = unit or grid_unit(cash)
        cap = int(np.floor(cash / u))
        tables = [np.zeros(cap + 1)]
        items = list(zip(pdf["amount"], pdf["rate"], pdf["_rigid"]))
        cells = np.arange(cap + 1)
        for a, w, rigid in items:
            prev = tables[-1]
            cur = prev.copy()
            if rigid:
                q = int(np.ceil(a / u - 1e-12))
                if q <= cap:
                    cur[q:] = np.maximum(prev[q:], prev[: cap + 1 - q] + w * a)
            else:
                k = int(np.floor(a / u))
                if k > 0:
                    v = u * w
                    cur = _sliding_max(prev - cells * v, min(k, cap)) + cells * v
            tables.append(cur)
        take = np.zeros(len(items))
        c = cap
        for i in range(len(items) - 1, -1, -1):
            a, w, rigid = items[i]
            prev = tables[i]
            if rigid:
                if tables[i + 1][c] > prev[c]:
                    take[i] = a
                    c -= int(np.ceil(a / u - 1e-12))
            else:
                k = min(int(np.floor(a / u)), c)
                if k > 0:
                    t = int(np.argmax(prev[c - k:c + 1][::-1] + np.arange(k + 1) * u * w))
                    take[i] = min(t * u, a)
                    c -= t
        return pdf[[*keys, "obligation_id"]].assign(_take=np.round(take * 1e4).astype("int64"), grid_unit=u)

    return solve


def grid_dp(obligations: DataFrame, instances: DataFrame, unit: float | None = None, strategy: str = "grid_dp", keys: Sequence[str] = KEYS) -> DataFrame:
    """Knapsack on a cash grid, one instance per group: an independent check of the exact method."""
    keys = list(keys)
    j = obligations.select(*keys, "obligation_id", "amount", F.col("penalty_rate").alias("rate"), is_rigid().alias("_rigid")).join(
        instances.select(*keys, F.greatest(F.lit(0.0), F.col("available_cash")).alias("_cash")), keys
    )
    types = {f.name: f.dataType.simpleString() for f in obligations.schema.fields}
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", obligation_id string, _take long, grid_unit double"
    taken = j.groupBy(*keys).applyInPandas(_grid_dp(keys, unit), schema)
    units_used = taken.select(*keys, "obligation_id", "grid_unit")
    return finish(obligations, taken.drop("grid_unit"), strategy, keys).join(units_used, [*keys, "obligation_id"])


# --- summaries -----------------------------------------------------------------------------


def objective(allocations: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return allocations.groupBy(*keys, "strategy").agg(
        F.sum("penalty").alias("objective"), F.sum("allocated_amount").alias("planned_spend"), F.count(F.when(F.col("fully_funded"), 1)).alias("n_funded")
    )


def plan_status(objectives: DataFrame, limits: DataFrame, epsilon: float = 0.05, keys: Sequence[str] = KEYS) -> DataFrame:
    """Plans with their safe-spend limit and whether any plan can keep the shortfall below ``epsilon``.

    Paying nothing is the safest plan; where even that falls short too often, the status is infeasible:
    the way out is more cash or other terms, not another schedule.
    """
    status = F.when(F.col("baseline_shortfall") > epsilon, "infeasible").otherwise("feasible")
    return objectives.join(limits.select(*keys, "safe_spend", "baseline_shortfall"), list(keys)).withColumn("status", status)


def feasibility(allocations: DataFrame, instances: DataFrame, tol: float = 0.01, keys: Sequence[str] = KEYS) -> DataFrame:
    """Budget, box and all-or-nothing tests with a tolerance of one hundredth per item."""
    x, a = F.col("allocated_amount"), F.col("amount")
    box = (x >= -tol) & (x <= a + tol)
    whole = ~is_rigid() | (F.abs(x) <= tol) | (F.abs(x - a) <= tol)
    agg = allocations.groupBy(*keys, "strategy").agg(
        F.sum("allocated_amount").alias("spend"), F.count(F.lit(1)).alias("n"), F.bool_and(box & whole).alias("items_ok")
    )
    return agg.join(instances, list(keys)).select(
        *keys, "strategy", (F.col("items_ok") & (F.col("spend") <= F.col("available_cash") + F.greatest(F.col("n"), F.lit(1)) * tol)).alias("feasible")
    )


def optimizer_lift(objectives: DataFrame, baseline: str, optimized: str, keys: Sequence[str] = KEYS) -> DataFrame:
    o = objectives.groupBy(*keys).agg(
        F.max(F.when(F.col("strategy") == baseline, F.col("objective"))).alias("baseline_penalty"),
        F.max(F.when(F.col("strategy") == optimized, F.col("objective"))).alias("optimized_penalty"),
    )
    saved = F.col("baseline_penalty") - F.col("optimized_penalty")
    return o.select(
        *keys, "baseline_penalty", "optimized_penalty", saved.alias("penalty_saved"),
        F.when(F.col("baseline_penalty") > 0, saved / F.col("baseline_penalty") * 100.0).otherwise(0.0).alias("penalty_saved_pct"),
    )


def solver_agreement(obligations: DataFrame, exact: DataFrame, grid: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Grid minus exact objective against its one-sided discretization bound."""
    keys = list(keys)
    e = exact.groupBy(*keys).agg(F.sum("penalty").alias("exact_objective"))
    g = grid.groupBy(*keys).agg(F.sum("penalty").alias("grid_objective"), F.max("grid_unit").alias("grid_unit"))
    w = obligations.groupBy(*keys).agg(F.sum("penalty_rate").alias("_w"), F.sum(F.col("penalty_rate") * F.col("amount")).alias("_max"))
    delta = F.col("grid_objective") - F.col("exact_objective")
    bound = F.col("grid_unit") * F.col("_w") + 1e-7 * F.greatest(F.col("_max"), F.lit(1.0)) + 1e-6
    verdict = F.when(delta < -bound, "grid below exact: one solver is wrong").when(delta > bound, "grid too coarse").otherwise("agree")
    return e.join(g, keys).join(w, keys).select(
        *keys, "exact_objective", "grid_objective", "grid_unit", delta.alias("delta"), bound.alias("tolerance"), (F.abs(delta) <= bound).alias("agree"), verdict.alias("explanation")
    )


# --- plan text -----------------------------------------------------------------------------


def category_of(obligation_id: Column) -> Column:
    """Name without a trailing ISO date."""
    return F.regexp_replace(obligation_id, r"-\d{4}-\d{2}-\d{2}$", "")


def plain_label(category: Column) -> Column:
    pairs = [x for k, v in LABELS.items() for x in (F.lit(k), F.lit(v))]
    spaced = F.lower(F.regexp_replace(category, "_", " "))
    fallback = F.concat(F.upper(F.left(spaced, F.lit(1))), F.substr(spaced, F.lit(2)))
    return F.coalesce(F.element_at(F.create_map(*pairs), category), fallback)


def due_phrase(days: Column) -> Column:
    weeks = F.floor(days / 7)
    return (
        F.when(days <= 0, "no days left").when(days == 1, "1 day left").when(days <= 7, F.concat(days.cast("string"), F.lit(" days left")))
        .otherwise(F.concat(F.lit("over "), weeks.cast("string"), F.when(weeks > 1, " weeks left").otherwise(" week left")))
    )


def payment_plan(allocations: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """pay_now / pay_partial / defer with a plain sentence per obligation, in due order."""
    a, x = F.col("amount"), F.col("allocated_amount")
    raw = a - x
    unpaid = F.when(raw > 0.01, raw).otherwise(0.0)
    fee = F.when(unpaid > 0, F.col("penalty_rate") * unpaid).otherwise(F.col("penalty_rate") * a)
    action = F.when(x >= a - 0.01, "pay_now").when(x > 0.01, "pay_partial").otherwise("defer")
    cat = category_of(F.col("obligation_id"))
    label, due = plain_label(cat), due_phrase(F.col("days_until_due"))
    cash = lambda c: F.format_number(F.floor(c + 0.5), 0)
    why = F.concat(
        label, F.lit(", "), due, F.lit(": "),
        F.when(action == "pay_now", F.concat(F.lit("settle all"), F.when(is_rigid(), " (no part payment)").otherwise(""), F.lit("; fee avoided "), cash(fee)))
        .when(action == "pay_partial", F.concat(F.lit("settle "), cash(x), F.lit(", carry over "), cash(raw)))
        .otherwise(F.concat(F.lit("wait; fee "), cash(fee), F.lit(", others cost more"))),
    )
    w = Window.partitionBy(*keys).orderBy("days_until_due", "obligation_id")
    return allocations.select(
        *keys, "obligation_id", label.alias("label"), cat.alias("category"), action.alias("action_type"), a.alias("amount_due"), x.alias("allocated_amount"),
        unpaid.alias("shortfall"), "days_until_due", is_rigid().alias("is_rigid"), fee.alias("late_fee_if_unpaid"), why.alias("justification"),
        F.row_number().over(w).cast("long").alias("place"),
    )


def plan_summary(plan: DataFrame, instances: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    s = plan.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_obligations"), F.count(F.when(F.col("action_type") == "pay_now", 1)).alias("n_paid_in_full"),
        F.sum(F.when(F.col("shortfall") > 0.01, F.col("late_fee_if_unpaid")).otherwise(0.0)).alias("expected_late_fees"),
        F.sum("amount_due").alias("total_due"),
    )
    return s.join(instances, list(keys)).select(
        *keys, "n_obligations", "n_paid_in_full", "expected_late_fees", F.greatest(F.lit(0.0), F.col("total_due") - F.col("available_cash")).alias("shortfall")
    )
