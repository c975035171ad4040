"""Bank statements: lines -> cells -> typed columns -> verified mapping -> records.

All files of a batch are handled in one job.  Work that needs the previous row of a
file is cut into blocks of rows, so one very long file is spread like many short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.functions.spread import lookup_join, previous_rows, running_totals
from ledgerloom.session import cut_lineage
from ledgerloom.sources.csv_records import DELIMITERS, cells_of

HEAD_CHARS = 4_096
SCAN_ROWS = 25
TOLERANCE_CENTS = 1.1
INDICATORS = ("dr", "cr", "d", "c", "debit", "credit", "db")
DEBIT_FLAGS = ("dr", "d", "debit", "db")


def sniff_delimiters(lines: DataFrame, head_chars: int = HEAD_CHARS) -> DataFrame:
    """Delimiter per file from the lines that start in its first ``head_chars`` characters: the one splitting
    most lines alike; comma otherwise."""
    near = lines.filter(F.col("line_no") < head_chars)  # a line has at least its line end
    before = F.sum(F.length("line") + 1).over(Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    near = near.withColumn("_before", F.coalesce(before, F.lit(0))).filter(F.col("_before") < head_chars)
    head = near.groupBy("file_id").agg(F.collect_list("line").alias("_lines"))

    def vote(i: int, d: str) -> Column:
        counts = F.filter(F.transform("_lines", lambda s: F.length(s) - F.length(F.replace(s, F.lit(d), F.lit("")))), lambda c: c > 0)
        widths = lambda n: F.transform(F.array_distinct(n), lambda c: F.struct(F.size(F.filter(n, lambda k: k == c)).alias("lines"), c.alias("width")))
        cast = lambda m: F.struct(F.coalesce(m["lines"], F.lit(0)).alias("lines"), F.coalesce(m["width"], F.lit(0)).alias("width"), F.lit(-i).alias("no"), F.lit(d).alias("d"))
        return text.bound(F.array_max(text.bound(counts, widths)), cast)

    best = F.array_max(F.array(*[vote(i, d) for i, d in enumerate(DELIMITERS)]))
    return head.select("file_id", text.bound(best, lambda b: F.when(b["lines"] > 0, b["d"]).otherwise(",")).alias("delimiter"))


def split_cells(lines: DataFrame, delimiters: DataFrame) -> DataFrame:
    """Cells of every record; delimiters and line breaks inside quotes do not split."""
    sized = lines.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_lines")).join(delimiters, "file_id")
    j = lookup_join(lines, sized, ["file_id"], "n_lines", how="inner")
    return j.select("file_id", "line_no", cells_of(F.col("line"), F.col("delimiter")).alias("cells"))


def locate_header(rows: DataFrame, scan_rows: int = SCAN_ROWS) -> DataFrame:
    """Best of the first ``scan_rows`` rows by header vocabulary, numeric cells and modal width."""
    from ledgerloom.functions.similarity import header_shape, header_vocabulary

    width = F.size("cells")
    modal = rows.filter(width > 1).groupBy("file_id", width.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first"))
    modal = modal.groupBy("file_id").agg(F.max_by("w", F.struct("n", -F.col("first"))).alias("modal_width"))
    head = rows.filter((F.col("line_no") < scan_rows) & (width >= 2))
    cells = head.select("file_id", "line_no", width.alias("w"), F.explode("cells").alias("cell")).withColumn("shape", header_shape("cell"))
    # Few bytes but much work for each: a number of tasks that is not merged by size.
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = cells.select("shape").filter(F.trim("shape") != "").distinct().repartition(tasks).withColumn("vocab", header_vocabulary("shape"))
    scored = cells.join(words, "shape", "left").groupBy("file_id", "line_no", "w").agg(
        (F.sum(F.coalesce("vocab", F.lit(0.0))) - 2.0 * F.count(text.parse_amount(F.col("cell")))).alias("s")
    )
    total = scored.join(modal, "file_id", "left").withColumn("score", F.col("s") + F.when(F.col("w") == F.col("modal_width"), 1.5).otherwise(0.0))
    return total.groupBy("file_id").agg(
        F.max_by("line_no", F.struct("score", -F.col("line_no"))).alias("header_line"), F.max("score").alias("header_score")
    )


def body_rows(rows: DataFrame, headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Header cells per file and the non-empty rows below, padded to the header width and numbered densely."""
    sized = rows.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_lines")).join(headers.select("file_id", "header_line"), "file_id")
    j = lookup_join(rows, sized, ["file_id"], "n_lines", how="inner")
    names = j.filter(F.col("line_no") == F.col("header_line")).select("file_id", F.transform("cells", lambda c: F.trim(c)).alias("header"))
    below = j.filter((F.col("line_no") > F.col("header_line")) & F.exists("cells", lambda c: F.trim(c) != ""))
    widths = below.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_rows")).join(names.select("file_id", F.size("header").alias("width")), "file_id")
    fitted = lookup_join(below.drop("header_line"), widths, ["file_id"], "n_rows", how="inner").select(
        "file_id", "line_no",
        F.transform(F.sequence(F.lit(1), F.col("width")), lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(""))).alias("cells"),
    )
    numbered = running_totals(fitted, ["file_id"], [], "line_no", {"row_idx": F.lit(1)}, inclusive=False)
    return names, numbered.select("file_id", "row_idx", "cells")


def long_cells(body: DataFrame) -> DataFrame:
    return body.select("file_id", "row_idx", F.posexplode("cells").alias("col_idx", "cell"))


def column_types(cells: DataFrame) -> DataFrame:
    """Numeric, fill and indicator shares of every column."""
    c = F.trim("cell")
    filled = c != ""
    n_filled = F.count(F.when(filled, 1))
    parsed = text.parse_amount(F.col("cell"))
    agg = cells.groupBy("file_id", "col_idx").agg(
        F.count(F.lit(1)).alias("n_rows"), n_filled.alias("n_filled"), F.count(F.when(filled, parsed)).alias("n_numeric"),
        F.coalesce(F.bool_and(F.when(filled, F.lower(c).isin(*INDICATORS))), F.lit(False)).alias("is_indicator"),
    )
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return agg.select(
        "file_id", "col_idx", "n_rows", share("n_numeric", "n_filled").alias("numeric_fraction"), share("n_filled", "n_rows").alias("fill_fraction"),
        "is_indicator", (F.col("n_numeric") == F.col("n_rows")).alias("is_complete"),
    ).withColumn("is_numeric", (F.col("numeric_fraction") > 0.95) & (F.col("fill_fraction") > 0) & ~F.col("is_indicator"))


def date_formats(cells: DataFrame, block_rows: int = 65_536) -> DataFrame:
    """Date layout per column from all of its cells, with the ambiguity warnings.

    A layout must parse every non-empty cell; layouts that give a non-decreasing column
    come first.  Sortedness is checked inside row blocks and then between blocks.
    """
    filled = cells.filter(F.trim("cell") != "")
    read = lambda p, s: F.when(F.col("_may"), text.parse_date(F.col("cell"), p, s))
    tests = [F.bool_and(read(p, s).isNotNull()).alias(f"_f{i}") for i, (_, p, s) in enumerate(text.DATE_FORMATS)]
    per_col = filled.withColumn("_may", text.may_be_date(F.col("cell"))).groupBy("file_id", "col_idx").agg(F.count(F.lit(1)).alias("n_cells"), *tests)
    viable = F.array_compact(F.array(*[F.when(F.col(f"_f{i}"), F.struct(F.lit(i).alias("no"), F.lit(n).alias("name"))) for i, (n, _, _) in enumerate(text.DATE_FORMATS)]))
    ok = per_col.select("file_id", "col_idx", "n_cells", viable.alias("viable")).filter(F.size("viable") > 0)
    dated = lookup_join(filled, ok, ["file_id", "col_idx"], "n_cells", how="inner").select(
        "file_id", "col_idx", "row_idx", "cell", F.explode("viable").alias("f")
    )
    d = dated.select(
        "file_id", "col_idx", "row_idx", F.col("f.no").alias("no"), F.col("f.name").alias("fmt"),
        text.parse_date_named(F.col("cell"), F.col("f.name")).alias("d"), F.floor(F.col("row_idx") / block_rows).alias("_b"),
    )
    key = ["file_id", "col_idx", "no", "fmt"]
    w = Window.partitionBy(*key, "_b").orderBy("row_idx")
    blocks = d.withColumn("_up", F.coalesce(F.col("d") >= F.lag("d").over(w), F.lit(True))).groupBy(*key, "_b").agg(
        F.bool_and("_up").alias("up"), F.min_by("d", "row_idx").alias("first"), F.max_by("d", "row_idx").alias("last")
    )
    wb = Window.partitionBy(*key).orderBy("_b")
    ordered = blocks.withColumn("join_ok", F.coalesce(F.col("first") >= F.lag("last").over(wb), F.lit(True))).groupBy(*key).agg(
        F.bool_and(F.col("up") & F.col("join_ok")).alias("ordered")
    )
    opts = ordered.groupBy("file_id", "col_idx").agg(F.array_sort(F.collect_list(F.struct((~F.col("ordered")).alias("late"), "no", "fmt"))).alias("o"))
    chosen = F.col("o")[0]
    pool = F.filter("o", lambda x: x["late"] == chosen["late"])
    other = F.lit(None).cast("string")
    for a, b in text.AMBIGUOUS.items():
        for x, y in ((a, b), (b, a)):
            other = F.when((chosen["fmt"] == x) & F.array_contains(F.transform(pool, lambda p: p["fmt"]), y), F.lit(y)).otherwise(other)
    return opts.select(
        "file_id", "col_idx", chosen["fmt"].alias("date_format"), (~chosen["late"]).alias("is_ordered"), other.alias("ambiguous_with")
    )


def choose_date_column(types: DataFrame, formats: DataFrame, header_cells: DataFrame) -> DataFrame:
    """Date-like column with fill above 0.9, best DATE header, then leftmost."""
    from ledgerloom.functions.similarity import header_scores

    names = header_cells.select("file_id", F.posexplode("header").alias("col_idx", "name"))
    scored = names.select("name").distinct().withColumn("s", F.coalesce(header_scores("name")["date"], F.lit(0.0)))
    c = (
        formats.join(types.select("file_id", "col_idx", "fill_fraction"), ["file_id", "col_idx"])
        .filter(F.col("fill_fraction") > 0.9)
        .join(names.join(scored, "name"), ["file_id", "col_idx"])
    )
    return c.groupBy("file_id").agg(
        F.max_by(F.struct("col_idx", "date_format", "is_ordered", "ambiguous_with"), F.struct("s", -F.col("col_idx"))).alias("c")
    ).select("file_id", F.col("c.col_idx").alias("date_idx"), "c.date_format", "c.is_ordered", "c.ambiguous_with")


def candidate_mappings(types: DataFrame, date_columns: DataFrame) -> DataFrame:
    """Every way to read balance and amounts from the typed columns.

    Columns of a file are few.  When a complete numeric column stands beside another numeric
    one, only complete columns are tried as the balance: a mapping without a usable balance
    can then never win.
    """
    t = types.join(date_columns.select("file_id", "date_idx"), "file_id").filter(F.col("col_idx") != F.col("date_idx"))
    idx = F.col("col_idx").cast("long")
    per_file = t.groupBy("file_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("is_numeric"), idx))).alias("num"),
        F.sort_array(F.collect_list(F.when(F.col("is_numeric") & F.col("is_complete"), idx))).alias("full"),
        F.sort_array(F.collect_list(F.when(F.col("is_indicator"), idx))).alias("ind"),
        F.max("n_rows").alias("n_rows"),
    ).filter(F.size("num") > 0)
    none = F.lit(None).cast("long")
    bal = F.when((F.size("full") > 0) & (F.size("num") > 1), F.col("full")).otherwise(F.array(none))
    opts = per_file.select("file_id", "n_rows", "num", "ind", F.explode(bal).alias("bal")).withColumn(
        "pool", F.filter("num", lambda x: F.col("bal").isNull() | (x != F.col("bal")))
    )
    base = opts.select("file_id", "n_rows", "bal", "ind", "pool", F.explode("pool").alias("a"))
    two = base.select("file_id", "n_rows", "bal", F.col("a").alias("debit"), F.explode("pool").alias("credit")).filter("debit <> credit")
    cols = ["file_id", "n_rows", "convention", "debit", "credit", "amount", "indicator", "bal"]
    separate = two.withColumn("convention", F.lit("separate_debit_credit")).withColumn("amount", none).withColumn("indicator", none)
    signed = base.select("file_id", "n_rows", "bal", F.col("a").alias("amount")).withColumn("convention", F.lit("signed_single_column"))
    signed = signed.withColumn("debit", none).withColumn("credit", none).withColumn("indicator", none)
    flagged = base.select("file_id", "n_rows", "bal", F.col("a").alias("amount"), F.explode("ind").alias("indicator"))
    flagged = flagged.withColumn("convention", F.lit("amount_with_indicator")).withColumn("debit", none).withColumn("credit", none)
    return separate.select(*cols).unionByName(signed.select(*cols)).unionByName(flagged.select(*cols))


def _pick(arr: Column, i: Column) -> Column:
    return F.coalesce(F.get(arr, i.cast("int")), F.lit(0).cast("long"))


def resolve(cand: Column, cents: Column, cells: Column) -> tuple[Column, Column]:
    """(debit, credit) in cents of one row under one candidate."""
    conv = cand["convention"]
    zero = F.lit(0).cast("long")
    a = _pick(cents, cand["amount"])
    flag = F.lower(F.trim(F.coalesce(F.get(cells, cand["indicator"].cast("int")), F.lit("")))).isin(*DEBIT_FLAGS)
    debit = (
        F.when(conv == "separate_debit_credit", F.abs(_pick(cents, cand["debit"])))
        .when(conv == "signed_single_column", F.greatest(zero, -a))
        .otherwise(F.when(flag, F.abs(a)).otherwise(zero))
    )
    credit = (
        F.when(conv == "separate_debit_credit", F.abs(_pick(cents, cand["credit"])))
        .when(conv == "signed_single_column", F.greatest(zero, a))
        .otherwise(F.when(flag, zero).otherwise(F.abs(a)))
    )
    return debit, credit


def parsed_body(body: DataFrame) -> DataFrame:
    """Body rows with every cell parsed once to whole cents and the two rows before."""
    cents = F.transform("cells", lambda c: (text.parse_amount(c) * 100).cast("long"))
    return previous_rows(body.withColumn("cents", cents), ["file_id"], "row_idx", ["cents", "cells"], depth=2).drop("prev2_cells")


CAND = ["convention", "debit", "credit", "amount", "indicator", "bal"]


def residuals(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Debit, credit, balance and running-balance residual of every (row, candidate)."""
    packed = candidates.groupBy("file_id").agg(F.max("n_rows").alias("n_rows"), F.collect_list(F.struct(*CAND)).alias("cands"))
    j = lookup_join(rows, packed, ["file_id"], "n_rows", how="inner").withColumn("c", F.explode("cands"))
    c = F.col("c")
    d0, c0 = resolve(c, F.col("cents"), F.col("cells"))
    d1, c1 = resolve(c, F.col("prev1_cents"), F.col("prev1_cells"))
    b = lambda arr: F.get(arr, c["bal"].cast("int"))
    out = j.select(
        "file_id", "row_idx", "c", "cells", d0.alias("debit"), c0.alias("credit"), b(F.col("cents")).alias("balance"),
        F.when(F.col("row_idx") >= 1, F.abs(b(F.col("prev1_cents")) + c0 - d0 - b(F.col("cents")))).alias("residual"),
        F.when(F.col("row_idx") >= 2, F.abs(b(F.col("prev2_cents")) + c1 - d1 - b(F.col("prev1_cents")))).alias("prev_residual"),
    )
    return out


def reconcile(resid: DataFrame, keys: list[str]) -> DataFrame:
    """Reconciliation report and residual diagnosis per key, in one aggregate."""
    r, tol = F.col("residual"), F.lit(TOLERANCE_CENTS)
    amt = F.col("debit") + F.col("credit")
    doubled = (amt > 0) & (F.abs(r - 2 * amt) <= F.greatest(tol, 0.01 * amt))
    a = resid.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("balance").alias("n_bal"), F.count(r).alias("n_res"),
        F.count(F.when(r > tol, 1)).alias("n_bad"), F.coalesce(F.max(r), F.lit(0)).alias("max_r"), F.coalesce(F.sum(r), F.lit(0)).alias("sum_r"),
        F.count(F.when(amt > 0, 1)).alias("movement"), F.count(F.when(doubled, 1)).alias("n_doubled"),
        F.coalesce(F.bool_and(F.when(F.col("prev_residual").isNotNull(), r >= F.col("prev_residual") - tol)), F.lit(True)).alias("monotone"),
    )
    checkable = (F.col("n_bal") == F.col("n_rows")) & (F.col("n_rows") > 0)
    passed = checkable & (F.col("n_bad") == 0) & (F.col("n_res") > 0)
    diagnosis = (
        F.when(~checkable, "no usable balance column")
        .when(passed | (F.col("n_res") == 0), F.lit(None))
        .when(F.col("n_doubled") / F.col("n_res") > 0.8, "inverted direction")
        .when(F.col("n_bad") <= F.greatest(F.lit(2), F.floor(F.col("n_res") / 20)), "localized bad cell")
        .when(F.col("monotone"), "missing row")
        .otherwise("unknown cause")
    )
    return a.select(
        *keys, "n_rows", checkable.alias("checkable"), passed.alias("passed"),
        F.when(checkable, F.col("n_rows") - F.col("n_bad")).otherwise(0).alias("n_reconciled"),
        F.when(checkable, F.col("max_r") / 100.0).otherwise(0.0).alias("max_residual"),
        F.when(checkable & (F.col("n_res") > 0), F.col("sum_r") / 100.0 / F.col("n_res")).otherwise(0.0).alias("mean_residual"),
        (F.col("movement") / F.col("n_rows") > 0.5).alias("moves"), diagnosis.alias("diagnosis"),
        (checkable & (F.col("n_bad") == 1)).alias("single_gap"),
    )


def header_support(candidates: DataFrame, header_cells: DataFrame) -> DataFrame:
    """Sum of header scores of the columns a candidate uses."""
    from ledgerloom.functions.similarity import header_scores

    names = header_cells.select("file_id", F.posexplode("header").alias("pos", "name"))
    scored = names.select("name").distinct().withColumn("s", header_scores("name"))
    arr = names.join(scored, "name").groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.map_entries("s").alias("s")))), lambda x: F.map_from_entries(x["s"])).alias("ss"))
    at = lambda i, role: F.coalesce(F.get("ss", F.col(i).cast("int"))[role], F.lit(0.0))
    return candidates.join(arr, "file_id", "left").withColumn(
        "support", at("debit", "debit") + at("credit", "credit") + at("amount", "signed_amount") + at("bal", "balance")
    ).drop("ss")


def choose_mapping(reports: DataFrame, support: DataFrame | None = None) -> DataFrame:
    """Best mapping per file: passed, moves, small residual, header support; unverified without balance."""
    c = F.col("c")
    flat = reports.select("file_id", *[c[x].alias(x) for x in CAND], *[x for x in reports.columns if x not in ("file_id", "c")])
    if support is not None:
        key = F.struct(*[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in CAND])
        flat = flat.withColumn("_k", key).join(support.select("file_id", key.alias("_k"), "support"), ["file_id", "_k"]).drop("_k")
    else:
        flat = flat.withColumn("support", F.lit(0.0))
    low = lambda x: -F.coalesce(F.col(x), F.lit(-1))
    order = F.struct(
        "checkable", "passed", "moves", F.when(F.col("checkable"), -F.col("mean_residual")).otherwise(0.0).alias("r"), "support",
        low("bal").alias("b"), low("debit").alias("d"), low("amount").alias("a"),
    )
    cols = [x for x in flat.columns if x != "file_id"]
    best = flat.groupBy("file_id").agg(F.max_by(F.struct(*cols), order).alias("m")).select("file_id", "m.*")
    rejected = F.col("checkable") & ~F.col("passed")
    reason = F.concat(
        F.lit("statement does not reconcile: "), (F.col("n_rows") - F.col("n_reconciled")).cast("string"), F.lit(" of "), F.col("n_rows").cast("string"),
        F.lit(" rows break the running balance (max residual "), F.format_string("%.2f", "max_residual"), F.lit("): "), F.col("diagnosis"),
    )
    return best.withColumn("rejected", rejected).withColumn("rejection_reason", F.when(rejected, reason)).withColumn(
        "warning", F.when(~F.col("checkable"), "mapping not verified: no balance column")
    )


def failing_rows(resid: DataFrame) -> DataFrame:
    """The rows that break the running balance, one each; a caller that shows a few of them cuts its own list."""
    return resid.filter(F.col("residual") > TOLERANCE_CENTS)


def descriptive_columns(types: DataFrame, header_cells: DataFrame, date_columns: DataFrame, mapping: DataFrame) -> DataFrame:
    """Description and reference columns among the unused, mostly non-numeric ones."""
    from ledgerloom.functions.similarity import header_scores

    names = header_cells.select("file_id", F.posexplode("header").alias("col_idx", "name"))
    scored = names.select("name").distinct().withColumn("s", header_scores("name"))
    used = mapping.join(date_columns.select("file_id", "date_idx"), "file_id").select(
        "file_id", F.array_compact(F.array(F.col("date_idx").cast("long"), "debit", "credit", "amount", "indicator", "bal")).alias("used")
    )
    free = (
        types.filter(F.col("numeric_fraction") < 0.5).join(used, "file_id")
        .filter(~F.array_contains("used", F.col("col_idx").cast("long")))
        .join(names.join(scored, "name"), ["file_id", "col_idx"])
    )
    desc = free.groupBy("file_id").agg(F.max_by("col_idx", F.struct(F.col("s")["description"], F.col("fill_fraction"), -F.col("col_idx"))).alias("desc_idx"))
    rest = free.join(desc, "file_id").filter(F.col("col_idx") != F.col("desc_idx"))
    ref = rest.groupBy("file_id").agg(F.max_by("col_idx", F.struct(F.col("s")["reference"], -F.col("col_idx"))).alias("ref_idx"))
    return desc.join(ref, "file_id", "left")


def column_roles(header_cells: DataFrame, date_columns: DataFrame, mapping: DataFrame, descriptive: DataFrame) -> DataFrame:
    """Role of every column with its confidence: own header score against the best rival role."""
    from ledgerloom.functions.similarity import ROLES, header_scores

    names = header_cells.select("file_id", F.posexplode("header").alias("col_idx", "name"))
    j = (
        names.join(names.select("name").distinct().withColumn("s", header_scores("name")), "name")
        .join(mapping.select("file_id", "debit", "credit", "amount", "bal"), "file_id")
        .join(date_columns.select("file_id", "date_idx"), "file_id")
        .join(descriptive, "file_id", "left")
    )
    i = F.col("col_idx")
    role = F.coalesce(
        F.when(i == F.col("desc_idx"), "description"), F.when(i == F.col("bal"), "balance"), F.when(i == F.col("amount"), "signed_amount"),
        F.when(i == F.col("credit"), "credit"), F.when(i == F.col("debit"), "debit"), F.when(i == F.col("date_idx"), "date"),
        F.when(i == F.col("ref_idx"), "reference"), F.lit("ignored"),
    )
    r = j.withColumn("role", role)
    own = F.coalesce(F.col("s")[F.col("role")], F.lit(0.0))
    rival = F.array_max(F.transform(F.array(*[F.lit(x) for x in ROLES]), lambda x: F.when(x == F.col("role"), 0.0).otherwise(F.coalesce(F.col("s")[x], F.lit(0.0)))))
    conf = F.when(F.col("role") == "ignored", 1.0).when(own <= 0, 0.25).otherwise(F.least(F.lit(1.0), own / (own + rival)))
    return r.select("file_id", "col_idx", "name", "role", conf.alias("confidence"))


def statement_rows(body: DataFrame, resid: DataFrame, date_columns: DataFrame, descriptive: DataFrame) -> DataFrame:
    """Typed rows of the chosen mapping: date, description, reference, debit, credit, balance, reconciled."""
    info = date_columns.select("file_id", "date_idx", "date_format").join(descriptive, "file_id", "left")
    sized = resid.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_rows")).join(info, "file_id")
    j = lookup_join(resid, sized, ["file_id"], "n_rows", how="inner")
    at = lambda i: F.trim(F.get("cells", F.col(i).cast("int")))
    posted = text.parse_date_named(at("date_idx"), F.col("date_format"))
    money = lambda c: (F.col(c) / F.lit(100)).try_cast("decimal(28,2)")
    return j.select(
        "file_id", "row_idx", posted.alias("posted_date"), F.coalesce(at("desc_idx"), F.lit("")).alias("description"),
        F.when(at("ref_idx") != "", at("ref_idx")).alias("reference"), money("debit").alias("debit"), money("credit").alias("credit"),
        money("balance").alias("balance"), (F.coalesce(F.col("residual"), F.lit(0)) <= TOLERANCE_CENTS).alias("reconciled"),
    ).filter(F.col("posted_date").isNotNull())


def statement_totals(rows: DataFrame) -> DataFrame:
    """Totals, closing balance (last known) and implied opening balance."""
    opening = F.min_by(F.col("balance") - F.col("credit") + F.col("debit"), "row_idx")
    return rows.groupBy("file_id").agg(
        F.sum("debit").alias("total_debits"), F.sum("credit").alias("total_credits"),
        F.max_by("balance", F.when(F.col("balance").isNotNull(), F.col("row_idx"))).alias("closing_balance"), opening.alias("opening_balance"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def records(rows: DataFrame, accepted: DataFrame, source_type: str = "bank_statement", prefix: str = "ledgerloom/statement") -> DataFrame:
    """Inflow and outflow records of reconciled rows of accepted files.

    The id is a name UUID of business, account, kind, date, amounts and text, so a
    re-delivered row gets the same id; ``occurrence_key`` tells true repeats in one file apart.
    ``accepted`` has file_id, business_id, account_reference, n_rows, and may have source_kind, which then
    tells the source type instead of ``source_type``.
    """
    j = lookup_join(rows, accepted, ["file_id"], "n_rows", how="inner").filter("reconciled")
    kind = F.when(F.col("credit") > 0, "in").when(F.col("debit") > 0, "out")
    t = lambda c: F.col(c).cast("string")
    key = F.concat_ws("/", F.lit(prefix), t("business_id"), "account_reference", kind, t("posted_date"), t("debit"), t("credit"), "description")
    is_in = F.col("kind") == "in"
    source = source_type_of(F.col("source_kind")) if "source_kind" in accepted.columns else F.lit(source_type)
    return (
        j.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
            text.name_uuid(text.URL_NAMESPACE, key).alias("record_id"), "kind", "business_id", "file_id", "row_idx",
            F.when(is_in, F.col("credit")).otherwise(F.col("debit")).alias("amount"), F.col("posted_date").alias("due_date"),
            F.col("posted_date").alias("settled_date"), text.counterparty_name(F.col("description")).alias("counterparty_name"),
            F.when(~is_in, "uncategorized").alias("category"), F.when(is_in, F.lit(False)).alias("is_receivable"), F.when(is_in, F.lit(1.0)).alias("certainty"),
            source.alias("source_type"), F.coalesce("reference", "account_reference").alias("source_reference"),
            F.concat_ws("#", "file_id", t("row_idx")).alias("occurrence_key"),
        )
    )


def ingest(lines: DataFrame, accounts: DataFrame) -> dict[str, DataFrame]:
    """Whole chain over a batch of files; a rejected file yields no records and stops nothing."""
    cells = cut_lineage(split_cells(lines, sniff_delimiters(lines)))
    names, body = body_rows(cells, locate_header(cells))
    names, body = cut_lineage(names), cut_lineage(body)
    long = long_cells(body)
    types = cut_lineage(column_types(long))
    dates = cut_lineage(choose_date_column(types, date_formats(long), names))
    cands = candidate_mappings(types, dates)
    parsed = cut_lineage(parsed_body(body))  # read for all candidates and for the chosen mapping
    reports = reconcile(residuals(parsed, cands), ["file_id", "c"])
    mapping = cut_lineage(choose_mapping(reports, header_support(cands, names)))
    chosen = residuals(parsed, mapping)
    rows = statement_rows(body, chosen, dates, descriptive_columns(types, names, dates, mapping))
    accepted = mapping.filter(~F.col("rejected")).select("file_id", "n_rows").join(accounts, "file_id")
    return {"mapping": mapping, "rows": rows, "records": records(rows, accepted), "rejected": mapping.filter("rejected")}


# --- pulls ---------------------------------------------------------------------------------


def concatenate_pages(landed: DataFrame, block_rows: int = 65_536) -> DataFrame:
    """Pages of one request as one statement: later pages lose the lines they share with page one.

    Only the leading run of equal lines is dropped; the first difference ends it, found as
    a minimum rather than by walking the page.
    """
    first = landed.filter(F.col("page_no") == 1).select("request_id", "line_no", F.col("line").alias("first_line"))
    later = landed.filter(F.col("page_no") > 1).join(first, ["request_id", "line_no"], "left")
    differs = ~F.coalesce(F.col("line") == F.col("first_line"), F.lit(False))
    cut = later.groupBy("request_id", "page_no").agg(F.min(F.when(differs, F.col("line_no"))).alias("cut"), F.count(F.lit(1)).alias("n"))
    kept = lookup_join(landed.filter(F.col("page_no") > 1), cut, ["request_id", "page_no"], "n", how="inner").filter(F.col("line_no") >= F.col("cut"))
    return landed.filter(F.col("page_no") == 1).select("request_id", "page_no", "line_no", "line").unionByName(
        kept.select("request_id", "page_no", "line_no", "line")
    )


def idempotency_key(provider: Column, business: Column, account: Column, since: Column, until: Column) -> Column:
    t = lambda c: c.cast("string")
    return F.left(F.sha2(F.concat_ws("|", provider, t(business), account, t(since), t(until)), 256), F.lit(32))


def plan_pulls(requests: DataFrame, landed_keys: DataFrame) -> DataFrame:
    """Requests with their key and whether an earlier pull already answers them."""
    done = landed_keys.select("idempotency_key").distinct().withColumn("_done", F.lit(True))
    return requests.join(done, "idempotency_key", "left").withColumn("replayed_from_cache", F.coalesce("_done", F.lit(False))).drop("_done")


def pull_status(pages: DataFrame, max_pages: int = 20) -> DataFrame:
    """Pages fetched, and INCOMPLETE when the ceiling was hit with a cursor outstanding."""
    s = pages.groupBy("request_id").agg(F.count(F.lit(1)).alias("n_pages"), F.max_by(F.struct("next_cursor"), "page_no")["next_cursor"].alias("last_cursor"))
    return s.withColumn("incomplete", (F.col("n_pages") >= max_pages) & F.col("last_cursor").isNotNull())


def source_type_of(kind: Column) -> Column:
    """Provenance by source kind: every statement source, the local one included, is a bank statement."""
    return F.when(kind.isNotNull(), F.lit("bank_statement"))
