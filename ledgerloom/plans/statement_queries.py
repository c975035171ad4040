"""Statement ingest: cells, typing, dates, mapping, reconciliation, records, pulls."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.functions.spread import widen
from ledgerloom.operators import statements
from ledgerloom.plans.base_sql import cte, twin
from ledgerloom.plans.registry import query, shown
from ledgerloom.session import cut_lineage, ensure_checkpoint_dir
from ledgerloom.sources import statement_files, tables

N4 = "', '".join(statement_files.NARRATIVES)
cte(
    "stmt",
    f"""
SELECT file_id, row_idx, event_id, posted_date, description, debit, credit,
  CAST({statement_files.OPENING_CENTS} + bal + CASE WHEN file_id % 3 = 0 AND row_idx % 41 = 40 THEN 500 ELSE 0 END AS BIGINT) AS balance FROM (
 SELECT *, row_number() OVER w - 1 AS row_idx, sum(credit - debit) OVER w AS bal FROM (
  SELECT user_id AS file_id, event_id, CAST(ts AS DATE) AS posted_date, ['{N4}'][event_id % 4 + 1] || event_id AS description,
    CASE WHEN event_type IN ('purchase', 'signup') THEN 0 ELSE CAST(round(value * 100) AS BIGINT) + 1 END AS debit,
    CASE WHEN event_type IN ('purchase', 'signup') THEN CAST(round(value * 100) AS BIGINT) + 1 ELSE 0 END AS credit FROM events)
 WINDOW w AS (PARTITION BY file_id ORDER BY event_id))
""",
)


def _money(e: str) -> str:
    return f"(CASE WHEN {e} < 0 THEN '-' ELSE '' END || (abs({e}) // 100) || '.' || lpad(CAST(abs({e}) % 100 AS VARCHAR), 2, '0'))"


# The cells each layout prints, by column number: layout -> expressions.
_CELLS = {
    0: ["strftime(posted_date, '%d/%m/%Y')", "description", "'REF' || event_id", f"CASE WHEN debit > 0 THEN {_money('debit')} ELSE '' END", f"CASE WHEN credit > 0 THEN {_money('credit')} ELSE '' END", _money("balance")],
    1: ["strftime(posted_date, '%d-%b-%Y')", "description", _money("(credit - debit)"), _money("balance")],
    2: ["strftime(posted_date, '%d/%m/%Y')", "description", _money("abs(credit - debit)"), "CASE WHEN debit > 0 THEN 'Dr' ELSE 'Cr' END", _money("balance")],
    3: ["strftime(posted_date, '%m/%d/%Y')", "description", f"CASE WHEN debit > 0 THEN '(' || {_money('debit')} || ')' ELSE {_money('credit')} END"],
    4: ["strftime(posted_date, '%Y-%m-%d')", "description", f"CASE WHEN debit > 0 THEN {_money('debit')} ELSE '' END", f"CASE WHEN credit > 0 THEN {_money('credit')} ELSE '' END", f"{_money('balance')} || ' Cr'"],
}
cte(
    "cells",
    " UNION ALL ".join(f"SELECT file_id, row_idx, {i} AS col_idx, {e} AS cell FROM stmt WHERE file_id % 5 = {k}" for k, es in _CELLS.items() for i, e in enumerate(es)),
    "stmt",
)


def amount_sql(c: str) -> str:
    """The currency-cell rules as SQL, for the twins."""
    body = rf"trim(regexp_replace(trim({c}), '^(inr|rs\.?|usd|eur|₹|\$|€)\s*', '', 'i'))"
    inner = rf"trim(CASE WHEN regexp_matches({body}, '^\(.*\)$') THEN regexp_extract({body}, '^\((.*)\)$', 1) ELSE {body} END)"
    bare = rf"replace(replace(trim(regexp_replace({inner}, '\b(cr|dr)\.?$', '', 'i')), ',', ''), ' ', '')"
    digits = rf"regexp_replace(regexp_replace({bare}, '^-', ''), '^\+', '')"
    flips = rf"(CASE WHEN regexp_matches({body}, '^\(.*\)$') THEN 1 ELSE 0 END + CASE WHEN regexp_matches({inner}, '\bdr\.?$', 'i') THEN 1 ELSE 0 END + CASE WHEN {bare} LIKE '-%' THEN 1 ELSE 0 END)"
    return rf"""CASE WHEN trim({c}) IN ('', '-', '--', 'NIL', 'nil', 'N/A') THEN NULL WHEN regexp_full_match({digits}, '-?\d+(\.\d+)?') THEN
  CASE WHEN {flips} % 2 = 1 THEN -1 ELSE 1 END * CAST({digits} AS DECIMAL(16,2)) END"""


# Currency cells in many notations, printed from order totals.
cte(
    "amount_texts",
    f"""SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN m WHEN 1 THEN '(' || m || ')' WHEN 2 THEN m || ' Dr' WHEN 3 THEN 'INR ' || m WHEN 4 THEN '-' WHEN 5 THEN 'NIL'
  WHEN 6 THEN '-' || m WHEN 7 THEN 'Rs. ' || m || ' Cr' WHEN 8 THEN m || 'x' ELSE '($' || m || ' DR.)' END AS cell
FROM (SELECT o_orderkey, (c // 100000) || ',' || lpad(CAST((c // 100) % 1000 AS VARCHAR), 3, '0') || '.' || lpad(CAST(c % 100 AS VARCHAR), 2, '0') AS m FROM (
  SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders))""",
)


def amount_texts(spark, sf):
    c = F.round(F.col("o_totalprice") * 100).cast("long")
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    m = F.concat(F.floor(c / 100000).cast("string"), F.lit(","), pad(F.floor(c / 100) % 1000, 3), F.lit("."), pad(c % 100, 2))
    forms = [m, F.concat(F.lit("("), m, F.lit(")")), F.concat(m, F.lit(" Dr")), F.concat(F.lit("INR "), m), F.lit("-"), F.lit("NIL"),
             F.concat(F.lit("-"), m), F.concat(F.lit("Rs. "), m, F.lit(" Cr")), F.concat(m, F.lit("x")), F.concat(F.lit("($"), m, F.lit(" DR.)"))]
    return tables.table(spark, sf, "orders").select("o_orderkey", F.get(F.array(*forms), (F.col("o_orderkey") % 10).cast("int")).alias("cell"))


@query("amount_cells", twin(f"SELECT o_orderkey, cell, CAST({amount_sql('cell')} AS DOUBLE) AS amount FROM amount_texts", "amount_texts"))
def amount_cells(spark, sf):
    return shown(widen(amount_texts(spark, sf)).withColumn("amount", text.parse_amount(F.col("cell"))), digits=2)


def lines(spark, sf):
    return statement_files.statement_lines(statement_files.event_rows(spark, sf))


def parsed(spark, sf):
    """Cells, header and body of every statement printed from the event log."""
    li = cut_lineage(lines(spark, sf))
    cells = cut_lineage(statements.split_cells(li, statements.sniff_delimiters(li)))
    heads = statements.locate_header(cells)
    names, body = statements.body_rows(cells, heads)
    return li, heads, cut_lineage(names), cut_lineage(body)


@query(
    "delimiter_sniff",
    twin("SELECT DISTINCT file_id, CASE file_id % 5 WHEN 1 THEN ';' WHEN 2 THEN '|' WHEN 3 THEN chr(9) ELSE ',' END AS delimiter FROM stmt", "stmt"),
)
def delimiter_sniff(spark, sf):
    return statements.sniff_delimiters(lines(spark, sf))


# Descriptions as they are meant, and their cells, of the files that quoted_lines prints.
_D = "CASE file_id % 4 WHEN 0 THEN ',' WHEN 1 THEN ';' WHEN 2 THEN chr(9) ELSE '|' END"
_NOTE = f"""CASE event_id % 6 WHEN 0 THEN description WHEN 1 THEN description || {_D} || ' paid' WHEN 2 THEN description || chr(10) || 'REF' WHEN 3 THEN 'say "' || description || '" twice'
  WHEN 4 THEN description || ' 5" pipe' ELSE chr(13) || chr(10) || description || chr(10) || chr(10) || 'end' END"""


@query(
    "quoted_statement_files",
    twin(
        f"""SELECT file_id, row_idx + 1 AS line_no, 3::BIGINT AS n_cells, strftime(posted_date, '%Y-%m-%d') AS first_cell, {_NOTE} AS second_cell, {_money('(credit - debit)')} AS third_cell FROM stmt
UNION ALL SELECT DISTINCT file_id, 0, 3::BIGINT, 'Date', 'Description', 'Amount' FROM stmt""",
        "stmt",
    ),
)
def quoted_statement_files(spark, sf):
    """Files with line breaks inside quotes, written from the event log and read back by byte ranges."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/statements-{uuid.uuid4().hex}"
    statement_files.write_files(statement_files.quoted_lines(statement_files.event_rows(spark, sf)), path)
    li, _ = statement_files.read_statement_folder(spark, path)
    li = cut_lineage(li.withColumn("file_id", F.regexp_extract("file_id", r"file_id=(\d+)/", 1).cast("long")))
    cells = statements.split_cells(li, statements.sniff_delimiters(li))
    return cells.select("file_id", "line_no", F.size("cells").cast("long").alias("n_cells"), *[F.get("cells", F.lit(k)).alias(f"{n}_cell") for k, n in enumerate(("first", "second", "third"))])


@query(
    "header_location",
    twin("SELECT DISTINCT file_id, CASE WHEN file_id % 5 = 4 THEN 3::BIGINT ELSE 0 END AS header_line FROM stmt", "stmt"),
)
def header_location(spark, sf):
    li = cut_lineage(lines(spark, sf))
    cells = cut_lineage(statements.split_cells(li, statements.sniff_delimiters(li)))
    return shown(statements.locate_header(cells).select("file_id", "header_line"))


@query("statement_cells", twin("SELECT file_id, row_idx, CAST(col_idx AS BIGINT) AS col_idx, cell FROM cells", "cells"))
def statement_cells(spark, sf):
    return shown(statements.long_cells(parsed(spark, sf)[3]))


@query(
    "encoding_fallback",
    r"""SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND NOT wide AND regexp_matches(text, '[^\x00-\x7F]') THEN 'latin-1' ELSE 'utf-8' END AS encoding, md5(text) AS text_hash
FROM (SELECT doc_id, text, regexp_matches(text, '[^\x{0000}-\x{00FF}]') AS wide FROM documents)""",
)
def encoding_fallback(spark, sf):
    d = tables.table(spark, sf, "documents").select("doc_id", "text")
    narrow = ~F.col("text").rlike(r"[^\x{0000}-\x{00FF}]")
    content = F.when((F.col("doc_id") % 2 == 0) & narrow, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    decoded, encoding = statement_files.decode_bytes(F.col("content"))
    return d.select("doc_id", content.alias("content")).select("doc_id", encoding.alias("encoding"), F.md5(F.encode(decoded, "UTF-8")).alias("text_hash"))


cte(
    "col_types",
    f"""SELECT file_id, col_idx, n_rows, CASE WHEN n_filled > 0 THEN n_num / n_filled::DOUBLE ELSE 0 END AS nf, n_filled / n_rows::DOUBLE AS ff, ind, n_num = n_rows AS full_col FROM (
  SELECT file_id, col_idx, count(*) AS n_rows, count(*) FILTER (WHERE trim(cell) <> '') AS n_filled, count({amount_sql('cell')}) AS n_num,
    coalesce(bool_and(lower(trim(cell)) IN ('dr', 'cr', 'd', 'c', 'debit', 'credit', 'db')) FILTER (WHERE trim(cell) <> ''), FALSE) AS ind FROM cells GROUP BY 1, 2)""",
    "cells",
)


@query(
    "column_typing",
    twin(
        """SELECT file_id, CAST(col_idx AS BIGINT) AS col_idx, n_rows, round(nf, 6) AS numeric_fraction, round(ff, 6) AS fill_fraction, ind AS is_indicator, full_col AS is_complete,
  nf > 0.95 AND ff > 0 AND NOT ind AS is_numeric FROM col_types""",
        "col_types",
    ),
)
def column_typing(spark, sf):
    return shown(statements.column_types(statements.long_cells(parsed(spark, sf)[3])))


_FMT = [("year-month-day", "%Y-%m-%d"), ("year/month/day", "%Y/%m/%d"), ("day-mon-year", "%d-%b-%Y"), ("day mon year", "%d %b %Y"), ("day-monthname-year", "%d-%B-%Y"), ("day/month/year", "%d/%m/%Y"), ("month/day/year", "%m/%d/%Y"),
        ("day-month-year", "%d-%m-%Y"), ("month-day-year", "%m-%d-%Y"), ("day/month/yy", "%d/%m/%y"), ("month/day/yy", "%m/%d/%y")]
cte(
    "formats",
    """SELECT file_id, col_idx, no, fmt, bool_and(coalesce(d >= p, TRUE)) AS ordered FROM (
  SELECT file_id, col_idx, no, fmt, d, lag(d) OVER (PARTITION BY file_id, col_idx, no ORDER BY row_idx) AS p FROM ("""
    + " UNION ALL ".join(f"SELECT file_id, col_idx, row_idx, {i} AS no, '{n}' AS fmt, try_strptime(trim(cell), '{p}') AS d FROM cells WHERE trim(cell) <> ''" for i, (n, p) in enumerate(_FMT))
    + """)) GROUP BY 1, 2, 3, 4 HAVING count(d) = count(*)""",
    "cells",
)
cte(
    "dates",
    """SELECT file_id, col_idx, fmt AS date_format, ordered AS is_ordered, (SELECT min(o.fmt) FROM formats o WHERE o.file_id = x.file_id AND o.col_idx = x.col_idx AND o.ordered = x.ordered AND
    ((x.fmt = 'day/month/year' AND o.fmt = 'month/day/year') OR (x.fmt = 'month/day/year' AND o.fmt = 'day/month/year') OR (x.fmt = 'day-month-year' AND o.fmt = 'month-day-year') OR (x.fmt = 'month-day-year' AND o.fmt = 'day-month-year')
     OR (x.fmt = 'day/month/yy' AND o.fmt = 'month/day/yy') OR (x.fmt = 'month/day/yy' AND o.fmt = 'day/month/yy'))) AS ambiguous_with
FROM (SELECT *, row_number() OVER (PARTITION BY file_id, col_idx ORDER BY NOT ordered, no) AS rn FROM formats) x WHERE rn = 1""",
    "formats",
)


@query("date_format_inference", twin("SELECT file_id, CAST(col_idx AS BIGINT) AS col_idx, date_format, is_ordered, ambiguous_with FROM dates", "dates"))
def date_format_inference(spark, sf):
    return shown(statements.date_formats(statements.long_cells(parsed(spark, sf)[3])))


cte(
    "cands",
    """
SELECT n.file_id, n.bal, c.convention, c.debit, c.credit, c.amount, c.indicator FROM (
  SELECT f.file_id, b.col_idx AS bal FROM (SELECT DISTINCT file_id FROM col_types) f
  LEFT JOIN (SELECT file_id, col_idx FROM col_types WHERE col_idx > 0 AND nf > 0.95 AND ff > 0 AND NOT ind AND full_col
    AND file_id IN (SELECT file_id FROM nums GROUP BY 1 HAVING count(*) > 1)) b ON b.file_id = f.file_id) n
JOIN (SELECT a.file_id, 'separate_debit_credit' AS convention, a.col_idx AS debit, b.col_idx AS credit, NULL AS amount, NULL AS indicator
      FROM nums a JOIN nums b ON a.file_id = b.file_id AND a.col_idx <> b.col_idx
      UNION ALL SELECT file_id, 'signed_single_column', NULL, NULL, col_idx, NULL FROM nums
      UNION ALL SELECT a.file_id, 'amount_with_indicator', NULL, NULL, a.col_idx, i.col_idx FROM nums a JOIN col_types i ON i.file_id = a.file_id AND i.ind) c
ON c.file_id = n.file_id AND (n.bal IS NULL OR (coalesce(c.debit, -1) <> n.bal AND coalesce(c.credit, -1) <> n.bal AND coalesce(c.amount, -1) <> n.bal))
""",
    "col_types",
    "nums",
)
cte("nums", "SELECT file_id, col_idx FROM col_types WHERE col_idx > 0 AND nf > 0.95 AND ff > 0 AND NOT ind", "col_types")


@query(
    "mapping_candidates",
    twin(
        """SELECT file_id, convention, CAST(debit AS BIGINT) AS debit, CAST(credit AS BIGINT) AS credit, CAST(amount AS BIGINT) AS amount, CAST(indicator AS BIGINT) AS indicator,
  CAST(bal AS BIGINT) AS bal FROM cands""",
        "cands",
    ),
)
def mapping_candidates(spark, sf):
    _, _, names, body = parsed(spark, sf)
    long = statements.long_cells(body)
    types = statements.column_types(long)
    dates = statements.choose_date_column(types, statements.date_formats(long), names)
    return shown(statements.candidate_mappings(types, dates).drop("n_rows"))


def searched(spark, sf):
    li, _, names, body = parsed(spark, sf)
    long = statements.long_cells(body)
    types = cut_lineage(statements.column_types(long))
    dates = cut_lineage(statements.choose_date_column(types, statements.date_formats(long), names))
    cands = statements.candidate_mappings(types, dates)
    rows = cut_lineage(statements.parsed_body(body))
    reports = statements.reconcile(statements.residuals(rows, cands), ["file_id", "c"])
    mapping = cut_lineage(statements.choose_mapping(reports, statements.header_support(cands, names)))
    return names, body, types, dates, rows, mapping


# The layout each file was printed in says which mapping the search must find.
@query(
    "mapping_choice",
    twin(
        """SELECT file_id, CASE WHEN file_id % 5 IN (0, 4) THEN 'separate_debit_credit' WHEN file_id % 5 = 2 THEN 'amount_with_indicator' ELSE 'signed_single_column' END AS convention,
  CASE file_id % 5 WHEN 0 THEN 3::BIGINT WHEN 4 THEN 2 END AS debit, CASE file_id % 5 WHEN 0 THEN 4::BIGINT WHEN 4 THEN 3 END AS credit,
  CASE file_id % 5 WHEN 1 THEN 2::BIGINT WHEN 2 THEN 2 WHEN 3 THEN 2 END AS amount, CASE file_id % 5 WHEN 2 THEN 3::BIGINT END AS indicator,
  CASE file_id % 5 WHEN 0 THEN 5::BIGINT WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 4 THEN 4 END AS bal, file_id % 5 <> 3 AND max(row_idx) >= 40 AND file_id % 3 = 0 AS rejected
FROM stmt GROUP BY 1""",
        "stmt",
    ),
)
def mapping_choice(spark, sf):
    return shown(searched(spark, sf)[5].select("file_id", "convention", "debit", "credit", "amount", "indicator", "bal", "rejected"))


cte(
    "resid_rows",
    """SELECT *, abs(lag(balance) OVER w + credit - debit - balance) AS r FROM stmt WINDOW w AS (PARTITION BY file_id ORDER BY row_idx)""",
    "stmt",
)
RECON = """SELECT file_id, count(*) AS n_rows, TRUE AS checkable, count(*) FILTER (WHERE r > 1.1) = 0 AND count(r) > 0 AS passed, count(*) - count(*) FILTER (WHERE r > 1.1) AS n_reconciled,
  coalesce(max(r), 0) / 100.0::DOUBLE AS max_residual, round(coalesce(avg(r), 0) / 100, 6) AS mean_residual, count(*) FILTER (WHERE debit + credit > 0) / count(*) > 0.5 AS moves,
  CASE WHEN count(*) FILTER (WHERE r > 1.1) = 0 OR count(r) = 0 THEN NULL WHEN count(*) FILTER (WHERE abs(r - 2 * (debit + credit)) <= greatest(1.1, 0.01 * (debit + credit))) > 0.8 * count(r) THEN 'inverted direction'
    WHEN count(*) FILTER (WHERE r > 1.1) <= greatest(2, count(r) // 20) THEN 'localized bad cell' WHEN bool_and(coalesce(r >= pr - 1.1, TRUE)) THEN 'missing row' ELSE 'unknown cause' END AS diagnosis,
  count(*) FILTER (WHERE r > 1.1) = 1 AS single_gap
FROM (SELECT *, lag(r) OVER (PARTITION BY file_id ORDER BY row_idx) AS pr FROM {t}) GROUP BY 1"""


def typed_residuals(spark, sf, swap: bool = False):
    """Residuals of the printed rows under their true columns, or with debit and credit swapped."""
    from ledgerloom.functions.spread import previous_rows

    rows = statement_files.event_rows(spark, sf)
    if swap:
        rows = rows.select("file_id", "row_idx", "balance", F.col("debit").alias("credit"), F.col("credit").alias("debit"))
    r = previous_rows(rows, ["file_id"], "row_idx", ["balance", "debit", "credit"], depth=2)
    res = lambda b0, b1, c, d: F.abs(F.col(b1) + F.col(c) - F.col(d) - F.col(b0))
    return r.withColumn("residual", res("balance", "prev1_balance", "credit", "debit")).withColumn(
        "prev_residual", res("prev1_balance", "prev2_balance", "prev1_credit", "prev1_debit")
    )


@query("statement_reconcile", twin(RECON.format(t="resid_rows"), "resid_rows"))
def statement_reconcile(spark, sf):
    return shown(statements.reconcile(typed_residuals(spark, sf), ["file_id"]))


cte(
    "swapped_rows",
    """SELECT file_id, row_idx, balance, credit AS debit, debit AS credit, abs(lag(balance) OVER (PARTITION BY file_id ORDER BY row_idx) + debit - credit - balance) AS r FROM stmt""",
    "stmt",
)


@query("statement_diagnosis", twin(RECON.format(t="swapped_rows"), "swapped_rows"))
def statement_diagnosis(spark, sf):
    return shown(statements.reconcile(typed_residuals(spark, sf, swap=True), ["file_id"]))


@query(
    "statement_failing_rows",
    twin(
        "SELECT file_id, CAST(row_idx AS BIGINT) AS row_idx FROM resid_rows WHERE r > 1.1",
        "resid_rows",
    ),
)
def statement_failing_rows(spark, sf):
    return statements.failing_rows(typed_residuals(spark, sf)).select("file_id", F.col("row_idx").cast("long").alias("row_idx"))


def chosen_rows(spark, sf):
    names, body, types, dates, rows, mapping = searched(spark, sf)
    desc = statements.descriptive_columns(types, names, dates, mapping)
    return statements.statement_rows(body, statements.residuals(rows, mapping), dates, desc), mapping, names, dates, desc


@query(
    "statement_totals",
    twin(
        """SELECT file_id, CAST(sum(debit) AS BIGINT) / 100.0::DOUBLE AS total_debits, CAST(sum(credit) AS BIGINT) / 100.0::DOUBLE AS total_credits,
  CASE WHEN file_id % 5 <> 3 THEN arg_max(balance, row_idx) / 100.0::DOUBLE END AS closing_balance,
  CASE WHEN file_id % 5 <> 3 THEN arg_min(balance - credit + debit, row_idx) / 100.0::DOUBLE END AS opening_balance, count(*) AS n_rows FROM stmt GROUP BY 1""",
        "stmt",
    ),
)
def statement_totals(spark, sf):
    return shown(statements.statement_totals(chosen_rows(spark, sf)[0]), digits=2)


cte(
    "good_rows",
    """SELECT s.* FROM resid_rows s JOIN (SELECT file_id, max(row_idx) AS last FROM stmt GROUP BY 1) m ON m.file_id = s.file_id
WHERE NOT (s.file_id % 5 <> 3 AND m.last >= 40 AND s.file_id % 3 = 0)""",
    "resid_rows",
)


STATEMENT_RECORDS = r"""SELECT lower(substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)) AS record_id,
  kind, file_id % 25 AS business_id, file_id, row_idx, (debit + credit) / 100.0::DOUBLE AS amount, CAST(posted_date AS VARCHAR) AS settled_date, name AS counterparty_name,
  CASE WHEN kind = 'out' THEN 'uncategorized' END AS category, 'bank_statement' AS source_type
FROM (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('ledgerloom/statement/' || (file_id % 25) || '/ACC-' || file_id || '/' || kind || '/' || posted_date || '/' ||
    printf('%.2f', debit / 100.0::DOUBLE) || '/' || printf('%.2f', credit / 100.0::DOUBLE) || '/' || description)) AS h FROM (
  SELECT *, CASE WHEN credit > 0 THEN 'in' ELSE 'out' END AS kind, CASE event_id % 4 WHEN 0 THEN 'Acme Supplies' WHEN 1 THEN 'Orion Textiles' WHEN 2 THEN 'UNKNOWN' ELSE 'Blue Lake Traders' END AS name FROM good_rows))"""


def statement_record_rows(spark, sf):
    rows, mapping, *_ = chosen_rows(spark, sf)
    accounts = mapping.filter(~F.col("rejected")).select(
        "file_id", "n_rows", (F.col("file_id") % 25).alias("business_id"), F.concat(F.lit("ACC-"), F.col("file_id").cast("string")).alias("account_reference"),
        F.when(F.col("file_id") % 2 == 0, "local").otherwise("aggregator").alias("source_kind"),
    )
    return statements.records(rows, accounts)


@query(
    "statement_records",
    twin(
        STATEMENT_RECORDS,
        "good_rows",
    ),
)
def statement_records(spark, sf):
    r = statement_record_rows(spark, sf)
    return shown(r.select("record_id", "kind", "business_id", "file_id", "row_idx", "amount", "settled_date", "counterparty_name", "category", "source_type"), digits=2)


@query("column_roles")
def column_roles(spark, sf):
    _, mapping, names, dates, desc = chosen_rows(spark, sf)
    return shown(statements.column_roles(names, dates, mapping, desc))


@query("statement_ingest")
def statement_ingest(spark, sf):
    li = cut_lineage(lines(spark, sf))
    accounts = li.select("file_id").distinct().select(
        "file_id", (F.col("file_id") % 25).alias("business_id"), F.concat(F.lit("ACC-"), F.col("file_id").cast("string")).alias("account_reference")
    )
    return shown(statements.ingest(li, accounts)["records"].drop("occurrence_key"))


cte("narr", "SELECT event_id, ['" + N4 + "'][event_id % 4 + 1] || event_id AS narrative, event_id % 4 AS k FROM events")


@query(
    "narrative_counterparty",
    twin(
        """SELECT event_id, narrative, CASE k WHEN 0 THEN 'Acme Supplies' WHEN 1 THEN 'Orion Textiles' WHEN 2 THEN 'UNKNOWN' ELSE 'Blue Lake Traders' END AS counterparty_name FROM narr""",
        "narr",
    ),
)
def narrative_counterparty(spark, sf):
    n = F.concat(F.get(F.array(*[F.lit(x) for x in statement_files.NARRATIVES]), (F.col("event_id") % 4).cast("int")), F.col("event_id").cast("string"))
    return tables.table(spark, sf, "events").select("event_id", n.alias("narrative")).withColumn("counterparty_name", text.counterparty_name(F.col("narrative")))


# Pulls: a request is a user, pages hold 25 events each and repeat three header lines.
cte(
    "landed",
    """SELECT user_id AS request_id, page_no, line_no, line FROM (
  SELECT user_id, rn // 25 + 1 AS page_no, rn % 25 + 3 AS line_no, 'row ' || event_id AS line FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn FROM events)
  UNION ALL SELECT user_id, page_no, h, 'head ' || h FROM (SELECT DISTINCT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 25 + 1 AS page_no FROM events) CROSS JOIN (SELECT unnest([0, 1, 2]) AS h))""",
)


def landed(spark, sf):
    from ledgerloom.functions.spread import running_totals

    e = running_totals(tables.table(spark, sf, "events").select("user_id", "event_id"), ["user_id"], [], "event_id", {"rn": F.lit(1)}, inclusive=False)
    page = (F.floor(F.col("rn") / 25) + 1).alias("page_no")
    data = e.select(F.col("user_id").alias("request_id"), page, (F.col("rn") % 25 + 3).alias("line_no"), F.concat(F.lit("row "), F.col("event_id").cast("string")).alias("line"))
    heads = data.select("request_id", "page_no").distinct().withColumn("line_no", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])))
    return data.unionByName(heads.withColumn("line", F.concat(F.lit("head "), F.col("line_no").cast("string"))))


@query("page_concat", twin("SELECT request_id, page_no, line_no, line FROM landed WHERE page_no = 1 OR line_no >= 3", "landed"))
def page_concat(spark, sf):
    return shown(statements.concatenate_pages(landed(spark, sf)))


@query(
    "pull_status",
    twin(
        """SELECT request_id, count(*) AS n_pages, CASE WHEN count(*) < 2 THEN NULL WHEN request_id % 2 = 0 THEN 'c' || count(*) END AS last_cursor, count(*) >= 2 AND request_id % 2 = 0 AS incomplete
FROM (SELECT DISTINCT request_id, page_no FROM landed) GROUP BY 1""",
        "landed",
    ),
)
def pull_status(spark, sf):
    """Even requests still hold a cursor on every page after the first; the ceiling here is two pages."""
    p = landed(spark, sf).select("request_id", "page_no").distinct()
    more = (F.col("request_id") % 2 == 0) & (F.col("page_no") >= 2)
    pages = p.withColumn("next_cursor", F.when(more, F.concat(F.lit("c"), F.col("page_no").cast("string"))))
    return shown(statements.pull_status(pages, max_pages=2))


@query(
    "idempotent_pull",
    """SELECT user_id, CAST(d AS VARCHAR) AS since, left(sha256('bank|' || (user_id % 25) || '|ACC-' || user_id || '|' || d || '|' || (d + 7)), 32) AS idempotency_key, day(d) < 15 AS replayed_from_cache
FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) AS d FROM events)""",
)
def idempotent_pull(spark, sf):
    since = F.col("since")
    r = tables.table(spark, sf, "events").select("user_id", F.col("ts").cast("date").alias("since")).distinct()
    key = statements.idempotency_key(F.lit("bank"), F.col("user_id") % 25, F.concat(F.lit("ACC-"), F.col("user_id").cast("string")), since, F.date_add(since, 7))
    r = r.withColumn("idempotency_key", key)
    done = r.filter(F.dayofmonth("since") < 15).select("idempotency_key")
    return shown(statements.plan_pulls(r, done))
