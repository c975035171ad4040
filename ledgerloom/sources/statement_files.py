"""Statement sources: files in a folder, or statement lines laid out from the event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.spread import running_totals
from ledgerloom.session import cut_lineage
from ledgerloom.sources import csv_records
from ledgerloom.sources.csv_records import BOM
from ledgerloom.sources.tables import table

OPENING_CENTS = 1_000_000

# Header line and cell separator of each layout (fixed values).
LAYOUTS = (
    ("Txn Date,Narration,Cheque/Ref No,Debit,Credit,Balance", ","),
    ("Date;Description;Amount;Running Balance", ";"),
    ("Value Date|Particulars|Amount|Dr/Cr|Balance", "|"),
    ("Posted Date\tMemo\tAmount", "\t"),
    ("Date,Transaction Details,Withdrawal (Dr),Deposit (Cr),Closing Balance", ","),
)
PREAMBLE = ("Account Statement", "Account No 000123", "Currency INR")
NARRATIVES = ("NEFT DR ACME SUPPLIES INV", "UPI/P2M/ORION TEXTILES/CR/", "GST CHALLAN ", "IMPS REF BLUE LAKE TRADERS TXN")


def decode_bytes(content: Column) -> tuple[Column, Column]:
    """(text, encoding): UTF-8 when valid, Latin-1 otherwise; a byte-order mark is dropped."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    raw = F.when(utf8, F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(raw, f"^{BOM}", ""), F.when(utf8, "utf-8").otherwise("latin-1")


def read_statement_folder(spark: SparkSession, path: str, record_chars: int = csv_records.RECORD_CHARS) -> tuple[DataFrame, DataFrame]:
    """Records (file_id, line_no, line, encoding) of every file in a folder, and the files refused with the reason.

    Files are split by byte ranges, so one may be of any size; a record may hold line breaks inside quotes.
    Blank lines have a number and no row.  Empty files and files with a quoted record of more than
    ``record_chars`` characters are refused.
    """
    from ledgerloom.operators.statements import HEAD_CHARS, sniff_delimiters

    lines = cut_lineage(csv_records.physical_lines(spark, path))
    # A head line has at least its line end, so more lines than characters are never needed.
    nth = F.row_number().over(Window.partitionBy("file_id").orderBy("seq"))
    head = lines.filter("block = 0").withColumn("nth", nth).filter(F.col("nth") <= HEAD_CHARS).select("file_id", (F.col("nth") - 1).alias("line_no"), "line")
    found, long = csv_records.records(lines, sniff_delimiters(head), record_chars)
    long = cut_lineage(long)
    # The scan skips zero-byte files, so they are found as listed paths that were not read.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    listed = spark.createDataFrame([(p,) for p in files.inputFiles()], "file_id string")
    short = lambda c: F.regexp_replace(c, "^([a-z0-9]+:)/+", "$1/")
    read = lines.select(short("file_id").alias("_p")).distinct()
    empty = listed.withColumn("_p", short("file_id")).join(read, "_p", "left_anti").select("file_id", F.lit("empty upload").alias("reject_reason"))
    kept = found.join(long.select("file_id"), "file_id", "left_anti")
    return kept.filter((F.col("line") != "") | (F.col("line_no") == 0)), empty.unionByName(long)


def quoted_lines(rows: DataFrame) -> DataFrame:
    """Rows printed as date, description and amount, the delimiter by file; descriptions hold delimiters, line
    breaks and doubled quotes inside quotes, or a quote as an ordinary character."""
    d = F.get(F.array(*[F.lit(x) for x in csv_records.DELIMITERS]), (F.col("file_id") % 4).cast("int"))
    t, k = F.col("description"), F.col("event_id") % 6
    note = (
        F.when(k == 0, t).when(k == 1, F.concat(F.lit('"'), t, d, F.lit(' paid"'))).when(k == 2, F.concat(F.lit('"'), t, F.lit('\nREF"')))
        .when(k == 3, F.concat(F.lit('"say ""'), t, F.lit('"" twice"'))).when(k == 4, F.concat(t, F.lit(' 5" pipe'))).otherwise(F.concat(F.lit('"\r\n'), t, F.lit('\n\nend"')))
    )
    day = F.date_format("posted_date", "yyyy-MM-dd")
    body = rows.select("file_id", "row_idx", F.concat(day, d, note, d, money_text(F.col("credit") - F.col("debit"))).alias("value"))
    heads = rows.filter("row_idx = 0").select("file_id", F.lit(-1).cast("long").alias("row_idx"), F.concat(F.lit("Date"), d, F.lit("Description"), d, F.lit("Amount")).alias("value"))
    return body.unionByName(heads)


def write_files(lines: DataFrame, path: str) -> None:
    """Text files of (file_id, row_idx, value), a folder for each file_id."""
    lines.repartition("file_id").sortWithinPartitions("file_id", "row_idx").select("file_id", "value").write.partitionBy("file_id").text(path)


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One statement row per event: file = user, credit for purchases and sign-ups, running balance.

    Every 41st row of every third user carries a wrong balance, so that some files fail.
    """
    e = table(spark, sf_dir, "events")
    cents = F.round(F.col("value") * 100).cast("long") + 1
    credit = F.col("event_type").isin("purchase", "signup")
    base = e.select(
        F.col("user_id").alias("file_id"), "event_id", F.col("ts").cast("date").alias("posted_date"),
        F.when(credit, cents).otherwise(0).alias("credit"), F.when(credit, 0).otherwise(cents).alias("debit"),
        F.concat(F.get(F.array(*[F.lit(n) for n in NARRATIVES]), (F.col("event_id") % 4).cast("int")), F.col("event_id").cast("string")).alias("description"),
    )
    run = running_totals(base, ["file_id"], [], "event_id", {"n": F.lit(1), "moved": F.col("credit") - F.col("debit")})
    wrong = (F.col("file_id") % 3 == 0) & ((F.col("n") - 1) % 41 == 40)
    return run.select(
        "file_id", (F.col("n") - 1).alias("row_idx"), "event_id", "posted_date", "description", "debit", "credit",
        (OPENING_CENTS + F.col("moved") + F.when(wrong, 500).otherwise(0)).alias("balance"),
    )


def money_text(cents: Column) -> Column:
    c = F.abs(cents)
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.floor(c / 100).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0"))


def statement_lines(rows: DataFrame) -> DataFrame:
    """Rows printed in one of five bank layouts, with header and preamble lines."""
    layout = F.col("file_id") % 5
    day = lambda f: F.date_format("posted_date", f)
    blank = lambda c: F.when(F.col(c) > 0, money_text(F.col(c))).otherwise("")
    moved = F.col("credit") - F.col("debit")
    bracketed = F.when(moved < 0, F.concat(F.lit("("), money_text(-moved), F.lit(")"))).otherwise(money_text(moved))
    bal = money_text(F.col("balance"))
    line = (
        F.when(layout == 0, F.concat_ws(",", day("dd/MM/yyyy"), "description", F.concat(F.lit("REF"), F.col("event_id").cast("string")), blank("debit"), blank("credit"), bal))
        .when(layout == 1, F.concat_ws(";", day("dd-MMM-yyyy"), "description", money_text(moved), bal))
        .when(layout == 2, F.concat_ws("|", day("dd/MM/yyyy"), "description", money_text(F.abs(moved)), F.when(moved < 0, "Dr").otherwise("Cr"), bal))
        .when(layout == 3, F.concat_ws("\t", day("MM/dd/yyyy"), "description", bracketed))
        .otherwise(F.concat_ws(",", day("yyyy-MM-dd"), "description", blank("debit"), blank("credit"), F.concat(bal, F.lit(" Cr"))))
    )
    top = F.when(layout == 4, 1 + len(PREAMBLE)).otherwise(1)
    data = rows.select("file_id", (F.col("row_idx") + top).alias("line_no"), line.alias("line"))
    files = rows.filter(F.col("row_idx") == 0).select("file_id", layout.alias("k"))
    header = F.get(F.array(*[F.lit(h) for h, _ in LAYOUTS]), F.col("k").cast("int"))
    heads = F.when(F.col("k") == 4, F.array(*[F.lit(p) for p in PREAMBLE], header)).otherwise(F.array(header))
    printed = files.select("file_id", F.posexplode(heads).alias("line_no", "line"))
    return data.unionByName(printed.withColumn("line_no", F.col("line_no").cast("long")))
