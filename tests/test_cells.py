"""Cells of statements: amounts, dates and headers read with little work for each."""

from decimal import Decimal

from pyspark.sql import functions as F

from ledgerloom.functions import similarity, text
from ledgerloom.operators import statements

AMOUNTS = {
    "12": "12.00", "-5.5": "-5.50", "1.005": "1.01", "-1.005": "-1.01", "1,23,456.70": "123456.70", "₹ 1,000 Dr": "-1000.00", "Rs. 7 Cr": "7.00", "(12.50)": "-12.50",
    "($5 DR.)": None, "(5 dr.)": "5.00", "-(5)": None, "- 5": "-5.00", "+5": "5.00", "-+5": "-5.00", " 8 ": "8.00", "5\n": "5.00", "(5)\n": "-5.00", "12 cr.\n": "12.00", "5 cr cr": None,
    "": None, "-": None, "NIL": None, "N/A": None, ".5": None, "1.": None, "2024-03-05": None, "05/03/2024": None, "NEFT 12": None, "9" * 30: None, None: None,
}


def test_amounts(spark):
    d = spark.createDataFrame([*AMOUNTS.items()], "cell string, want string").withColumn("got", text.parse_amount(F.col("cell")))
    assert {r.cell: r.got for r in d.collect()} == {k: None if v is None else Decimal(v) for k, v in AMOUNTS.items()}


def test_an_amount_takes_each_pattern_once(spark):
    d = spark.createDataFrame([("1",)], "cell string").select(text.parse_amount(F.col("cell")).alias("a"))
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 4


def test_no_date_is_missed(spark):
    cells = ["2024-1-5", " 05/03/2024 ", "1/2/24", "5-Mar-2024", "5 Mar 2024", "05-March-2024", "2024/01/05", "31-12-2024", "REF5", "12.50", "Acme 12/03/2024"]
    d = spark.createDataFrame([(c,) for c in cells], "cell string")
    read = F.coalesce(*[text.parse_date(F.col("cell"), p, s) for _, p, s in text.DATE_FORMATS])
    rows = d.select("cell", read.isNotNull().alias("date"), text.may_be_date(F.col("cell")).alias("may")).collect()
    assert [r.cell for r in rows if r.date] == cells[:8] and all(r.may for r in rows if r.date)
    assert [r.cell for r in rows if not r.may] == cells[8:]


def test_headers_are_scored_by_shape(spark, monkeypatch):
    """Cells that differ in their digits alone are scored once, with the scores they have by themselves."""
    cells = [f"NEFT DR INV{k}" for k in range(10, 60)] + [f"{k}.{k}" for k in range(10, 60)] + ["Ref No. 7", "Date", "ſ-1 debit", "(dr) 5"]
    d = spark.createDataFrame([(c,) for c in cells], "cell string").withColumn("shape", similarity.header_shape("cell"))
    for r in d.collect():
        assert similarity.hint_score(r["cell"], tuple(similarity.MEASURES)) == similarity.hint_score(r["shape"], tuple(similarity.MEASURES))
    assert d.select("shape").distinct().count() == 6
    rows = [(1, 0, ["Date", "Narration", "Amount"]), *[(1, k, [f"0{k}/01/2024", f"NEFT DR INV{k}", f"{k}.50"]) for k in range(1, 9)]]
    asked = []
    score = similarity.header_vocabulary
    monkeypatch.setattr(similarity, "header_vocabulary", lambda c: asked.append(c) or score(c))
    head = statements.locate_header(spark.createDataFrame(rows, "file_id long, line_no long, cells array<string>")).collect()
    assert [r.header_line for r in head] == [0] and asked == ["shape"]
