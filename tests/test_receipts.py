"""Receipts: pages that move once, amounts and fields against plain readings."""

import random
import re
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import documents

SF = "/root/testdata/sf0.001"


def plain_amount(line):
    found = []
    for t in (line, line.translate(str.maketrans(text.GLYPHS_FROM, text.GLYPHS_TO))):
        for run in re.findall(r"(\d[\d.,\s]*\d)", t, re.ASCII):
            groups = re.findall(r"\d+", run)
            digits = "".join(groups)
            if len(digits) < 3:
                continue
            if "." in run:
                head, tail = run.rsplit(".", 1)
                value = re.sub(r"\D", "", head) + "." + re.sub(r"\D", "", tail)
            elif len(groups) > 1 and len(groups[-1]) == 2 and len(groups[0]) <= 3 and all(len(g) == 3 for g in groups[1:-1]):
                value = "".join(groups[:-1]) + "." + groups[-1]
            else:
                value = digits
            try:
                if (v := Decimal(value).quantize(Decimal("0.01"), ROUND_HALF_UP)) > 0:
                    found.append((len(digits), v))
            except InvalidOperation:
                pass
    return max(found)[1] if found else None


def test_amounts_of_lines(spark):
    rnd = random.Random(5)
    marks = [*"0123456789" * 2, *".,  ", "O", "l", "S", "x", "-", "\t"]
    lines = ["", "TOTAL INR 123 456 78", "000", "0.00 12 345.60", "1.234.56", "7 l2", "GST 9,99", "O.OO1"] + ["".join(rnd.choice(marks) for _ in range(rnd.randint(1, 14))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, line string").withColumn("runs", text.digit_runs(F.col("line")))
    got = rows.withColumn("one", text.noisy_amount(F.col("line"))).withColumn("v", text.amount_of_runs(F.col("runs"))).withColumn("two", F.when(F.col("v") > 0, F.col("v"))).collect()
    for r in got:
        assert r.one == r.two == plain_amount(r.line), r.line


def test_pages_do_not_move_again(spark):
    from ledgerloom.plans import document_queries

    for frame in (document_queries.receipt_fields(spark, SF), document_queries.receipt_review(spark, SF)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "Window" not in plan


def test_a_tilted_page_with_values_below_their_labels(spark):
    def page(doc, lines, angle=0.0):
        return [(doc, n, t, c, x, y, x + 50.0, y + 20.0, angle) for n, (t, c, x, y) in enumerate(lines)]

    rows = page(1, [("B", 0.5, 200.0, 11.0), ("A", 0.9, 10.0, 10.0), (None, 0.7, 400.0, 12.0), ("below", None, 10.0, 60.0)])
    rows += page(2, [("Acme Goods", 0.9, 0.0, 0.0), ("GSTIN: 22AAAAA0000A1Z5", 0.9, 0.0, 40.0), ("TOTAL", 0.6, 0.0, 80.0), ("INR 1,180.00", 0.8, 0.0, 120.0), ("GST 180.00", 0.7, 0.0, 160.0), ("dated", 0.5, 0.0, 200.0), ("x", 0.5, 0.0, 240.0), ("05/03/2024", 0.4, 0.0, 280.0)])
    schema = "doc_id long, line_no long, text string, confidence double, x0 double, y0 double, x1 double, y1 double, angle double"
    read = documents.visual_rows(spark.createDataFrame(rows, schema))
    assert {(r.row_no, r.text, r.confidence) for r in read.filter("doc_id = 1").collect()} == {(0, "A B", 0.5), (1, "below", None)}
    got = documents.extract_fields(read).filter("doc_id = 2").first()
    assert (got.vendor_name, got.total_amount, got.total_confidence, got.tax_amount, str(got.issue_date), got.date_confidence, got.invoice_number) == ("Acme Goods", Decimal("1180.00"), 0.8, Decimal("1180.00"), "2024-03-05", 0.4, None)
