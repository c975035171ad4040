"""Statement files end to end: layouts, encodings, swapped headers, inverted signs."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import statements
from ledgerloom.sources import statement_files

ROWS = [(f"{d:02d}", "NEFT DR ACME SUPPLIES INV1%02d" % d, 0 if d % 3 else 40 * d, 25 * d if d % 3 else 0) for d in range(1, 25)]


def ledger_text(style):
    bal, out = 1000, []
    for day, text, credit, debit in ROWS:
        bal += credit - debit
        c, d = (f"{credit}.00" if credit else ""), (f"{debit}.00" if debit else "")
        line = {
            "plain": f"{day}/01/2026,{text},{d},{c},{bal}.00", "swapped": f"{day}/01/2026,{text},{d},{c},{bal}.00",
            "signed": f"{day}-Jan-2026;{text};{credit - debit}.00;{bal}.00", "inverted": f"{day}-Jan-2026;{text};{debit - credit}.00;{bal}.00",
            "quoted": f'2026-01-{day},"{text}, x",{d},{c},"{bal // 1000},{bal % 1000:03d}.00 Cr"' if bal >= 1000 else f'2026-01-{day},"{text}, x",{d},{c},"{bal}.00 Cr"',
        }[style]
        out.append(line)
    head = {
        "plain": "Txn Date,Narration,Debit,Credit,Balance", "swapped": "Txn Date,Narration,Credit,Debit,Balance", "signed": "Date;Description;Amount;Running Balance",
        "inverted": "Date;Description;Amount;Running Balance", "quoted": "Account Statement\nCurrency INR\nDate,Transaction Details,Withdrawal (Dr),Deposit (Cr),Closing Balance",
    }[style]
    return head + "\n" + "\n".join(out) + "\n"


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    for s in ("plain", "swapped", "signed", "inverted", "quoted"):
        data = ledger_text(s).replace("ACME", "CAFÉ" if s == "plain" else "ACME")
        (folder / f"{s}.csv").write_bytes(data.encode("latin-1" if s == "plain" else "utf-8"))
    (folder / "empty.csv").write_bytes(b"")
    lines, empty = statement_files.read_statement_folder(spark, str(folder))
    name = F.regexp_extract("file_id", r"([a-z]+)\.csv$", 1)
    lines = lines.withColumn("file_id", name).cache()
    accounts = lines.select("file_id").distinct().withColumn("business_id", F.lit(7)).withColumn("account_reference", F.lit("ACC"))
    return lines, empty, statements.ingest(lines, accounts)


def test_encodings_and_empty_files(result):
    lines, empty, _ = result
    assert {r.file_id: r.encoding for r in lines.select("file_id", "encoding").distinct().collect()}["plain"] == "latin-1"
    assert empty.count() == 1


def test_every_layout_gives_the_same_ledger(result):
    _, _, out = result
    rows = out["rows"].toPandas()
    want = [(float(d), float(c)) for _, _, c, d in ROWS]
    for s in ("plain", "swapped", "signed", "quoted"):
        part = rows[rows.file_id == s].sort_values("row_idx")
        assert [(float(a), float(b)) for a, b in zip(part["debit"], part["credit"])] == want, s


def test_inverted_signs_are_rejected_and_give_no_records(result):
    _, _, out = result
    rejected = {r.file_id: r.diagnosis for r in out["rejected"].collect()}
    assert rejected == {"inverted": "inverted direction"}
    by_file = {r.file_id: r["count"] for r in out["records"].groupBy("file_id").count().collect()}
    assert "inverted" not in by_file and by_file["plain"] == len(ROWS)


def test_page_heads_are_dropped_once(spark):
    rows = [(1, 1, i, t) for i, t in enumerate(["h1", "h2", "a"])] + [(1, 2, i, t) for i, t in enumerate(["h1", "h2", "b", "a"])]
    got = statements.concatenate_pages(spark.createDataFrame(rows, "request_id long, page_no long, line_no long, line string"))
    assert [r.line for r in got.orderBy("page_no", "line_no").collect()] == ["h1", "h2", "a", "b", "a"]
