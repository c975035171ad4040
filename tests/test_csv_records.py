"""Files cut into byte ranges against a serial reader."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import csv_records, statement_files


def serial(text, delimiter=","):
    return [row for row in csv.reader(io.StringIO(text), delimiter=delimiter) if row]


@pytest.fixture()
def small_blocks(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "257b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def read(spark, path, delimiter=",", **more):
    lines = csv_records.physical_lines(spark, str(path)).cache()
    delimiters = lines.select("file_id").distinct().withColumn("delimiter", F.lit(delimiter))
    found, long = csv_records.records(lines, delimiters, **more)
    rows = found.filter("line <> ''").select(F.regexp_extract("file_id", "([a-z0-9]+).csv$", 1).alias("f"), "line_no", csv_records.cells_of(F.col("line"), F.lit(delimiter)).alias("cells")).orderBy("f", "line_no").collect()
    blocks = lines.select("file_id", "block").distinct().count()
    lines.unpersist()
    out = {}
    for r in rows:
        out.setdefault(r.f, []).append(list(r.cells))
    return out, long, blocks


def test_random_files_over_many_blocks(spark, tmp_path, small_blocks):
    rng = random.Random(8)
    texts = {}
    for k in range(30):
        marks = ["\n", "\r\n", '"', '""', ",", "a", " ", "é", "\n\n", ',"', '",', '"\n'][: rng.randrange(6, 13)]
        texts[f"r{k}"] = "".join(rng.choice(marks) for _ in range(rng.randrange(0, 600))) + "end"
    texts["long"] = "h,i\n" + "".join(f'{i},"x\n{"y" * (i % 90)}\n""q"""\n' for i in range(150))
    texts["wide"] = 'a,"' + "line\n" * 300 + '",b\nc,d,e\n'  # one record over several blocks
    texts["open"] = 'a,b\nc,"never closed\nx,y\n'
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    got, long, blocks = read(spark, tmp_path)
    assert blocks > 2 * len(texts) and long.count() == 0
    for name, text in texts.items():
        # a last record that is never closed comes without its last line end
        want = [row[:-1] + [row[-1].removesuffix("\n")] for row in serial(text)] if name == "open" else serial(text)
        assert got.get(name, []) == want, name


def test_carriage_returns_marks_and_encodings(spark, tmp_path, small_blocks):
    (tmp_path / "mac.csv").write_bytes(b'a|b\rc|"d\re"\rf|g')
    (tmp_path / "mark.csv").write_bytes("\ufeffnaïve|x\n".encode())
    (tmp_path / "old.csv").write_bytes(("caf\xe9|" + "z" * 600 + "\n" + 'p|"q\n"\n').encode("latin-1"))
    got, _, _ = read(spark, tmp_path, "|")
    assert got == {"mac": [["a", "b"], ["c", "d\re"], ["f", "g"]], "mark": [["naïve", "x"]], "old": [["café", "z" * 600], ["p", "q\n"]]}


def test_quotes_never_closed_are_refused(spark, tmp_path, small_blocks):
    (tmp_path / "bad.csv").write_bytes(b'a,b\n"' + b"x\n" * 2000)
    (tmp_path / "good.csv").write_bytes(b'a,b\n"x\n' + b'y",2\n')
    (tmp_path / "none.csv").write_bytes(b"")
    kept, refused = statement_files.read_statement_folder(spark, str(tmp_path), record_chars=500)
    name = F.regexp_extract("file_id", "([a-z]+).csv$", 1)
    assert {(r.f, r.reject_reason) for r in refused.select(name.alias("f"), "reject_reason").collect()} == {("bad", "quoted record too long"), ("none", "empty upload")}
    assert [(r.f, r.line_no, r.line) for r in kept.select(name.alias("f"), "line_no", "line").orderBy("line_no").collect()] == [("good", 0, "a,b"), ("good", 1, '"x\ny",2')]
