"""Line dedup: lines within a small edit distance of an earlier line, by DataFrame functions alone.

Lines are cut into threshold + 1 segments; a line within the threshold keeps one of them whole, at a
place that the two lengths and the segment's number leave few choices for.  Hashed segments, with the
length and the number, are the index; the substrings at those places of lines as long or up to
``threshold`` longer probe it.  Candidates are verified by the edit distance with a threshold, which
computes a band only.

Equal lines are one entry.  With a threshold of 1, keys that more than HOT_LINES distinct lines share
are replaced by finer ones: all of the line but one of FINE parts.  So a long stretch that
thousands of lines share does not compare them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.chunks import tidy
from ledgerloom.session import cut_lineage

THRESHOLD = 1
#: Shorter lines are never removed; the pipeline drops a document that has nothing else left.
MIN_CHARS = 20
HOT_LINES = 64
FINE = 16
#: The place of documents without an id.
LAST = (1 << 63) - 1


def _start(n: Column, i: int, parts: int) -> Column:
    return F.floor(n * i / parts).cast("int")


def _part(line: Column, start: Column, length: Column) -> Column:
    return F.substring(line, (start + 1).cast("int"), length.cast("int"))


def index_keys(line: Column, n: Column, threshold: int) -> list[Column]:
    parts = threshold + 1
    return [F.xxhash64(n, F.lit(i), _part(line, _start(n, i, parts), _start(n, i + 1, parts) - _start(n, i, parts))) for i in range(parts)]


def probe_keys(line: Column, m: Column, threshold: int) -> list[Column]:
    """Where a line of m characters meets the segments of lines as long, or up to ``threshold`` shorter, besides its own."""
    parts, out = threshold + 1, []
    for less in range(parts):
        n = m - less
        for i in range(parts):
            low, high = max(-i, less - (threshold - i)), min(i, less + (threshold - i))
            for shift in range(low, high + 1):
                if less or shift:
                    out.append(F.xxhash64(n, F.lit(i), _part(line, _start(n, i, parts) + shift, _start(n, i + 1, parts) - _start(n, i, parts))))
    return out


def fine_keys(line: Column, m: Column, less: int) -> list[Column]:
    """All of a line but one part, as a line of m - less characters has it; for a threshold of 1."""
    n = m - less
    return [F.xxhash64(n, F.lit(j), _part(line, F.lit(0), _start(n, j, FINE)), _part(line, _start(n, j + 1, FINE) + less, m)) for j in range(FINE)]


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, row, pos, line, n, k1, k2) of the lines that are long enough; (k1, k2) names the line."""
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.col(text)).alias("row"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "line"))
    rows = rows.withColumn("n", F.char_length("line")).filter(F.col("n") >= MIN_CHARS)
    return rows.withColumns({"k1": F.xxhash64("line"), "k2": F.xxhash64(F.lit(1), "line")})


def _pairs(keys: DataFrame) -> DataFrame:
    """(a1, a2, b1, b2): lines that share a key, at least one of them in the index."""
    a, b = keys.filter("own").alias("a"), keys.alias("b")
    other = (F.col("a.k1") != F.col("b.k1")) | (F.col("a.k2") != F.col("b.k2"))
    return a.join(b, (F.col("a.key") == F.col("b.key")) & other).select(F.col("a.k1").alias("a1"), F.col("a.k2").alias("a2"), F.col("b.k1").alias("b1"), F.col("b.k2").alias("b2"))


def _shared(keys: DataFrame) -> DataFrame:
    sizes = keys.groupBy("key").agg(F.count("*").alias("held"), F.max("own").alias("indexed")).filter("held > 1 and indexed").select("key", "held")
    return cut_lineage(keys.join(sizes, "key"))


def late_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(k1, k2, first, late): each distinct line, its first place, and whether an earlier line is within the threshold."""
    lines = _lines(docs, doc_id, text)
    own = F.transform(F.array(*index_keys(F.col("line"), F.col("n"), threshold)), lambda k: F.struct(k.alias("key"), F.lit(True).alias("own")))
    probe = F.transform(F.array(*probe_keys(F.col("line"), F.col("n"), threshold)), lambda k: F.struct(k.alias("key"), F.lit(False).alias("own")))
    distinct = cut_lineage(lines.groupBy("k1", "k2").agg(F.min(F.struct("doc", "row", "pos")).alias("first"), F.first(F.concat(own, probe)).alias("keys")))
    keys = distinct.select("k1", "k2", F.inline("keys"))
    shared = _shared(keys)
    pairs = cut_lineage(_pairs(shared.filter((F.col("held") <= HOT_LINES) | F.lit(threshold != 1))).distinct())
    hot = shared.filter((F.col("held") > HOT_LINES) & F.lit(threshold == 1)).select("k1", "k2").distinct()
    names = lambda side: pairs.select(F.col(f"{side}1").alias("k1"), F.col(f"{side}2").alias("k2"))
    wanted = cut_lineage(names("a").union(names("b")).union(hot).distinct())
    texts = cut_lineage(lines.select("k1", "k2", "line", "n").join(wanted.hint("shuffle_hash"), ["k1", "k2"]).dropDuplicates(["k1", "k2"]))
    if threshold == 1 and hot.limit(1).count():
        finer = texts.join(hot, ["k1", "k2"])
        sides = [finer.select("k1", "k2", F.explode(F.array(*fine_keys(F.col("line"), F.col("n"), less))).alias("key"), F.lit(not less).alias("own")) for less in (0, 1)]
        pairs = cut_lineage(pairs.union(_pairs(_shared(sides[0].union(sides[1])))).distinct())
    for side in "ab":
        pairs = pairs.join(texts.select(F.col("k1").alias(f"{side}1"), F.col("k2").alias(f"{side}2"), F.col("line").alias(side)), [f"{side}1", f"{side}2"])
    alike = cut_lineage(pairs.filter(F.levenshtein("a", "b", threshold) >= 0).select("a1", "a2", "b1", "b2"))
    firsts = distinct.select("k1", "k2", "first")
    for side in "ab":
        alike = alike.join(firsts.select(F.col("k1").alias(f"{side}1"), F.col("k2").alias(f"{side}2"), F.col("first").alias(f"first_{side}")), [f"{side}1", f"{side}2"])
    later = F.when(F.col("first_a") > F.col("first_b"), F.struct(F.col("a1").alias("k1"), F.col("a2").alias("k2"))).otherwise(F.struct(F.col("b1").alias("k1"), F.col("b2").alias("k2")))
    late = alike.select(later.alias("x")).select("x.*").distinct().withColumn("late", F.lit(True))
    return cut_lineage(firsts.join(late, ["k1", "k2"], "left").select("k1", "k2", "first", F.coalesce("late", F.lit(False)).alias("late")))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs with n_lines, n_removed and kept_text.

    A line of MIN_CHARS characters or more is removed when an earlier line, by (doc_id, place), is within
    ``threshold`` edits, whether or not that line stays itself.  A null doc_id comes last; rows with the same
    doc_id go by a hash of their text, and rows that repeat whole are one document.  A null text has no
    lines and stays null; an empty one has one line.  Columns of docs with these names are replaced.
    """
    made = ["n_lines", "n_removed", "kept_text"]
    with tidy(docs.sparkSession):
        late = late_lines(docs, doc_id, text, threshold)
        place = F.struct("doc", "row", "pos")
        gone = _lines(docs, doc_id, text).select("doc", "row", "pos", "k1", "k2").join(late, ["k1", "k2"]).filter(F.col("late") | (place > F.col("first")))
        gone = cut_lineage(gone.select("doc", "row", "pos").distinct().groupBy("doc", "row").agg(F.collect_list("pos").alias("gone")))
    rows = docs.select(*[c for c in docs.columns if c not in made]).withColumns({"doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)), "row": F.xxhash64(F.col(text))})
    rows = rows.join(gone, ["doc", "row"], "left")
    every = F.split(F.col(text), "\n", -1)
    kept = F.array_join(F.filter(every, lambda x, i: ~F.array_contains("gone", i)), "\n")
    out = rows.withColumns({"n_lines": F.when(F.col(text).isNull(), 0).otherwise(F.size(every)).cast("long"), "n_removed": F.coalesce(F.size("gone"), F.lit(0)).cast("long"), "kept_text": F.when(F.col("gone").isNull(), F.col(text)).otherwise(kept)})
    return out.select(*[c for c in docs.columns if c not in made], *made)


def stubs(found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, row) of the rows of ``dedup_lines`` that lost lines and keep no long one, only short ones of earlier documents."""
    place = {"doc": F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)), "row": F.xxhash64(F.col(text))}
    rows = found.withColumns(place)
    short = lambda x: (F.char_length(x) < MIN_CHARS) & x.rlike(r"\S")
    lines = rows.select("doc", "row", F.explode(F.split(F.col(text), "\n", -1)).alias("line")).filter(short(F.col("line")))
    firsts = lines.groupBy("line").agg(F.min(F.struct("doc", "row")).alias("first"))
    left = F.split(F.col("kept_text"), "\n", -1)
    bare = cut_lineage(rows.filter((F.col("n_removed") > 0) & ~F.exists(left, lambda x: F.char_length(x) >= MIN_CHARS)).select("doc", "row", F.array_distinct(F.filter(left, short)).alias("left")).distinct())
    new = bare.select("doc", "row", F.explode("left").alias("line")).join(firsts, "line").filter(F.col("first") == F.struct("doc", "row")).select("doc", "row").distinct()
    return cut_lineage(bare.select("doc", "row").join(new, ["doc", "row"], "left_anti"))


def query(docs: DataFrame) -> DataFrame:
    found = dedup_lines(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = f"""
WITH split AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents
), lines AS (
  SELECT line, length(line) AS n, min((doc_id, pos)) AS first FROM split WHERE length(line) >= {MIN_CHARS} GROUP BY line
), sides AS (
  SELECT line, n, n AS of, first, line[:n // 2] AS head, line[n // 2 + 1:] AS tail FROM lines
), longer AS (
  SELECT line, n, n - d AS of, first, line[:(n - d) // 2] AS head, line[(n - d) // 2 + 1 + d:] AS tail FROM lines, (VALUES (0), (1)) AS t(d)
), alike AS (
  SELECT a.line AS x, b.line AS y, a.first AS fx, b.first AS fy
  FROM sides a JOIN longer b ON a.of = b.of AND a.head = b.head WHERE a.line <> b.line AND levenshtein(a.line, b.line) <= {THRESHOLD}
  UNION ALL
  SELECT a.line, b.line, a.first, b.first
  FROM sides a JOIN longer b ON a.of = b.of AND a.tail = b.tail WHERE a.line <> b.line AND levenshtein(a.line, b.line) <= {THRESHOLD}
), late AS (SELECT DISTINCT CASE WHEN fx > fy THEN x ELSE y END AS line FROM alike),
marked AS (
  SELECT s.doc_id, s.pos, s.line, (l.line IS NOT NULL AND ((s.doc_id, s.pos) > l.first OR s.line IN (SELECT line FROM late))) AS gone
  FROM split s LEFT JOIN lines l ON s.line = l.line
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
