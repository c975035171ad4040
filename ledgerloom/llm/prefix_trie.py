"""Conversation prefix trie by van Emde Boas recursion: every distinct beginning is a node with totals.

1. A turn is a digest of its role and text.  Turns are numbered by one range sort, so a conversation
   may span tasks; sequences longer than SEGMENT are cut into segments, whose digests are turns of a
   shorter trie that names the segments' roots.
2. A block of height H holds sequences below named roots.  It is cut at half depth: the cut prefix's
   name is a digest of its root and its turns; equal prefixes become one sequence of the upper trie
   with a count, and what follows is a sequence of the forest below the name.  All blocks of a
   height are cut in one job, and blocks of height 1 are the nodes.
3. Totals are grafted upward: the total of each lower tree goes to the nodes on its cut prefix,
   for heights 1, 2, 4 and so on.  Sums combine before they are shuffled.

Names are 128-bit digests.  Each height is a written table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.spread import lookup_join
from ledgerloom.llm.chunks import tidy
from ledgerloom.session import cut_lineage

SEGMENT = 1024
#: Of a conversation's first turns, at most so many come from another one.
HEAD = 5
ROOT = ""
#: Bytes of a block of listed members.
BLOCK_BYTES = 1 << 16


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, sym, chars): turns numbered from 0 in order of turn (null first), then digest; null texts are empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    sym = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), sym.alias("sym"), F.length(text).cast("long").alias("chars")).filter("conv_id is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, k = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            conv = batch.column(0).to_numpy()
            if not len(conv):
                continue
            heads = np.flatnonzero(np.concatenate(([True], conv[1:] != conv[:-1])))
            at = np.arange(len(conv)) - np.repeat(heads, np.diff(np.append(heads, len(conv))))
            if conv[0] == last:
                at[: heads[1] if len(heads) > 1 else len(at)] += k
            last, k = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(conv), part, np.int64)), pa.array(at), batch.column(1), batch.column(2)], ["conv_id", "part", "k", "sym", "chars"])

    order = ["conv_id", "turn", "sym"]
    placed = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "sym", "chars").mapInArrow(count, "conv_id long, part long, k long, sym string, chars long"))
    runs = placed.groupBy("conv_id", "part").agg((F.max("k") + 1).alias("n"))
    # Only the first and the last conversation of a task can go on in another: at most two rows a task.
    edges = placed.groupBy("part").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi")).select("part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("conv_id"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ahead = runs.join(F.broadcast(edges), ["conv_id", "part"]).select("conv_id", "part", F.coalesce(before, F.lit(0)).alias("ahead")).filter("ahead > 0")
    return placed.join(F.broadcast(ahead), ["conv_id", "part"], "left").select("conv_id", (F.col("k") + F.coalesce("ahead", F.lit(0))).alias("pos"), "sym", "chars")


def rebuilt(turns: DataFrame, every: int = 100) -> tuple[DataFrame, DataFrame]:
    """(conversations with their number of turns n, their turns) after the first h turns came from conversation c - c % every.

    h is crc32 of the decimal id modulo 6.  Null ids take no part.
    """
    rows = cut_lineage(numbered(turns))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (HEAD + 1)
    convs = rows.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"h": head, "base": F.col("conv_id") - F.col("conv_id") % every})
    first = rows.filter((F.col("conv_id") % every == 0) & (F.col("pos") < HEAD)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "sym", "chars"))).alias("head"))
    head_of = F.slice("head", F.lit(1), F.col("h").cast("int"))
    convs = cut_lineage(convs.join(first, "base", "left").withColumn("head", F.coalesce(head_of, F.slice(F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit("").alias("sym"), F.lit(0).cast("long").alias("chars"))), 1, 0))))
    shared = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.pos", "t.sym", "t.chars")
    short = convs.filter(F.size("head") < F.col("h")).select("conv_id", (F.col("h") - F.size("head")).alias("less"), "own")
    own = lookup_join(rows.filter(F.col("pos") >= head), short, ["conv_id"], "own")
    own = own.select("conv_id", (F.col("pos") - F.coalesce("less", F.lit(0))).alias("pos"), "sym", "chars")
    return convs.select("conv_id", (F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")), shared.unionByName(own)


def _named(root: Column, syms: Column) -> Column:
    return F.md5(F.concat(root, F.lit(":"), F.array_join(syms, "")))


def _path(root: Column, syms: Column) -> Column:
    """Names of a block's nodes along a sequence: node i hangs below node i minus its lowest bit."""
    return F.slice(
        F.aggregate(
            F.sequence(F.lit(1), F.size(syms)),
            F.array(root),
            lambda names, i: F.concat(names, F.array(_named(F.get(names, i - i.bitwiseAND(-i)), F.slice(syms, i - i.bitwiseAND(-i) + 1, i.bitwiseAND(-i))))),
        ),
        F.lit(2),
        F.size(syms),
    )


def _end(root: Column, syms: Column, segment: int) -> Column:
    """Name of the last node along a sequence."""
    powers = F.array(*[F.lit(1 << k) for k in range(segment.bit_length() - 1, -1, -1)])
    step = lambda s, b: F.when(F.size(syms).bitwiseAND(b) != 0, F.struct(_named(s["name"], F.slice(syms, s["p"] + 1, b)).alias("name"), (s["p"] + b).alias("p"))).otherwise(s)
    return F.aggregate(powers, F.struct(root.alias("name"), F.lit(0).alias("p")), step)["name"]


@dataclass
class Level:
    """A trie's segments (conv_id, piece, root, top, syms), its heights from high to low, and its nodes."""

    segments: DataFrame
    heights: list[tuple[int, DataFrame]]
    nodes: DataFrame
    above: "Level | None" = None
    whole: DataFrame | None = field(default=None)


def build(turns: DataFrame, segment: int = SEGMENT) -> Level:
    """The trie of sequences given as (conv_id, pos, sym, chars); ``segment`` is a power of two."""
    t = F.array_sort(F.collect_list(F.struct("pos", "sym", "chars")))
    pieces = turns.groupBy("conv_id", F.floor(F.col("pos") / segment).cast("long").alias("piece")).agg(t.alias("t"))
    pieces = cut_lineage(pieces.select("conv_id", "piece", F.col("t.sym").alias("syms"), F.col("t.chars").alias("chars")))
    deepest, longest = pieces.agg(F.max("piece"), F.max(F.size("syms"))).first()
    above = None
    if deepest:
        height = segment
        sums = pieces.filter(F.size("syms") == segment).select("conv_id", F.col("piece").alias("pos"), F.md5(F.array_join("syms", "")).alias("sym"), F.lit(0).cast("long").alias("chars"))
        above = build(sums, segment)
        ends = above.segments.select("conv_id", F.posexplode(F.when(F.size("syms") == segment, F.concat(F.slice(_path(F.col("root"), F.col("syms")), 1, segment - 1), F.array("top"))).otherwise(_path(F.col("root"), F.col("syms")))), "piece")
        ends = cut_lineage(ends.select("conv_id", (F.col("piece") * segment + F.col("pos")).alias("piece"), F.col("col").alias("name")))
        roots = ends.select("conv_id", (F.col("piece") + 1).alias("piece"), F.col("name").alias("root"))
        pieces = pieces.join(ends.withColumnRenamed("name", "top"), ["conv_id", "piece"], "left").join(roots, ["conv_id", "piece"], "left")
        pieces = cut_lineage(pieces.withColumn("root", F.coalesce("root", F.lit(ROOT))))
    else:
        height = 1 << max(0, (longest or 1) - 1).bit_length()
        pieces = pieces.withColumn("root", F.lit(ROOT)).withColumn("top", F.when(F.size("syms") == height, _named(F.col("root"), F.col("syms"))))
    key = ["root", "lo", "top", "syms", "chars"]
    items = cut_lineage(pieces.withColumn("lo", F.col("piece") * segment).groupBy(*key).agg(F.min("conv_id").alias("rep"), F.count("*").alias("n")).withColumn("upper", F.lit(True)))
    whole, heights = items, []
    while height > 1:
        height //= 2
        cut = F.when(F.size("syms") >= height, _named(F.col("root"), F.slice("syms", 1, height)))
        upper = items.select("root", "lo", cut.alias("top"), F.slice("syms", 1, height).alias("syms"), F.slice("chars", 1, height).alias("chars"), "rep", "n").groupBy(*key).agg(F.min("rep").alias("rep"), F.sum("n").alias("n"))
        rest = [F.slice(c, F.lit(height + 1), F.size(c)).alias(c) for c in ("syms", "chars")]
        lower = items.filter(F.size("syms") > height).select(cut.alias("root"), (F.col("lo") + height).alias("lo"), "top", *rest, "rep", "n")
        items = cut_lineage(upper.withColumn("upper", F.lit(True)).unionByName(lower.withColumn("upper", F.lit(False))))
        heights.append((height, items))
    nodes = items.select(F.col("top").alias("name"), F.col("root").alias("parent"), (F.col("lo") + 1).alias("depth"), "rep", "n", F.col("chars")[0].alias("chars"))
    return Level(pieces, heights, nodes, above, whole)


def grafted(level: Level, own: DataFrame, segment: int = SEGMENT) -> tuple[DataFrame, DataFrame]:
    """(totals of each node's subtree, totals below each block's root), from (name, parent, leaves, saved) of the nodes."""
    sums = [F.sum(c).alias(c) for c in ("leaves", "saved")]
    below = own.groupBy(F.col("parent").alias("name")).agg(*sums)
    found = [own.select("name", "leaves", "saved")]
    for _, items in reversed(level.heights):
        trees = items.filter("upper and top is not null").select("root", "syms", F.col("top").alias("name")).join(below, "name")
        nodes = F.transform(_path(F.col("root"), F.col("syms")), lambda x: F.struct(x.alias("name"), F.lit(False).alias("is_root")))
        given = trees.select(F.explode(F.concat(nodes, F.array(F.struct(F.col("root").alias("name"), F.lit(True).alias("is_root"))))).alias("to"), "leaves", "saved")
        given = cut_lineage(given.groupBy("to.name", "to.is_root").agg(*sums))
        found.append(given.filter("not is_root").select("name", "leaves", "saved"))
        below = cut_lineage(below.unionByName(given.filter("is_root").drop("is_root")).groupBy("name").agg(*sums))
    if level.above is not None:
        upper = level.above.nodes.select("name", "parent").join(below, "name", "left").fillna(0, ["leaves", "saved"])
        totals, ends = grafted(level.above, cut_lineage(upper), segment)
        trees = level.whole.filter(F.size("syms") == segment).select("root", "syms", F.col("top").alias("name")).join(totals, "name")
        path = F.concat(F.slice(_path(F.col("root"), F.col("syms")), 1, segment - 1), F.array("name"))
        found.append(trees.select(F.explode(path).alias("name"), "leaves", "saved"))
        below = below.unionByName(ends.filter(F.col("name") == ROOT)).groupBy("name").agg(*sums)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return cut_lineage(out.groupBy("name").agg(*sums)), cut_lineage(below)


def listed(members: DataFrame) -> DataFrame:
    """(name, ends_sha256) of (name, conv_id): ids in ascending order, comma-joined.

    A range sort lets many tasks write one name's list in blocks; the hash then streams over the blocks.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, names, ids = [], batch.column(0).to_pylist(), batch.column(1).to_pylist()
            a = 0
            for b in range(1, len(ids) + 1):
                if b == len(ids) or names[b] != names[a] or (b - a) * 8 >= BLOCK_BYTES:
                    out.append((names[a], ids[a], ",".join(map(str, ids[a:b]))))
                    a = b
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))] if out else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.string())], ["name", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            out = []
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name == now:
                    state.update(b",")
                else:
                    if state:
                        out.append((now, state.hexdigest()))
                    now, state = name, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], ["name", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([state.hexdigest()])], ["name", "ends_sha256"])

    runs = members.select("name", "conv_id").repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id").mapInArrow(blocks, "name string, first long, ids string")
    return runs.repartition("name").sortWithinPartitions("name", "first").select("name", "ids").mapInArrow(hashed, "name string, ends_sha256 string")


def trie(convs: DataFrame, turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """One row per distinct beginning of the sequences (conv_id, pos, sym, chars) of the conversations (conv_id, n).

    Columns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256.  A conversation without turns is a member of the root alone; no conversations, no rows.
    """
    with tidy(convs.sparkSession):
        level = build(turns, segment)
        nodes = cut_lineage(level.nodes)
        kids = nodes.groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
        top = convs.agg(F.min("conv_id").alias("rep"), F.count("*").alias("n")).filter("n > 0").select(F.lit(ROOT).alias("name"), F.lit(None).cast("string").alias("parent"), F.lit(0).cast("long").alias("depth"), "rep", "n", F.lit(0).cast("long").alias("chars"))
        nodes = nodes.unionByName(top).join(kids, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
        nodes = cut_lineage(nodes.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n") - 1) * F.col("chars")}))
        totals, below = grafted(level, nodes.filter("depth > 0").select("name", "parent", "leaves", "saved"), segment)
        totals = totals.unionByName(below.filter(F.col("name") == ROOT))
        end = F.coalesce("top", _end(F.col("root"), F.col("syms"), segment))
        ends = level.segments.groupBy("conv_id").agg(F.max_by(end, "piece").alias("name")) if level.above else level.segments.select("conv_id", end.alias("name"))
        members = ends.unionByName(convs.filter("n = 0").select("conv_id", F.lit(ROOT).alias("name")))
        nodes = nodes.join(totals.withColumnsRenamed({"leaves": "n_leaves", "saved": "saved_tokens"}), "name", "left").join(listed(members), "name", "left")
        parents = nodes.filter("n_children > 0").select(F.col("name").alias("parent"), F.col("rep").alias("parent_conv_id"), "n_children")
        plain = nodes.select("parent", F.col("rep").alias("conv_id"), "depth", F.col("n").alias("n_convs"), F.col("n_children").alias("n_kids"), F.coalesce("n_leaves", "leaves").alias("n_leaves"), F.coalesce("saved_tokens", "saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
        out = lookup_join(cut_lineage(plain), parents, ["parent"], "n_children")
        return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_kids").alias("n_children"), "n_leaves", "saved_tokens", "ends_sha256")


def query(turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The trie of the rebuilt conversations; other columns are not read.  Repeated rows are turns of their own."""
    with tidy(turns.sparkSession):
        convs, rows = rebuilt(turns.select("conv_id", "turn", "role", "text"))
    return trie(convs, rows, segment)


SQL = """
WITH RECURSIVE crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
ids AS MATERIALIZED (SELECT conv_id AS c, count(*) AS own FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
convs AS MATERIALIZED (
  SELECT c, own, c - c % 100 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda k: ascii(substr(c::VARCHAR, k, 1))::BIGINT)),
      lambda s, b: xor(s >> 8, t[(xor(s, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM ids, crc_table),
rows_ AS MATERIALIZED (
  SELECT conv_id AS c, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS sym, length(coalesce(text, '')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
sequences AS MATERIALIZED (
  SELECT v.c, v.c AS o, r.pos + 0 AS p0, 0 AS side, r.sym, r.chars FROM convs v JOIN rows_ r ON r.c = v.base AND r.pos < v.h
  UNION ALL SELECT v.c, v.c, r.pos, 1, r.sym, r.chars FROM convs v JOIN rows_ r ON r.c = v.c AND r.pos >= v.h),
turns AS MATERIALIZED (SELECT c, sym, chars, row_number() OVER (PARTITION BY c ORDER BY side, p0) AS d FROM sequences),
prefixes AS MATERIALIZED (
  SELECT a.c, a.d, any_value(a.chars) AS chars, string_agg(b.sym, '' ORDER BY b.d) AS name FROM turns a JOIN turns b ON a.c = b.c AND b.d <= a.d GROUP BY 1, 2
  UNION ALL SELECT c, 0, 0, '' FROM convs),
lens AS (SELECT c, max(d) AS d FROM prefixes GROUP BY 1),
nodes AS MATERIALIZED (
  SELECT name, d AS depth, left(name, greatest(length(name) - 32, 0)) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM prefixes GROUP BY 1, 2),
kids AS (SELECT parent AS name, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
own AS MATERIALIZED (SELECT n.*, coalesce(k.n, 0) AS n_children, (n.n_convs - 1) * n.chars AS saved FROM nodes n LEFT JOIN kids k USING (name)),
below AS (
  SELECT a.name, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves, sum(b.saved) AS saved
  FROM own a JOIN own b ON b.depth >= a.depth AND left(b.name, length(a.name)) = a.name GROUP BY 1),
ends AS (SELECT p.name, sha256(string_agg(p.c::VARCHAR, ',' ORDER BY p.c)) AS h FROM prefixes p JOIN lens USING (c, d) GROUP BY 1)
SELECT o.conv_id, o.depth::BIGINT AS depth, CASE WHEN o.depth > 0 THEN p.conv_id END AS parent_conv_id, o.n_convs, o.n_children, b.n_leaves, b.saved::BIGINT AS saved_tokens,
  coalesce(e.h, sha256('')) AS ends_sha256
FROM own o JOIN below b USING (name) LEFT JOIN ends e USING (name) LEFT JOIN own p ON p.name = o.parent AND o.depth > 0
"""
