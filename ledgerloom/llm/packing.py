"""Packing: all documents one after another, cut into sequences of a fixed length.

1. Every document becomes its ids and an end id, once, in a written table that also has each
   document's place among the ids of its partition.
2. First pass: ids per partition; a prefix sum over them gives each partition's place (one small
   row a partition).
3. Second pass: with its global place, each document cuts itself at the sequences' borders; a
   document across a border leaves a piece on either side.  Only the last sequence can be short.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.textbytes import buffer_of, cuts, id_array, ids_of
from ledgerloom.session import cut_lineage

if TYPE_CHECKING:
    from tokenizers import Tokenizer

SEQUENCE = 4096
END_ID = 2
#: Words kept with their ids in a task; a memory bound that changes no result.
CACHED_WORDS = 400_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"

#: The tokenizer's own steps before its pairs are merged, under which a plain word is pieces of its model.
STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: Letters that no other letter composes with, of ASCII and Latin-1, then marks; no special token's string fits.
PLAIN = re.compile(rb"([A-Za-z]*+(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][A-Za-z]*+)*+)([!-&(-/:;=-@\[-`{-~]*+)")
#: The byte-level characters of the bytes of those letters.
LEVEL = {b: 256 + 33 + b - 127 for b in range(128, 161)} | {173: 323}


class WordIds(dict):
    """Ids of words as little-endian 32-bit integers, found by the tokenizer when a word is first asked for.

    A plain word is its letters, made small, and its marks: the tokenizer starts a new piece between them, so
    they go to its model, and what many words share is merged once.  Every other word goes through all of its steps.
    """

    def __init__(self, tokenizer: Tokenizer) -> None:
        self.tokenizer, self.model, self.pieces = tokenizer, tokenizer.model, {b"": b""}
        parts = (tokenizer.normalizer, tokenizer.pre_tokenizer)
        self.plain = all(parts) and tuple(json.loads(p.__getstate__()) for p in parts) == STEPS

    def __missing__(self, word: bytes) -> bytes:
        if self.plain and word.isalpha():
            ids = self.piece(word.lower())
        elif self.plain and (found := PLAIN.fullmatch(word)):
            letters, marks = found.groups()
            ids = self.piece(letters.lower() if letters.isascii() else letters.decode().lower().encode()) + self.piece(marks)
        else:
            ids = array("I", self.tokenizer.encode(word.decode(), add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def piece(self, text: bytes) -> bytes:
        ids = self.pieces.get(text)
        if ids is None:
            level = text.decode() if text.isascii() else text.decode("latin-1").translate(LEVEL)
            ids = self.pieces[text] = array("I", [t.id for t in self.model.tokenize(level)]).tobytes()
        return ids

    def clear(self) -> None:
        super().clear()
        self.pieces = {b"": b""}


def token_table(docs: DataFrame, tokenizer_path: str, doc_id: str, text: str, end_id: int, by_word: bool) -> DataFrame:
    """Written table of (part, place, doc_id, n, ids): ids as little-endian 32-bit integers, end id last.

    ``by_word``: the tokenizer drops white space, so words can be encoded one by one and kept.
    """

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tail = np.array([end_id], "<u4").tobytes()
        known = WordIds(tokenizer)
        part, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = ids_of(batch.column(0))
            buf, offs = buffer_of(batch.column(1))
            for i, j in cuts(offs, 2 << 20):
                raw = [buf[a:b].tobytes() for a, b in zip(offs[i:j], offs[i + 1 : j + 1])]
                if by_word:
                    split = [t.split() for t in raw]
                    if len(known) > CACHED_WORDS:
                        known.clear()
                    bodies = [b"".join(map(known.__getitem__, t)) + tail for t in split]
                else:
                    bodies = [np.array(x.ids, "<u4").tobytes() + tail for x in tokenizer.encode_batch([t.decode() for t in raw], add_special_tokens=False)]
                n = np.array([len(x) // 4 for x in bodies], np.int64)
                places = place + np.cumsum(n) - n
                place += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(j - i, part, np.int64)), pa.array(places), id_array(ids[i:j]), pa.array(n), pa.array(bodies, pa.binary())], ["part", "place", "doc_id", "n", "ids"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return cut_lineage(source.mapInArrow(encoded, "part long, place long, doc_id long, n long, ids binary"))


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, end_id: int = END_ID, by_word: bool = True, with_ids: bool = True) -> DataFrame:
    """One row for each piece of a document in a sequence, with its ids if asked for.

    A null text is empty: its document is the end id alone.  Rows that share an id, or have none, are
    packed one by one.  An empty table gives no sequence.  Other columns are not read.
    """
    tokens = token_table(docs, tokenizer_path, doc_id, text, end_id, by_word)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    places = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))  # two numbers for each partition of the input

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, start, length, crc, total, where, bodies = [], [], [], [], [], [], []
            at, n = (batch.column(c).to_numpy() for c in (1, 2))
            for d, body in enumerate(batch.column(3)):
                raw = body.as_buffer()
                first, count = int(at[d]), int(n[d])
                borders = [0, *range(sequence - first % sequence, count, sequence), count]
                for a, b in zip(borders, borders[1:]):
                    piece = raw.slice(4 * a, 4 * (b - a))
                    owner.append(d)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(piece))
                    total.append(count)
                    where.append(first + a)
                    if with_ids:
                        bodies.append(piece.to_pybytes())
            place = np.array(where, np.int64)
            columns = [batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array(place // sequence), pa.array(place % sequence)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(bodies, pa.binary())] * with_ids, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids)

    placed = tokens.join(F.broadcast(places), "part").select("doc_id", (F.col("base") + F.col("place")).alias("at"), "n", "ids")
    return placed.mapInArrow(cut, PIECES if with_ids else PIECES.removesuffix(", ids binary"))
