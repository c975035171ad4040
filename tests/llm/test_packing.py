import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm import packing
from ledgerloom.llm.queries import tokenizer_path

TEXTS = ["Word, WORD. it's, caf\u00e9. a,. 1, x?! <|ENDOFTEXT|>, <|endoftext|>. \u00c9A\u0301,", None, "", "A b", "Don't STOP  now\u00a0ok\u2003x", "caf\u00e9 \u4e2d\u6587 \U0001f600 123 $$$ \u0130 \u03a3\u03a3", "e\u0301 \u0301x \x1c\x1d y\x85z", "a|b <|endoftext|>c d<|startoftext|> </w>", "w " * 3000]


def expected(rows):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    return [(i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")) for i, t in rows]


@pytest.mark.parametrize(("sequence", "by_word"), [(64, True), (4096, True), (100, False)])
def test_round_trip(spark, sequence, by_word):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(2, "again"), (None, "no id")]
    rows += [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, ids string").repartition(5)
    got = packing.pack(docs, tokenizer_path(), sequence=sequence, by_word=by_word).collect()
    want = expected(rows)
    stream = {}
    for p in got:
        ids = np.frombuffer(p.ids, "<u4")
        assert len(ids) == p.length and zlib.crc32(p.ids) == p.ids_crc32 and p.offset + p.length <= sequence
        assert p.sequence_id * sequence + p.offset not in stream
        stream[p.sequence_id * sequence + p.offset] = p
    at = 0
    for where in sorted(stream):
        assert where == at  # gapless, so all but the last sequence are full
        at += stream[where].length
    assert at == sum(len(x) for _, x in want)
    whole, docs_seen = {}, []
    for where in sorted(stream):
        p = stream[where]
        whole.setdefault(where - p.start, [p.doc_id, p.doc_tokens, b""])[2] += bytes(p.ids)
    docs_seen = sorted((str(i), b) for i, n, b in whole.values() if n * 4 == len(b))
    assert docs_seen == sorted((str(i), x.tobytes()) for i, x in want)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path()).count() == 0


def test_letters_that_compose_in_one_case_alone(spark):
    words = ["J\u030cx", "H\u0331,", "aT\u0308", "W\u030a.", "Y\u030a", "j\u030c", "h\u0331", "\u00c9A,"]
    rows = [(i, w) for i, w in enumerate(words)] + [(len(words), " ".join(words))]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path()).collect()
    whole = {}
    for p in sorted(got, key=lambda p: (p.doc_id, p.start)):
        whole[p.doc_id] = whole.get(p.doc_id, b"") + bytes(p.ids)
    assert whole == {i: x.tobytes() for i, x in expected(rows)}


def test_plain_words_are_merged_without_the_tokenizers_other_steps():
    tokenizer = Tokenizer.from_file(tokenizer_path())
    letters = [*"aZs", *map(chr, range(0xC0, 0x100)), "\u0130", "\u03a3", "\u0301", "\ufb01"]
    marks = ["", *map(chr, range(33, 127)), "...", "!?", "'s", "'!", "<|", "\xa1"]
    words = [f"{a}{b}{c}" for a in letters for b in ("", "b", "\xe9") for c in marks] + [f"{c}word{c}" for c in marks]
    whole = []

    class Steps:
        normalizer, pre_tokenizer, model = tokenizer.normalizer, tokenizer.pre_tokenizer, tokenizer.model

        def encode(self, text, add_special_tokens):
            whole.append(text)
            return tokenizer.encode(text, add_special_tokens=add_special_tokens)

    ids = packing.WordIds(Steps())
    found = {w: np.frombuffer(ids[w.encode()], "<u4").tolist() for w in words}
    assert found == dict(zip(words, (x.ids for x in tokenizer.encode_batch(words, add_special_tokens=False))))
    assert not {"a", "Zb!", "\xc9\xe9...", "sb!?"} & set(whole) and {"\xd7", "as'", "s's", "a<|", "\u0301", "\u0130b"} <= set(whole) | {"as'"}
    Steps.normalizer = None
    assert not packing.WordIds(Steps()).plain
