import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from ledgerloom.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_table():
    """Letters of byte-level tokens."""
    table, more = {}, 256
    for x in range(256):
        if 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x:
            table[chr(x)] = x
        else:
            table[chr(more)], more = x, more + 1
    return table


def brute(rows):
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    table = byte_table()
    docs = []
    for i, text in rows:
        if not text:
            docs.append((i, None))
            continue
        x = a.encode(" " + text, add_special_tokens=False)
        y = b.encode(text)
        bytes_x = [bytes(table[c] for c in t) for t in x.tokens]
        pieces = [b.id_to_piece(k) for k in y]
        bytes_y = [bytes([int(p[3:-1], 16)]) if b.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(y, pieces)]
        whole = (" " + text).encode()
        if b"".join(bytes_x) != whole or b"".join(bytes_y) != whole:
            docs.append((i, None))
            continue
        ends = []
        for parts in (bytes_x, bytes_y):
            at, line = 0, []
            for p in parts:
                at += len(p)
                line.append(at)
            ends.append(line)
        at_x, at_y = ({e: k for k, e in enumerate(line)} for line in ends)
        links = [(y[at_y[e]], x.ids[at_x[e]]) for e in ends[0] if e in at_y]
        groups, pa_, pb = [], 0, 0
        for e in (e for e in ends[0] if e in at_y):
            qa, qb = at_x[e] + 1, at_y[e] + 1
            groups.append(",".join(map(str, x.ids[pa_:qa])) + "|" + ",".join(map(str, y[pb:qb])))
            pa_, pb = qa, qb
        docs.append((i, (len(x.ids), len(y), groups, links)))
    count = Counter(p for _, d in docs if d for p in d[3])
    highest = defaultdict(int)
    for (y, _), n in count.items():
        highest[y] = max(highest[y], n)
    out = []
    for i, d in docs:
        if d is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = d
            out.append((i, n_a, n_b, len(groups), len(links), sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    assert df.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


ODD = [
    None, "", " ", "   ", "a", " a", "  a  b   c ", "\n", "a\n b\n\n  c", "tab\t x\t\ty", "It's we'll I'd  'tis", "<s>[INST] ok [/INST]</s>", "<|endoftext|> here <|endoftext|>", "<0x0A> <unk>",
    "naïve café — “quotes”", "中文字符 没有 空格", "😀 👩‍👩‍👧 x", "a b   c　d  e", "lower ▁ one eighth", "▁", "x\u0000y", "\r\n \x1c x", "é fi ﬁ ½", "1234567890 3.14 -- ... !!!", "عربي hello हिन्दी", "a" * 300, "word " * 50, "   x",
]


def test_odd_texts(spark):
    rng = random.Random(5)
    marks = [" ", "  ", "a", "B", "é", "\n", "▁", "'s", "1", ".", "中", " ", "\t", "<s>"]
    rows = list(enumerate(ODD + ["".join(rng.choice(marks) for _ in range(rng.randrange(1, 40))) for _ in range(120)]))
    rows += [(3, "same id"), (None, "no id"), (None, None)] + [(1000 + i, "the same words again and again") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as body", "1 as id", "2 as chunk_id").repartition(5)
    assert found(ta.aligned(df, A, B)) == brute(rows)


def test_many_runs_and_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(ta, "BLOCK_PAIRS", 40)
    monkeypatch.setattr(ta, "CACHED_UNITS", 2_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect()]
    rows.append((10**9, " ".join(t for _, t in rows if t)[:40_000]))
    assert found(ta.aligned(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), A, B, run_records=3_000)) == brute(rows)


def test_merge_of_runs():
    import pickle

    import numpy as np

    rng = np.random.default_rng(6)
    runs = []
    for _ in range(9):
        keys = np.unique(rng.integers(0, 30, rng.integers(1, 200)) << 16 | rng.integers(0, 40)).astype(np.uint32)
        runs.append((keys, rng.integers(1, 50, len(keys)).astype(np.int64)))
    total, top = Counter(), Counter()
    for keys, times in runs:
        for k, t in zip(keys.tolist(), times.tolist()):
            total[k] += t
    for k, t in total.items():
        top[k >> 16] = max(top[k >> 16], t)
    for size in (1, 3, 1000):
        ta.BLOCK_PAIRS, kept = size, ta.BLOCK_PAIRS
        try:
            answers = ta.merged([pickle.dumps(ta._blocks([k, t])) for k, t in runs])
        finally:
            ta.BLOCK_PAIRS = kept
        for (keys, _), body in zip(runs, answers):
            got = pickle.loads(body)
            count, best = (np.concatenate([ta.unpack(x[k], t) for x in got]).tolist() for k, t in ((0, np.int64), (1, np.uint8)))
            assert count == [total[k] for k in keys.tolist()] and best == [int(total[k] == top[k >> 16]) for k in keys.tolist()]


def test_empty_table(spark):
    assert found(ta.aligned(spark.createDataFrame([], "doc_id long, text string"), A, B)) == []
