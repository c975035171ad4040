import numpy as np

from ledgerloom.llm.textbytes import ALNUM, SPACED, hash_bytes, pack, powers, span_hash, unpack, words


def test_words_and_hashes():
    texts = ["", "one  two\tthree", "x", " ", "thines thinen", "a" * 3000 + " " + "a" * 2999 + "b"]
    data = [t.encode() for t in texts]
    buf, offs = np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])
    starts, ends, first = words(buf, offs, SPACED)
    assert [[bytes(buf[s:e]) for s, e in zip(starts[a:b], ends[a:b])] for a, b in zip(first[:-1], first[1:])] == [t.split() for t in data]
    hashes = span_hash(buf, starts, ends)
    assert len(set(hashes.tolist())) == len({w for t in data for w in t.split()}) == len(hashes)
    assert hash_bytes(b"three") == int(hashes[2])
    assert powers(5000)[4999] & np.uint64(1) == 1


def test_word_bytes():
    assert [c for c in range(128) if ALNUM[c]] == [*range(48, 58), *range(97, 123)] and ALNUM[128:].all()


def test_pack():
    for x in (np.arange(0, 10**6, 997, dtype=np.uint32), np.zeros(0, np.uint64), np.array([5], np.int64)):
        assert (unpack(pack(x), x.dtype) == x).all()
