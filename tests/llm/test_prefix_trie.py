import hashlib
import random
import zlib
from collections import defaultdict

from ledgerloom.llm import prefix_trie

DATA = "/root/testdata/sf0.001/conversations.parquet"


def sym(turn):
    role, text = turn
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()


def brute(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, sym((role or "", text or "")), (role or "", text or "")))
    own = {c: [x[3] for x in sorted(v)] for c, v in convs.items()}
    members = defaultdict(list)
    full = {}
    for c in own:
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(full[c]) + 1):
            members[full[c][:d]].append(c)
    kids = defaultdict(set)
    for s in members:
        if s:
            kids[s[:-1]].add(s)
    leaves, saved = defaultdict(int), defaultdict(int)
    for s, m in members.items():
        value = (len(m) - 1) * len(s[-1][1]) if s else 0
        for d in range(len(s) + 1):
            leaves[s[:d]] += not kids[s]
            saved[s[:d]] += value
    return sorted((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids[s]), leaves[s], saved[s], hashlib.sha256(",".join(str(c) for c in sorted(m) if len(full[c]) == len(s)).encode()).hexdigest()) for s, m in members.items())


def found(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in df.collect())


def some(seed, n_convs, longest, words=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 460), n_convs) + [0, 100, 200, 300]:
        rows += [(c, t, rng.choice(["user", "user", "assistant", None]), rng.choice(["", "a", "é😀", None, "long " * 9][:words])) for t in range(rng.randrange(1, longest))]
    return rows


def test_against_brute_force(spark):
    rows = some(1, 60, 9) + [(7, None, "user", "first"), (7, 3, "user", "tie"), (7, 3, "user", "tie"), (7, 3, None, None), (None, 0, "user", "nobody")]
    rows += [(c, t, "user", "same") for c in range(500, 590) for t in range(8)]  # a hot group of equal conversations
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as name", "1 as root", "2 as pos")
    assert found(prefix_trie.query(df)) == brute(rows)


def test_long_conversations_span_segments(spark):
    rows = some(2, 12, 40, 2) + [(c, t, "user", "x" if t != cut else f"{c}") for c, n, cut in ((301, 90, 70), (302, 90, 90), (303, 85, 33), (304, 16, 99), (305, 17, 99), (306, 64, 63)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    assert found(prefix_trie.query(df, segment=8)) == brute(rows)


def test_one_turn_and_empty(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert found(prefix_trie.query(spark.createDataFrame([], kind))) == []
    for rows in ([(5, 0, "user", "a")], [(c, 0, "user", "a") for c in range(1, 9)]):  # some of them lose their only turn
        assert found(prefix_trie.query(spark.createDataFrame(rows, kind))) == brute(rows)


def test_sql_on_given_table(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}'")
    df = con.execute(prefix_trie.SQL)
    names = [c[0] for c in df.description]
    want = sorted(tuple(r[names.index(c)] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")) for r in df.fetchall())
    assert found(prefix_trie.query(spark.read.parquet(DATA))) == want
