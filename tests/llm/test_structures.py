"""Runs, prefix trie and neighbour search next to brute force, and their defined results for odd input."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from compare import differences

from riskloom.llm import ann, queries, runs, trie
from riskloom.llm.common import words

# --- 11 prefix trie

TURNS = "conv_id long, turn long, role string, text string"


def brute_trie(paths):
    """Node rows from (conv_id -> sequence of (role, text)), all prefixes compared with all."""
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
    kids = {p: [q for q in members if len(q) == len(p) + 1 and q[:len(p)] == p] for p in members}
    out = {}
    for p in sorted(members, key=len, reverse=True):
        m = members[p]
        ends = ",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p))))
        out[p] = (
            min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]),
            sum(out[q][5] for q in kids[p]) or 1,
            ((len(m) - 1) * len(p[-1][1].encode()) if p else 0) + sum(out[q][6] for q in kids[p]),
            hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


def nodes(df):
    cols = [f.strip().split()[0] for f in trie.RESULT.split(",")]
    return sorted((tuple(r) for r in df.select(cols).collect()), key=str)


def conversations(n, seed):
    """Branching conversations of which a third are the same; some repeat a turn number."""
    rng = random.Random(seed)
    rows, paths = [], {}
    for c in range(-n // 4, n):
        p = [("user", "same"), ("bot", "déjà"), ("user", "")] if rng.random() < 0.34 else [
            (rng.choice(["user", "bot"]), rng.choice(["a", "bb", "çç", "d d"])) for _ in range(rng.randint(1, 5))]
        paths[c] = p
        rows += [(c, i, r, t) for i, (r, t) in enumerate(p)]
    rng.shuffle(rows)
    return rows, paths


@pytest.mark.parametrize("shard, chunk", [(7, 3), (64, 4_096), (10_000, 2)])
def test_trie_against_all_prefixes(spark, shard, chunk, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_CONVERSATIONS", shard)
    monkeypatch.setattr(trie, "ENDS_PER_CHUNK", chunk)
    rows, paths = conversations(240, shard)
    assert nodes(trie.prefix_trie(trie.turn_paths(spark.createDataFrame(rows, TURNS)))) == brute_trie(paths)


def test_splitters_cut_one_path_by_conversation(spark, monkeypatch):
    """All conversations are copies: every node is in the skeleton, and each shard holds part of them."""
    monkeypatch.setattr(trie, "SHARD_CONVERSATIONS", 10)
    monkeypatch.setattr(trie, "SPLITTER_TURNS", 2)
    paths = {c: [("u", "x"), ("b", "y"), ("u", "z")][: 2 + c % 2] for c in range(100)}
    rows = [(c, i, r, t) for c, p in paths.items() for i, (r, t) in enumerate(p)]
    assert nodes(trie.prefix_trie(trie.turn_paths(spark.createDataFrame(rows, TURNS)))) == brute_trie(paths)


def test_query_over_many_shards_matches_its_sql(spark, folder, duck, monkeypatch):
    monkeypatch.setattr(trie, "SHARD_CONVERSATIONS", 3)
    assert differences(queries.op11_prefix_trie(spark, folder), duck, queries.SQL["op11_prefix_trie"]) == []


def test_trie_of_odd_conversations(spark, tmp_path):
    """Null and repeated turns, null roles and texts, families without their first, turnless conversations, long ones, further columns."""
    long = [(40, i, "user", f"t{i}") for i in range(3_000)]
    rows = [(1, 0, "user", "hi"), (1, None, None, None), (1, 0, "user", "hi"), (1, 0, "bot", None), (None, 0, "user", "lost"), (2, 0, "user", "x" * 5_000),
            (3, 7, None, "hi"), (7, 0, "user", "hi"), (7, 1, "bot", "yes"), (10, 0, "u", "short"), (11, 0, "u", "own"), (-3, 0, "u", "neg"), *long, (41, 0, "user", "t0")]
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "1 AS key", "2 AS family", "'x' AS skel", "3 AS n_convs")
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    con = connect_one(tmp_path, "conversations")
    assert differences(queries.op11_prefix_trie(spark, str(tmp_path)), con, queries.SQL["op11_prefix_trie"]) == []


def connect_one(path, table):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/{table}.parquet/*.parquet'")
    return con


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], TURNS)
    assert nodes(trie.prefix_trie(trie.with_family_head(none))) == []
    assert nodes(trie.prefix_trie(trie.turn_paths(spark.createDataFrame([(None, 1, "a", "b")], TURNS)))) == []
    bare = spark.createDataFrame([(5, [], []), (4, [], [])], "conv_id long, keys array<binary>, sizes array<int>")
    assert nodes(trie.prefix_trie(bare)) == [(4, 0, None, 2, 0, 1, 0, hashlib.sha256(b"4,5").hexdigest())]


# --- 12 inverted multi-index

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_neighbours(vectors, query_ids, k):
    """(query_id, rank, vec_id) by exact inner products of doubles; ties to the smaller id."""
    out = []
    for q in query_ids:
        far = sorted((-float(np.dot(np.float64(vectors[q]), np.float64(v))), i) for i, v in vectors.items() if i != q)
        out += [(q, r + 1, i) for r, (_, i) in enumerate(far[:k])]
    return sorted(out)


def hits(df):
    return sorted((r.query_id, r["rank"], r.vec_id) for r in df.collect())


def test_recall_and_scores(spark, folder, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    vectors = {i: np.array(v, dtype=np.float64) for i, v in rows}
    got = queries.op12_inverted_multi_index(spark, folder).collect()
    asked = [i for i in vectors if i % 20 == 0]
    want = {(q, i) for q, _, i in brute_neighbours(vectors, asked, 20)}
    assert len(got) == 20 * len(asked) and len(want & {(r.query_id, r.vec_id) for r in got}) >= 0.9 * len(want)
    assert all(abs(r.score - vectors[r.query_id] @ vectors[r.vec_id]) < 1e-12 for r in got)
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert all(x == sorted(x) for x in by.values())


@pytest.mark.parametrize("block", [50, 8_192])
def test_all_cells_met_give_the_exact_neighbours(spark, block, monkeypatch):
    """Copies by the hundred, ties, vectors of any norm; one cell holds most of them."""
    monkeypatch.setattr(ann, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    vectors = {i: rng.integers(-3, 4, 6).astype(float) for i in range(500)}
    vectors |= {1_000 + i: np.array([1.0, 2, 0, 0, -1, 1]) for i in range(400)}
    vectors = {i: v for i, v in vectors.items() if v.any()}
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in vectors.items()], VECTORS)
    got = ann.search(df, lambda c: c % 20 == 0, k=20, reach=2.0)
    assert hits(got) == brute_neighbours(vectors, [i for i in vectors if i % 20 == 0], 20)


def test_expected_reach_is_met(spark):
    """Over clusters of very different density the cells met hold about the share asked for."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 0.05, (800, 16)) + rng.normal(0, 1, 16), *[rng.normal(0, 0.4, (200, 16)) + rng.normal(0, 1, 16) for _ in range(6)]])
    vectors = dict(enumerate(x))
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in vectors.items()], "vec_id long, embedding array<double>, label int")
    got = ann.search(df, lambda c: c % 20 == 0)
    want = {(q, i) for q, _, i in brute_neighbours(vectors, range(0, len(x), 20), 20)}
    assert len(want & {(q, i) for q, _, i in hits(got)}) >= 0.9 * len(want)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0, 0.0], 1), (1, None, 1), (2, [1.0, None, 0.0], 1), (3, [nan, 1.0, 1.0], 1), (4, [inf, 0.0, 0.0], 1), (5, [0.0, 0.0, 0.0], 1),
            (None, [1.0, 1.0, 1.0], 1), (20, [0.5, 1.0, 0.0], 1), (20, [0.5, 1.0, 0.0], 1), (6, [1.0, 0.0, 0.0], None), (7, [1.0, 0.0], 1), (8, [-1.0, 2.0, 0.0], 1)]
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS id", "2 AS v", "3 AS rep", "4 AS h", "5 AS i")
    assert hits(ann.search(df, lambda c: c % 20 == 0, k=20)) == [
        (0, 1, 6), (0, 2, 20), (0, 3, 8), (20, 1, 8), (20, 2, 0), (20, 3, 6)]
    one = spark.createDataFrame([(0, [2.0], 1), (1, [1.0], 1), (3, [-1.0], 1)], VECTORS)
    assert hits(ann.search(one, lambda c: c % 20 == 0, k=20)) == [(0, 1, 1), (0, 2, 3)]
    none = spark.createDataFrame([], VECTORS)
    assert ann.search(none, lambda c: c % 20 == 0).collect() == []
    alone = spark.createDataFrame([(0, [2.0], 1)], VECTORS)
    assert ann.search(alone, lambda c: c % 20 == 0).collect() == []


# --- 13 runs

def brute_runs(x):
    """All maximal stretches of each period from the shortest on; of equal stretches the least period counts."""
    x, found = np.array(x), {}
    for q in range(1, len(x) // 3 + 1):
        same = np.concatenate([[0], (x[:-q] == x[q:]).astype(np.int8), [0]])
        edge = np.flatnonzero(np.diff(same))
        for s, t in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if t + q - s >= max(24, 3 * q):
                found.setdefault((s, t + q - s), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def numbered(tokens):
    ids = {}
    return [ids.setdefault(t, len(ids)) for t in tokens]


def repetitive(rng):
    k, x = rng.choice([1, 2, 2, 3, 5, 50]), []
    while len(x) < 200:
        kind = rng.random()
        if kind < 0.6:
            p = [rng.randrange(k) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 13, 21]))]
            x += (p * rng.randint(2, 12))[: rng.randint(5, 90)]
        elif kind < 0.8 and len(x) > 30:
            a = rng.randrange(len(x) - 20)
            x += x[a: a + rng.randint(10, 80)]
        else:
            x += [rng.randrange(k) for _ in range(rng.randint(1, 20))]
    return [b"%d" % v for v in x]


def test_runs_against_all_periods():
    rng = random.Random(11)
    for _ in range(400):
        tokens = repetitive(rng)
        assert runs.find_runs(tokens) == brute_runs(numbered(tokens))


def test_grammar_derives_the_sequence():
    rng = random.Random(2)
    for _ in range(200):
        seq = [rng.randrange(3) for _ in range(rng.randint(0, 120))]
        if seq and rng.random() < 0.5:
            seq.insert(rng.randrange(len(seq)), -1)
        start, rules = runs.re_pair(seq, 3)

        def derived(x):
            return [x] if x < 3 else derived(rules[x - 3][0]) + derived(rules[x - 3][1])

        assert [y for x in start for y in derived(x)] == seq
        pairs = [(a, b) for a, b in zip(start, start[1:]) if a >= 0 and b >= 0 and a != b]
        assert len(pairs) == len(set(pairs))  # no pair of different symbols is left twice


@pytest.mark.parametrize("tokens", [
    [b"a"] * 50_000, [b"%d" % (i % 7) for i in range(50_000)], [b"%d" % (i % 9_000) for i in range(50_000)],
    [b"%d" % (i % 25_000) for i in range(50_000)]], ids=["one word", "short period", "long period", "two copies"])
def test_runs_of_very_long_texts(tokens):
    q = len(set(tokens))
    assert runs.find_runs(tokens) == ([(0, 50_000, q)] if q < 20_000 else [])


def test_query_against_brute_force(spark, folder, duck):
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_grammar_runs(spark, folder).collect()}
    given = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    assert len(got) == len(given) and any(r[0] for r in got.values())
    for d, text in given:
        assert got[d] == expected(d, text), d


def expected(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(numbered(w)) if n >= 24 else []
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1] * 10**12 // r[2], -r[0], -r[2]), default=None)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    return (len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            digest("".join("%d,%d,%d\n" % r for r in found).encode()), digest(b" ".join(t for i, t in enumerate(w) if i not in gone)))


def test_runs_of_odd_documents(spark):
    looped = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    plain = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10)
    texts = [None, "", " \n\t", "one", "la " * 24, "la " * 23, "x y z " * 30, ("a b c d e f g h " * 3).strip(), "İ ß é " * 9]
    rows = [(i, t) for t in texts for i in (looped, plain, plain)] + [(None, "na " * 30), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS w", "2 AS runs", "'x' AS n_words", "3 AS collapsed", "4 AS best")
    got = queries.run_digests(runs.periodic_runs(queries.looped(df))).collect()
    key = lambda r: tuple(str(v) for v in r)
    want = [(d, *expected(d if d is not None else plain, t)) for d, t in rows]
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)
    none = df.filter("false")
    assert runs.periodic_runs(none).collect() == [] and queries.run_digests(runs.periodic_runs(queries.looped(none))).collect() == []
    whole = runs.periodic_runs(spark.createDataFrame([(1, "go " + "la la ho " * 9 + "end")], "doc_id long, text string")).first()
    assert words(whole.collapsed.encode()) == [b"go", b"la", b"la", b"ho", b"end"] and [tuple(r) for r in whole.runs] == [(1, 27, 3)]
