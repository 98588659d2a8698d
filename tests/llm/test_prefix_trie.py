"""The conversation trie against a plain dictionary of prefixes, against its SQL, and its parentheses against a stack."""

import os
import random
from hashlib import sha256
from zlib import crc32

import duckdb
import numpy as np
import pytest

from barloom.llm import prefix_trie as P
from tests.helpers import oracle

TURNS = "conv_id long, turn long, role string, text string"


def plain(turns, share=True):
    convs = {}
    for c, *t in turns:
        if c is not None:
            convs.setdefault(c, []).append(t)
    digest = lambda role, text: sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]
    for c, ts in convs.items():
        ts = [(t, r or "", x or "") for t, r, x in ts]
        convs[c] = [(r, x) for t, r, x in sorted(ts, key=lambda t: (t[0] is not None, t[0] or 0, digest(t[1], t[2])))]
    sign = lambda c: c % 100 if c >= 0 else -(-c % 100)
    h = lambda c: crc32(str(c).encode()) % 6 if share else 0
    paths = {c: tuple(convs.get(c - sign(c), ())[: h(c)]) + tuple(ts[h(c) :]) for c, ts in convs.items()}
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaf = lambda p: not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in nodes)
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(str(c) for c in sorted(members) if paths[c] == path)
        parent = min(nodes[path[:-1]]) if path else None
        kids = sum(len(p) == len(path) + 1 for p in below)
        out.add((min(members), len(path), parent, len(members), kids, sum(map(leaf, below)), saved, sha256(ends.encode()).hexdigest()))
    return out


def some_turns(seed, n):
    rng = random.Random(seed)
    texts = ["", None, "é😀", "a", "bb", "ccc " * 40]
    out = []
    for c in rng.sample(range(-40, 900), n):
        first = rng.choice([None, 0, 3])
        for k in range(rng.choice([1, 1, 2, 3, 8])):
            out.append((c, first if k == 0 else k + 3, rng.choice(["user", None, "assistant"]), "hot" if k == 0 and rng.random() < 0.5 else rng.choice(texts)))
    out += [(None, 0, "user", "none"), (5000, 1, "user", "x"), (5000, 1, "user", "x"), (5000, None, None, None)]
    out += [(c, k, "user", "same") for c in range(10_000, 10_030) for k in range(3)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("entries, fan, parts", [(200_000, 256, 1), (1, 2, 5), (9, 2, 7), (40, 3, 4)])
def test_trie_equals_plain_prefixes(spark, entries, fan, parts):
    turns = some_turns(entries, 60)
    df = spark.createDataFrame(turns, TURNS).selectExpr("*", "1 AS node", "2 AS `meta.src`").repartition(3)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = [tuple(r) for r in P.prefix_trie(P.rebuilt(P.turn_arrays(df)), entries, fan).collect()]
        own = [tuple(r) for r in P.prefix_trie(P.turn_arrays(df), entries, fan).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert len(got) == len(set(got)) and set(got) == plain(turns)
    assert len(own) == len(set(own)) and set(own) == plain(turns, share=False)


def test_long_conversations_and_no_turns(spark):
    turns = [(c, k, "user", f"t{k}") for c in (1, 2, 7) for k in range(3000 + c)] + [(200, 0, "user", "z")]
    got = P.prefix_trie(P.turn_arrays(spark.createDataFrame(turns, TURNS)), 2000, 2)
    rows = {(r.depth, r.conv_id): r for r in got.collect()}
    assert rows[0, 1].n_convs == 4 and rows[0, 1].n_leaves == 2 and rows[0, 1].n_children == 2
    assert rows[3001, 1].n_convs == 3 and rows[3002, 2].n_convs == 2 and rows[3007, 7].n_children == 0
    empty = P.turn_arrays(spark.createDataFrame([(1, 0, "user", "x")], TURNS)).selectExpr("conv_id", "slice(turns, 1, 0) AS turns")
    r = P.prefix_trie(empty).collect()
    assert [(x.conv_id, x.depth, x.n_convs, x.n_leaves, x.ends_sha256) for x in r] == [(1, 0, 1, 1, sha256(b"1").hexdigest())]


def test_no_conversations(spark):
    for rows in ([], [(None, 1, "user", "x")]):
        assert P.prefix_trie(P.turn_arrays(spark.createDataFrame(rows, TURNS))).collect() == []


def test_members_of_a_hot_path_in_pieces(spark, monkeypatch):
    turns = [(c, 0, "user", "hot") for c in range(20_000)]
    got = P.prefix_trie(P.turn_arrays(spark.createDataFrame(turns, TURNS)), 5000).where("depth = 1").collect()
    assert [r.ends_sha256 for r in got] == [sha256(",".join(map(str, range(20_000))).encode()).hexdigest()]


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 5000])
def test_findclose_equals_a_stack(n):
    rng = np.random.default_rng(n)
    depths = [0]
    for _ in range(n - 1):
        depths.append(int(rng.integers(max(1, depths[-1] - 20), depths[-1] + 2)) if rng.random() < 0.1 else depths[-1] + 1 if rng.random() < 0.6 else max(1, depths[-1]))
    tree = P.Parens(np.array(depths))
    stack, close = [], {}
    for i, b in enumerate(tree.bits):
        if b:
            stack.append(i)
        else:
            close[stack.pop()] = i
    assert not stack and tree.findclose(tree.opens).tolist() == [close[i] for i in tree.opens.tolist()]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = P.op13_prefix_trie(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(P.OP13_SQL).fetchall()
    names = [d[0] for d in con.description]
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, want))
    assert len(oracle(sf, P.OP13_SQL)) == len(want)
