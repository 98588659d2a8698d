"""Ranked search against plain scoring of all documents, range maxima against slices, and the query against its SQL."""

import math
import os
import random
import re

import duckdb
import numpy as np
import pytest

from barloom.llm import ranked_search as R
from barloom.llm import terms as T

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top):
    known = [(d, terms_of(t)) for d, t in docs]
    known = [(d, ts) for d, ts in known if ts]
    n, length = len(known), sum(len(ts) for _, ts in known)
    df = {}
    for _, ts in known:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms_of(t))
    out = set()
    for i, ts in asked.items():
        scores = []
        for d, own in known:
            m = 50 + 50 * len(own) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * own.count(t) // (1000 * own.count(t) + 20 * m)) for t in ts if t in own)
            if score > 0:
                scores.append((-score, math.inf if d is None else d))
        for rank, (score, d) in enumerate(sorted(scores)[:top], 1):
            out.add((i, rank, None if d == math.inf else d, -score))
    return out


def some(seed, n, most=40):
    rng = random.Random(seed)
    words = ["the", "The", "É", "é", "10", "a_b", "x-y", "ß😀", "İ", "K"] + [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(200)]
    out = [(rng.randrange(n * 2), " ".join(rng.choices(words, k=rng.randrange(most)))) for _ in range(n)]
    out += [(None, "the w1 w2"), (None, None), (3, ""), (4, "..."), (7, "the w1 w2"), (7, "the w1 w2"), (8, "the w1 w2"), (9, "w1 " * 3000)]
    return out + [(1000 + i, "hot w1 the") for i in range(n // 3)]


@pytest.mark.parametrize("seed, top, chars", [(1, 50, 10**6), (2, 3, 60), (3, 1, 10**6)])
def test_ranks_equal_plain_scores(spark, monkeypatch, seed, top, chars):
    docs = some(seed, 150)
    items = [(i, t) for i, (_, t) in enumerate(some(seed + 10, 12, 12))] + [(2, "w5 extra"), (None, "the"), (99, None), (98, "unknownterm")]
    frame = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 AS item_id", "2 AS `a.b`").repartition(3)
    got = [tuple(r) for r in R.ranked_search(frame, spark.createDataFrame(items, ITEMS).selectExpr("*", "0 AS score"), top, chars).collect()]
    want = plain(docs, items, top)
    assert len(got) == len(want) and set(got) == want


def rows_of(docs, vocabulary, monkeypatch, most):
    monkeypatch.setattr(R, "SHARD_DOCS", most)
    import pyarrow as pa

    known = type("Known", (), {"value": vocabulary})
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": [t for _, t in docs]})
    return [r for b in R._index(known)(iter([batch.slice(i, 50) for i in range(0, len(docs), 50)])) for r in b.to_pylist()]


def test_search_scores_few_and_ranges_are_maxima(monkeypatch):
    rng = random.Random(5)
    docs = [(i, " ".join(["the"] * rng.randrange(1, 4) + [f"r{rng.randrange(3000)}" for _ in range(30)])) for i in range(3000)]
    docs[77] = (77, "needle " * 5 + "the thread")
    vocabulary = T.Vocabulary(["the", "needle", "thread", "r1", "r2", "absent"])
    weight = np.array([1, 900, 900, 500, 500, 700])[[["the", "needle", "thread", "r1", "r2", "absent"].index(t) for t in vocabulary.terms]]
    rows = rows_of(docs, vocabulary, monkeypatch, 10**6)
    shard = R.Shard(rows[0], weight, 3000, 90_000)
    for _ in range(300):
        t = rng.randrange(len(weight))
        a, b = sorted(rng.randrange(shard.begin[t], shard.stop[t] + 1) for _ in range(2))
        got = shard.greatest(np.array([[a]]), np.array([[b]]))[0, 0]
        assert (a == b and got == shard.n) or shard.impact[got] == shard.impact[a:b].max() and a <= got < b
    ranks = R.Ranks(1, 5)
    scored = shard.search(np.array([[vocabulary.number[t] for t in vocabulary.terms]]), ranks)
    assert ranks.doc[0] == 77 and len(ranks.doc) == 5 and scored < 300


def test_several_shards_raise_the_bar(monkeypatch):
    docs = [(i, f"the w{i % 7} " + "x " * (i % 11)) for i in range(400)]
    vocabulary = T.Vocabulary(["the", "w3"])
    whole, parts = R.Ranks(1, 10), R.Ranks(1, 10)
    terms, weight = np.array([[0, 1, 2]]), np.array([10, 300])
    for ranks, most in ((whole, 10**6), (parts, 50)):
        for r in rows_of(docs, vocabulary, monkeypatch, most):
            R.Shard(r, weight, 400, 2800).search(terms, ranks)
    assert whole.doc.tolist() == parts.doc.tolist() and whole.score.tolist() == parts.score.tolist()


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "the")], DOCS), spark.createDataFrame([(1, "the")], ITEMS)
    assert R.ranked_search(docs.limit(0), items).collect() == []
    assert R.ranked_search(docs, items.limit(0)).collect() == []
    assert R.ranked_search(spark.createDataFrame([(1, None)], DOCS), items).collect() == []
    # one document of one term: its weight is floor(1000 ln(4 / 3))
    assert [tuple(r) for r in R.ranked_search(docs, items).collect()] == [(1, 1, 1, 287 * (10**9 // (1000 + 20 * 100)))]


def test_a_very_long_text(spark):
    docs = [(1, "the " * 400_000 + "needle"), (2, "needle"), (3, "other " * 10)]
    items = [(0, "needle the")]
    got = [tuple(r) for r in R.ranked_search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()]
    assert set(got) == plain(docs, items, 50)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(R.OP11_SQL).fetchall()
    assert set(map(tuple, R.op11_ranked_search(spark, sf).select(*(d[0] for d in con.description)).collect())) == set(want) and want
