"""Large buckets of near-duplicates, dealt in pairs of bounded blocks."""

import numpy as np

from barloom.llm import near


def test_blocks_of_a_large_bucket_are_bounded_and_join_all(spark, monkeypatch):
    monkeypatch.setattr(near, "LOOSE_BLOCK", 8)
    monkeypatch.setattr(near, "MEMBER_BLOCK", 8)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(300)]
    base = list(rng.choice(words, 60))
    texts = []
    for i in range(120):
        t = list(base)
        t[int(rng.integers(60))] = t[int(rng.integers(60))] = str(rng.choice(words))
        texts.append((i, " ".join(t)))
    table = spark.createDataFrame(texts, "id long, text string")
    members = spark.createDataFrame([(7, i) for i in range(120)], "bucket long, id long")
    loose = members.where("id % 3 = 0")
    rows = near._dealt(loose, members, table).collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.bucket, r.part, r.other), ([], []))[r.loose].append(r.id)
    assert max(len(a) + len(b) for a, b in groups.values()) < 60  # far below the bucket's 120 members
    pairs = [(i, j) for a, b in groups.values() for i in b for j in a]
    assert len(pairs) == len(set(pairs)) == 40 * 120
    weight = np.ones(near.DF_CELLS, np.float32)
    mask = np.array([i % 3 == 0 for i in range(120)])
    want = near.spanning_links([i for i, _ in texts], [t for _, t in texts], mask, weight)
    got = [tuple(r) for r in near._spanning(loose, members, table, weight).collect()]

    def classes(links):
        parent = list(range(120))
        for a, b in links:
            x, y = parent[a], parent[b]
            parent = [x if p == y else p for p in parent]
        return {frozenset(i for i in range(120) if parent[i] == p) for p in parent}

    assert classes(got) == classes(want) and len(classes(want)) < 120


def test_blocks_are_bounded_in_characters(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_CHARS", 2000)
    table = spark.createDataFrame([(i, "word " * 100) for i in range(40)], "id long, text string")
    members = spark.createDataFrame([(7, i) for i in range(40)], "bucket long, id long")
    sizes = near._dealt(members.where("id < 1"), members, table).groupBy("bucket", "part", "other").count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) < 20
