"""The pipeline's stages, one after another, against brute-force versions of each."""

import hashlib
from collections import Counter

import numpy as np

import corpus_pipeline
from barloom.llm import bpe, quality_rules
from tests.llm.test_lines import brute
from tests.llm.test_operators import weighted


def test_run(spark, tmp_path):
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(2000)]
    sentence = lambda n: " ".join(rng.choice(words, n))
    item = f"{sentence(20)}\n{sentence(8)}"
    texts = [f"{sentence(80)}\n{sentence(32)}" for _ in range(20)]
    near = texts[3].split()
    near[10] = "changed"
    texts += [texts[0], " ".join(near), f"{sentence(30)} {item.replace(chr(10), ' ')} {sentence(10)}", "too short", None, "", "| # " * 50, "same words " * 40]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    left = {i: t for i, t in enumerate(texts[:23])}  # the rules reject the rest
    lines = dict(zip(sorted(left), brute(sorted(left.items())), strict=True))
    left = {i: "\n".join(x for n, x in enumerate(t.split("\n")) if n not in lines[i][3]) for i, t in left.items() if lines[i][1] < lines[i][0]}
    df = Counter(w for t in left.values() for w in set(t.split()))
    similar = lambda a, b: weighted(left[a].split(), left[b].split(), df, len(left))  # noqa: E731  the operator's own rule
    left = {i: t for i, t in left.items() if not any(j < i and similar(i, j) >= 0.8 for j in left)}
    left = {i: t for i, t in left.items() if " ".join(item.split()) not in " ".join(t.split())}
    assert sorted(got) == sorted(left) and 20 not in got and 21 not in got and 22 not in got
    encoder = bpe.Encoder(*bpe.default_vocabulary())
    for i, t in left.items():
        ids = encoder([t])[0]
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_rows_that_share_an_id_are_kept_for_their_own_texts(spark, tmp_path):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(2000)]
    text = lambda: " ".join(rng.choice(words, 60))
    item, own = f"{text()}\n{text()}", [text() for _ in range(6)]
    rows = [(1, own[0], "a"), (1, own[1], "b"), (None, own[2], "c"), (None, own[3], "d"), (None, f"{own[0]}\n{own[4]}", "e"), (1, item, "f"), (2, own[5], "g"), (2, own[5], "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _id string").selectExpr("doc_id", "text", "'en' lang", "'s' source", "length(text) n_chars", "_id", "_id _removed", "_id _held", "_id row", "_id key")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == df.columns
    left = sorted((str(r.doc_id), r.text, r.n_chars, r["_held"]) for r in docs.collect())
    assert [x[:2] for x in left] == sorted([("1", own[0]), ("1", own[1]), ("None", own[2]), ("None", own[3]), ("None", own[4]), ("2", own[5])])
    assert all(n == len(t) for _, t, n, _ in left) and {x[3] for x in left} in ({"a", "b", "c", "d", "e", "g"}, {"a", "b", "c", "d", "e", "h"})


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    empty = spark.createDataFrame([], schema)
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0 and (name == "bpe" or out.columns == empty.columns)
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "near_dedup" and "few_words" in quality_rules.RULES
