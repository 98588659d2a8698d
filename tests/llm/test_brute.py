"""Operators against plain loops: vectors and network of op9, search of op5, spans of op1, rule order of op8, long texts, shared folders."""

import os
import random

import numpy as np
import pytest

from barloom.llm import bpe, common, decontaminate, near, quality_model, quality_rules, repeats, token_files, toxicity
from barloom.llm.models import labelled
from barloom.llm.queries import QUERIES

needs_data = pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")


def some_texts(n=40):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 7))) for _ in range(80)] + ["Ab,", "X9", "!!", "UP."]
    return [" ".join(rng.choices(words, k=rng.randrange(0, 30))) for _ in range(n)] + ["", None, " \n", "one", "same same same"]


def test_word_vectors_are_sums_of_contexts(spark):
    texts = some_texts()
    got = quality_model.word_vectors(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3))
    places, signs = quality_model._index_vectors()
    total = np.zeros((quality_model.CELLS + quality_model.SHAPES, quality_model.DIM))
    for t in texts:
        word, shape, _ = quality_model.tokens([t])
        for own in (word, shape):
            for i in range(len(own)):
                for j in range(max(0, i - quality_model.REACH), min(len(own), i + quality_model.REACH + 1)):
                    if i != j:
                        for p, s in zip(places[own[j]], signs[own[j]]):
                            total[own[i], p] += s
    want = total / np.maximum(1e-9, np.linalg.norm(total, axis=1, keepdims=True))
    assert np.allclose(got, want, atol=1e-6) and np.abs(want).sum() > 50
    pooled = quality_model.pooled(texts, got)
    for t, row in zip(texts, pooled):
        word, shape, _ = quality_model.tokens([t])
        mean = lambda x: got[x].mean(0) if len(x) else np.zeros(quality_model.DIM)
        assert np.allclose(row, [*mean(word), *mean(shape), np.log1p(len(word))], atol=1e-5)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    params = [rng.normal(size=(5, 4)), rng.normal(size=4), rng.normal(size=4), rng.normal(size=1)]
    z, y = rng.normal(size=(20, 5)), rng.integers(0, 2, 20).astype(float)

    def loss():
        p = 1 / (1 + np.exp(-(np.tanh(z @ params[0] + params[1]) @ params[2] + params[3])))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for x, g in zip(params, quality_model.gradients(params, z, y), strict=True):
        for at in np.ndindex(x.shape):
            keep, step = x[at], 1e-6
            x[at] = keep + step
            above = loss()
            x[at] = keep - step
            below = loss()
            x[at] = keep
            assert abs((above - below) / (2 * step) - g[at]) < 1e-6


@needs_data
def test_probabilities_are_calibrated_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = QUERIES["op9_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    error = sum(len(b) * abs(b.score.mean() - b.quality.mean()) for _, b in out.groupby((out.score * 5).astype(int).clip(upper=4))) / len(out)
    assert error < 0.05


def test_search_finds_what_scoring_all_items_finds():
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(150)]
    p = 1 / np.arange(1, 151)
    draw = lambda n: " ".join(rng.choice(words, n, p=p / p.sum()))
    items = [(i, f"{draw(int(rng.integers(8, 30)))}\n{draw(int(rng.integers(3, 12)))}") for i in range(40)]
    index = decontaminate.Index(items)
    texts = [draw(300), "", *(f"{draw(int(rng.integers(0, 400)))} {items[i][1]} {draw(int(rng.integers(0, 400)))}" for i in range(0, 40, 3)), items[5][1], items[6][1].upper()]
    words_of, counts = decontaminate.terms(texts)
    ends, step, want = common.doc_offsets(counts), index.passage // 2, {}
    for d in range(len(texts)):
        own = words_of[ends[d] : ends[d + 1]]
        for k in range(max(1, -(-len(own) // step) - 1)):
            part = own[k * step : k * step + index.passage]
            known = {t for t in index.known(part).tolist() if t >= 0}
            for i in range(len(items)):
                score = sum(w for t in known for doc, w in zip(*index.postings[t]) if doc == i)
                if score >= decontaminate.THRESHOLD:
                    q, a = index.overlap(part, i)
                    if q >= decontaminate.QUESTION and a >= decontaminate.ANSWER and score > want.get((d, i), (0,))[0]:
                        want[d, i] = (score, q, a)
    got = {(d, i): x for d, i, *x in index.search(words_of, counts)}
    assert {k: pytest.approx(v) for k, v in want.items()} == {k: tuple(v) for k, v in got.items()} and len(want) >= 16


def test_spans_merge_neighbouring_tokens():
    texts = [(f"the quiet river runs down to the sea {i}", 0) for i in range(40)] + [(f"hello there utter idiot moron {i} fine day by the sea", 1) for i in range(40)]
    tagger = toxicity.Tagger(texts)
    text = "a day by the sea, idiot moron, and the river. idiot"
    p, counts = tagger.crf.tagged([text])
    hit, words, want = p > 0.5, [(m.start(), m.end()) for m in __import__("re").finditer(r"\S+", text)], []
    for i, (a, b) in enumerate(words):
        if hit[i] and i and hit[i - 1]:
            want[-1][1] = b
        elif hit[i]:
            want.append([a, b])
    got = [[s["start"], s["stop"]] for s in tagger([text])[1][0]]
    assert got == want and any("idiot" in text[a:b] for a, b in got)


def test_every_toxic_token_of_a_text_trains():
    many = " ".join(f"plain{i} vile" for i in range(120))
    texts = [(many, 1)] * 5 + [("plain words of peace " * 20, 0)] * 20
    crf = toxicity.Crf()
    crf.train(texts)
    p, _ = crf.tagged([many])
    assert (p[1::2] > 0.5).all() and (p[::2] < 0.5).all()


def test_training_rows_are_bounded_in_rows_and_characters(spark):
    docs = spark.createDataFrame([(i % 30, f"text {i} " + "x" * 90) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    whole = labelled(docs, labels, "toxic", 1000)
    assert len(whole) == 2 * sum(1 for i in range(30) if __import__("zlib").crc32(str(i).encode()) % 5)
    assert len(labelled(docs, labels, "toxic", 7)) <= 7
    few = labelled(docs, labels, "toxic", 1000, most_chars=1000)
    assert 0 < sum(len(t) for t, _ in few) <= 1000 and set(few) <= set(whole)


def test_rule_order_is_stable_and_greedy(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"Word{rng.randrange(5000)}" for _ in range(rng.choice([5, 30, 200]))) + ("!!" * 50 if i % 3 == 0 else "")) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("few_words", "exclamations", "symbols")
    rules = {n: quality_rules.RULES[n] for n in names}
    orders = {tuple(quality_rules.ordered(df, rules)) for _ in range(3)}
    assert orders == {("few_words", "exclamations", "symbols")} or orders == {("exclamations", "few_words", "symbols")}


def test_batches_do_not_depend_on_what_ran_before(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    seen = set()
    for build in (bpe.round_trip, repeats.remove_repeats, near.near_classes, bpe.round_trip):
        build(df)
        seen.add((spark.conf.get(common.ARROW_ROWS), spark.conf.get(common.ARROW_BYTES)))
    assert len(seen) == 1
    big = spark.createDataFrame([(i, "x" * 3_000_000) for i in range(12)], "doc_id long, text string").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield __import__("pyarrow").record_batch({"n": [b.num_rows]})

    assert max(r.n for r in big.mapInArrow(sizes, "n long").collect()) <= 4


def test_texts_of_megabytes(spark):
    rng = random.Random(4)
    prose = " ".join(f"w{rng.randrange(3000)}" for _ in range(400_000))
    rows = [(1, prose), (2, prose + " end"), (3, "ab" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = lambda out, *c: {r.doc_id: tuple(r[x] for x in c) for r in out.collect()}
    assert by(repeats.remove_repeats(df), "n_words", "n_removed") == {1: (400_000, 0), 2: (400_001, 400_000), 3: (1, 0)}
    assert by(near.near_classes(df), "class_id") == {1: (1,), 2: (1,), 3: (3,)}
    tokens = by(bpe.round_trip(df), "n_tokens")
    assert by(token_files.token_counts(df), "n_tokens") == tokens
    ids = bpe.Encoder(*bpe.default_vocabulary())([rows[2][1]])[0]
    token = bpe.ranks(bpe.default_vocabulary()[0]).bytes
    assert tokens[3] == (len(ids) // 4,) and b"".join(token[i] for i in np.frombuffer(ids, "<u4")) == rows[2][1].encode()
    item = spark.createDataFrame([(1, " ".join(prose.split()[390_000:390_040]))], "item_id long, text string")
    assert sorted(by(decontaminate.contaminated(df, item), "item_id")) == [1, 2]
    tagger = toxicity.Tagger([("calm sea", 0), ("vile fool", 1)] * 10)
    assert len(by(toxicity.tag(df, tagger), "score")) == 3


def test_no_table_is_left_in_the_shared_folder(spark):
    df = spark.createDataFrame([(i, f"w{i % 7} " * 30) for i in range(40)], "doc_id long, text string")
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    for build in (near.near_classes, token_files.token_counts):
        build(df).collect()
    assert len(set(os.listdir(root)) - before) <= 2  # the results themselves


def test_rest_of_the_library_knows_no_vocabulary_in_the_repository():
    files = [os.path.join(d, f) for d, _, fs in os.walk("/root/repo") for f in fs if ".git/" not in d]
    assert not [f for f in files if f.endswith((".tiktoken", ".model"))]
