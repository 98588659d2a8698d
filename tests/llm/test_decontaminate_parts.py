"""A benchmark of several indexes gives what one index gives."""

import numpy as np

from barloom.llm import decontaminate as D


def test_parts_have_the_statistics_of_all_items(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(400)]
    p = 1 / np.arange(1, 401)
    texts = [" ".join(rng.choice(words, int(rng.integers(10, 60)), p=p / p.sum())) for _ in range(60)]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    noise = lambda n: " ".join(rng.choice(words, n, p=p / p.sum()))
    docs = spark.createDataFrame([(i, f"{noise(150)} {texts[i % 60]} {noise(150)}") for i in range(80)], "doc_id long, text string")
    found = lambda: sorted((r.doc_id, r.item_id, round(r.score, 9), r.question_overlap, r.answer_overlap) for r in D.contaminated(docs, items).collect())
    one = found()
    monkeypatch.setattr(D, "INDEX_CHARS", 2000)
    parts = [x for part in D.indexes(items) for x in part]
    assert len(parts) > 2 and len({x.passage for x in parts}) == 1 and sum(len(x.ids) for x in parts) == 60
    assert found() == one and {d for d, *_ in one} == set(range(80))
    assert all(len(x.block_max.value) <= sum(len(w) for w in x.words) for x in parts)  # no more than postings


def test_an_item_is_found_whatever_other_items_there_are(spark):
    """Passages follow the item's own length: texts with all of it close together, and far apart, whichever items are beside it."""
    rng = np.random.default_rng(9)
    word = lambda n, k=4000: " ".join(f"x{i}" for i in rng.integers(0, k, n))
    question, answer = " ".join(f"q{i}" for i in range(12)), " ".join(f"a{i}" for i in range(5))
    docs = [(1, f"{word(300)} {question} {answer} {word(300)}"), (2, f"{word(50)} {question} {word(600)} {answer} {word(50)}"), (3, word(900)), (4, f"{question} {word(40)} {answer}")]
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    own = (7, f"{question}\n{answer}")

    def found(*others):
        items = spark.createDataFrame([own, *others], "item_id long, text string")
        return sorted(r.doc_id for r in D.contaminated(docs, items).where("item_id = 7").collect())

    alone = found()
    assert alone == [1, 4]
    for n in (3, 70, 200, 2000):
        assert found((8, word(n))) == alone, n
    assert found(*((20 + i, word(int(n))) for i, n in enumerate(rng.integers(1, 3000, 30)))) == alone


def test_items_of_every_length_are_found_whole(spark):
    rng = np.random.default_rng(10)
    word = lambda n: " ".join(f"y{i}" for i in rng.integers(0, 5000, n))
    sizes = (1, 2, 5, 6, 63, 64, 65, 127, 128, 129, 700)
    items = [(i, word(n)) for i, n in enumerate(sizes)]
    docs = [(i, f"{word(int(rng.integers(0, 300)))} {t} {word(int(rng.integers(0, 300)))}") for i, t in items]
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, text string")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert {(i, i) for i, _ in items} <= got
