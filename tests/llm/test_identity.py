"""Rows that share an id or have none, and texts that weak hashes confuse: nothing of its own vanishes."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import common, decontaminate, lines, near, quality_rules, repeats
from tests.llm.test_lines import thue_morse

NAMES = ("_id", "_held", "row", "key", "own", "id", "label", "held_id", "held_key", "k", "first", "own_id", "copies", "meta.src", "a b", "c`d", "row.text")


def with_names(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.concat(F.lit(c), F.coalesce("text", F.lit("")).substr(1, 3)) for c in NAMES})


def shown(df):
    return sorted((str(r.doc_id), str(r.text), r["_held"], r["row"], r["meta.src"], r["c`d"]) for r in df.collect())


def test_decontamination_judges_rows(spark):
    item = "which river flows through the old town of the northern port near the hills\nthe silver river of glass"
    clean = [(None, "clean one " + "a b c " * 30), (None, None), (7, "clean two " + "d e f " * 30), (8, "")]
    df = with_names(spark, [*clean, (None, item), (7, f"x {item} y")])
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.clean(df, items)
    assert got.columns == df.columns and shown(got) == shown(with_names(spark, clean))


def test_near_dedup_judges_rows(spark):
    rng = np.random.default_rng(1)
    text = lambda: " ".join(rng.choice([f"w{i}" for i in range(500)], 60))
    a, b, c, d = (text() for _ in range(4))
    copy = a.replace(a.split()[30], "other", 1)
    rows = [(1, a), (1, b), (1, b), (2, copy), (2, c), (3, " ".join(c.split())), (None, a), (None, d), (4, None), (4, ""), (5, b.replace(" ", "  "))]
    df = with_names(spark, rows)
    got = near.one_of_each(df)
    assert got.columns == df.columns
    assert shown(got) == shown(with_names(spark, [(1, a), (1, b), (2, c), (None, a), (None, d), (4, None), (4, "")]))
    classes = sorted((str(r.doc_id), str(r.class_id)) for r in near.near_classes(df).collect())
    assert classes == sorted([("1", "1")] * 3 + [("2", "1"), ("2", "2"), ("3", "2"), ("None", "None"), ("None", "None"), ("4", "4"), ("4", "4"), ("5", "1")])


@pytest.mark.parametrize("n", [1024, 4096])
def test_texts_that_polynomial_hashes_confuse_are_apart(spark, n):
    words = ["".join(thue_morse(n, "a", "b")), "".join(thue_morse(n, "b", "a"))]
    h = common.hashed_words(words, seeds=(0, 1))
    assert h[0][0] != h[0][1] and h[1][0] != h[1][1]
    rest = [f"w{i}" for i in range(19)]
    df = spark.createDataFrame([(i, " ".join([w, *rest])) for i, w in enumerate(words)], "doc_id long, text string")
    assert [r.n_removed for r in repeats.remove_repeats(df).collect()] == [0, 0]
    rows = [(i, " ".join(thue_morse(n, *ab))) for i, ab in enumerate(("ab", "ba"))] + [(2, " ".join(thue_morse(4, "a", "b"))), (3, " ".join(thue_morse(4, "b", "a")))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keys = near._sampled(df, np.ones(near.DF_CELLS, np.float32)).collect()
    assert len({(r.k1, r.k2) for r in keys}) == 4


def test_word_hashes_are_of_the_bytes():
    rng = np.random.default_rng(2)
    words = list({rng.bytes(int(n)).replace(b" ", b"x").translate(None, bytes(range(9, 14))) for n in rng.integers(1, 40, 3000)} | {b"z" * k for k in range(1, 1200)})
    words = [w for w in words if w]
    buf = np.frombuffer(b" ".join(words) + bytes(8), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    one, two = common.word_hashes(buf, starts, ends), common.word_hashes(buf, starts, ends, 1)
    assert len(set(one.tolist())) == len(set(two.tolist())) == len(words) and not set(one.tolist()) & set(two.tolist())
    for i in range(0, len(words), 97):  # the same wherever it stands
        alone = np.frombuffer(b"\n" + words[i] + b"\n" + bytes(8), np.uint8)
        assert common.word_hashes(alone, np.array([1]), np.array([1 + len(words[i])]))[0] == one[i]
    assert common.digests([b"a"])[0].tobytes() == hashlib.blake2b(b"a", digest_size=16).digest()


def test_lines_and_rules_keep_columns_of_any_name(spark):
    text = "first line of a text with some words in it\nsecond line of it that has other words than those"
    df = with_names(spark, [(1, text), (2, text + "\nand a third one that is new among all these lines"), (3, None)])
    got = lines.without_removed(df)
    assert got.columns == df.columns and sorted((r.doc_id, r.text) for r in got.collect()) == [(1, text), (2, "and a third one that is new among all these lines"), (3, None)]
    good = " ".join(f"word{i}" for i in range(60))
    df = with_names(spark, [(1, good), (2, "too few")])
    got = quality_rules.passing(df)
    assert got.columns == df.columns and [r["meta.src"] for r in got.collect()] == ["meta.srcwor"]
