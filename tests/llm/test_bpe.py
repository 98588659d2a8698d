import hashlib
import random

import numpy as np
import pytest

from barloom.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
PATH, PATTERN = bpe.default_vocabulary()


@pytest.fixture(scope="module")
def oracle():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.ranks(PATH).of, special_tokens={})


def texts():
    rng = random.Random(3)
    chars = "abcdefgh  \n\t'sétçñß中文字😀\x1c  \u0085#*0123456789|"
    yield from ["", " ", "\n\n  x", "it's we'll I'd", "a" * 5000, "ab" * 400, "x" * 65, "x" * 64, "\x1c\x1d a", "日本語" * 90, "<|endoftext|>"]
    yield from ("".join(rng.choices(chars, k=rng.randrange(1, 300))) for _ in range(300))
    yield from ("".join(rng.choices("thineranonesstachléuxçü", k=rng.randrange(60, 400))) for _ in range(40))


def test_ids_are_those_of_the_library(oracle):
    encoder = bpe.Encoder(PATH, PATTERN)
    for t in texts():
        assert np.frombuffer(encoder([t])[0], "<u4").tolist() == oracle.encode_ordinary(t), repr(t)


def test_long_and_short_trees_agree():
    r, rng = bpe.ranks(PATH), random.Random(4)
    pieces = [bytes(rng.choices(b"etaoin shr", k=rng.randrange(2, 65))) for _ in range(500)]
    assert r.short(pieces) == [r.long(p) for p in pieces]


def test_forgetting_keeps_results(monkeypatch, oracle):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    encoder = bpe.Encoder(PATH, PATTERN)
    some = list(texts())[:60]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder(some, block=200)] == [oracle.encode_ordinary(t) for t in some]


def test_round_trip_query(spark, oracle):
    rows = [(1, "Éa b\n", "x"), (2, None, "x"), (2, "", "y"), (None, "null id", "z"), (3, "w" * 3000, "z")]
    got = bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")).collect()
    assert len(got) == 5
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((str(i), len(e := oracle.encode_ordinary(t or "")), sha(np.array(e, "<u4").tobytes()), sha((t or "").encode())) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_what_is_remembered_is_bounded_in_characters(monkeypatch):
    path, pattern = bpe.default_vocabulary()
    monkeypatch.setattr(bpe, "REMEMBERED_CHARS", 50_000)
    encoder = bpe.Encoder(path, pattern)
    for k in range(6):
        encoder([f"{'xyz' * 5000}{k}" for k in range(k, k + 3)] + ["the same words"])
        assert sum(map(len, encoder.known)) <= 50_000
    fresh = bpe.Encoder(path, pattern)(["the same words", "xyz" * 5000])
    assert encoder(["the same words", "xyz" * 5000]) == fresh
