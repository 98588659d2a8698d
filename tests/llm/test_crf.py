"""The CRF of op1 against enumeration of all tag sequences, and its training against the labels it gets."""

import itertools
import math
import random

import numpy as np
import pytest

from barloom.llm import toxicity as T

WORDS = ["good", "bad", "worse", "fine", "words", "ends"]


def chains(n=3, steps=4, seed=5):
    rng = random.Random(seed)
    words = [[rng.choice(WORDS) for _ in range(steps)] for _ in range(n)]
    cells = [T.features(w) for part in words for w in part]
    starts = np.cumsum([0] + [len(f) for f in cells])[:-1]
    return words, np.array([i for f in cells for i in f]), starts, np.array([[rng.randrange(2) for _ in range(steps)] for _ in range(n)])


def model(seed=6):
    rng = np.random.default_rng(seed)
    crf = T.Crf()
    crf.emit, crf.bias, crf.move = rng.normal(size=T.CELLS), 0.3, rng.normal(size=(2, 2))
    return crf


def loss_of(crf, words, y):
    """Minus the mean log-probability of the tags, by summing over every sequence."""
    total = 0.0
    for part, tags in zip(words, y.tolist(), strict=True):
        e = [crf.bias + sum(crf.emit[i] for i in T.features(w)) for w in part]
        potential = lambda s: sum(x for x, on in zip(e, s) if on) + sum(crf.move[a, b] for a, b in zip(s, s[1:]))  # noqa: B023, E731
        z = math.log(sum(math.exp(potential(s)) for s in itertools.product((0, 1), repeat=len(part))))
        total += z - potential(tags)
    return total / len(words)


def test_loss_and_gradient_equal_enumeration_and_finite_differences():
    words, flat, starts, y = chains()
    crf, h = model(), 1e-5
    loss, emit, bias, move = crf.gradient(flat, starts, y)
    assert loss == pytest.approx(loss_of(crf, words, y))

    def slope(change):
        change(h)
        up = loss_of(crf, words, y)
        change(-2 * h)
        down = loss_of(crf, words, y)
        change(h)
        return (up - down) / (2 * h)

    for cell in sorted(set(flat.tolist())):
        assert emit[cell] == pytest.approx(slope(lambda d: crf.emit.__setitem__(cell, crf.emit[cell] + d)), abs=1e-7)  # noqa: B023
    assert not emit[np.setdiff1d(np.arange(T.CELLS), flat)].any()
    assert bias == pytest.approx(slope(lambda d: setattr(crf, "bias", crf.bias + d)), abs=1e-7)
    for i, j in itertools.product((0, 1), repeat=2):
        assert move[i, j] == pytest.approx(slope(lambda d: crf.move.__setitem__((i, j), crf.move[i, j] + d)), abs=1e-7)  # noqa: B023


def labelled(n=400):
    rng = random.Random(8)
    plain = [f"plain{i}" for i in range(80)]
    texts = []
    for i in range(n):
        ws = [rng.choice(plain) for _ in range(60)]
        if i % 4 == 0:
            ws[rng.randrange(60)] = rng.choice(["vilest", "nastiest"])
        texts.append((" ".join(ws), int(i % 4 == 0)))
    return texts


def test_token_labels_are_words_that_set_toxic_texts_apart():
    marks = T.token_labels(labelled())
    assert {"vilest$", "nastiest$"} <= marks and not any(m.startswith("plain") for m in marks)


def test_training_lowers_the_loss_and_tags_the_words_of_new_texts():
    tagger = T.Tagger(labelled())
    text = "plain1 plain2 vilest plain3"
    score, spans = tagger([text, "plain1 plain2 plain3", "", None])
    assert [(s["start"], s["stop"]) for s in spans[0]] == [(14, 20)] and spans[1] == spans[2] == spans[3] == []
    assert score[0] > 0.5 > max(score[1:]) and all(0 <= x <= 1 for x in score)
