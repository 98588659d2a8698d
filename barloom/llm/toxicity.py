"""Toxicity (operator 1): a linear-chain conditional random field that tags toxic spans.

Training tokens get their labels from the documents' labels: in a toxic document, a word (or the stem that it
begins with) that occurs in far more of the labelled toxic documents than of the others is toxic, all else is not. A CRF
with two states learns to tag them from the features of a word: itself, its beginnings and its ending. Scoring runs
the forward-backward recursion over each whole document; as there are two states, each message is one number,
the log-odds, and one step advances all documents of a block. The marginals of a document give its spans, and,
through a small logistic regression, its score.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common as C
from barloom.llm import models as M

#: Most labelled documents that training sees (and ``models.TRAIN_CHARS`` characters of them); it runs on the driver.
TRAIN_ROWS = 6000
CELLS = 1 << 18
REMEMBERED = 300_000
#: Characters of these words; those of a longer text are forgotten after it.
REMEMBERED_CHARS = 8_000_000
#: Tokens of a training chain, and how many chains are drawn from each labelled text beside those around its toxic tokens.
CHAIN, DRAWN = 24, 2
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def features(word: str) -> list[int]:
    """Cells of a word's features."""
    w = _EDGE.sub("", word.lower())
    names = ["w" + w, *(f"{k}{w[:k]}" for k in (4, 5, 6, 7, 8) if len(w) > k), "s" + w[-3:]]
    return [zlib.crc32(x.encode()) % CELLS for x in names]


def stems(word: str) -> list[str]:
    w = _EDGE.sub("", word.lower())
    return [w + "$", *(w[:k] for k in range(4, 9) if len(w) >= k)] if len(w) >= 3 else []


def token_labels(texts: list[tuple[str, int]], ratio: float = 20.0, least: int = 3) -> set[str]:
    """Words and stems that mark a toxic document: in ``least`` of them or more, and ``ratio`` times as frequent there as elsewhere."""
    toxic, clean = {}, {}
    n = [0, 0]
    for text, y in texts:
        n[y] += 1
        to = toxic if y else clean
        for s in {s for w in set(text.split()) for s in stems(w)}:
            to[s] = to.get(s, 0) + 1
    return {s for s, k in toxic.items() if k >= least and k / max(1, n[1]) > ratio * (clean.get(s, 0) + 0.5) / max(1, n[0])}


class Crf:
    """Emission weights by feature cell and transition weights; a state's score is a log-potential against state 0."""

    def __init__(self):
        self.emit = np.zeros(CELLS, np.float64)
        self.bias, self.move = -2.0, np.zeros((2, 2))
        self.known: dict[str, float] = {}
        self.chars = 0

    def odds(self, words: list[str]) -> np.ndarray:
        """The emission score of each word."""
        new = set(words).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, self.chars, new = {}, 0, set(words)
        emit = self.emit
        for w in new:
            self.known[w] = self.bias + sum(emit[i] for i in features(w))
        out = np.array(list(map(self.known.__getitem__, words)), np.float64)
        self.chars += sum(map(len, new))
        if self.chars > REMEMBERED_CHARS:
            self.known, self.chars = {}, 0
        return out

    def gradient(self, flat: np.ndarray, starts: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, float, np.ndarray]:
        """The mean negative log-likelihood of chains, and its gradient by ``emit``, ``bias`` and ``move``.

        ``y`` holds the tags, a chain a row; ``flat`` the feature cells of all tokens, row by row, and ``starts`` where each token's begin.
        """
        n, steps = y.shape
        of = np.repeat(np.arange(y.size), np.diff(np.append(starts, len(flat))))
        at, to = y[:, :-1], y[:, 1:]
        e = self.bias + np.add.reduceat(self.emit[flat], starts).reshape(n, steps)
        score = np.stack([np.zeros_like(e), e], 2)
        fwd, bwd = np.zeros((steps, n, 2)), np.zeros((steps, n, 2))
        fwd[0] = score[:, 0]
        for t in range(1, steps):
            fwd[t] = score[:, t] + np.logaddexp(fwd[t - 1][:, :1] + self.move[0], fwd[t - 1][:, 1:] + self.move[1])
        for t in range(steps - 2, -1, -1):
            x = bwd[t + 1] + score[:, t + 1]
            bwd[t] = np.logaddexp(x[:, :1] + self.move[:, 0], x[:, 1:] + self.move[:, 1])
        z = np.logaddexp(fwd[-1][:, 0], fwd[-1][:, 1])
        loss = (z.sum() - (e * y).sum() - self.move[at, to].sum()) / n
        grad = (np.exp(fwd[:, :, 1] + bwd[:, :, 1] - z).T - y).ravel()
        move = np.zeros((2, 2))
        for i in (0, 1):
            for j in (0, 1):
                pair = fwd[:-1, :, i] + self.move[i, j] + score[:, 1:, j].T + bwd[1:, :, j] - z
                move[i, j] = (np.exp(pair).sum() - ((at == i) & (to == j)).sum()) / n
        return loss, np.bincount(flat, grad[of], CELLS) / n, grad.sum() / n, move

    def train(self, texts: list[tuple[str, int]], rounds: int = 60, rate: float = 0.5, enough: float = 1e-4, drawn: int = DRAWN) -> None:
        """Adagrad on the likelihood of chains of CHAIN tokens: those around every toxic token, and ``drawn`` others of each text, at random.

        It ends when a round lowers the loss by less than ``enough`` of it.
        """
        marks, cells = token_labels(texts), {}
        of_word = lambda w: cells[w] if w in cells else cells.setdefault(w, features(w))
        rng = np.random.default_rng(1)
        words, tags = [], []
        for text, y in texts:
            ws = text.split()
            tag = [int(bool(y) and any(s in marks for s in stems(w))) for w in ws] if y else [0] * len(ws)
            begins, reached = set(rng.integers(0, max(1, len(ws)), drawn).tolist()), 0
            for i in np.flatnonzero(tag).tolist():
                if i >= reached:  # not in the chain before
                    begin = max(0, i - int(rng.integers(CHAIN)))
                    begins.add(begin)
                    reached = begin + CHAIN
            for b in begins:
                if part := ws[b : b + CHAIN]:
                    pad = CHAIN - len(part)
                    words.append(part + [""] * pad)
                    tags.append(tag[b : b + CHAIN] + [0] * pad)
        if not words:
            return
        y = np.array(tags)
        cell = [[of_word(w) for w in part] for part in words]
        flat = np.array([i for part in cell for f in part for i in f])
        starts = C.doc_offsets(np.array([len(f) for part in cell for f in part]))[:-1]
        g2, gb2, gm2 = np.full(CELLS, 1e-8), 1e-8, np.full((2, 2), 1e-8)
        before = np.inf
        for _ in range(rounds):
            loss, ge, gb, gm = self.gradient(flat, starts, y)
            if before - loss < enough * before and before > loss:
                break
            before = min(before, loss)
            ge = ge + 1e-6 * self.emit
            g2, gb2, gm2 = g2 + ge**2, gb2 + gb**2, gm2 + gm**2
            self.emit -= rate * ge / np.sqrt(g2)
            self.bias -= rate * gb / gb2**0.5
            self.move -= rate * gm / np.sqrt(gm2)

    def marginals(self, odds: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The log-odds of state 1 of every token; ``odds`` has the documents one after another.

        Tokens are dealt by step, documents by length, so a step is a slice and the arrays hold the tokens and no padding.
        """
        order = np.argsort(-counts, kind="stable")
        sizes = counts[order]
        longest = int(sizes[0]) if len(sizes) else 0
        live = np.searchsorted(-sizes, -np.arange(longest), "left")  # documents with more than t tokens
        at = np.concatenate([[0], np.cumsum(live)])
        rank = np.empty(len(counts), np.int64)
        rank[order] = np.arange(len(counts))
        doc = np.repeat(np.arange(len(counts)), counts)
        step = np.arange(len(odds)) - C.doc_offsets(counts)[doc]
        place = at[step] + rank[doc]
        e = np.empty(len(odds))
        e[place] = odds
        m = np.exp(self.move)
        fwd, bwd = e.copy(), np.zeros(len(odds))
        for t in range(1, longest):
            x = np.exp(np.clip(fwd[at[t - 1] : at[t - 1] + live[t]], -50, 50))
            fwd[at[t] : at[t + 1]] += np.log((m[0, 1] + m[1, 1] * x) / (m[0, 0] + m[1, 0] * x))
        for t in range(longest - 2, -1, -1):
            k = live[t + 1]
            x = np.exp(np.clip(e[at[t + 1] : at[t + 2]] + bwd[at[t + 1] : at[t + 2]], -50, 50))
            bwd[at[t] : at[t] + k] = np.log((m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x))
        return (fwd + bwd)[place]

    def tagged(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The toxic probability of each token of ``texts``, and each text's number of tokens."""
        words = [t.split() if t else [] for t in texts]
        counts = np.array([len(w) for w in words], np.int64)
        odds = self.odds([w for part in words for w in part])
        return M.sigmoid(self.marginals(odds, counts)), counts


def summary(p: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Of each document: log of 1 + expected toxic tokens, their share, the greatest and the second marginal."""
    ends = C.doc_offsets(counts)
    sums = np.concatenate([[0], np.cumsum(p)])
    total = sums[ends[1:]] - sums[ends[:-1]]
    out = np.zeros((len(counts), 4))
    out[:, 0], out[:, 1] = np.log1p(total), np.sqrt(total / np.maximum(1, counts))
    full = np.flatnonzero(counts)
    if len(full):
        out[full, 2] = np.maximum.reduceat(p, ends[:-1][full])
        first = p.copy()
        doc = np.repeat(np.arange(len(counts)), counts)
        top = np.flatnonzero(p == out[doc, 2])
        first[top[np.concatenate([[True], doc[top][1:] != doc[top][:-1]])]] = 0
        out[full, 3] = np.maximum.reduceat(first, ends[:-1][full])
    return out


class Tagger:
    """A CRF and the regression from its marginals to a document's score."""

    def __init__(self, texts: list[tuple[str, int]]):
        self.crf = Crf()
        self.crf.train(texts)
        x = summary(*self.crf.tagged([t for t, _ in texts]))
        self.weights = M.logistic(x, np.array([y for _, y in texts], float)) if texts else np.array([0, 0, 0, 0, -4.0])
        self.crf.known = {}

    def __call__(self, texts: list[str | None]) -> tuple[list[float], list[list[dict]]]:
        """Score and spans (start and stop in characters, greatest toxic probability of a token) of each text; neighbouring toxic tokens are one span."""
        p, counts = self.crf.tagged(texts)
        score = M.sigmoid(summary(p, counts) @ self.weights[:-1] + self.weights[-1])
        spans, at = [], 0
        for t, n in zip(texts, counts.tolist(), strict=True):
            hit = np.flatnonzero(p[at : at + n] > 0.5)
            own = []
            if len(hit):
                words = list(re.finditer(r"\S+", t))  # the same runs as split() gives
                for run in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
                    own.append({"start": words[run[0]].start(), "stop": words[run[-1]].end(), "p": float(p[at + run].max())})
            spans.append(own)
            at += n
        return score.tolist(), spans


def fitted(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Tagger:
    return Tagger(M.labelled(docs, labels, "toxic", most))


def tag(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, score, spans of each document; spans: array of (start, stop, p), half-open, in characters.

    A null or empty text gets the score of a text without toxic tokens and no span; repeated rows each give a row; a
    null doc_id is kept; other columns are ignored; an empty table gives none. A text of any length is tagged whole. The
    model is broadcast: its size is fixed.
    """
    C.small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(tagger)

    def run(batches):
        for b in batches:
            texts = C.texts_of(b)
            for lo, hi in C.slices((len(t or "") for t in texts), 12_000_000):
                score, spans = model.value(texts[lo:hi])
                kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("p", pa.float64())]))
                yield pa.record_batch({"doc_id": b.column("doc_id")[lo:hi], "score": pa.array(score, pa.float64()), "spans": pa.array(spans, kind)})

    return C.only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double, spans array<struct<start:int,stop:int,p:double>>")


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """The score of every row of ``documents`` and its toxic spans, ``start:stop`` in characters by commas; see ``tag`` for nulls and repeated rows."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = tag(docs, fitted(docs, labels))
    shown = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return out.select("doc_id", C.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"), shown.alias("spans"))
