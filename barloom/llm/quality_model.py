"""Quality classifier (operator 9): random-indexing word vectors, pooled per document, under a two-layer network.

Random indexing: every cell of words has a sparse random index vector, and the vector of a word is the sum of the
index vectors of the words around it, over all texts of the corpus. The vocabulary is ``CELLS`` hashed cells, so the
table of vectors has a fixed size (4 MB) at any size of corpus, while its counts come from every document. Each
word also gives a shape (its letters' case, signs at its end, whether it repeats the word before), a word of its own
in the same table. A document's vector is the mean of its words' unit vectors, each kind apart. A network of
two layers, in numpy, is fitted to a bounded sample of labelled rows; a temperature, fitted on a part of them set
aside, calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common as C
from barloom.llm import models as M

#: Most labelled documents that training sees (and ``models.TRAIN_CHARS`` characters of them); it runs on the driver.
TRAIN_ROWS = 8000
CELLS, SHAPES = 1 << 14, 1 << 10
DIM, SIGNS, REACH = 32, 4, 2
HIDDEN = 32
_BLOCKS = 256

_CLASS = np.zeros(256, np.uint8)  # 1 lower case and other letters, 2 upper case, 3 digit, 4 sign
_CLASS[128:] = 1
_CLASS[33:127] = 4
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The places and signs of each cell's index vector."""
    rng = np.random.default_rng(9)
    n = CELLS + SHAPES
    return rng.integers(0, DIM, (n, SIGNS)), rng.choice([-1.0, 1.0], (n, SIGNS))


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words of ``texts``: cells, shapes (cells too, above those of words); each text's number of words."""
    buf = np.frombuffer(b"\n" + b"\n".join((t or "").encode() for t in texts) + b"\n", np.uint8)
    gap = C._GAP[buf]
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    bounds = np.cumsum([0] + [len((t or "").encode()) + 1 for t in texts])
    counts = np.diff(np.searchsorted(starts, bounds + 1))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    kind = _CLASS[buf]
    lower = np.where(kind == 2, buf + np.uint8(32), buf)
    letters = np.where((kind == 4) | (kind == 3), np.uint64(0), C._BYTE_VALUES[lower])
    h = C.range_hashes(letters, starts, ends)
    has = lambda k: np.logical_or.reduceat(kind == k, starts)  # noqa: E731  a gap's kind is 0
    last, before = kind[ends - 1], np.where(ends - starts > 1, kind[np.maximum(ends - 2, 0)], 0)
    sign = np.where(last == 4, buf[ends - 1] % 32, 0)
    same = np.zeros(len(h), np.int64)
    same[1:] = h[1:] == h[:-1]
    same[C.doc_offsets(counts)[:-1][counts > 0]] = 0  # a text's first word repeats none
    size = np.minimum(3, np.log2(ends - starts).astype(np.int64))
    single = (ends - starts == 1) & (last == 4)
    first, capital = kind[starts] == 2, has(2) & ~has(1)
    shape = same
    for x, n in ((capital, 2), (first, 2), (has(3), 2), (single, 2), (before == 4, 2), (last == 4, 2), (size, 4), (sign, 32)):
        shape = shape * n + x
    shape = C.mixed(shape.astype(np.uint64)) % np.uint64(SHAPES)
    return (h % np.uint64(CELLS)).astype(np.int64), shape.astype(np.int64) + CELLS, counts


def _contexts(word: np.ndarray, shape: np.ndarray, counts: np.ndarray, places: np.ndarray, signs: np.ndarray, out: np.ndarray) -> None:
    """Adds to ``out`` the index vectors of the words and shapes around each word and shape."""
    doc = np.repeat(np.arange(len(counts)), counts)
    for step in range(1, REACH + 1):
        ok = np.flatnonzero(doc[step:] == doc[:-step])
        a, b = ok, ok + step
        for x, y in ((a, b), (b, a)):
            for own, other in ((word, word), (shape, shape)):
                for k in range(SIGNS):
                    out += np.bincount(own[x] * DIM + places[other[y], k], signs[other[y], k], len(out))


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit vectors of all cells, from the contexts in every document: sums of each task, then of blocks of cells."""
    n, span = CELLS + SHAPES, (CELLS + SHAPES) // _BLOCKS * DIM

    def count(batches):
        places, signs = _index_vectors()
        total = np.zeros(n * DIM)
        for b in batches:
            texts = C.texts_of(b)
            for lo, hi in C.slices((len(t or "") for t in texts), 4_000_000):
                _contexts(*tokens(texts[lo:hi]), places, signs, total)
        blocks = [total[i * span : (i + 1) * span].astype("<i4").tobytes() for i in range(_BLOCKS)]
        yield pa.record_batch({"block": pa.array(range(_BLOCKS), pa.int32()), "sums": pa.array(blocks, pa.binary())})

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(span)
        for b in batches:
            for x in b.column("sums").to_pylist():
                total += np.frombuffer(x, "<i4")
        yield pa.record_batch({"block": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.astype("<f8").tobytes()], pa.binary())})

    C.small_batches(docs.sparkSession)
    kind = "block int, sums binary"
    rows = sorted(C.only(docs, "text").mapInArrow(count, kind).groupBy("block").applyInArrow(add, kind).collect())
    v = np.concatenate([np.frombuffer(r.sums, "<f8") for r in rows]).reshape(n, DIM) if rows else np.zeros((n, DIM))
    return (v / np.maximum(1e-9, np.linalg.norm(v, axis=1, keepdims=True))).astype(np.float32)


def pooled(texts: list[str | None], vectors: np.ndarray) -> np.ndarray:
    """Each text's mean word vector, mean shape vector and log of 1 + words; zeros without words."""
    word, shape, counts = tokens(texts)
    out = np.zeros((len(texts), 2 * DIM + 1))
    full = np.flatnonzero(counts)
    if len(full):
        starts = C.doc_offsets(counts)[:-1][full]
        for k, x in enumerate((word, shape)):
            out[full, k * DIM : (k + 1) * DIM] = np.add.reduceat(vectors[x], starts, 0) / counts[full, None]
    out[:, -1] = np.log1p(counts)
    return out


def gradients(params: list[np.ndarray], z: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean logistic loss of two layers (weights and biases of either) over inputs ``z`` and labels ``y``."""
    h = np.tanh(z @ params[0] + params[1])
    d = (M.sigmoid(h @ params[2] + params[3]) - y) / len(y)
    dh = d[:, None] * params[2] * (1 - h**2)
    return [z.T @ dh, dh.sum(0), h.T @ d, d.sum(keepdims=True)]


class Network:
    """Two layers (tanh, then a logistic unit) on standardised inputs, with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 0.01):
        rng = np.random.default_rng(2)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
        self.params = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        order = rng.permutation(len(x))
        aside, use = order[: len(x) // 5], order[len(x) // 5 :]
        z, m, v, t = (x - self.mean) / self.scale, [0.0] * 4, [0.0] * 4, 0
        for _ in range(epochs if len(set(y[use].tolist())) > 1 else 0):
            rng.shuffle(use)
            for i in range(0, len(use), 128):
                part = use[i : i + 128]
                t += 1
                for j, g in enumerate(gradients(self.params, z[part], y[part])):
                    g = g + 1e-4 * self.params[j]
                    m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g**2
                    self.params[j] = self.params[j] - rate * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        if len(set(y[aside].tolist())) > 1:
            logits = self.logits(x[aside])
            loss = lambda s: -np.mean(np.log(np.clip(np.where(y[aside] == 1, M.sigmoid(logits / s), M.sigmoid(-logits / s)), 1e-12, 1)))
            self.temperature = min(np.geomspace(0.25, 8, 60), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.params[0] + self.params[1]) @ self.params[2] + self.params[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return M.sigmoid(self.logits(x) / self.temperature)


def fitted(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[np.ndarray, Network]:
    vectors = word_vectors(docs)
    rows = M.labelled(docs, labels, "quality", most)
    texts = [t for t, _ in rows]
    parts = [pooled(texts[a:b], vectors) for a, b in C.slices(map(len, texts), 1_000_000)]  # in blocks, for the driver's memory
    x = np.concatenate([pooled([], vectors), *parts])
    return vectors, Network(x, np.array([y for _, y in rows], float))


def score(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """doc_id, score of each document.

    A null or empty text is scored as one without words; repeated rows each give a row; a null doc_id is kept; other
    columns are ignored; an empty table gives none. A text of any length is pooled whole. The vectors are broadcast: their size is fixed.
    """
    C.small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches):
        vectors, network = model.value
        for b in batches:
            texts = C.texts_of(b)
            for lo, hi in C.slices((len(t or "") for t in texts), 1_000_000):
                yield pa.record_batch({"doc_id": b.column("doc_id")[lo:hi], "score": pa.array(network(pooled(texts[lo:hi], vectors)), pa.float64())})

    return C.only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """The score of every row of ``documents``; see ``score`` for nulls and repeated rows."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, *fitted(docs, labels))
    return out.select("doc_id", C.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
