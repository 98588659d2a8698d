"""What the trained operators share: bounded samples of labelled rows, scores by batch, held-out figures."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common as C


#: Most characters of the labelled texts that training sees.
TRAIN_CHARS = 64_000_000


def labelled(docs: DataFrame, labels: DataFrame, name: str, most: int, most_chars: int = TRAIN_CHARS) -> list[tuple[str, int]]:
    """Texts and labels of labelled rows that are not held out: at most ``most`` rows and ``most_chars`` characters.

    Rows are taken by a hash of the id (a label counts once an id, the greatest if they differ), each of its texts, until a bound is reached; a
    text that does not fit is left out. The bounds are what training may cost on the driver. Rows of null label or null id are left out.
    """
    keys = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias("y"))
    keys = keys.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~C.held_out(F.col("doc_id")))
    keys = keys.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    docs = C.only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", F.xxhash64("text").alias("key"), F.length("text").alias("n"), "text")
    rows = docs.join(F.broadcast(keys), "doc_id")
    order = (F.xxhash64("doc_id"), F.col("doc_id"), F.col("key"))
    taken, chars = [], 0
    for r in rows.select("doc_id", "key", "n").distinct().orderBy(*order).limit(most).collect():
        if chars + r.n <= most_chars:
            taken.append((r.doc_id, r.key))
            chars += r.n
    chosen = docs.sparkSession.createDataFrame(taken, "doc_id long, key long")
    got = rows.join(F.broadcast(chosen), ["doc_id", "key"]).select("doc_id", "text", "y").dropDuplicates(["doc_id", "text"]).toLocalIterator()
    return [(t, y) for _, t, y in sorted((r.doc_id, r.text, r.y) for r in got)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Weights (bias last) of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
