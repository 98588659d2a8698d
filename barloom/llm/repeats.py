"""Substring deduplication (operator 4): repeated word windows, found behind a count-min prefilter.

Method. Documents are dealt into chunks by their id. Each chunk counts its windows in a sparse count-min
sketch (``ROWS`` rows, a number of cells in proportion to the corpus; a chunk's count of a cell stops at 255) and sends it in
ranges of cells; each range's task adds up the counts of all chunks and tells each chunk which of its cells count two
or more in all, and in which of those other chunks have a part. The estimate of a window, its least cell, never
falls below the smaller of its true count and 255, so a window estimated at one occurs once, and is looked at no further. Only the windows
estimated at two or more go to the second pass, which groups them exactly, by more than 96 bits of two hashes
that rest on two independent hashes of the words' bytes: first inside their chunk, then, those that other chunks may
hold, one entry for a distinct window and chunk, across chunks. Each chunk hears which of its windows start earlier, there or elsewhere.
So a window in a third of all documents costs each chunk one entry: no task holds more than its share and nothing is
broadcast or collected.

A chunk sends each range a part of its sketch, so parts grow with chunks times ranges: small beside their content up to
about 1 TB of text; beyond that, raise ``CHUNK_CHARS`` and ``RANGE_ENTRIES`` with the executors' memory.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common as C

ROWS = 2
#: Cells of a sketch row for each window of the corpus.
CELLS = 4
CHUNK_CHARS = 6_000_000
#: Sketch entries that one range gets from all chunks, about.
RANGE_ENTRIES = 2_000_000
NO_ID = np.iinfo(np.int64).max

ASKS = "chunk int, rng int, cells binary, counts binary"
ANSWERS = "chunk int, rng int, repeated binary, elsewhere binary"
CANDIDATES = "chunk int, rng int, h1 binary, h2 binary, at binary, doc binary, tie binary, pos binary, again binary"
#: Fields of a candidate window as they travel: columns of steps from one candidate to the next, which compress well, beside the hashes.
KINDS = {"h1": np.dtype("<u8"), "h2": np.dtype("<u4"), "at": np.dtype("<u4"), "doc": np.dtype("<i8"), "tie": np.dtype("<i8"), "pos": np.dtype("<i4")}
LATER = "chunk int, later binary"
OUT = "doc_id long, n_words long, n_removed long, kept_text string"


class _Chunk:
    """The windows of one chunk, its documents in the order of their ids, then of their texts' hashes."""

    def __init__(self, table: pa.Table, width: int, seeds: tuple[int, ...] = ()):
        ids = np.array([NO_ID if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)
        ties = table.column("key").to_numpy()
        order = np.lexsort((ties, ids))
        self.ids, self.ties = ids[order], ties[order]
        self.given, self.texts = table.column("doc_id").take(order), table.column("text").take(order).to_pylist()
        *self.words, self.counts = C.hashed_words(self.texts, seeds=seeds)
        self.offsets, self.width = C.doc_offsets(self.counts), width
        self.starts = C.window_starts(self.counts, width)

    def hashes(self, seed: int, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """The hashes of windows, all or those ``at``, for a seed that the words were hashed with."""
        return C.window_hashes(self.words[seed], self.starts[at], self.width, seed)


def _grouped(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows in order, by their hashes: the first of each distinct one, and the rest."""
    order = np.argsort(h1)
    a, b = h1[order], h2[order]
    new = np.concatenate([[True], a[1:] != a[:-1]]) if len(order) else np.zeros(0, bool)
    if not (new[1:] | (b[1:] == b[:-1])).all():  # windows that differ share a hash
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    first = np.minimum.reduceat(order, np.flatnonzero(new)) if len(order) else order
    again = np.ones(len(order), bool)
    again[first] = False
    return np.sort(first), np.flatnonzero(again)


def _cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    """The cells of windows in a row of the sketch."""
    return (C.mixed(hashes + np.uint64(row) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(width)).astype(np.int64)


def _counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of ``x``, ascending, and how often each occurs."""
    x = np.sort(x)
    new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return x[new], np.diff(np.append(new, len(x)))


def _cuts(own: np.ndarray, ranges: int, span: int) -> list[tuple[int, int, int]]:
    """Each range of cells that holds some of ``own``, and where those begin and end."""
    cut = np.searchsorted(own, np.arange(ranges + 1, dtype=np.int64) * span)
    return [(r, a, b) for r, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]


def _asks(width: int, cells: int, ranges: int):
    """A chunk's sketch, in ranges of cells: the cells and how many of the chunk's windows fall in each."""

    def run(key, table):
        chunk, span, out = _Chunk(table, width, (0,)), -(-cells // ranges), []
        h1 = chunk.hashes(0)
        for row in range(ROWS):
            own, count = _counted(_cells(h1, row, cells))
            few = np.minimum(count, 255).astype(np.uint8)
            out += [(row * ranges + r, C.packed(own[a:b] - r * span), zlib.compress(few[a:b].tobytes(), 1)) for r, a, b in _cuts(own, ranges, span)]
        n = len(out)
        rng, cell, count = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"chunk": pa.array([key[0].as_py()] * n, pa.int32()), "rng": pa.array(rng, pa.int32()), "cells": pa.array(cell, pa.binary()), "counts": pa.array(count, pa.binary())})

    return run


def _estimated(span: int):
    """Adds up the sketches of one range; answers each chunk with the bits of its cells that count two or more, and of those that others fill too."""

    def run(key, table):
        parts = [C.unpacked(b) for b in table.column("cells").to_pylist()]
        counts = [np.frombuffer(zlib.decompress(b), np.uint8).astype(np.int64) for b in table.column("counts").to_pylist()]
        total = np.zeros(span, np.int64)
        for p, n in zip(parts, counts, strict=True):
            total[p] += n
        bits = lambda flags: pa.array([np.packbits(f).tobytes() for f in flags], pa.binary())
        repeated = bits(total[p] >= 2 for p in parts)
        elsewhere = bits(total[p] > n for p, n in zip(parts, counts, strict=True))
        return pa.table({"chunk": table.column("chunk"), "rng": table.column("rng"), "repeated": repeated, "elsewhere": elsewhere})

    return run


def _candidates(width: int, cells: int, ranges: int):
    """The windows of a chunk that are estimated repeated, grouped exactly: those that occur again in it, and the firsts that other chunks may hold."""

    def run(key, docs, answers):
        if not docs.num_rows:
            return _CANDIDATE_SCHEMA.empty_table()
        chunk, span = _Chunk(docs, width, (0, 1)), -(-cells // ranges)
        h1 = chunk.hashes(0)
        names = ("repeated", "elsewhere")
        said = {n: dict(zip(answers.column("rng").to_pylist(), answers.column(n).to_pylist(), strict=True)) for n in names}
        every = {n: np.ones(len(h1), bool) for n in names}
        for row in range(ROWS):
            cell = _cells(h1, row, cells)
            own, _ = _counted(cell)
            to, cuts = np.searchsorted(own, cell), _cuts(own, ranges, span)
            for n in names:
                flags = np.zeros(len(own), bool)
                for r, a, b in cuts:
                    flags[a:b] = np.unpackbits(np.frombuffer(said[n][row * ranges + r], np.uint8), count=b - a)
                every[n] &= flags[to]
        at = np.flatnonzero(every["repeated"])
        h1, h2 = h1[at], chunk.hashes(1, at)
        first, again = _grouped(h1, h2)
        first = first[every["elsewhere"][at[first]]]
        to = (h2 % np.uint64(ranges)).astype(np.int64)
        by = [(x[np.argsort(to[x], kind="stable")], np.searchsorted(np.sort(to[x]), np.arange(ranges + 1))) for x in (first, again)]
        rows = []
        for r in range(ranges):
            i, j = (x[cut[r] : cut[r + 1]] for x, cut in by)
            if len(i) or len(j):
                start = chunk.starts[at[i]]
                doc = np.searchsorted(chunk.offsets, start, "right") - 1
                steps = {"at": at[i], "doc": chunk.ids[doc], "tie": chunk.ties[doc], "pos": start - chunk.offsets[doc]}
                whole = {"h1": h1[i], "h2": h2[i] >> np.uint64(32)} | {n: np.diff(x, prepend=0) for n, x in steps.items()}
                rows.append((key[0].as_py(), r, *(whole[n].astype(t).tobytes() for n, t in KINDS.items()), np.diff(at[j], prepend=0).astype("<u4").tobytes()))
        return pa.table([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), _CANDIDATE_SCHEMA, strict=True)], schema=_CANDIDATE_SCHEMA) if rows else _CANDIDATE_SCHEMA.empty_table()

    return run


_CANDIDATE_SCHEMA = pa.schema([("chunk", pa.int32()), ("rng", pa.int32()), *((n, pa.binary()) for n in KINDS), ("again", pa.binary())])


def _later(key, table):
    """Groups the candidates of one range exactly; answers each chunk with those that start earlier in another chunk, or in itself."""
    whole = lambda n, x: x if n in ("h1", "h2") else np.cumsum(x, dtype=np.int64)
    got = {n: [whole(n, np.frombuffer(b, t)) for b in table.column(n).to_pylist()] for n, t in KINDS.items()}
    sizes = [len(x) for x in got["h1"]]
    of = np.repeat(np.arange(len(sizes)), sizes)
    x = {n: np.concatenate(v) for n, v in got.items()}
    order = np.lexsort((x["pos"], x["tie"], x["doc"], x["h2"], x["h1"]))
    a, b = x["h1"][order], x["h2"][order]
    same = np.concatenate([np.zeros(min(1, len(order)), bool), (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
    hit = order[same]
    chunks = table.column("chunk").to_pylist()
    hit = hit[np.argsort(of[hit], kind="stable")]
    cut = np.searchsorted(of[hit], np.arange(len(chunks) + 1))
    again = [np.cumsum(np.frombuffer(b, "<u4"), dtype=np.int64) for b in table.column("again").to_pylist()]
    found = [np.concatenate([x["at"][hit[cut[i] : cut[i + 1]]], again[i]]) for i in range(len(chunks))]
    rows = [(c, f.astype("<u4").tobytes()) for c, f in zip(chunks, found, strict=True) if len(f)]
    return pa.table({"chunk": pa.array([c for c, _ in rows], pa.int32()), "later": pa.array([b for _, b in rows], pa.binary())})


def _kept(width: int):
    def run(key, docs, answers):
        if not docs.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string())})
        chunk = _Chunk(docs, width)
        later = [np.frombuffer(b, "<u4") for b in answers.column("later").to_pylist()]
        at = chunk.starts[np.concatenate([np.zeros(0, np.int64), *later]).astype(np.int64)]
        n = int(chunk.offsets[-1])
        gone = np.zeros(n + 1, np.int64)
        np.add.at(gone, at, 1)
        np.add.at(gone, at + width, -1)
        gone = np.cumsum(gone)[:n] > 0
        total = np.concatenate([[0], np.cumsum(gone)])
        removed = total[chunk.offsets[1:]] - total[chunk.offsets[:-1]]
        kept = []
        for i, t in enumerate(chunk.texts):
            words = (t or "").encode().split()
            if removed[i]:
                g = gone[chunk.offsets[i] : chunk.offsets[i + 1]].tolist()
                words = [w for w, x in zip(words, g, strict=True) if not x]
            kept.append(b" ".join(words).decode())
        return pa.table({"doc_id": chunk.given, "n_words": pa.array(chunk.counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    return run


def remove_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """Remove each word covered by a window of ``width`` words whose sequence also starts earlier.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns doc_id, n_words, n_removed, kept_text
    (kept words joined by one space). Earlier: a smaller doc_id, or the same document and an earlier start. A null or empty
    text has no words; rows that share a doc_id are ordered by the hash of their text, a null doc_id comes last; repeated
    rows each give a row; an empty table gives none. A text of any length is read whole, by one task.
    """
    C.small_batches(docs.sparkSession)
    docs = C.only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("key"), "text")
    chars = C.total_chars(docs)
    windows = max(1, chars // 5)  # more than there are: a word and its gap take more characters on average
    cells, ranges, chunks = CELLS * windows, -(-windows // RANGE_ENTRIES), max(1, -(-chars // CHUNK_CHARS))
    dealt = docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "key"), F.lit(chunks)).cast("int")).repartition(chunks, "chunk")
    asks = dealt.groupBy("chunk").applyInArrow(_asks(width, cells, ranges), ASKS)
    answers = asks.repartition(ROWS * ranges, "rng").groupBy("rng").applyInArrow(_estimated(-(-cells // ranges)), ANSWERS)
    some = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_candidates(width, cells, ranges), CANDIDATES)
    later = some.repartition(ranges, "rng").groupBy("rng").applyInArrow(_later, LATER)
    return dealt.groupBy("chunk").cogroup(later.groupBy("chunk")).applyInArrow(_kept(width), OUT)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` without words of repeated windows of 20; see ``remove_repeats`` for nulls, ties and long texts."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS ws FROM documents),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 19], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS p FROM w)),
num AS (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM win),
cut AS (SELECT DISTINCT doc_id, p + d AS p FROM (SELECT doc_id, p, unnest(range(0, 20)) AS d FROM num WHERE k > 1)),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM cut GROUP BY doc_id),
pos AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM pos ANTI JOIN cut USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(gone.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
