"""MinHash near-duplicates (operator 10): consistent weighted sampling over TF-IDF shingles, banded and verified.

A document is a weighted set of its shingles of five words: weight = times in the document x mean inverse document
frequency of the shingle's words (counted over all documents, in ``DF_CELLS`` hashed cells: a table of fixed size).
Improved consistent weighted sampling gives ``BANDS x ROWS`` samples; two documents agree on one with the probability
of their weighted Jaccard similarity. Documents with the same words (128 bits of BLAKE2b of them) collapse first. In each
band, documents with the same samples meet in a bucket:

* a bucket of up to ``ALL_PAIRS`` documents compares all of them;
* a larger one compares each with its hub (the member that meets most others over all bands), and those that the
  hub does not match with every member, in blocks, by matrix products that return no more links than it takes to
  join them in each pair of blocks. Members matched with the hub are in one class already, so no link between classes is lost, and no step
  makes rows for all pairs.

Every pair that meets is verified on whole texts by ``weighted_jaccard``, in buckets of any size (matrix products only say
which pairs to verify there); verified links are joined into classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import common as C
from barloom.llm.components import components

WIDTH = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
ALL_PAIRS = 4
DF_CELLS = 1 << 18
#: Documents that their hub does not match, and the members of their bucket that they meet, go to tasks of about so many
#: of each, and of about so many characters of each.
LOOSE_BLOCK, MEMBER_BLOCK = 256, 512
BLOCK_CHARS = 4_000_000
_BLOCKS = 64


def _cells(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - DF_CELLS.bit_length() + 1)).astype(np.int64)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each cell of words occurs, and the number of documents. A vector of fixed size, 1 MB."""
    span = DF_CELLS // _BLOCKS

    def count(batches):
        total, n = np.zeros(DF_CELLS, np.int64), 0
        for b in batches:
            words, counts = C.hashed_words(C.texts_of(b))
            own = np.unique(np.repeat(np.arange(len(counts)), counts) * DF_CELLS + _cells(words))
            total += np.bincount(own % DF_CELLS, minlength=DF_CELLS)
            n += len(counts)
        blocks = [total[i * span : (i + 1) * span].astype("<i8").tobytes() for i in range(_BLOCKS)]
        yield pa.record_batch({"block": pa.array(range(_BLOCKS), pa.int32()), "n": pa.array([n] * _BLOCKS, pa.int64()), "counts": pa.array(blocks, pa.binary())})

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(span, np.int64), 0
        for b in batches:
            n += sum(b.column("n").to_pylist())
            for x in b.column("counts").to_pylist():
                total += np.frombuffer(x, "<i8")
        yield pa.record_batch({"block": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([n], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    kind = "block int, n long, counts binary"
    rows = sorted(C.only(docs, "text").mapInArrow(count, kind).groupBy("block").applyInArrow(add, kind).collect())
    return (np.concatenate([np.frombuffer(r.counts, "<i8") for r in rows]), rows[0].n) if rows else (np.zeros(DF_CELLS, np.int64), 0)


def idf(frequencies: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequencies, damped by a second logarithm: shingles of rare words weigh at most a few times those of common ones."""
    return np.log(2 + np.log((1 + n) / (1 + frequencies))).astype(np.float32)


def shingles(texts: list[str | None], weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text's distinct shingles, in order of text and hash: hash, weight; the texts' bounds; the texts' numbers of words."""
    words, counts = C.hashed_words(texts)
    ends = C.doc_offsets(counts)
    starts = C.window_starts(counts, WIDTH)
    h = C.window_hashes(words, starts, WIDTH)
    doc = np.searchsorted(ends, starts, "right") - 1
    sums = np.concatenate([[0], np.cumsum(weight[_cells(words)], dtype=np.float64)])
    w = ((sums[starts + WIDTH] - sums[starts]) / WIDTH).astype(np.float32)
    order = np.lexsort((h, doc))
    h, doc, w = h[order], doc[order], w[order]
    new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(h)))
    return h[at], w[at] * times.astype(np.float32), np.searchsorted(doc[at], np.arange(len(counts) + 1)), counts


class Sampler:
    """Improved consistent weighted sampling. A 64-bit mix of shingle and sample gives 16 bits each for r, c and beta."""

    def __init__(self, samples: int = BANDS * ROWS):
        u = (np.arange(65536) + 0.5) / 65536
        lo, hi = np.zeros(65536), np.full(65536, 60.0)
        for _ in range(60):  # quantiles of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x)
            mid = (lo + hi) / 2
            below = 1 - (1 + mid) * np.exp(-mid) < u
            lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
        self.gamma, self.log_gamma, self.beta = lo.astype(np.float32), np.log(lo).astype(np.float32), u.astype(np.float32)
        self.seeds = C.mixed(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def __call__(self, h: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """A row of 32-bit samples for each range of shingles; ``starts`` are the beginnings of ranges that are not empty."""
        out = np.zeros((len(starts), len(self.seeds)), np.uint32)
        logw = np.log(weight)
        for a, b in C.slices(np.diff(np.append(starts, len(h))), 100_000):
            lo, hi = starts[a], starts[b] if b < len(starts) else len(h)
            part, lw, begin = h[lo:hi], logw[lo:hi], starts[a:b] - lo
            for k, seed in enumerate(self.seeds):
                z = C.mixed(part ^ seed)
                r, beta = self.gamma[z & np.uint64(0xFFFF)], self.beta[z >> np.uint64(32) & np.uint64(0xFFFF)]
                t = np.floor(lw / r + beta)
                rank = (self.log_gamma[z >> np.uint64(16) & np.uint64(0xFFFF)] - r * (t - beta + 1)).view(np.uint32)
                rank = np.where(rank >> np.uint32(31), ~rank, rank | np.uint32(1 << 31)).astype(np.uint64)
                mark = (z >> np.uint64(7) ^ t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
                out[a:b, k] = np.minimum.reduceat(rank << np.uint64(32) | mark, begin) & np.uint64(0xFFFFFFFF)
        return out


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of lesser weights over sum of greater weights; each side has ascending hashes and their weights."""
    at = np.minimum(np.searchsorted(b[0], a[0]), max(0, len(b[0]) - 1))
    same = b[0][at] == a[0] if len(b[0]) else np.zeros(len(a[0]), bool)
    low = np.minimum(a[1][same], b[1][at[same]]).sum(dtype=np.float64)
    total = a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - low
    return float(low / total) if total else 0.0


def _sampled(docs: DataFrame, weight: np.ndarray) -> DataFrame:
    """doc_id, key (the hash of the text), k1, k2 (of the words), n, bands (longs; null below five words) of each document."""

    def run(batches):
        sampler = Sampler()
        mult = C.mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
        for b in batches:
            texts = C.texts_of(b)
            for lo, hi in C.slices((len(t or "") for t in texts), 2_000_000):
                h, w, bounds, counts = shingles(texts[lo:hi], weight)
                full = np.flatnonzero(np.diff(bounds))
                sig = sampler(h, w, bounds[:-1][full]) if len(full) else np.zeros((0, BANDS * ROWS), np.uint32)
                band = C.mixed((sig.astype(np.uint64) * mult).reshape(-1, BANDS, ROWS).sum(2, dtype=np.uint64) ^ np.arange(BANDS, dtype=np.uint64)).view(np.int64)
                bands = [None] * (hi - lo)
                for i, x in zip(full.tolist(), band.tolist(), strict=True):
                    bands[i] = x
                k = C.digests(b" ".join((t or "").encode().split()) for t in texts[lo:hi])
                own = b.slice(lo, hi - lo)
                yield pa.record_batch({"doc_id": own.column("doc_id"), "key": own.column("key"), "k1": pa.array(k[:, 0]), "k2": pa.array(k[:, 1]), "n": pa.array(counts), "bands": pa.array(bands, pa.list_(pa.int64()))})

    rows = C.only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(run, "doc_id long, key long, k1 long, k2 long, n long, bands array<long>")


def _texts(docs: DataFrame, reps: DataFrame, ids: DataFrame) -> DataFrame:
    """id and text of ``ids`` (id), which may be any share of the corpus: dealt by the row they stand for, never broadcast."""
    own = reps.join(ids.distinct(), "id", "left_semi").select("id", "doc_id", "key").hint("merge")
    rows = C.only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("key"), "text")
    return C.written(rows.join(own, ["doc_id", "key"]).select("id", "text").dropDuplicates(["id"]))


def _verified(pairs: DataFrame, texts: DataFrame, weight: np.ndarray) -> DataFrame:
    """The pairs that are similar by their whole texts."""
    side = lambda x: texts.select(F.col("id").alias(x), F.col("text").alias(f"text_{x}"))

    def run(batches):
        for b in batches:
            x, y = C.texts_of(b, "text_a"), C.texts_of(b, "text_b")
            own: dict[str, int] = {}
            at = [(own.setdefault(s, len(own)), own.setdefault(t, len(own))) for s, t in zip(x, y, strict=True)]
            h, w, bounds, _ = shingles(list(own), weight)
            of = lambda i: (h[bounds[i] : bounds[i + 1]], w[bounds[i] : bounds[i + 1]])
            yield b.select(["a", "b"]).filter(pa.array([weighted_jaccard(of(i), of(j)) >= SIMILARITY for i, j in at], pa.bool_()))

    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def spanning_links(ids: list[int], texts: list[str], loose: np.ndarray, weight: np.ndarray, columns: int = 2048) -> list[tuple[int, int]]:
    """Links that join the ``loose`` documents (a Boolean mask) to all they are similar to, no more than it takes to join them.

    Sums of shared weights come from products of blocks of the matrix of documents and shingles, which single precision may
    put beside the exact sums by a little; so pairs that come close are verified one by one.
    """
    exact = shingles(texts, weight)
    part = lambda i: (exact[0][exact[2][i] : exact[2][i + 1]], exact[1][exact[2][i] : exact[2][i + 1]])
    words, counts = C.hashed_words(texts)
    ends = C.doc_offsets(counts)
    starts = C.window_starts(counts, WIDTH)
    h, doc = C.window_hashes(words, starts, WIDTH), np.searchsorted(ends, starts, "right") - 1
    sums = np.concatenate([[0], np.cumsum(weight[_cells(words)], dtype=np.float64)])
    w = (sums[starts + WIDTH] - sums[starts]) / WIDTH
    order = np.lexsort((h, doc))
    h, doc, w = h[order], doc[order], w[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])) if len(h) else np.zeros(0, np.int64)
    times = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    h = C.mixed(h ^ times.astype(np.uint64))  # the second occurrence of a shingle is an element of its own
    total = np.bincount(doc, w, len(texts))
    cells, col, n = np.unique(h, return_inverse=True, return_counts=True)
    often = np.flatnonzero(n > 1)
    place = np.full(len(cells), -1)
    place[often] = np.arange(len(often))
    keep = place[col] >= 0
    col, doc, w = place[col[keep]], doc[keep], w[keep]
    order = np.argsort(col, kind="stable")
    col, doc, w = col[order], doc[order], w[order]
    rows = np.flatnonzero(loose)
    shared = np.zeros((len(rows), len(texts)))
    for lo in range(0, len(often), columns):
        a, b = np.searchsorted(col, [lo, lo + columns])
        block = np.zeros((len(texts), columns), np.float32)
        weights = np.zeros(columns, np.float32)
        block[doc[a:b], col[a:b] - lo] = 1
        weights[col[a:b] - lo] = w[a:b]
        shared += (block[rows] * weights) @ block.T
    either = total[rows, None] + total[None, :] - shared
    similar = shared >= (SIMILARITY - 1e-3) * either
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(similar), strict=True):
        a, b = root(int(rows[i])), root(int(j))
        if a != b and weighted_jaccard(part(rows[i]), part(j)) >= SIMILARITY:
            parent[a] = b
            out.append((ids[rows[i]], ids[j]))
    return out


def _dealt(loose: DataFrame, members: DataFrame, texts: DataFrame) -> DataFrame:
    """bucket, part, other, id, loose, text: each pair of blocks of the ``loose`` (bucket, id) and of the members (bucket, id) of a bucket.

    Blocks do not grow with the bucket. A document may be in both blocks of a pair, and is then there twice.
    """
    sizes = texts.select("id", F.length("text").alias("chars"))

    def blocks(df, most, name):
        n = F.greatest(F.count("*") / most, F.sum("chars") / BLOCK_CHARS)
        return df.join(sizes, "id").groupBy("bucket").agg(F.ceil(n).cast("int").alias(name))

    members = members.join(loose.select("bucket").distinct(), "bucket", "left_semi")
    counts = blocks(loose, LOOSE_BLOCK, "parts").join(blocks(members, MEMBER_BLOCK, "others"), "bucket")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = loose.join(counts, "bucket").select("bucket", own("parts").alias("part"), every("others").alias("other"), "id", F.lit(True).alias("loose"))
    rows = rows.union(members.join(counts, "bucket").select("bucket", every("parts").alias("part"), own("others").alias("other"), "id", F.lit(False).alias("loose")))
    return rows.join(texts, "id")


def _spanning(loose: DataFrame, members: DataFrame, texts: DataFrame, weight: np.ndarray) -> DataFrame:
    """a, b: links of the ``loose`` (bucket, id) to members (bucket, id) of their buckets, by pairs of blocks of both."""

    def run(table):
        own: dict[int, tuple[str, bool]] = {}
        for i, t, x in zip(table.column("id").to_pylist(), C.texts_of(table), table.column("loose").to_pylist(), strict=True):
            own[i] = t, x or (i in own and own[i][1])
        texts, mask = zip(*own.values(), strict=True)
        links = spanning_links(list(own), list(texts), np.array(mask, bool), weight)
        return pa.table({"a": pa.array([min(x) for x in links], pa.int64()), "b": pa.array([max(x) for x in links], pa.int64())})

    return _dealt(loose, members, texts).groupBy("bucket", "part", "other").applyInArrow(run, "a long, b long")


def _classed(docs: DataFrame) -> DataFrame:
    """doc_id, key, n, id, label of each row, as a written table: its text's hash and number of words, what stands for its words, and for its class.

    Of documents with the same words the first (by doc_id, key) stands for all; its ``id`` is its doc_id, or a hash of its words if other
    words have that doc_id too. Rows without words or doc_id have neither id nor label.
    """
    C.small_batches(docs.sparkSession)
    counts, n = document_frequencies(docs)
    weight = idf(counts, n)
    sampled = C.written(_sampled(docs, weight))
    real = sampled.where("n > 0 AND doc_id IS NOT NULL")
    reps = real.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "key", "bands")).alias("x")).select("k1", "k2", "n", "x.*")
    several = reps.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1")
    reps = reps.join(several, "doc_id", "left").withColumn("id", F.when(F.col("texts") > 1, F.xxhash64("k1", "k2")).otherwise(F.col("doc_id"))).drop("texts")
    reps = C.written(reps)
    rows = reps.select("id", F.explode("bands").alias("bucket")).distinct()
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    rows = C.written(rows.join(sizes, "bucket"))
    met = rows.groupBy("id").agg(F.sum("size").alias("met"))
    large = rows.where(F.col("size") > ALL_PAIRS)
    hubs = large.join(met, "id").groupBy("bucket").agg(F.max_by("id", F.struct("met", -F.col("id"))).alias("hub"))
    small = rows.where(F.col("size") <= ALL_PAIRS).groupBy("bucket").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    few = small.select(F.explode("ids").alias("a"), "ids").select("a", F.explode(F.filter("ids", lambda x: x > F.col("a"))).alias("b"))
    spokes = C.written(large.join(hubs, "bucket").where("id <> hub").select("bucket", F.col("hub").alias("a"), F.col("id").alias("b")))
    pairs = C.written(few.union(spokes.select("a", "b")).distinct())
    texts = _texts(docs, reps, pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
    first = C.written(_verified(pairs, texts, weight))
    loose = C.written(spokes.join(first, ["a", "b"], "left_anti").select("bucket", F.col("b").alias("id")))
    links = C.written(first.union(_spanning(loose, large.select("bucket", "id"), texts, weight)))
    C.forget(rows, spokes, pairs, texts, first, loose)
    label = components(links)
    exact = sampled.join(reps.select("k1", "k2", "n", "id").where("n > 0"), ["k1", "k2", "n"], "left")
    exact = exact.withColumn("id", F.when(F.col("doc_id").isNotNull(), F.col("id")))
    out = C.written(exact.join(label, "id", "left").select("doc_id", "key", "n", "id", F.coalesce("label", "id").alias("label")))
    C.forget(sampled, reps, links, label)
    return out


def near_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id: the least doc_id of each document's class of near-duplicates.

    Documents with the same words are in one class, as are those linked by a weighted Jaccard similarity of
    ``SIMILARITY`` or more over shingles of five words (below five words, only the same words). A text without words, null or
    empty, is alone in its class, and so is a null doc_id (class null). Rows that share a doc_id are judged by their own
    texts; each gives a row. Texts of any length are compared whole. Other columns are ignored; an empty table gives no row.
    """
    rows = _classed(docs)
    least = rows.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return rows.join(least, "label", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, with one row of each class of near-duplicates: the least by doc_id, then by the hash of its text.

    Rows without words, or without doc_id, all stay. A row goes only if a row that stays is in its class, whatever rows share its doc_id;
    of rows with the same doc_id and text one stays (the least by a hash of the other columns). Columns may have any names.
    """
    classed = _classed(docs)
    rows = classed.where("label IS NOT NULL").select("doc_id", "key", "label")
    best = rows.groupBy("label").agg(F.min(F.struct("doc_id", "key")).alias("best"))
    found = rows.groupBy("doc_id", "key", "label").agg(F.count("*").alias("copies")).join(best, "label")
    first = F.struct("doc_id", "key") == F.col("best")
    special = C.written(found.where(~first | (F.col("copies") > 1)).select(F.col("doc_id").alias("own_id"), F.col("key").alias("own_key"), first.alias("first")))
    C.forget(classed)
    packed = C.packed_rows(docs).select("row", F.col("row")["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.col("row")["text"].cast("string")).alias("key"))
    same = (F.col("doc_id") == F.col("own_id")) & (F.col("key") == F.col("own_key"))
    kept = packed.join(special, same, "left_anti")
    w = Window.partitionBy("doc_id", "key").orderBy(F.xxhash64(*(F.col("row").getField(f.name) for f in docs.schema if "map<" not in f.dataType.simpleString())))
    again = packed.join(special.where("first"), same, "left_semi").withColumn("k", F.row_number().over(w)).where("k = 1")
    out = kept.select("row").union(again.select("row"))
    return out.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its class of near-duplicates; see ``near_classes`` for nulls, ties and repeated rows."""
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
