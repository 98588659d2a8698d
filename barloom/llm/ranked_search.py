"""Ranked lexical search (operator 11): the best documents for each item, by range-maximum tables over posting lists.

Documents are indexed in shards of a bounded size: for each term that an item asks for, a posting list of (document, occurrences). The
index is written once, and terms' document frequencies, the number of documents and their length are counted from it, over all documents.

The search takes one shard after another. Every posting list gets a sparse table of the places of its greatest impacts,
so the greatest impact of a term in any interval of documents is two look-ups, and the sum over an item's terms bounds the
score of every document there. Intervals are taken best bound first (``AHEAD`` of each item at a time, all items at once); the
document of greatest impact in it is scored and cuts the interval in two, and what cannot reach the item's current
last rank is dropped. The ranks of one shard are the bar for the task's next ones, so a task sends on at most ``top`` documents an item.

All arithmetic is in 64-bit integers, except for the logarithm in a term's weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import common as C
from barloom.llm import terms as T

#: Documents and bytes of text of a shard, at most (a longer text is a shard alone).
SHARD_DOCS, SHARD_BYTES = 8192, 16 << 20
#: Characters of items that share one index and one search.
ITEM_CHARS = 4_000_000
#: Items that are searched together, and intervals of each that are cut at once.
TOGETHER, AHEAD = 256, 8
NO_ID = np.iinfo(np.int64).max
INDEX = "docs long, length long, ids binary, lengths binary, terms binary, sizes binary, at binary, tf binary"
FOUND = "item int, doc_id long, score long"


def _index(vocabulary):
    """Index rows of texts in the order in which they come."""

    def row(ids, lengths, doc, term):
        ids, lengths = np.array(ids, np.int64), np.concatenate(lengths)
        key, tf = np.unique(np.concatenate(term) * len(ids) + np.concatenate(doc), return_counts=True)
        terms, sizes = np.unique(key // len(ids), return_counts=True)
        kept = lengths > 0
        arrays = (ids, lengths.astype("<i8"), terms.astype("<i4"), sizes.astype("<i4"), (key % len(ids)).astype("<i4"), tf.astype("<i4"))
        return pa.RecordBatch.from_pylist([dict(zip((c.split()[0] for c in INDEX.split(",")), (int(kept.sum()), int(lengths.sum()), *(a.tobytes() for a in arrays)), strict=True))], _INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids, lengths, doc, term, size = vocabulary.value, [], [], [], [], 0
        for b in batches:
            own, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for done, block in T.blocks(texts):
                n = len(block.starts) - 1
                number = known.find(block)
                hit = np.flatnonzero(number >= 0)
                doc.append(np.searchsorted(block.starts, hit, "right") - 1 + len(ids))
                term.append(number[hit])
                lengths.append(np.diff(block.starts))
                ids += [NO_ID if i is None else i for i in own[done : done + n]]
                size += len(block.buf)
                if size >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                    yield row(ids, lengths, doc, term)
                    ids, lengths, doc, term, size = [], [], [], [], 0
        if ids:
            yield row(ids, lengths, doc, term)

    return run


_INDEX = pa.schema([(n, pa.int64() if t == "long" else pa.binary()) for n, t in (c.split() for c in INDEX.split(","))])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of documents of each term, for all shards of a task."""
    terms, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for b in batches:
        terms += [np.frombuffer(x, "<i4").astype(np.int64) for x in b.column("terms").to_pylist()]
        sizes += [np.frombuffer(x, "<i4").astype(np.int64) for x in b.column("sizes").to_pylist()]
        own, place = np.unique(np.concatenate(terms), return_inverse=True)
        terms, sizes = [own], [np.bincount(place, np.concatenate(sizes), len(own)).astype(np.int64)]
    yield pa.RecordBatch.from_pydict({"term": terms[0], "df": sizes[0]})


class Shard:
    """Posting lists with their impacts and sparse tables of places of greatest impact."""

    def __init__(self, row: dict, weight: np.ndarray, docs: int, length: int):
        got = lambda n, t: np.frombuffer(row[n], t).astype(np.int64)
        self.ids, lengths, terms, sizes, at, tf = got("ids", "<i8"), got("lengths", "<i8"), got("terms", "<i4"), got("sizes", "<i4"), got("at", "<i4"), got("tf", "<i4")
        m = 50 + (50 * lengths * docs) // length
        impact = np.repeat(weight[terms], sizes) * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[at]))
        self.n, self.at = len(at), at
        self.impact = np.append(impact, 0)  # the last place is that of no posting
        self.key = np.repeat(terms, sizes) * len(self.ids) + at
        stop = np.cumsum(sizes)
        self.begin, self.stop = np.zeros(len(weight) + 1, np.int32), np.zeros(len(weight) + 1, np.int32)
        self.begin[terms], self.stop[terms] = stop - sizes, stop
        most = int(sizes.max(initial=1))
        self.table = [np.arange(self.n + 1, dtype=np.int32)]
        for k in range(most.bit_length() - 1):
            a = self.table[-1]
            b = np.append(a[1 << k :], np.full(min(1 << k, len(a)), self.n, np.int32))
            self.table.append(np.where(self.impact[a] >= self.impact[b], a, b).astype(np.int32))
        self.table = np.stack(self.table)
        self.log = np.zeros(most + 1, np.int64)
        for i in range(1, most.bit_length()):
            self.log[1 << i :] += 1

    def greatest(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of the greatest impact of each half-open range of postings, the last place if it is empty."""
        out = np.full(a.shape, self.n, np.int32)
        some = np.flatnonzero(b > a)
        first, size = a.reshape(-1)[some], (b - a).reshape(-1)[some]
        level = self.log[size]
        x, y = self.table[level, first], self.table[level, first + size - (1 << level)]
        out.reshape(-1)[some] = np.where(self.impact[x] >= self.impact[y], x, y)
        return out

    def search(self, terms: np.ndarray, ranks: Ranks) -> int:
        """Brings into ``ranks`` the documents that are among the best for each row of ``terms`` (padded by the last term); how many were scored."""
        scored, held = 0, _Held(terms.shape[1])
        bound, doc, item, a, b = self._intervals(np.arange(len(terms)), self.begin[terms], self.stop[terms], ranks)
        slot = held.put(a, b)
        while len(item):
            order = np.lexsort((-bound, item))
            begins = np.searchsorted(item[order], item[order])
            take = np.zeros(len(order), bool)
            take[order[np.arange(len(order)) - begins < AHEAD]] = True
            own, d = item[take], doc[take]
            left, right = held.take(slot[take])
            cut, score = right.copy(), np.zeros(len(own), np.int64)
            r, c = np.nonzero(right > left)
            want = terms[own[r], c] * len(self.ids) + d[r]
            place = np.searchsorted(self.key, want)
            cut[r, c] = place
            hit = self.key[np.minimum(place, self.n - 1)] == want
            np.add.at(score, r[hit], self.impact[place[hit]])
            after = cut.copy()
            after[r[hit], c[hit]] += 1
            ranks.add(own, score, self.ids[d])
            scored += len(own)
            *new, a, b = self._intervals(np.concatenate([own, own]), np.concatenate([left, after]), np.concatenate([cut, right]), ranks)
            new.append(held.put(a, b))
            rest = ~take & (bound >= ranks.bar[item])
            held.take(slot[~take & ~rest])
            bound, doc, item, slot = (np.concatenate([x[rest], y]) for x, y in zip((bound, doc, item, slot), new, strict=True))
        return scored

    def _intervals(self, item, a, b, ranks):
        """Bounds of intervals, given by each term's range of postings, and the documents that cut them; those that can rank."""
        top = self.greatest(a, b)
        impact = self.impact[top]
        bound = impact.sum(1)
        doc = np.append(self.at, 0)[top[np.arange(len(top)), impact.argmax(1)]]
        live = (bound > 0) & (bound >= ranks.bar[item])
        return bound[live], doc[live], item[live], a[live], b[live]


class _Held:
    """Ranges of postings of the intervals that wait, in slots that are used again."""

    def __init__(self, width: int):
        self.a, self.b, self.free = np.zeros((0, width), np.int32), np.zeros((0, width), np.int32), np.zeros(0, np.int64)

    def put(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if len(self.free) < len(a):
            more = max(len(self.a), len(a))
            self.free = np.concatenate([self.free, np.arange(len(self.a), len(self.a) + more)])
            self.a, self.b = (np.concatenate([x, np.zeros((more, x.shape[1]), np.int32)]) for x in (self.a, self.b))
        slot, self.free = self.free[: len(a)], self.free[len(a) :]
        self.a[slot], self.b[slot] = a, b
        return slot

    def take(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.free = np.concatenate([self.free, slot])
        return self.a[slot], self.b[slot]


class Ranks:
    """The best documents so far of each item, and the score that a document must have to be among them."""

    def __init__(self, items: int, top: int):
        self.items, self.top = items, top
        self.item, self.score, self.doc = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bar = np.ones(items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        good = score >= self.bar[item]
        if not good.any():
            return
        item, score, doc = (np.concatenate(x) for x in ((self.item, item[good]), (self.score, score[good]), (self.doc, doc[good])))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        full = item[rank == self.top - 1]
        self.bar[full] = score[rank == self.top - 1]
        self.item, self.score, self.doc = (x[rank < self.top] for x in (item, score, doc))


def _found(asked, top: int):
    """The best documents of a task's shards for every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, docs, length = asked.value
        groups = []
        for i in range(0, len(items), TOGETHER):
            some = items[i : i + TOGETHER]
            table = np.full((len(some), max(1, *map(len, some))), len(weight))
            for k, terms in enumerate(some):
                table[k, : len(terms)] = terms
            groups.append((i, table, Ranks(len(some), top)))
        for b in batches:
            for row in b.to_pylist():
                if row["at"]:
                    shard = Shard(row, weight, docs, length)
                    for _, table, ranks in groups:
                        shard.search(table, ranks)
        for i, _, ranks in groups:
            ids = pa.array(ranks.doc, pa.int64(), mask=ranks.doc == NO_ID)
            yield pa.RecordBatch.from_arrays([pa.array(ranks.item + i, pa.int32()), ids, pa.array(ranks.score, pa.int64())], ["item", "doc_id", "score"])

    return run


def _parts(items: DataFrame, most: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Items and their distinct terms, in parts of about ``most`` characters; rows of one id follow each other."""
    part, size, last = {}, 0, None
    for r in items.orderBy("item_id", "text").toLocalIterator():
        if size >= most and r.item_id != last:
            yield list(part.items())
            part, size = {}, 0
        for _, block in T.blocks([r.text]):
            part.setdefault(r.item_id, set()).update(block.term(i) for i in range(len(block.begin)))
        size += len(r.text or "")
        last = r.item_id
    if part:
        yield list(part.items())


def ranked_search(docs: DataFrame, items: DataFrame, top: int = 50, item_chars: int = ITEM_CHARS) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` documents of score above 0, best first, equal scores by ascending doc_id (null last).

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are ignored. Every row of ``docs`` is a document, also one of a repeated or
    null id; a null or empty text has no terms and is not counted. Rows of ``items`` that share an id are one item of all their terms; rows of null id are
    none; an item without known terms has no rows, and no more has an empty table on either side. Items go in parts of ``item_chars``
    characters; each part takes one pass over the documents and is broadcast, so its size does not grow with the documents.
    """
    spark = docs.sparkSession
    C.small_batches(spark)
    docs, items = C.only(docs, "doc_id", "text"), C.only(items, "item_id", "text").where(F.col("item_id").isNotNull())
    out = None
    for part in _parts(items, item_chars):
        vocabulary = T.Vocabulary(t for _, terms in part for t in terms)
        known = spark.sparkContext.broadcast(vocabulary)
        index = C.written(docs.mapInArrow(_index(known), INDEX))
        known.unpersist()
        n, length = index.agg(F.sum("docs"), F.sum("length")).first()
        df = np.zeros(len(vocabulary.terms), np.int64)
        for r in index.select("terms", "sizes").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
            df[r.term] = r.df
        weight = np.floor(1000 * np.log((2 * (n or 0) + 2) / (2 * df + 1))).astype(np.int64)
        part.sort(key=lambda x: len(x[1]))
        ids = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(part)], "item int, item_id long")
        asked = spark.sparkContext.broadcast(([sorted(vocabulary.number[t] for t in terms) for _, terms in part], weight, n or 0, length or 0))
        found = index.where("length > 0").mapInArrow(_found(asked, top), FOUND)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        best = C.written(found.withColumn("rank", place).where(F.col("rank") <= top).join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score"))
        asked.unpersist()
        C.forget(index)
        out = best if out is None else out.union(best)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op11_ranked_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best of all ``documents`` for each item of ``benchmark``; see ``ranked_search`` for nulls, ties and repeated rows."""
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS("text")} AS ts FROM documents WHERE text IS NOT NULL),
s AS (SELECT count(*) AS n, sum(len(ts))::BIGINT AS l FROM d WHERE len(ts) > 0),
q AS (SELECT DISTINCT item_id, unnest({_TERMS("text")}) AS t FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY t),
m AS (SELECT r, doc_id, 50 + (50 * len(ts) * n) // l AS m FROM d, s WHERE len(ts) > 0),
x AS (SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN p USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM x WHERE score > 0
QUALIFY rank <= 50
"""
