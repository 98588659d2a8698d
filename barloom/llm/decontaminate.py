"""Benchmark decontamination (operator 5): training passages as BM25 queries against an index of the test items.

Items are the indexed side, so the index is as small as the benchmark. Impacts are BM25 weights over the item's own
full score: an item that a passage holds whole scores 1, and one threshold serves all items. Passages are windows
of words, long and dense enough that any item lies whole in one. For each passage the search adds up upper bounds
and goes on only where they reach the threshold: first each term's greatest impact over all items, then over groups of
blocks, then over blocks of items, each for all passages of a task at once; then WAND walks the postings of the passages left, a document at a
time from the pivot on, with block maxima to jump over blocks. All items above the threshold are verified: the
question's shingles of five words, and the answer's words, must be in the passage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common as C

THRESHOLD = 0.6
QUESTION, ANSWER = 0.8, 0.6
SHINGLE = 5
K1, B = 1.2, 0.75
#: Items of a block, and blocks of a group.
BLOCK, GROUP = 4, 8
LEAST_PASSAGE = 128
#: Characters of items in one index, which bound what is broadcast; a larger benchmark makes several indexes, all with the
#: statistics of the whole.
INDEX_CHARS = 4_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SIGN = np.zeros(256, bool)
_SIGN[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def terms(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``texts``, without ASCII case and signs at their ends, and each text's number of words; a word of signs alone is kept."""
    buf, starts, ends, counts = C.words_of([(t or "").encode() for t in texts])
    place = np.arange(len(buf))
    real = ~(_SIGN[buf] | C._GAP[buf])
    last = np.maximum.accumulate(np.where(real, place, -1))[ends - 1] + 1
    first = np.minimum.accumulate(np.where(real, place, len(buf))[::-1])[::-1][starts]
    some = last > starts
    return C.word_hashes(_LOWER[buf], np.where(some, first, starts), np.where(some, last, ends)), counts


def _parts(text: str) -> tuple[str, str]:
    """An item's question and answer: its first line and the rest, or else all but its last sentence and that."""
    text = text.strip()
    at = text.find("\n") if "\n" in text else text[:-1].rfind(". ") + 1
    return text[:at], text[at:]


def width(words: int) -> int:
    """Words of the passages that are searched for an item of so many words: twice as many at least, in steps of a factor of two."""
    return max(LEAST_PASSAGE, 1 << (2 * words - 1).bit_length()) if words else LEAST_PASSAGE


class Totals:
    """Of all items: number, mean number of words, and in how many a word (ascending hashes) occurs."""

    def __init__(self, n: int, mean: float, words: np.ndarray, df: np.ndarray):
        self.n, self.mean, self.words, self.df = n, mean, words, df


class Maxima:
    """The greatest impact of each term in each block of ``width`` items where it occurs, as ranges of sparse rows."""

    def __init__(self, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, width: int, v: int):
        block = doc // width  # postings are in order of term and item
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.block, self.value = block[new], np.maximum.reduceat(impact, new) if len(new) else np.zeros(0)
        self.bounds = np.searchsorted(term[new], np.arange(v + 1))

    def of(self, term: int) -> dict[int, float]:
        a, b = self.bounds[term], self.bounds[term + 1]
        return dict(zip(self.block[a:b].tolist(), self.value[a:b].tolist(), strict=True))

    def reached(self, what: np.ndarray, passage: np.ndarray, n: int, blocks: int, least: float) -> np.ndarray:
        """Which of ``n`` passages, with these terms, have a block whose bound reaches ``least``; ``passage`` ascends."""
        out = np.zeros(n, bool)
        count = self.bounds[what + 1] - self.bounds[what]
        size = np.bincount(passage, count, n).astype(np.int64)
        first = np.searchsorted(passage, np.arange(n + 1))
        for lo, hi in C.slices(np.maximum(size, blocks), 2_000_000):
            at, c = slice(first[lo], first[hi]), count[first[lo] : first[hi]]
            row = np.repeat(self.bounds[what[at]] - C.doc_offsets(c)[:-1], c) + np.arange(c.sum())
            key = np.repeat(passage[at] - lo, c) * blocks + self.block[row]
            out[lo:hi] = (np.bincount(key, self.value[row], (hi - lo) * blocks).reshape(hi - lo, blocks) >= least - 1e-9).any(1)
        return out


class Index:
    """Postings, impacts and their maxima over items and blocks of items, by term; with the ``totals`` of all items, or else their own."""

    def __init__(self, items: list[tuple[int, str]], totals: Totals | None = None):
        self.ids = [i for i, _ in items]
        words, counts = terms([t for _, t in items])
        ends = C.doc_offsets(counts)
        self.words = [words[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        heads, _ = zip(*(_parts(t) for _, t in items), strict=True) if items else ((), ())
        cut = [int(n) if SHINGLE <= n < len(w) else len(w) for n, w in zip(terms(heads)[1], self.words, strict=True)]
        self.question = [w[:c] for c, w in zip(cut, self.words, strict=True)]
        self.answer = [w[c:] if c < len(w) else w for c, w in zip(cut, self.words, strict=True)]
        doc = np.repeat(np.arange(len(items)), counts)
        self.terms, at = np.unique(words, return_inverse=True)
        n, v = len(items), len(self.terms)
        pair, tf = np.unique(at * max(1, n) + doc, return_counts=True)
        term, doc = pair // max(1, n), pair % max(1, n)
        if totals is None:
            totals = Totals(n, float(counts.mean()) if n else 1.0, self.terms, np.bincount(term, minlength=v))
        df = totals.df[np.searchsorted(totals.words, self.terms)] if v else np.zeros(0)
        idf = np.log(1 + (totals.n - df + 0.5) / (df + 0.5))
        size = counts / max(1e-9, totals.mean)
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[doc]))
        full = np.bincount(doc, impact, n)
        impact = impact / full[doc] if len(doc) else impact
        self.blocks = -(-n // BLOCK)
        self.groups = -(-self.blocks // GROUP)
        self.block_max = Maxima(term, doc, impact, BLOCK, v)
        self.group_max = Maxima(term, doc, impact, BLOCK * GROUP, v)
        self.term_max = np.zeros(v)
        np.maximum.at(self.term_max, term, impact)
        bounds = np.searchsorted(term, np.arange(v + 1))
        self.postings = [(doc[a:b].tolist(), impact[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.passage = max((width(len(w)) for w in self.words), default=LEAST_PASSAGE)
        self.mask = np.zeros(1 << 20, bool)
        self.mask[self.terms >> np.uint64(44)] = True

    def known(self, words: np.ndarray) -> np.ndarray:
        """The term number of each word, -1 for words of no item."""
        out = np.full(len(words), -1, np.int64)
        may = np.flatnonzero(self.mask[words >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.terms, words[may]), max(0, len(self.terms) - 1))
        ok = self.terms[at] == words[may] if len(self.terms) else np.zeros(0, bool)
        out[may[ok]] = at[ok]
        return out

    def wand(self, query: list[int], least: float) -> list[tuple[int, float]]:
        """All items that score ``least`` or more against the distinct terms of ``query``."""
        lists = [(self.postings[t][0], self.postings[t][1], float(self.term_max[t]), self.block_max.of(t)) for t in query]
        at, out = [0] * len(lists), []
        while True:
            live = sorted((x[0][at[i]], i) for i, x in enumerate(lists) if at[i] < len(x[0]))
            bound, pivot = 0.0, None
            for doc, i in live:
                bound += lists[i][2]
                if bound >= least:
                    pivot = doc
                    break
            if pivot is None:
                return out
            block = pivot // BLOCK
            ahead = [i for doc, i in live if doc <= pivot]
            if sum(x[3].get(block, 0.0) for x in lists) < least - 1e-9:
                to = (block + 1) * BLOCK  # no item of this block can reach the threshold
            else:
                to = pivot
                if live[0][0] == pivot:
                    score = sum(lists[i][1][at[i]] for i in ahead)
                    if score >= least:
                        out.append((pivot, score))
                    to = pivot + 1
            for i in ahead:
                docs = lists[i][0]
                while at[i] < len(docs) and docs[at[i]] < to:
                    at[i] += 1

    def search(self, words: np.ndarray, counts: np.ndarray, least: float = THRESHOLD) -> list[tuple[int, int, float, float, float]]:
        """Text number, item number, score, overlap of question and answer of the items found in texts of these words."""
        if not len(self.terms) or not len(words):
            return []
        term, step, out = self.known(words), self.passage // 2, {}
        ends = C.doc_offsets(counts)
        pos = np.flatnonzero(term >= 0)
        doc = np.searchsorted(ends, pos, "right") - 1
        per = np.maximum(1, -(-counts // step) - 1)  # passages of a text: from 0, step, 2 step ...; the last reaches the end
        base = C.doc_offsets(per)
        q = (pos - ends[doc]) // step
        own = np.concatenate([x[ok] for x, ok in ((base[doc] + q, q < per[doc]), (base[doc] + q - 1, q > 0))])
        what = np.concatenate([term[pos[q < per[doc]]], term[pos[q > 0]]])
        pair = np.sort(own * len(self.terms) + what)
        pair = pair[np.concatenate([[True], pair[1:] != pair[:-1]])] if len(pair) else pair
        own, what = pair // len(self.terms), pair % len(self.terms)
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        stops = np.append(starts[1:], len(own))
        alive = np.flatnonzero(np.add.reduceat(self.term_max[what], starts) >= least) if len(starts) else starts
        for lo in range(0, len(alive), 2000):
            part = alive[lo : lo + 2000]
            sizes = stops[part] - starts[part]
            idx = np.repeat(starts[part] - C.doc_offsets(sizes)[:-1], sizes) + np.arange(sizes.sum())
            which = np.repeat(np.arange(len(part)), sizes)
            hit = self.group_max.reached(what[idx], which, len(part), self.groups, least)
            some = hit[which]  # blocks, for the passages that a group of them may hold
            near = np.flatnonzero(hit)
            hit[near] = self.block_max.reached(what[idx][some], np.searchsorted(near, which[some]), len(near), self.blocks, least)
            for k in part[hit].tolist():
                passage = int(own[starts[k]])
                d = int(np.searchsorted(base, passage, "right") - 1)
                begin = int(ends[d] + (passage - base[d]) * step)
                stop = min(int(ends[d + 1]), begin + self.passage)
                for item, score in self.wand(what[starts[k] : stops[k]].tolist(), least):
                    found = (score, *self.overlap(words[begin:stop], item))
                    if found > out.get((d, item), (0,)) and found[1] >= QUESTION and found[2] >= ANSWER:
                        out[d, item] = found
        return [(d, i, *x) for (d, i), x in out.items()]

    def overlap(self, passage: np.ndarray, item: int) -> tuple[float, float]:
        """Shares of the question's shingles and of the answer's words that are in a passage."""

        def grams(w):
            n = min(SHINGLE, len(w))
            s = np.arange(len(w) - n + 1)
            return n, C.range_hashes(w, s, s + n, C._WORD_POWERS[0])

        if not len(self.question[item]):
            return 0.0, 0.0
        n, own = grams(self.question[item])
        s = np.arange(max(0, len(passage) - n + 1))
        return float(np.isin(own, C.range_hashes(passage, s, s + n, C._WORD_POWERS[0])).mean()), float(np.isin(self.answer[item], passage).mean())


def indexes(items: DataFrame) -> Iterator[list[Index]]:
    """Indexes of the items (item_id, text), about INDEX_CHARS characters at a time; statistics are of all items, counted on the executors.

    A part has an index for each width of passage: how long a passage is depends on the item alone, not on how long others are. The driver holds one
    part's items and the counts of its words at a time.
    """
    rows = C.only(items, "item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    size = int(rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0)
    parts = max(1, -(-size // INDEX_CHARS))
    rows = C.written(rows.withColumn("part", F.lit(0)) if parts == 1 else rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)).cast("int")))

    def count(batches):
        for b in batches:
            words, counts = terms(C.texts_of(b))
            part = np.array(b.column("part").to_pylist(), np.int32)
            ends = C.doc_offsets(counts)
            own = [np.unique(words[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
            n = [len(w) for w in own]
            if len(words):
                yield pa.record_batch({"part": pa.array(np.repeat(part, n), pa.int32()), "word": pa.array(np.concatenate(own).view(np.int64))})

    def lengths(batches):
        for b in batches:
            yield pa.record_batch({"n": pa.array(terms(C.texts_of(b))[1], pa.int64())})

    n, mean = rows.mapInArrow(lengths, "n long").agg(F.count("*"), F.avg("n")).first()
    words = C.written(rows.select("text", "part").mapInArrow(count, "part int, word long").groupBy("part", "word").agg(F.count("*").alias("df")))
    df = C.written(words.groupBy("word").agg(F.sum("df").alias("df"))) if parts > 1 else words.select("word", "df")
    for part in range(parts if n else 0):
        own = [(r.item_id, r.text) for r in rows.where(F.col("part") == part).orderBy("item_id", "text").collect()]
        known = df.join(words.where(F.col("part") == part).select("word"), "word", "left_semi").toArrow() if parts > 1 else df.toArrow()
        word, freq = (known.column(c).to_numpy() for c in ("word", "df"))
        word = word.view(np.uint64)
        order = np.argsort(word)
        classes: dict[int, list] = {}
        for item, size in zip(own, terms([t for _, t in own])[1].tolist(), strict=True):
            classes.setdefault(width(size), []).append(item)
        if classes:
            yield [Index(some, Totals(n, mean, word[order], freq[order])) for _, some in sorted(classes.items())]


def _found(docs: DataFrame, items: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``names``, item_id, score, question_overlap, answer_overlap of the items that rows of ``docs`` (long columns ``names``, text) hold."""
    C.small_batches(docs.sparkSession)
    spark, out = docs.sparkSession, None
    kind = ", ".join(f"{n} long" for n in (*names, "item_id")) + ", score double, question_overlap double, answer_overlap double"
    shared = None
    for part in indexes(items):
        if shared is not None:  # a part's broadcast goes before the next one comes
            out = C.written(out)
            shared.unpersist()
        shared = spark.sparkContext.broadcast(part)

        def run(batches, shared=shared):
            for b in batches:
                texts = C.texts_of(b)
                for lo, hi in C.slices((len(t or "") for t in texts), 1_000_000):
                    words = terms(texts[lo:hi])
                    found = sorted((d, index.ids[i], *map(float, x)) for index in shared.value for d, i, *x in index.search(*words))
                    cols = list(zip(*((lo + d, *x) for d, *x in found), strict=True)) or [[]] * 5
                    own = [b.column(n).take(pa.array(cols[0], pa.int64())) for n in names]
                    rest = [pa.array(x, t) for x, t in zip(cols[1:], [pa.int64(), *[pa.float64()] * 3], strict=True)]
                    yield pa.record_batch([*own, *rest], names=[*names, "item_id", "score", "question_overlap", "answer_overlap"])

        part = docs.select(*names, "text").mapInArrow(run, kind)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], kind) if out is None else out


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: the items that documents hold, at their best passage.

    An item's answer is what follows its first line, or else its last sentence; an item of one sentence, or with fewer
    than five words before its answer, is question and answer. Null or empty texts and items hold nothing and are held by nothing; a null doc_id is kept, a null item_id is
    left out; repeated documents or items give a row each time; other columns are ignored; empty tables give none. A text of any
    length is searched whole; of passages that hold an item the one of the highest score, then the first, is reported.
    """
    return _found(C.only(docs, "doc_id", "text"), items, ("doc_id",))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows that hold an item. A row goes for its own text alone, whatever rows share its id; columns may have any names."""
    rows = C.only(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("key"), "text")
    held = _found(rows, items, ("doc_id", "key")).select(F.col("doc_id").alias("held_id"), F.col("key").alias("held_key")).distinct()
    packed = C.packed_rows(docs).select("row", F.col("row")["doc_id"].cast("long").alias("doc_id"), F.xxhash64(F.col("row")["text"].cast("string")).alias("key"))
    kept = packed.join(held, F.col("doc_id").eqNullSafe(F.col("held_id")) & (F.col("key") == F.col("held_key")), "left_anti")
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Every item of ``benchmark`` that a row of ``documents`` holds; see ``contaminated`` for nulls, ties, repeated rows and long texts."""
    return contaminated(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))
