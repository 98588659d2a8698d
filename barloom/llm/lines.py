"""Line deduplication (operator 7): an edit-distance join of lines by segments.

A line is a sequence of words and one of characters; two lines, whatever their lengths, are near if the
longer one's length allows the edits between them in either (``allowed``: a word in ten up to two, then one in twenty-five up to
``EDITS``; or a character in ten up to two). If two sequences are within k edits, and the shorter is cut into k + 1 segments, one
segment occurs in the longer, shifted by a few places at most. So each distinct line is indexed under its length and
its segments, and probes, for each length down to k less, the substrings that such a segment could be (only as many as the
shift around the edits before and after it allows). Lines with the same text are one line first. Index and probes
are dealt and sorted by the substring's hash, and each task walks its keys in order; a parity signature of the
symbols, which an edit changes in two bits at most, is compared there, so lines that merely share a long passage go no
further. Few keys are of two lines, so a first pass sends no more than 32 bits of each key, packed by ranges of keys, and only the keys
that it finds under two lines, told by a bitmap, are dealt with their lines. A key of very many lines is cut into blocks, which are compared two at a time by tasks of their own. Lines
that met another go on, with their texts, to the group of each key where they did; a pair is verified in the first of the keys
of words that it shares, or else of characters, by a banded bit-parallel edit distance, all pairs of a batch at once, a column at a time. What leaves
a group is a row a line: its number of near lines there, and the earliest of them; pairs never become rows.

Lines are told apart by 128 bits of BLAKE2b of their bytes; 64-bit hashes only find pairs, which texts decide.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common as C

#: The most edits of any pair.
EDITS = 4
#: Characters of texts that a task looks at together.
BLOCK_CHARS = 2_000_000
#: Keys of a line, about; keys that a range gets from all tasks, about; keys that a task packs at once.
KEYS_PER_LINE = 32
RANGE_KEYS = 250_000
PACKED_KEYS = 1_000_000
#: Symbols of sequences that are compared at once, were each as long as the longest.
PAIR_SYMBOLS = 500_000
#: Hashes that a task marks in a bitmap at once.
MARKED_ROWS = 2_000_000
#: Rows of keys that a task walks at once, rows of a key from which on it is compared in blocks, lines and characters of a
#: block of a group that is verified, and the most bits (a power of two) of a broadcast bitmap: 32 MB.
WALK_ROWS = 200_000
BLOCK_ROWS = 8192
GROUP_LINES, GROUP_CHARS = 1024, 4_000_000
#: Characters of a group whose symbols are held at once, some eighty bytes each.
SYMBOL_CHARS = 250_000
MOST_BITS = 28
#: Bits of a signature that tell symbols apart; three more hold the edits, and one the role.
KINDS = 28

NO_ID = (1 << 63) - 1
_BIT = np.uint8(128) >> np.arange(8, dtype=np.uint8)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_CHAR_VALUES = C.mixed(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * _GOLDEN)


class Lines:
    """The lines of a block of texts that hold more than white space, as ranges of bytes and of words."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        self.buf, begins, ends, _ = C.words_of(raw)
        breaks = np.flatnonzero(self.buf[:-8] == 10)
        starts, stops = breaks[:-1] + 1, breaks[1:]
        low, high = np.searchsorted(begins, starts), np.searchsorted(begins, stops)
        first = np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in raw]) + 1)
        of = np.repeat(np.arange(len(texts)), np.diff(first))
        real = np.flatnonzero(high > low)
        self.starts, self.stops, self.doc = starts[real], stops[real], of[real]
        self.number = real - first[self.doc]
        self.low, self.high = low[real], high[real]
        self.begins, self.ends = begins, ends
        self._ids = None

    def line(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.stops[i]].tobytes()

    @property
    def ids(self) -> np.ndarray:
        """128 bits of each line, as a row of two int64."""
        if self._ids is None:
            self._ids = self.ids_of(np.arange(len(self.starts)))
        return self._ids

    def ids_of(self, at: np.ndarray) -> np.ndarray:
        data = self.buf.tobytes()
        return C.digests(data[a:b] for a, b in zip(self.starts[at].tolist(), self.stops[at].tolist(), strict=True))

    def symbols(self, at: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Values of the words, or of the characters, of the lines ``at`` (at least), and where each line's begin and end."""
        if words:
            return C.word_hashes(self.buf, self.begins, self.ends), self.low[at], self.high[at]
        later = np.flatnonzero((self.buf & 0xC0) == 0x80)  # bytes that begin no character
        start, stop = (x[at] - np.searchsorted(later, x[at]) for x in (self.starts, self.stops))
        chars = np.frombuffer(self.buf.tobytes().decode().encode("utf-32-le"), "<u4")
        if chars.max() < len(_CHAR_VALUES):
            return _CHAR_VALUES[chars], start, stop
        return C.mixed((chars.astype(np.uint64) + np.uint64(1)) * _GOLDEN), start, stop


def allowed(length: np.ndarray, words: bool) -> np.ndarray:
    """The edits within which two lines are near, by the longer one's length in words or characters; 0: copies only."""
    few = np.minimum(2, length // 10)
    return np.minimum(EDITS, np.maximum(few, length // 25)) if words else few


def segments(length: np.ndarray, edits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start and length of each of the ``edits`` + 1 even segments of lines of these lengths."""
    k = edits + 1
    short, long = length // k, length % k
    out, begin = [], np.zeros_like(length)
    for i in range(k):
        size = short + (i >= k - long)
        out.append((begin, size))
        begin = begin + size
    return out


def parities(values: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Of ranges of symbol values, for each of KINDS kinds, whether a range has an odd number of them."""
    bits = np.uint32(1) << ((values >> np.uint64(32)) * np.uint64(KINDS) >> np.uint64(32)).astype(np.uint32)
    total = np.concatenate([np.zeros(1, np.uint32), np.bitwise_xor.accumulate(bits)])
    return total[stop] ^ total[start]


def pieces(values: np.ndarray, start: np.ndarray, stop: np.ndarray, words: bool, own_probes: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, bool, int]]:
    """Of lines as ranges of symbol values, for each kind of key: which line, the key, whether it indexes (or else probes), the edits.

    Without ``own_probes``, keys that a line both indexes and probes as its own segments are given as indexing only.
    """
    length = stop - start
    own = allowed(length, words)
    up, down = C._WORD_POWERS[1].to(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, up[:-1], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])

    def tags(of_length, edits):
        """A value for each segment of lines of these lengths."""
        whole = of_length.astype(np.uint64) * np.uint64(512) + np.uint64(edits * 2 + words)
        return [(whole + np.uint64(i * 32)) * _GOLDEN for i in range(edits + 1)]

    def hashes(begin, size, tag):
        x = sums[begin + size]
        x -= sums[begin]
        x *= down[begin]
        x ^= tag
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x.view(np.int64)

    for edits in range(1, int(allowed(length + EDITS, words).max(initial=0)) + 1):
        at = np.flatnonzero((own <= edits) & (edits <= allowed(length + edits, words)))  # the shorter line of a pair
        first = start[at]
        for (p, n), tag in zip(segments(length[at], edits), tags(length[at], edits), strict=True):
            yield at, hashes(first + p, n, tag), True, edits
        at = np.flatnonzero(own == edits)  # the longer line
        first, whole = start[at], length[at]
        for less in range(edits + 1):
            other = whole - less
            for i, ((p, n), tag) in enumerate(zip(segments(other, edits), tags(other, edits), strict=True)):
                low = max(-i, less - (edits - i))
                high = min(i, less + (edits - i))
                for shift in range(low, high + 1):
                    if less == shift == 0 and not own_probes:
                        continue
                    ok = (p + shift >= 0) & (p + shift + n <= whole)
                    if ok.all():
                        yield at, hashes(first + p + shift, n, tag), False, edits
                    else:
                        yield at[ok], hashes((first + p + shift)[ok], n[ok], tag[ok]), False, edits


def signed(parity: np.ndarray, index: np.ndarray | bool, edits: np.ndarray | int) -> np.ndarray:
    """Signatures: negative where the key indexes; then come three bits for the edits, and the parities."""
    return (parity.astype(np.int64) | np.int64(edits) << KINDS | np.int64(index) << 31).astype(np.uint32).view(np.int32)


def keys(values: np.ndarray, start: np.ndarray, stop: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lines as ranges of symbol values: which line, the key, whether it indexes (or else probes), the signature."""
    parity = parities(values, start, stop)
    out = [(row, key, np.full(len(row), index), signed(parity[row], index, edits)) for row, key, index, edits in pieces(values, start, stop, words)]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int32)
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def _alike(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ascending sizes, each at most twice its least, and at most ``most`` in all were each as its greatest, or of one."""
    lo = 0
    while lo < len(sizes):
        hi = int(np.searchsorted(sizes, 2 * sizes[lo], "right"))
        hi = max(lo + 1, lo + min(hi - lo, most // int(sizes[hi - 1])))
        yield lo, hi
        lo = hi


def distances(a: list[np.ndarray], b: list[np.ndarray], most: int) -> np.ndarray:
    """Edit distances of pairs of sequences of symbols (below 2**32 - 1); ``most`` + 1 stands for all above ``most``.

    Bit i of a column's words stands for the row i - most below the diagonal: a band of 2 most + 1 rows, in
    which vertical differences are kept as bits for +1 and for -1. The value at the band's last row is carried along
    the diagonal, then along the last row. Sequences longer than ``most`` only.
    """
    m, n = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out = np.full(len(a), most + 1)
    todo = np.flatnonzero((np.abs(m - n) <= most) & (m > most))
    order = todo[np.argsort(n[todo], kind="stable")]
    for lo, hi in _alike(n[order], PAIR_SYMBOLS):
        part = order[lo:hi]
        rows, cols, w = m[part], n[part], 2 * most + 1
        pattern = np.zeros((len(part), int(rows.max()) + 2 * w + int(cols.max())), np.uint32)
        text = np.full((len(part), int(cols.max())), 0xFFFFFFFF, np.uint32)
        pattern[:, most : most + int(rows.max())][np.arange(int(rows.max())) < rows[:, None]] = np.concatenate([a[k] for k in part.tolist()]) + np.uint32(1)
        text[np.arange(int(cols.max())) < cols[:, None]] = np.concatenate([b[k] for k in part.tolist()]) + np.uint32(1)
        full = np.uint64((1 << w) - 1)
        plus = np.full(len(part), ((1 << (most + 1)) - 1) << most, np.uint64)
        minus = np.zeros(len(part), np.uint64)
        value = np.full(len(part), most, np.int64)
        top = np.uint64(1 << (w - 1))
        for j in range(int(cols.max())):
            live = j < cols
            same = np.zeros(len(part), np.uint64)
            for k in range(w):
                same |= (pattern[:, j + k] == text[:, j]).astype(np.uint64) << np.uint64(k)
            d = ((((same & plus) + plus) ^ plus) | same | minus) & full
            up, down = (minus | ~(d | plus)) & full, d & plus
            diagonal = j < rows - most
            bit = np.uint64(1) << np.clip(rows - 1 - j + most, 0, w - 1).astype(np.uint64)
            step = np.where(diagonal, (d & top == 0).astype(np.int64), (up & bit != 0).astype(np.int64) - (down & bit != 0))
            value += np.where(live, step, 0)
            d >>= np.uint64(1)
            plus, minus = (down | ~(d | up)) & full, d & up
        out[part] = np.minimum(value, most + 1)
    return out


def trimmed(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Two sequences without the symbols that both begin or end with, but no shorter than ``most`` + 1: their distance is the same."""
    for _ in range(2):
        n = max(0, min(len(a), len(b)) - most - 1)
        apart = a[:n] != b[:n]
        first = int(apart.argmax()) if n else 0
        n = first if n and apart[first] else n
        a, b = a[n:][::-1], b[n:][::-1]
    return a, b


def near(texts: list[str], i: np.ndarray, j: np.ndarray, words: bool) -> np.ndarray:
    """Which pairs (i, j) of ``texts`` are near lines by their words, or by their characters."""
    number: dict[bytes, int] = defaultdict(count().__next__)
    of = {}
    for k in np.union1d(i, j).tolist():
        if words:
            of[k] = np.array(list(map(number.__getitem__, texts[k].encode().split())), np.uint32)
        else:
            of[k] = np.frombuffer(texts[k].encode("utf-32-le"), "<u4")
    most = allowed(np.array([max(len(of[a]), len(of[b])) for a, b in zip(i.tolist(), j.tolist(), strict=True)], np.int64), words)
    x, y = [], []
    for a, b, k in zip(i.tolist(), j.tolist(), most.tolist(), strict=True):
        a, b = trimmed(of[a], of[b], k)
        x.append(a)
        y.append(b)
    out = np.zeros(len(i), bool)
    for edits in np.unique(most[most > 0]).tolist():
        at = np.flatnonzero(most == edits)
        out[at] = distances([x[k] for k in at], [y[k] for k in at], edits) <= edits
    return out & np.array([texts[a] != texts[b] for a, b in zip(i.tolist(), j.tolist(), strict=True)], bool)


def _prepared(docs: DataFrame) -> DataFrame:
    """doc_id, key, text: rows of the same id are told apart by the hash of their text."""
    docs = C.only(docs, "doc_id", "text")
    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text")


def _blocks(batch):
    texts = C.texts_of(batch)
    for lo, hi in C.slices((len(t or "") for t in texts), BLOCK_CHARS):
        yield Lines(texts[lo:hi]), batch.slice(lo, hi - lo)


def _all_lines(docs: DataFrame) -> DataFrame:
    """doc_id, key, line (number from 0, blank lines counted), h1, h2 of each line that is not blank."""

    def run(batches):
        for b in batches:
            for x, rows in _blocks(b):
                of = pa.array(x.doc)
                yield pa.record_batch({"doc_id": rows.column("doc_id").take(of), "key": rows.column("key").take(of), "line": pa.array(x.number.astype(np.int32)), "h1": pa.array(x.ids[:, 0]), "h2": pa.array(x.ids[:, 1])})

    return docs.mapInArrow(run, "doc_id long, key long, line int, h1 long, h2 long")


def _spots(d: np.ndarray, key: np.ndarray, line: np.ndarray) -> np.ndarray:
    """A hash of a line's place."""
    out = np.zeros(len(d), np.uint64)
    for x in (d, key, line):
        out = C.mixed((out ^ x.astype(np.int64).view(np.uint64)) * _GOLDEN)
    return out.view(np.int64)


def _first_spots(batches):
    for b in batches:
        yield pa.record_batch({"h1": pa.array(_spots(*(b.column(n).to_numpy() for n in ("d", "key", "line"))))})


def _marked(bitmap: tuple[np.ndarray, int], h: np.ndarray) -> np.ndarray:
    """Which hashes are marked in a bitmap of ``_bits``."""
    spot = h.view(np.uint64) >> np.uint64(64 - bitmap[1])
    return bitmap[0][spot >> np.uint64(3)] & _BIT[spot & np.uint64(7)] != 0


def _distinct(x: Lines, rows: pa.RecordBatch, firsts) -> np.ndarray:
    """Lines of a block that differ; given the broadcast bitmap of first places, only those at such a place, or that it takes for such."""
    if firsts is None:
        return np.unique(x.ids, axis=0, return_index=True)[1]
    d, key = rows.column("doc_id").fill_null(NO_ID).to_numpy(), rows.column("key").to_numpy()
    return np.flatnonzero(_marked(firsts.value, _spots(d[x.doc], key[x.doc], x.number)))


def _few(bitmap: tuple[np.ndarray, int], values: np.ndarray, start: np.ndarray, stop: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, key and signature, as of ``keys``, of the keys marked in a bitmap."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for row, key, index, edits in pieces(values, start, stop, words):
        ok = np.flatnonzero(_marked(bitmap, key))
        out.append((row[ok], key[ok], np.full(len(ok), edits << 1 | index)))
    row, key, kind = map(np.concatenate, zip(*out, strict=True))
    own = np.unique(row)
    size = stop[own] - start[own]
    offsets = C.doc_offsets(size)
    some = values[np.arange(offsets[-1]) + np.repeat(start[own] - offsets[:-1], size)]
    parity = parities(some, offsets[:-1], offsets[1:])
    return row, key, signed(parity[np.searchsorted(own, row)], kind & 1, kind >> 1)


def _keys(docs: DataFrame, firsts=None, shared=None) -> DataFrame:
    """key, sig, h1 of each line that may be near another; with broadcast bitmaps, only of lines at first places, and keys ``shared``."""

    def run(batches):
        for b in batches:
            for x, rows in _blocks(b):
                at = _distinct(x, rows, firsts)
                for words in (True, False):
                    values, start, stop = x.symbols(at, words)
                    if shared is None:
                        row, key, _, sig = keys(values, start, stop, words)
                    else:
                        row, key, sig = _few(shared.value, values, start, stop, words)
                    some, of = np.unique(row, return_inverse=True)
                    yield pa.record_batch({"key": pa.array(key), "sig": pa.array(sig), "h1": pa.array(x.ids_of(at[some])[of, 0])})

    return docs.mapInArrow(run, "key long, sig int, h1 long")


def packed_keys(codes: list[np.ndarray], ranges: int) -> list[tuple[int, bytes]]:
    """Codes (a range, 31 bits of a key, a bit for those that probe), ascending, by range: two that index at most of a key, and one that probes."""
    x = np.sort(np.concatenate(codes))
    ok = np.ones(len(x), bool)
    ok[1:] = (x[1:] != x[:-1]) | (x[1:] & np.uint64(1) == 0)
    ok[2:] &= x[2:] != x[:-2]
    x = x[ok]
    cut = np.searchsorted(x, np.arange(1, ranges, dtype=np.uint64) << np.uint64(32)).tolist()
    return [(r, x[a:b].astype("<u4").tobytes()) for r, (a, b) in enumerate(zip([0, *cut], [*cut, len(x)], strict=True)) if b > a]


def shared_keys(parts: list[bytes]) -> np.ndarray:
    """The 31 bits of a range's keys that a line indexes and another indexes or probes."""
    x = np.sort(np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(p, "<u4") for p in parts)]))
    key = x >> np.uint32(1)
    run = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(x) else np.zeros(0, np.int64)
    return key[run[(x[run] & np.uint32(1) == 0) & (np.diff(np.append(run, len(x))) > 1)]]


def _shared(docs: DataFrame, firsts, n: int) -> DataFrame:
    """h1: the leading bits, of ``n`` lines, of the keys of two lines, as a written table; others may be among them, but none of those is missing.

    Keys are dealt by ranges, 32 bits each, sorted and packed; a key of very many lines is no more than three entries a part.
    """
    power = max(0, (n * KEYS_PER_LINE // RANGE_KEYS).bit_length())
    kind = pa.schema([("rng", pa.int32()), ("codes", pa.binary())])

    def pack(batches):
        waiting, size = [], 0
        for b in chain(batches, [None]):
            for x, rows in _blocks(b) if b is not None else ():
                at = _distinct(x, rows, firsts)
                for words in (True, False):
                    for _, key, index, _ in pieces(*x.symbols(at, words), words, own_probes=False):
                        waiting.append(key.view(np.uint64) >> np.uint64(33 - power) << np.uint64(1) | np.uint64(not index))
                        size += len(key)
            if size >= PACKED_KEYS or (b is None and size):
                parts = packed_keys(waiting, 1 << power)
                waiting, size = [], 0
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*parts, strict=True), kind, strict=True)], schema=kind)

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared_keys([p for b in batches for p in b.column("codes").to_pylist()]).astype(np.uint64)
        found |= np.uint64(key[0].as_py() << 31)
        yield pa.record_batch({"h1": pa.array((found << np.uint64(33 - power)).view(np.int64))})

    return C.written(docs.mapInArrow(pack, "rng int, codes binary").groupBy("rng").applyInArrow(merge, "h1 long"))


def _close(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether signatures, one that indexes and one that probes with the same edits, are as near as the edits allow."""
    x, y = x.view(np.uint32), y.view(np.uint32)
    return np.bitwise_count(x ^ y) <= 2 * (y >> np.uint32(KINDS)) + 1


def meetings(key: np.ndarray, sig: np.ndarray, h1: np.ndarray, most: int = 2_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Keys and lines (h1) of the lines that index or probe a key where another's signature is close, each once.

    Rows are sorted by key, signature (so that those that index come first), hash. ``most``: pairs of rows that are compared at once.
    """
    if not len(key):
        return key, h1
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (sig[1:] != sig[:-1]) | (h1[1:] != h1[:-1])])
    key, sig, h1 = key[new], sig[new], h1[new]
    run = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    stop = np.append(run[1:], len(key))
    n = np.add.reduceat((sig < 0).astype(np.int64), run)
    ok = (n > 0) & (n < stop - run)
    run, stop, n = run[ok], stop[ok], n[ok]
    left = np.repeat(run - C.doc_offsets(n)[:-1], n) + np.arange(n.sum())  # every indexing row, with the probes of its run
    first, count = np.repeat(run + n, n), np.repeat(stop - run - n, n)
    met = np.zeros(len(key), bool)
    for lo, hi in C.slices(count, most):
        c = count[lo:hi]
        for skip in range(0, int(c.max()), most):  # one row may have more probes than are compared at once
            k = np.clip(c - skip, 0, most)
            i = np.repeat(left[lo:hi], k)
            j = np.repeat(first[lo:hi] + skip - C.doc_offsets(k)[:-1], k) + np.arange(k.sum())
            close = np.flatnonzero(_close(sig[i], sig[j]) & (h1[i] != h1[j]))
            met[i[close]] = met[j[close]] = True
    found = np.unique(np.stack([key[met], h1[met]]), axis=1)
    return found[0], found[1]


def _met(key: np.ndarray, h1: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch({"key": pa.array(key, pa.int64()), "h1": pa.array(h1, pa.int64())})


def _walked(table: DataFrame) -> DataFrame:
    """Of ``_keys``: key, line for lines that met another; or, of a key with many lines, its lines in blocks: key, block, probe, h1, sig.

    Keys are dealt and sorted once; a task walks its keys in order and holds no more than a bounded number of rows.
    """
    names = ("key", "sig", "h1")
    kind = pa.schema([("key", pa.int64()), ("line", pa.int64()), ("block", pa.int32()), ("probe", pa.bool_()), ("h1", pa.binary()), ("sig", pa.binary())])

    def rows(**columns):
        n = len(columns["key"])
        return pa.record_batch([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in kind], schema=kind)

    def run(batches):
        held, waiting, hot, number = [np.zeros(0, t) for t in (np.int64, np.int32, np.int64)], [], None, 0

        def blocks(cols):
            """The rows of one key, as blocks of either role."""
            nonlocal number
            for probe in (False, True):
                own = np.flatnonzero((cols[1] >= 0) == probe)
                for lo in range(0, len(own), BLOCK_ROWS):
                    part = own[lo : lo + BLOCK_ROWS]
                    yield rows(key=[int(cols[0][0])], block=[number], probe=[probe], h1=[cols[2][part].tobytes()], sig=[cols[1][part].tobytes()])
                    number += 1

        def settled(cols, last):
            """What whole keys give; of the last key only so much as must not be held, unless it is over."""
            nonlocal hot, number
            edge = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1], [True]])) if len(cols[0]) else np.zeros(1, np.int64)
            size, rest = np.diff(edge), [x[:0] for x in cols]
            light = np.ones(len(cols[0]), bool)
            for i in np.flatnonzero((size > BLOCK_ROWS) | (cols[0][edge[:-1]] == hot if hot is not None else False)).tolist():
                light[edge[i] : edge[i + 1]] = False
                own = [x[edge[i] : edge[i + 1]] for x in cols]
                if hot != own[0][0]:
                    hot, number = own[0][0], 0
                yield from blocks(own)
            if not last and len(size) and light[edge[-2]]:
                rest = [x[edge[-2] :] for x in cols]
                light[edge[-2] :] = False
            if light.any():
                key, line = meetings(*(x[light] for x in cols))
                yield rows(key=key, line=line)
            return rest

        for b in chain(batches, [None]):
            if b is not None:
                waiting.append([b.column(n).to_numpy() for n in names])
                if sum(len(x[0]) for x in waiting) < WALK_ROWS:
                    continue
            cols = [np.concatenate(x) for x in zip(held, *waiting, strict=True)]
            waiting = []
            held = yield from settled(cols, b is None)

    dealt = table.select(*names).repartition("key").sortWithinPartitions(*names)
    return dealt.mapInArrow(run, "key long, line long, block int, probe boolean, h1 binary, sig binary")


def _block_pairs(blocks: DataFrame) -> DataFrame:
    """key, h1 of lines that met another, of every two blocks of a key, one that indexes and one that probes: a task for a few of them."""
    index = blocks.where("NOT probe").select("key", F.col("h1").alias("h"), F.col("sig").alias("s"))
    probes = blocks.where("probe").select("key", "block", "h1", "sig")
    met = index.join(probes.select("key", "block"), "key").join(probes, ["key", "block"]).repartition(F.expr("uuid()"))

    def run(batches):
        for b in batches:
            for key, h, s, h1, sig in zip(*(b.column(n).to_pylist() for n in ("key", "h", "s", "h1", "sig")), strict=True):
                h, s, h1, sig = np.frombuffer(h, np.int64), np.frombuffer(s, np.int32), np.frombuffer(h1, np.int64), np.frombuffer(sig, np.int32)
                yield _met(*meetings(np.full(len(h) + len(h1), key), np.concatenate([s, sig]), np.concatenate([h, h1])))

    return met.select("key", "h", "s", "h1", "sig").mapInArrow(run, "key long, h1 long")


def _members(docs: DataFrame, firsts, n: int) -> DataFrame:
    """key, h1: the lines (their first 64 bits), ``n`` distinct ones, that met another, by the keys where they did, as a written table."""
    shared = _shared(docs, firsts, n)
    bits = docs.sparkSession.sparkContext.broadcast(_bits(shared, 4 * shared.count()))
    walked = C.written(_walked(_keys(docs, firsts, bits)))
    C.forget(shared)
    bits.destroy()
    out = walked.where("line IS NOT NULL").select("key", F.col("line").alias("h1"))
    hot = walked.where("line IS NULL")
    if not hot.isEmpty():
        out = out.union(_block_pairs(hot).distinct())
    members = C.written(out)
    C.forget(walked)
    return members


def _bits(ids: DataFrame, n: int, hashes: Callable | None = None) -> tuple[np.ndarray, int]:
    """A packed bitmap of the leading bits of hashes (h1), 16 bits for each of ``n``, merged on the executors by block; and its power of two, at most MOST_BITS.

    ``hashes`` makes batches of them from those of ``ids`` where they are marked: two ``mapInArrow`` in a row would run two Python
    workers a task, and Spark keeps, and uses in turn, as many as ever ran at once.
    """
    power = min(MOST_BITS, max(16, int(16 * n - 1).bit_length()))
    blocks = 1 << max(0, power - 20)

    def mark(batches):
        span, waiting, size = (1 << power) // blocks, [], 0
        for b in chain(hashes(batches) if hashes else batches, [None]):
            if b is not None:
                waiting.append(b.column("h1").to_numpy().view(np.uint64) >> np.uint64(64 - power))
                size += b.num_rows
            if size >= MARKED_ROWS or (b is None and size):
                at = np.sort(np.concatenate(waiting)).astype(np.int64)
                waiting, size = [], 0
                cut = np.searchsorted(at, np.arange(blocks + 1) * span)
                for k in np.flatnonzero(np.diff(cut)).tolist():
                    bits = np.zeros(span, bool)
                    bits[at[cut[k] : cut[k + 1]] - k * span] = True
                    yield pa.record_batch({"block": pa.array([k], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << power) // blocks // 8, np.uint8)
        for b in batches:
            for x in b.column("bits").to_pylist():
                total |= np.frombuffer(x, np.uint8)
        yield pa.record_batch({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([total.tobytes()], pa.binary())})

    kind = "block int, bits binary"
    out = np.zeros((1 << power) // 8, np.uint8)
    span = len(out) // blocks
    for r in (ids if hashes else ids.select("h1")).mapInArrow(mark, kind).groupBy("block").applyInArrow(merge, kind).toLocalIterator():
        out[r.block * span : (r.block + 1) * span] = np.frombuffer(r.bits, np.uint8)
    return out, power


def _texts(docs: DataFrame, ids: DataFrame, firsts) -> DataFrame:
    """h1, h2, text, first (place) of the lines whose h1 is among ``ids``. A bitmap of bounded size spares most others the shuffle; the join decides."""
    shared = docs.sparkSession.sparkContext.broadcast(_bits(ids, ids.count()))

    def run(batches):
        for b in batches:
            for x, rows in _blocks(b):
                at = _distinct(x, rows, firsts)
                ids_at = x.ids_of(at)
                ok = np.flatnonzero(_marked(shared.value, ids_at[:, 0]))
                at, ids_at = at[ok], ids_at[ok]
                lines = [x.line(i).decode() for i in at.tolist()]
                of = pa.array(x.doc[at])
                d, key = rows.column("doc_id").fill_null(NO_ID).take(of), rows.column("key").take(of)
                yield pa.record_batch({"h1": pa.array(ids_at[:, 0]), "h2": pa.array(ids_at[:, 1]), "text": pa.array(lines, pa.string()), "d": d, "key": key, "line": pa.array(x.number[at].astype(np.int32))})

    some = docs.mapInArrow(run, "h1 long, h2 long, text string, d long, key long, line int").join(ids.hint("merge"), "h1", "left_semi")
    return some.groupBy("h1", "h2").agg(F.min("text").alias("text"), F.min(F.struct("d", "key", "line")).alias("first"))


def _padded(row: np.ndarray, key: np.ndarray, n: int, fill: int) -> np.ndarray:
    """The keys of each of ``n`` lines as a row of a matrix."""
    order = np.argsort(row, kind="stable")
    row, key = row[order], key[order]
    count = np.bincount(row, minlength=n)
    out = np.full((n, int(count.max(initial=0))), fill, np.int64)
    out[row, np.arange(len(row)) - np.repeat(C.doc_offsets(count)[:-1], count)] = key
    return out


class Group:
    """Lines that met, as rows of groups (``key``; ``part`` tells blocks of a large key apart), and their pairs that are near."""

    def __init__(self, texts: list[str], key: np.ndarray):
        self.texts, self.key, self.size, self.parity, self.index, self.probes = texts, key, {}, {}, {}, {}
        parts = {words: [] for words in (True, False)}
        for lo, hi in C.slices(map(len, texts), SYMBOL_CHARS):
            x = Lines(texts[lo:hi])
            for words, out in parts.items():
                values, start, stop = x.symbols(np.arange(hi - lo), words)
                row, k, index, _ = keys(values, start, stop, words)
                out.append((stop - start, parities(values, start, stop), row + lo, k, index))
        for words, out in parts.items():
            self.size[words], self.parity[words], row, k, index = map(np.concatenate, zip(*out, strict=True))
            self.index[words] = _padded(row[index], k[index], len(texts), np.iinfo(np.int64).min)
            self.probes[words] = _padded(row[~index], k[~index], len(texts), np.iinfo(np.int64).max)

    def first_shared(self, i: np.ndarray, j: np.ndarray, words: bool) -> np.ndarray:
        """The least key, of words or of characters, that one line of each pair indexes and the other probes."""
        index, probes = self.index[words], self.probes[words]
        out = np.full(len(i), np.iinfo(np.int64).max)
        step = max(1, 4_000_000 // max(1, index.shape[1] * probes.shape[1]))
        for lo in range(0, len(i), step):
            for a, b in ((i, j), (j, i)):
                x, y = index[a[lo : lo + step]][:, :, None], probes[b[lo : lo + step]][:, None, :]
                if x.size and y.size:
                    least = np.where(x == y, x, np.iinfo(np.int64).max).min((1, 2))
                    out[lo : lo + step] = np.minimum(out[lo : lo + step], least)
        return out

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs of rows of one group, those that are to be found there: near by words, or else by characters, with no lesser key of that kind."""
        out = []
        for words in (True, False):
            a, b = self.size[words][i], self.size[words][j]
            most = allowed(np.maximum(a, b), words)
            apart = np.bitwise_count(self.parity[words][i] ^ self.parity[words][j])
            at = np.flatnonzero((np.abs(a - b) <= most) & (most > 0) & (apart <= 2 * most))
            at = at[self.first_shared(i[at], j[at], words) == self.key[i[at]]]
            at = at[near(self.texts, i[at], j[at], words)]
            if not words:
                at = at[~near(self.texts, i[at], j[at], True)]
            out.append(at)
        at = np.concatenate(out)
        return i[at], j[at]


def _linked(members: DataFrame, texts: DataFrame) -> DataFrame:
    """h1, h2, links, near (place): how many lines are near each of ``texts`` (h1, h2, text, n, first), and the earliest place of one.

    A group holds the lines that met at a key; a large one is cut into blocks by line, and every two blocks meet.
    """
    sizes = members.join(texts.select("h1", "n"), "h1").groupBy("key").agg(F.ceil(F.greatest(F.count("*") / GROUP_LINES, F.sum("n") / GROUP_CHARS)).cast("int").alias("blocks"))
    rows = members.join(sizes.where("blocks > 1"), "key", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("h1"), "blocks"), F.lit(0)).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    rows = rows.select("h1", "key", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q")).join(texts.drop("n"), "h1")
    dealt = rows.select("key", "p", "q", "block", "h1", "h2", "text", "first").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "h1", "h2")
    kind = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("links", pa.int64()), ("d", pa.int64()), ("key", pa.int64()), ("line", pa.int32())])

    def found(t: pa.Table):
        """What whole groups give."""
        col = {n: t.column(n).to_numpy() for n in ("key", "p", "q", "block", "h1", "h2")}
        edge = np.flatnonzero(np.concatenate([[True], *(((col["key"][1:] != col["key"][:-1]) | (col["p"][1:] != col["p"][:-1]) | (col["q"][1:] != col["q"][:-1])),)]))
        stop = np.repeat(np.append(edge[1:], t.num_rows), np.diff(np.append(edge, t.num_rows)))
        group = Group(t.column("text").to_pylist(), col["key"])
        place = t.column("first").combine_chunks()
        d, key, line = (place.field(n).to_numpy() for n in ("d", "key", "line"))
        order = np.lexsort((line, key, d))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        links, best = np.zeros(t.num_rows, np.int64), np.full(t.num_rows, t.num_rows)
        after = stop - np.arange(t.num_rows) - 1
        for lo, hi in C.slices(after, 500_000):
            c = after[lo:hi]
            i = np.repeat(np.arange(lo, hi), c)
            j = i + 1 + np.arange(c.sum()) - np.repeat(C.doc_offsets(c)[:-1], c)
            ok = (col["p"][i] == col["q"][i]) | (col["block"][i] != col["block"][j])
            i, j = group.near(i[ok], j[ok])
            for a, b in ((i, j), (j, i)):
                np.add.at(links, a, 1)
                np.minimum.at(best, a, rank[b])
        at = np.flatnonzero(links)
        at_place = order[best[at]]
        return pa.record_batch([pa.array(x, f.type) for x, f in zip((col["h1"][at], col["h2"][at], links[at], d[at_place], key[at_place], line[at_place]), kind, strict=True)], schema=kind)

    def run(batches):
        waiting, size, chars = [], 0, 0
        for b in chain(batches, [None]):
            if b is not None:
                waiting.append(b)
                size, chars = size + b.num_rows, chars + b.column("text").nbytes
                if size < GROUP_LINES * 16 and chars < GROUP_CHARS:
                    continue
            if not waiting:
                break
            t = pa.Table.from_batches(waiting)
            last = [t.column(n)[-1].as_py() for n in ("key", "p", "q")]
            cut = t.num_rows
            if b is not None:  # the last group may go on
                same = np.logical_and.reduce([t.column(n).to_numpy() == v for n, v in zip(("key", "p", "q"), last, strict=True)])
                cut = int(np.flatnonzero(same)[0])
            if cut:
                yield found(t.slice(0, cut))
            waiting = t.slice(cut).to_batches()
            size, chars = t.num_rows - cut, sum(x.column("text").nbytes for x in waiting)

    out = dealt.mapInArrow(run, "h1 long, h2 long, links long, d long, key long, line int")
    return out.groupBy("h1", "h2").agg(F.sum("links").alias("links"), F.min(F.struct("d", "key", "line")).alias("near"))


def judged_lines(docs: DataFrame) -> DataFrame:
    """doc_id, key, line, removed, links, first of each line that is not blank.

    A line goes if an earlier line has the same text, or if a distinct line near it first occurs earlier. Earlier: a
    smaller doc_id (null last), then, of rows that share one, a smaller ``key`` (the hash of the row's text), then a smaller
    number. ``links``: how many distinct lines are near it; ``first``: the place (d, key, line) where its text, or
    else the first line near it, occurs first, which is the line itself if nothing is earlier. Rows of one id and one text have the same
    place, so none of them loses a line to the other.
    """
    C.small_batches(docs.sparkSession)
    docs = _prepared(docs)
    every = C.written(_all_lines(docs))
    place = F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), "key", "line")
    own = C.written(every.groupBy("h1", "h2").agg(F.min(place).alias("own")))
    n = own.count()
    at_first = docs.sparkSession.sparkContext.broadcast(_bits(own.select("own.*"), n, _first_spots))
    members = _members(docs, at_first, n)
    ids = C.written(members.select("h1").distinct())
    texts = C.written(_texts(docs, ids, at_first).select("h1", "h2", "text", F.length("text").alias("n"), "first"))
    at_first.destroy()
    near_first = C.written(_linked(members, texts))
    C.forget(members, ids, texts)
    firsts = own.join(near_first, ["h1", "h2"], "left").select("h1", "h2", "own", "links", F.least("own", "near").alias("first"))
    firsts = C.written(firsts)  # so that both sides of the next join are dealt for it, and a very common line can be split
    C.forget(near_first, own)
    out = every.join(firsts, ["h1", "h2"]).select("doc_id", "key", "line", (place != F.col("first")).alias("removed"), F.coalesce("links", F.lit(0)).alias("links"), "first")
    out.tables = every, firsts
    return out


def _judged_rows(docs: DataFrame) -> DataFrame:
    """What ``judged_lines`` says, by doc_id and key, as a written table."""
    lines = judged_lines(docs)
    rows = lines.groupBy("doc_id", "key").agg(F.count("*").alias("n_lines"), F.count_if("removed").alias("n_removed"), F.sum("links").alias("n_links"), F.array_distinct(F.sort_array(F.collect_list(F.when(F.col("removed"), F.col("line"))))).alias("removed"))
    rows = C.written(rows)
    C.forget(*lines.tables)
    return rows


def line_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_links, removed (ascending numbers of removed lines) of each row of ``docs``.

    A null, empty or blank text has no lines and gives zeros; an empty table gives no row. Rows that share a doc_id, or have none, are judged apart
    (``judged_lines``), and rows of one id and one text alike. Texts and lines of any length are compared whole; of
    equal lines the earliest stays. Other columns are ignored, whatever their names.
    """
    rows, found = _prepared(docs).select("doc_id", "key"), _judged_rows(docs)
    copies = rows.groupBy("doc_id", "key").agg(F.count("*").alias("copies"))
    on = copies["doc_id"].eqNullSafe(found["doc_id"]) & (copies["key"] == found["key"])
    share = lambda c: F.coalesce((F.col(c) / F.col("copies")).cast("long"), F.lit(0).cast("long")).alias(c)
    both = copies.join(found, on, "left").select(copies["doc_id"], "copies", share("n_lines"), share("n_removed"), share("n_links"), F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))
    return both.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def without_removed(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without the lines that ``judged_lines`` removes; documents that lose their last line go.

    Documents without lines, of null or blank text, stay as they are. A row loses only lines of its own that occur earlier, whatever
    rows share its id; columns may have any names.
    """
    gone = _judged_rows(docs).where("n_removed > 0").select(F.col("doc_id").alias("id"), "key", "n_lines", "n_removed", "removed")
    rows = C.packed_rows(docs)
    text = F.col("row")["text"].cast("string")
    rows = rows.select("row", F.col("row")["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("own"))
    both = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("own") == F.col("key")), "left").where("n_removed IS NULL OR n_removed < n_lines")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("removed", i)), "\n")
    return both.select(*((F.when(F.col("removed").isNull(), text).otherwise(kept) if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``: its lines, those removed (numbers, by commas), and the links of its lines to distinct lines near them.

    See ``line_counts`` for nulls, empty and long texts, ties and repeated rows.
    """
    out = line_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("removed", F.array_join(F.col("removed").cast("array<string>"), ","))
