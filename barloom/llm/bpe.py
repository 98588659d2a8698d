"""Byte-level BPE (operator 3): merges chosen by a segment tree over byte positions.

A piece of text is a row of byte positions. A leaf of the tree holds the rank of the pair that starts at its
position, joined with the position, so the root is the leftmost pair of least rank. A merge changes three leaves
(the pair's own, its right part's, its left neighbour's), each with a walk to the root. Short pieces go through
the trees of a whole batch at once, one merge of each piece a step; a long piece has a tree of its own. Each task
keeps the pieces it has met, as a text's words repeat.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common as C

#: Pieces of up to so many bytes share the vectorised trees.
SHORT = 64
#: Pieces that a task remembers before it starts anew; the bound of its memory.
REMEMBERED = 300_000
#: Characters of these pieces; those of a longer block are forgotten after it.
REMEMBERED_CHARS = 8_000_000
NONE = 1 << 40


class Ranks:
    """A vocabulary of byte strings by rank, and the ranks of the pairs of tokens that merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.of = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.bytes = [b""] * (max(self.of.values()) + 1)
        for b, r in self.of.items():
            self.bytes[r] = b
        self.byte = np.array([self.of[bytes([i])] for i in range(256)], np.int64)
        pairs = sorted({(self.of[b[:i]] << 32 | self.of[b[i:]], r) for b, r in self.of.items() for i in range(1, len(b)) if b[:i] in self.of and b[i:] in self.of})
        self.pair = np.array([k for k, _ in pairs] or [-1], np.int64)
        self.rank = np.array([r for _, r in pairs] or [NONE], np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; ``NONE`` if it has none."""
        key = left << 32 | right
        i = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[i] == key, self.rank[i], NONE)

    @property
    def first_pairs(self) -> np.ndarray:
        if not hasattr(self, "_first"):
            a = np.repeat(self.byte, 256)
            self._first = self.pairs(a, np.tile(self.byte, 256))
        return self._first

    def short(self, pieces: list[bytes]) -> list[bytes]:
        """The ids, as bytes, of pieces of 2 to SHORT bytes; the trees of all pieces of a width advance together."""
        out: list[bytes] = [b""] * len(pieces)
        lengths = np.array([len(p) for p in pieces])
        width = 2
        while width // 2 < SHORT:
            for part in (x for x in np.array_split(np.flatnonzero((lengths > width // 2) & (lengths <= width)), max(1, len(pieces) * width // 2_000_000)) if len(x)):
                ids, counts = self._trees([pieces[i] for i in part], width)
                data, ends = ids.astype("<u4").tobytes(), np.cumsum(counts).tolist()
                for i, a, b in zip(part.tolist(), [0, *ends], ends, strict=False):
                    out[i] = data[4 * a : 4 * b]
            width *= 2
        return out

    def _trees(self, pieces: list[bytes], s: int) -> tuple[np.ndarray, np.ndarray]:
        n, bits = len(pieces), s.bit_length() - 1
        raw = np.zeros((n, s), np.uint8)
        length = np.array([len(p) for p in pieces])
        live = np.arange(s) < length[:, None]
        raw[live] = np.frombuffer(b"".join(pieces), np.uint8)
        token = self.byte[raw]
        tree = np.full((n, 2 * s), NONE << bits, np.int64)
        leaf = self.first_pairs[raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]]
        tree[:, s : 2 * s - 1] = np.where(live[:, 1:] & (leaf < NONE), leaf << bits | np.arange(s - 1), NONE << bits)
        for lo in (s >> k for k in range(1, bits + 1)):
            tree[:, lo : 2 * lo] = np.minimum(tree[:, 2 * lo : 4 * lo : 2], tree[:, 2 * lo + 1 : 4 * lo : 2])
        after = np.minimum(np.arange(1, s + 1), length[:, None])
        before = np.tile(np.arange(-1, s - 1), (n, 1))
        rows = np.arange(n)

        def put(row, at, value):
            node = at + s
            tree[row, node] = value
            for _ in range(bits):
                node = node >> 1
                tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

        def joined(row, left, right):
            rank = self.pairs(token[row, left], token[row, right])
            return np.where(rank < NONE, rank << bits | left, NONE << bits)

        while True:
            rows = rows[tree[rows, 1] < NONE << bits]
            if not len(rows):
                return token[live], live.sum(1)
            root = tree[rows, 1]
            p = root & (s - 1)
            q = after[rows, p]
            r = after[rows, q]
            token[rows, p], live[rows, q], after[rows, p] = root >> bits, False, r
            put(rows, q, NONE << bits)
            more = r < length[rows]
            put(rows[~more], p[~more], NONE << bits)
            x, a, b = rows[more], p[more], r[more]
            before[x, b] = a
            put(x, a, joined(x, a, b))
            has = before[rows, p] >= 0
            x, b = rows[has], p[has]
            a = before[x, b]
            put(x, a, joined(x, a, b))

    def long(self, piece: bytes) -> bytes:
        """The ids of one piece of any length, by a tree of its own."""
        n = len(piece)
        bits = max(1, (n - 1).bit_length())
        s, none, merge = 1 << bits, NONE << bits, self._merge
        raw = np.frombuffer(piece, np.uint8).astype(np.int64)
        leaf = self.first_pairs[raw[:-1] << 8 | raw[1:]]
        full = np.full(2 * s, none, np.int64)
        full[s : s + n - 1] = np.where(leaf < NONE, leaf << bits | np.arange(n - 1), none)
        for lo in (s >> k for k in range(1, bits + 1)):
            full[lo : 2 * lo] = np.minimum(full[2 * lo : 4 * lo : 2], full[2 * lo + 1 : 4 * lo : 2])
        tree, token = array("q", full.tobytes()), array("q", self.byte[raw].tobytes())
        after, before = array("q", range(1, n + 1)), array("q", range(-1, n - 1))
        del full

        def put(at, value):
            i = s + at
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                new = a if a < b else b
                if tree[i] == new:
                    return
                tree[i] = new

        def joined(left, right):
            r = merge.get(token[left] << 32 | token[right])
            return none if r is None else r << bits | left

        while tree[1] < none:
            p = tree[1] & (s - 1)
            q = after[p]
            r = after[p] = after[q]
            token[p] = tree[1] >> bits
            put(q, none)
            if r < n:
                before[r] = p
                put(p, joined(p, r))
            else:
                put(p, none)
            if before[p] >= 0:
                put(before[p], joined(before[p], p))
        out, i = array("I"), 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return np.array(out, "<u4").tobytes()

    @property
    def _merge(self) -> dict[int, int]:
        if not hasattr(self, "_merges"):
            self._merges = dict(zip(self.pair.tolist(), self.rank.tolist(), strict=True))
        return self._merges

    def encoded(self, pieces: list[str]) -> list[bytes]:
        """The ids, as little-endian uint32, of each piece; a piece that is a token itself needs no merge."""
        raw = [p.encode() for p in pieces]
        out = [b"" if (r := self.of.get(p)) is None else r.to_bytes(4, "little") for p in raw]
        short = [i for i, p in enumerate(raw) if not out[i] and len(p) <= SHORT]
        for i, ids in zip(short, self.short([raw[i] for i in short]), strict=True):
            out[i] = ids
        for i, p in enumerate(raw):
            if not out[i] and p:
                out[i] = self.long(p)
        return out


@lru_cache(2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


@lru_cache(4)
def splitter(pattern: str) -> regex.Pattern:
    r"""The pattern with white space as Unicode defines it, which is what ``\s`` means to the tokenizer."""
    return regex.compile(regex.sub(r"\[\^\\s", r"[^\\p{White_Space}", pattern).replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Encoder:
    """Encodes texts one block at a time, with the pieces met so far at hand."""

    def __init__(self, path: str, pattern: str):
        self.ranks, self.split, self.known, self.chars = ranks(path), splitter(pattern).findall, {}, 0

    def __call__(self, texts: list[str | None], block: int = 2_000_000) -> list[bytes]:
        out = []
        for a, b in C.slices((len(t or "") for t in texts), block):
            parts = [self.split(t or "") for t in texts[a:b]]
            new = list(set().union(*parts).difference(self.known))
            if len(self.known) + len(new) > REMEMBERED:
                self.known, self.chars = {}, 0
                new = list(set().union(*parts))
            self.known.update(zip(new, self.ranks.encoded(new), strict=True))
            get = self.known.__getitem__
            out += [b"".join(map(get, p)) for p in parts]
            self.chars += sum(map(len, new))
            if self.chars > REMEMBERED_CHARS:
                self.known, self.chars = {}, 0
        return out


def default_vocabulary() -> tuple[str, str]:
    """Path of the ranks and the pattern that op3 prescribes."""
    import public_tokenizers as P

    return P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian uint32, as binary) of each document.

    A null text is an empty one and has no ids; repeated rows each give a row, a null doc_id is kept, other columns
    are ignored, an empty table gives none. ``path`` must hold the vocabulary on every executor.
    """
    C.small_batches(docs.sparkSession)

    def run(batches):
        encoder = Encoder(path, pattern)
        for b in batches:
            ids = encoder(C.texts_of(b))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids": pa.array(ids, pa.binary())})

    return C.only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of its ids."""
    C.small_batches(encoded.sparkSession)

    def run(batches):
        token = ranks(path).bytes.__getitem__
        for b in batches:
            texts = [b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in b.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_tokens": b.column("n_tokens"), "ids": b.column("ids"), "decoded": pa.array(texts, pa.binary())})

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to, in one pass: ids and bytes do not leave the task.

    Nulls, empty and repeated rows and other columns as in ``encode``; a text of any length is encoded whole.
    """
    C.small_batches(docs.sparkSession)
    path, pattern = default_vocabulary()

    def run(batches):
        encoder, token = Encoder(path, pattern), ranks(path).bytes.__getitem__
        for b in batches:
            ids = encoder(C.texts_of(b))
            decoded = (b"".join(map(token, np.frombuffer(x, "<u4").tolist())) for x in ids)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": pa.array([sha256(x).hexdigest() for x in ids]), "decoded_sha256": pa.array([sha256(x).hexdigest() for x in decoded])})

    return C.only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Every row of ``documents``, encoded and decoded; see ``round_trip``."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
