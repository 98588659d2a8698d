"""Terms of texts: maximal runs of digits, letters and characters beyond ASCII, only A to Z lower-cased.

These are the matches of ``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+``, lower-cased or after lower-casing. They are found
in the bytes of many texts at once and told apart by two 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from barloom.llm import common as C

_IN_TERM = np.zeros(256, bool)
_IN_TERM[0x30:0x3A] = _IN_TERM[0x41:0x5B] = _IN_TERM[0x61:0x7B] = _IN_TERM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
BLOCK_BYTES = 1 << 20


class Block:
    """Terms of some texts, in order; ``starts`` has each text's first term and, at the end, their number."""

    def __init__(self, raw: list[bytes]):
        self.buf = _LOWER[np.frombuffer(b"\n" + b"\n".join(raw) + b"\n" + bytes(8), np.uint8)]
        inside = _IN_TERM[self.buf[:-8]]
        self.begin = np.flatnonzero(~inside[:-1] & inside[1:]) + 1
        self.end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        self.starts = np.searchsorted(self.begin, np.cumsum([0] + [len(x) + 1 for x in raw]) + 1)

    def hashes(self, seed: int = 0, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        return C.word_hashes(self.buf, self.begin[at], self.end[at], seed)

    def term(self, i: int) -> str:
        return self.buf[self.begin[i] : self.end[i]].tobytes().decode()


def blocks(texts: Iterable[str | None]) -> Iterator[tuple[int, Block]]:
    """Consecutive texts in blocks of about a megabyte, or a longer one alone, and how many texts went before; a null text has no terms."""
    part, size, done = [], 0, 0
    for t in texts:
        part.append((t or "").encode())
        size += len(part[-1]) + 1
        if size >= BLOCK_BYTES:
            yield done, Block(part)
            done, part, size = done + len(part), [], 0
    if part:
        yield done, Block(part)


class Vocabulary:
    """Numbers for a given set of terms, from their two hashes."""

    def __init__(self, terms: Iterable[str]):
        self.terms = sorted(set(terms))
        own = Block([t.encode() for t in self.terms])
        assert len(own.begin) == len(self.terms)
        first, second = own.hashes(0), own.hashes(1)
        self.order = np.argsort(first, kind="stable")
        self.first, self.second = first[self.order], second[self.order]
        self.number = {t: i for i, t in enumerate(self.terms)}

    def find(self, block: Block) -> np.ndarray:
        """The number of each term of a block, or -1."""
        out = np.full(len(block.begin), -1)
        if not len(self.first) or not len(out):
            return out
        h = block.hashes(0)
        at = np.minimum(np.searchsorted(self.first, h), len(self.first) - 1)
        hit = np.flatnonzero(self.first[at] == h)
        hit = hit[self.second[at[hit]] == block.hashes(1, hit)]
        out[hit] = self.order[at[hit]]
        return out
