"""Helpers that the operators of this subpackage share.

A word's hash chains its bytes, eight at a time, through an avalanche mix, for all words of a block in a handful of numpy
calls; functions of different seeds are independent. Windows of a fixed number of words combine their words' hashes as
a polynomial modulo 2**64. Whole lines and texts are told apart by 128 bits of BLAKE2b. Polynomials straight over
bytes (``range_hashes`` of ``_BYTE_VALUES``) only deal words to cells, where a collision does no harm.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are the maximal runs of characters other than these (space, tab, \n, \v, \f, \r), as in ``[^\x20\x09-\x0D]+``.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20
#: Words above so many bytes are hashed one at a time.
LONG_WORD = 512

_GAP = np.zeros(256, bool)
_GAP[[0x20, 9, 10, 11, 12, 13]] = True


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that driver and executors share: ``spark.checkpoint.dir``, or one in the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.table_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and that no plan still to run reads."""
    for t in tables:
        delete(t.sparkSession, t.table_path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches in rows and bytes, so that one batch of long texts fits a Python worker; the same for every operator."""
    spark.conf.set(ARROW_ROWS, str(BATCH_ROWS))
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def mixed(x: np.ndarray) -> np.ndarray:
    """The avalanche of splitmix64, over an array of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = 1 << (n - 1).bit_length()
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(m, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_BYTE_POWERS = Powers(0x9E3779B97F4A7C15)
_WORD_POWERS = (Powers(0xD6E8FEB86659FD93), Powers(0xA0761D6478BD642F))
_BYTE_VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers = _BYTE_POWERS) -> np.ndarray:
    """A hash of each half-open range of ``values`` (uint64) that depends on the range's content alone."""
    up, down = powers.to(max(1, len(values)))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[np.minimum(starts, max(0, len(values) - 1))])


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """The hash of each half-open range of bytes of ``buf``, which goes on for eight bytes after the last; ranges are not empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lanes = np.ndarray(len(buf) - 7, "<u8", np.ascontiguousarray(buf), strides=(1,))
    size = ends - starts
    h = mixed(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0x51ED27 + 1))
    h = mixed(h ^ lanes[starts] & _MASKS[np.minimum(size, 8)])
    at = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    done = 8
    while len(at):
        h[at] = mixed(h[at] ^ lanes[starts[at] + done] & _MASKS[np.minimum(size[at] - done, 8)])
        done += 8
        at = at[size[at] > done]
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(blake2b(buf[starts[i] : ends[i]].tobytes(), digest_size=8, key=bytes([seed])).digest(), "little")
    return h


def words_of(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of texts one after another, where words start and end in them, and each text's number of words."""
    buf = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n" + bytes(8), np.uint8)
    gap = _GAP[buf[:-8]]
    starts, ends = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    return buf, starts, ends, np.diff(np.searchsorted(starts, np.cumsum([0] + [len(x) + 1 for x in raw]) + 1))


def hashed_words(texts: Iterable[str | None], block: int = 1 << 20, seeds: tuple[int, ...] = (0,)) -> tuple[np.ndarray, ...]:
    """The hash, for each of ``seeds``, of every word of ``texts`` in order, and each text's number of words (null: none)."""
    hashes, counts, part, size = [[] for _ in seeds], [], [], 0

    def flush():
        nonlocal part, size
        if part:
            buf, starts, ends, n = words_of(part)
            counts.append(n)
            for out, seed in zip(hashes, seeds, strict=True):
                out.append(word_hashes(buf, starts, ends, seed))
            part, size = [], 0

    for t in texts:
        part.append((t or "").encode())
        size += len(part[-1]) + 1
        if size >= block:
            flush()
    flush()
    return *(np.concatenate(x or [np.zeros(0, np.uint64)]) for x in hashes), np.concatenate(counts or [np.zeros(0, np.int64)]).astype(np.int64)


def digests(items: Iterable[bytes]) -> np.ndarray:
    """128 bits of BLAKE2b of each item, as a row of two int64."""
    return np.frombuffer(b"".join(blake2b(x, digest_size=16).digest() for x in items), "<i8").reshape(-1, 2)


def window_starts(counts: np.ndarray, width: int) -> np.ndarray:
    """Positions, in the concatenated words of texts with ``counts`` words, where a window of ``width`` words of one text starts."""
    n = int(counts.sum())
    ends = np.repeat(np.cumsum(counts), counts)
    return np.flatnonzero(np.arange(n) + width <= ends)


def window_hashes(words: np.ndarray, starts: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hashes of windows of ``width`` words, given their words' hashes; ``which`` (0 or 1) picks one of two bases."""
    return range_hashes(words, starts, starts + width, _WORD_POWERS[which])


def doc_offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def slices(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of rows whose sizes add up to about ``most``."""
    begin, total, i = 0, 0, -1
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield begin, i + 1
            begin, total = i + 1, 0
    if i + 1 > begin:
        yield begin, i + 1


def packed(positions: np.ndarray) -> bytes:
    """Ascending distinct positions as 16-bit steps, low bytes and deflated high bytes apart; 65535 is a step that is no position itself."""
    steps = np.diff(positions.astype(np.int64), prepend=-1) - 1 if len(positions) else np.zeros(0, np.int64)
    skips = steps // 65535
    out = steps
    if skips.any():
        out = np.full(len(steps) + int(skips.sum()), 65535)
        out[np.arange(len(steps)) + np.cumsum(skips)] = steps % 65535
    return (out & 255).astype(np.uint8).tobytes() + zlib.compress((out >> 8).astype(np.uint8).tobytes(), 1) + len(out).to_bytes(4, "little")


def unpacked(data: bytes) -> np.ndarray:
    """The positions that ``packed`` got."""
    n = int.from_bytes(data[-4:], "little")
    high = np.frombuffer(zlib.decompress(data[n:-4]), np.uint8).astype(np.int64)
    steps = np.frombuffer(data, np.uint8, n) | high << 8
    real = steps != 65535
    return np.cumsum(np.where(real, steps + 1, 65535))[real] - 1


def texts_of(batch: pa.RecordBatch | pa.Table, name: str = "text") -> list[str | None]:
    return batch.column(name).to_pylist()


def only(df: DataFrame, *names: str) -> DataFrame:
    """These columns alone, cast to what the operators expect: ids to long, texts to string."""
    kinds = {"doc_id": "long", "conv_id": "long", "item_id": "long", "turn": "long"}
    return df.select(*(F.col(n).cast(kinds.get(n, "string")).alias(n) for n in names))


def named(name: str) -> F.Column:
    """The column of exactly this name, whatever dots, spaces or backticks are in it."""
    return F.col(f"`{name.replace('`', '``')}`")


def packed_rows(df: DataFrame) -> DataFrame:
    """``row``: each row whole, as a struct, so that other columns may be added without a clash of names."""
    return df.select(F.struct(*(named(c).alias(c) for c in df.columns)).alias("row"))


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text, modulo 5, is 0: such rows are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def total_chars(docs: DataFrame) -> int:
    return int(docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0)
