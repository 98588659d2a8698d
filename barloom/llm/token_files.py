"""Token counts (operator 2): a separator scan over flat token files.

A token file is a run of little-endian 16-bit ids, each document closed by an end-of-document id; nothing says where
documents begin. The scan cuts a file into blocks, finds the separators of a block with one vectorised comparison,
and reports the block's separators and the documents that start in it. A document may cross any number of blocks:
a prefix scan over a file's blocks (running counts of starts and separators, and the last start so far) tells
each block which document is open where it begins.

``write`` makes such files with Spark's own writer: a document's ids are a line whose line end is the separator.
Each document begins with its id in ``HEADER`` digits below the separator, so files need no index beside them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm import common as C
from barloom.llm.bpe import Encoder, default_vocabulary

SEPARATOR = 50256
HEADER = 5
DIGIT = 15
NULL_ID = 1 << 64
#: Documents of a file that is written, and ids of a block.
FILE_DOCS = 2000
BLOCK = 1 << 16
#: Blocks of a file that a task reads at once.
RANGE = 64


def _header(doc_id: int | None) -> bytes:
    n = NULL_ID if doc_id is None else doc_id % NULL_ID
    return np.array([n >> DIGIT * i & (1 << DIGIT) - 1 for i in range(HEADER)], "<u2").tobytes()


def _doc_id(digits: list[int]) -> int | None:
    n = sum(d << DIGIT * i for i, d in enumerate(digits))
    return None if n >= NULL_ID else n - NULL_ID if n >> 63 else n


def write(docs: DataFrame, path: str, vocabulary: str, pattern: str) -> None:
    """Flat token files of ``docs`` (doc_id, text) under ``path``. A null text is a document without tokens."""
    C.small_batches(docs.sparkSession)

    def run(batches):
        encoder = Encoder(vocabulary, pattern)
        if len(encoder.ranks.bytes) > SEPARATOR:
            raise ValueError(f"{vocabulary} has ids from {SEPARATOR} on, which these files cannot hold")
        for b in batches:
            ids = (np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in encoder(C.texts_of(b)))
            yield pa.record_batch({"ids": pa.array([_header(i) + x for i, x in zip(b.column("doc_id").to_pylist(), ids, strict=True)], pa.binary())})

    flat = C.only(docs, "doc_id", "text").mapInArrow(run, "ids binary").select(F.col("ids").cast("string").alias("value"))
    end = SEPARATOR.to_bytes(2, "little").decode("latin-1")
    flat.write.option("encoding", "ISO-8859-1").option("lineSep", end).option("maxRecordsPerFile", FILE_DOCS).text(path)


def _store(name: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it of a file as Spark names it."""
    if name.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + name[5:].lstrip("/")
    return pafs.FileSystem.from_uri(name)


def _seekable(name: str) -> bool:
    try:
        store, at = _store(name)
        return store.get_file_info(at).is_file
    except (OSError, ValueError, NotImplementedError):
        return False


def blocks(spark: SparkSession, path: str, separator: int = SEPARATOR, header: int = HEADER, block: int = BLOCK) -> DataFrame:
    """file, block, starts (array of (at, head)), stops (array of positions): what a block of each file of ``path`` shows.

    ``at`` and the positions count ids from the file's beginning; ``head`` has a document's first ``header`` ids.
    The end of a file ends an unterminated document. Empty files have no block. Tasks read ranges of a file, so it may be
    of any size; only from a store that Spark alone can open, a file is read whole, by one task.
    """
    C.small_batches(spark)
    files = spark.read.format("binaryFile").load(path)
    kind = pa.schema([("file", pa.string()), ("block", pa.int64()), ("starts", pa.list_(pa.struct([("at", pa.int64()), ("head", pa.list_(pa.int32()))]))), ("stops", pa.list_(pa.int64()))])

    def shown(name, ids, begin, first, last, total):
        """The blocks from ``first`` to ``last`` (ids of a file); ``ids`` begin with the file's id ``begin`` and go on for a header after ``last``."""
        rows = []
        for lo in range(first, last, block):
            hi = min(lo + block, total)
            stops = np.flatnonzero(ids[lo - begin : hi - begin] == separator) + lo
            starts = stops[stops + 1 < hi] + 1
            if not lo or ids[lo - 1 - begin] == separator:
                starts = np.concatenate([[lo], starts])
            if hi == total and ids[total - 1 - begin] != separator:
                stops = np.append(stops, total)
            rows.append({"file": name, "block": lo // block, "starts": [{"at": int(s), "head": ids[s - begin : s - begin + header].tolist()} for s in starts], "stops": stops.tolist()})
        return pa.Table.from_pylist(rows, kind).to_batches()

    def whole(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                ids = np.frombuffer(content.as_buffer(), "<u2")
                yield from shown(name, ids, 0, 0, len(ids), len(ids))

    def ranged(batches):
        for b in batches:
            for name, length, first in zip(*(b.column(c).to_pylist() for c in ("path", "length", "first")), strict=True):
                if length % 2:
                    raise ValueError(f"{name}: not a file of 16-bit ids")
                total = length // 2
                last, begin = min(first + RANGE * block, total), max(0, first - 1)
                store, at = _store(name)
                with store.open_input_file(at) as f:
                    ids = np.frombuffer(f.read_at(2 * (min(last + header, total) - begin), 2 * begin), "<u2")
                yield from shown(name, ids, begin, first, last, total)

    out = "file string, block long, starts array<struct<at:long,head:array<int>>>, stops array<long>"
    some = files.select("path").first()
    if some and not _seekable(some.path):
        return files.select("path", "content").mapInArrow(whole, out)
    step = 2 * RANGE * block
    ranges = files.select("path", "length").where("length > 0").select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / step))).alias("k"))
    tasks = max(1, spark.sparkContext.defaultParallelism, ranges.count() // 4)  # a number, as rows so small would be put into one task
    return ranges.select("path", "length", (F.col("k") * (RANGE * block)).alias("first")).repartition(tasks, "path", "first").mapInArrow(ranged, out)


def lengths(found: DataFrame) -> DataFrame:
    """file, at, head, n: start, first ids and number of ids (without the separator) of each document of ``blocks``.

    The scan has two levels: what ranges of RANGE blocks add up to, of which a file has one row each, and then the blocks within a range. What
    a range takes over is the number of starts and stops before it and the last start. ``found`` is read twice.
    """
    size = lambda c: F.size(c).cast("long")
    table = found.withColumn("range", F.floor(F.col("block") / RANGE))
    last = F.when(F.size("starts") > 0, F.element_at("starts", -1))
    totals = table.groupBy("file", "range").agg(F.sum(size("starts")).alias("_s"), F.sum(size("stops")).alias("_e"), F.max_by(last, F.when(last.isNotNull(), F.col("block"))).alias("_l"))
    w = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0).cast("long"))
    totals = totals.select("file", "range", (before("_s") - before("_e")).alias("_ahead"), F.last("_l", ignorenulls=True).over(w).alias("_from"))
    inside = Window.partitionBy("file", "range").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_ahead") + F.coalesce(F.sum(size("starts") - size("stops")).over(inside), F.lit(0).cast("long"))
    df = table.join(totals, ["file", "range"]).withColumns({"open": ahead > 0, "carried": F.coalesce(F.last(last, ignorenulls=True).over(inside), "_from")})
    begun = F.when(F.col("open"), F.concat(F.array("carried"), "starts")).otherwise(F.col("starts"))
    pairs = F.zip_with(F.slice(begun, 1, F.size("stops")), "stops", lambda s, e: F.struct(s["at"].alias("at"), s["head"].alias("head"), (e - s["at"]).alias("n")))
    return df.select("file", F.explode(pairs).alias("x")).select("file", "x.*")


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens of each document, by way of flat token files in ``path`` (new, in the shared folder by default).

    A null or empty text counts 0; repeated rows each give a row; a null doc_id is kept; other columns are ignored; an
    empty table gives none. A text of any length is encoded whole, by one task, and counted across the blocks it fills. Files
    in a folder of our own are deleted once they are counted.
    """
    own, path = path is None, path or C.shared_dir(docs.sparkSession)
    write(docs, path, *default_vocabulary())
    digits = sum((F.get("head", i).cast("long") * F.lit(1 << DIGIT * i) for i in range(HEADER - 1)), F.lit(0).cast("long"))
    top = F.get("head", HEADER - 1)  # bits 60 to 74: four of the id, and one that says null
    doc_id = F.when(top >= 16, None).otherwise(digits.bitwiseOR(F.shiftleft(top.cast("long"), DIGIT * (HEADER - 1))))
    found = C.written(blocks(docs.sparkSession, path))
    out = lengths(found).select(doc_id.alias("doc_id"), (F.col("n") - HEADER).alias("n_tokens"))
    if own:
        out = C.written(out)
        C.forget(found)
        C.delete(docs.sparkSession, path)
    return out


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    """The number of tokens of every row of ``documents``; see ``token_counts``."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
