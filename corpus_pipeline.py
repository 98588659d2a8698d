"""From documents to token ids: five stages, each written as Parquet and read again by the next.

Quality rules and line, near-duplicate and benchmark filters return the columns of ``documents``; the last stage
encodes what is left and checks that it decodes to the same bytes. SQL cannot express line joins, sampling or
BPE, so ``ORACLE_SQL`` is None and tests compare ``run`` with a brute-force version.

In every stage a row is judged by its own text, whatever rows share its doc_id or have none; columns beyond those of
``documents`` pass through, whatever their names; an empty table gives an empty one; texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, common, decontaminate, lines, near, quality_rules


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that a rule rejects go, null and empty texts among them (fewer than 20 words); repeated rows alike."""
    return quality_rules.passing(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: lines that occur earlier, or nearly so, go; so does a document that has none left. Null and blank texts stay; a null doc_id is last."""
    out = lines.without_removed(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*map(common.named, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each class of near-duplicates stays, the least doc_id; rows without words or doc_id all stay."""
    return near.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a benchmark item go; null and empty texts hold none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: token counts and digests of the ids and of what they decode to; a null text is an empty one, repeated rows each give a row."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table is deleted once the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir))
        if before is not None:
            common.forget(before)
        before = docs
    return docs
