"""Connected components of links, as a loop of joins; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import common as C


def components(links: DataFrame) -> DataFrame:
    """id, label: the least id that each id of ``links`` (a, b: longs) is connected to.

    Every round takes the least label among neighbours and then the label's own label, so the number of rounds is
    about the logarithm of the longest path; each round is written, so a lost executor costs one round at most. The caller
    deletes the result (``common.forget``).
    """
    both = C.written(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct())
    table = labels = C.written(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label")).withColumnRenamed("a", "id"))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        least = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        own = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = C.written(least.join(own, "label", "left").select("id", "old", F.least("label", "up").alias("label")))
        C.forget(table)
        table, labels = new, new.select("id", "label")
        if new.where("old <> label").isEmpty():
            C.forget(both)
            labels.table_path = new.table_path
            return labels
