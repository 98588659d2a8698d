"""The order of quality rules: greedy by rejections per cost, the same on every run, and never a change of verdict."""

from pyspark.sql import functions as F

from barloom.llm import quality_rules as Q

CLEAN = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))


def table(spark, copies=30):
    texts = [CLEAN] * 4 + ["few words"] + [CLEAN + " # # # # # # # #"] * 3 + [CLEAN.upper()] + [None]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts * copies)], "doc_id long, text string").repartition(4)


def greedy(rows, rules, prices):
    """The same choice by a plain loop over what each rule says of each row."""
    order, left = [], rows
    while len(order) < len(rules):
        chars, words = sum(r["chars"] for r in left), sum(r["words"] for r in left)
        rate = {n: sum(r[n] for r in left) / (prices[n][0] * chars + prices[n][1] * words + Q.ROW_NS * (len(left) + 1)) for n in rules if n not in order}
        order.append(max(rate, key=rate.get))
        left = [r for r in left if not r[order[-1]]]
    return order


def test_order_is_greedy_and_stable(spark):
    df = table(spark)
    said = Q._prepared(df).select(F.length("text").alias("chars"), F.size("words").alias("words"), *(F.coalesce(r(F.col("text"), F.col("words")), F.lit(False)).cast("int").alias(n) for n, r in Q.RULES.items()))
    want = greedy([r.asDict() for r in said.collect()], Q.RULES, Q.PRICES)
    assert {tuple(Q.ordered(df)) for _ in range(3)} == {tuple(want)}
    assert want[0] == "few_words" and sorted(want) == sorted(Q.RULES)
    assert Q.ordered(df.limit(0)) == list(Q.RULES)


def test_prices_decide_between_rules_that_reject_alike(spark):
    df = table(spark)
    rules = {"a": lambda t, w: F.size(w) < 20, "b": lambda t, w: F.length(t) < 20}
    assert Q.ordered(df, rules, prices={"a": (50, 0), "b": (5, 0)}) == ["b", "a"]
    assert Q.ordered(df, rules, prices={"a": (5, 0), "b": (50, 0)}) == ["a", "b"]
    assert Q.ordered(df, rules) == ["a", "b"]  # alike: the order given


def test_rules_and_columns_of_any_name(spark):
    df = table(spark, 3).withColumn("chars", F.lit(1)).withColumn("meta.src", F.lit("x"))
    rules = {"n": Q.RULES["few_words"], "doc.id": Q.RULES["symbols"], "words": lambda t, w: F.lit(None).cast("boolean")}
    assert sorted(Q.ordered(df, rules)) == sorted(rules)
    assert {r.doc_id % 10 for r in Q.passing(df, rules).collect()} == {0, 1, 2, 3, 8}


def test_texts_of_megabytes(spark):
    long = "\n".join(f"{CLEAN} {i}" for i in range(6000))
    got = Q.judged(spark.createDataFrame([(1, long), (2, long + "\n" + long)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.n_words for r in got] == [61 * 6000, 2 * 61 * 6000] and len(long) > 2_000_000
    assert got[1].n_dup_lines == 6000 and got[1].n_repeat_words == got[1].n_words and got[1].base_failed
