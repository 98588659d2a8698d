"""Quality rules (operator 8): a short-circuit cascade of document rules, in DataFrame functions only.

Each rule is a Boolean column over a document. ``ordered`` tries every rule on a bounded sample, and then takes rule after rule: the one that
rejects most of what the rules before it left, per cost, where a cost is the work that it has on those rows (their characters and
words) at the rule's price. ``judged`` chains them with CASE WHEN, so a document that one rule rejects is spared the later ones. The order changes the cost, never the verdict.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import common as C

GAP_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, C.WORD_GAP), lambda w: w != "")


def _removed(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def word_chars(text: Column) -> Column:
    return F.length(_removed(text, GAP_CHARS)).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(_removed(text, SYMBOLS))).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.length(_removed(x, GAP_CHARS)) > 0)


def n_dup_lines(text: Column) -> Column:
    return _let(_lines(text), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))


def n_repeat_words(words: Column) -> Column:
    """Words covered by windows of eight that occur twice or more. Sorting the windows' hashes brings equal ones together."""

    def covered(starts: Column) -> Column:
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last"))
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), step, lambda a: a["n"])

    def repeated(windows: Column) -> Column:
        def starts(s: Column) -> Column:
            same = lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"])
            return F.array_sort(F.transform(F.filter(s, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))

        pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(_let(pairs, lambda s: covered(starts(s))))

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: _let(windows(h), repeated))).cast("long")


def _n(words: Column) -> Column:
    return F.size(words).cast("long")


#: Each rule: whether it rejects a document, of its text and its array of words.
RULES: dict[str, Callable[[Column, Column], Column]] = {
    "few_words": lambda t, w: _n(w) < 20,
    "repeated_windows": lambda t, w: 100 * n_repeat_words(w) > 30 * _n(w),
    "symbols": lambda t, w: 10 * n_symbols(t) > _n(w),
    "exclamations": lambda t, w: 5 * (F.length(t) - F.length(F.replace(t, F.lit("!!"), F.lit("")))) > _n(w),
    "capitals": lambda t, w: 2 * (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))) > word_chars(t),
    "word_length": lambda t, w: (word_chars(t) > 15 * _n(w)) | (word_chars(t) < 2 * _n(w)),
    "repeated_lines": lambda t, w: _let(_lines(t), lambda x: 2 * F.size(F.array_distinct(x)) < F.size(x)),
    "stutter": lambda t, w: 4 * F.size(F.filter(F.zip_with(w, F.array_prepend(w, F.lit("")), lambda a, b: a == b), lambda x: x)) > _n(w),
}


def _prepared(docs: DataFrame) -> DataFrame:
    docs = C.only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    return docs.withColumn("words", _words(F.col("text")))


#: Rows of the sample (about; taken at random, so no more than chance adds).
SAMPLE_ROWS = 1000
#: Nanoseconds a character and a word that each rule takes, as measured in one task on 8,000 documents, words given; a rule not listed is priced by ``ANY_RULE``.
PRICES = {
    "few_words": (0, 0),
    "repeated_windows": (0, 1340),
    "symbols": (60, 0),
    "exclamations": (8, 0),
    "capitals": (80, 0),
    "word_length": (50, 0),
    "repeated_lines": (58, 0),
    "stutter": (0, 56),
}
ANY_RULE, ROW_NS = (60, 0), 100
#: What is counted for the result anyway costs a comparison.
COUNTED = {"few_words": (0, 0), "repeated_windows": (0, 0)}


def ordered(docs: DataFrame, rules: dict[str, Callable] = RULES, sample_rows: int = SAMPLE_ROWS, prices: dict[str, tuple[float, float]] = PRICES) -> list[str]:
    """Names of ``rules`` by rejections per cost on a random sample of about ``sample_rows`` documents.

    One job tries every rule on the sample where its rows are, and returns the rows, characters and words of each combination of
    outcomes. From these, rule after rule is taken: its rejections are of the rows that no rule before it rejects, and its cost is the price of the
    characters and words of those rows. The same table gives the same order; ties keep the order of ``rules``; an empty sample keeps it too.
    """
    n = docs.count()
    if not n:
        return list(rules)
    rows = _prepared(C.only(docs, "doc_id", "text").sample(min(1.0, sample_rows / n), seed=8))
    tests = [F.coalesce(rule(F.col("text"), F.col("words")), F.lit(False)).alias(f"r{i}") for i, rule in enumerate(rules.values())]
    tried = rows.select(F.length("text").alias("chars"), F.size("words").alias("words"), *tests)
    hits = tried.groupBy(*(f"r{i}" for i in range(len(tests)))).agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("words").alias("words")).collect()
    rejects = {name: f"r{i}" for i, name in enumerate(rules)}
    order: list[str] = []
    while len(order) < len(rules):
        left = [h for h in hits if not any(h[rejects[name]] for name in order)]
        of = lambda c: sum(h[c] for h in left)  # noqa: B023, E731
        cost = lambda name: sum(x * y for x, y in zip(prices.get(name, ANY_RULE), (of("chars"), of("words")), strict=True)) + ROW_NS * (of("n") + 1)  # noqa: B023, E731
        rate = {name: sum(h["n"] for h in left if h[rejects[name]]) / cost(name) for name in rules if name not in order}
        order.append(max(rate, key=rate.get))
    return order


def verdict(order: list[str], rules: dict[str, Callable], text: Column, words: Column) -> Column:
    """Whether no rule rejects, tried in this order."""
    chain = None
    for name in order:
        test = rules[name](text, words)
        chain = F.when(test, False) if chain is None else chain.when(test, False)
    return F.lit(True) if chain is None else chain.otherwise(True)


def judged(docs: DataFrame, rules: dict[str, Callable] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept of each document.

    A null text has no words; repeated rows each give a row; a null doc_id is kept; other columns are ignored; an
    empty table gives none. A text of any length is counted whole. The two base rules take their place in the cascade, by the
    counts that are returned anyway.
    """
    order = ordered(docs, rules, sample_rows, PRICES | COUNTED)
    df = _prepared(docs)
    t, w = F.col("text"), F.col("words")
    df = df.select("doc_id", "text", "words", _n(w).alias("n_words"), word_chars(t).alias("word_chars"), n_symbols(t).alias("n_symbols"), n_dup_lines(t).alias("n_dup_lines"), n_repeat_words(w).alias("n_repeat_words"))
    failed = {"few_words": F.col("n_words") < 20, "repeated_windows": 100 * F.col("n_repeat_words") > 30 * F.col("n_words")}
    counted = rules | {name: lambda _t, _w, x=x: x for name, x in failed.items() if name in rules}
    base = failed["few_words"] | failed["repeated_windows"]
    kept = ~base & verdict(order, counted, t, w)
    return df.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), kept.alias("kept"))


def passing(docs: DataFrame, rules: dict[str, Callable] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects, by the cascade alone; each row for its own text (null: none), whatever the other columns."""
    order = ordered(docs, rules, sample_rows)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.where(_let(_words(text), lambda w: verdict(order, rules, text, w)))


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The counts and the verdict of every row of ``documents``; see ``judged`` for nulls and repeated rows."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_BASE_SQL = r"""
t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
win AS (SELECT doc_id, p, array_to_string(ws[p:p + 7], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS p FROM d)),
rep AS (SELECT doc_id, p FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, count(DISTINCT p + k) AS n FROM (SELECT doc_id, p, unnest(range(0, 8)) AS k FROM rep) GROUP BY doc_id),
b AS (SELECT d.doc_id, text, ws, ls, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
      10 * n_symbols > n_words OR 5 * (length(text) - length(replace(text, '!!', ''))) > n_words
      OR 2 * (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g'))) > word_chars
      OR word_chars > 15 * n_words OR word_chars < 2 * n_words OR 2 * len(list_distinct(ls)) < len(ls)
      OR 4 * len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) > n_words AS more_failed FROM b)
"""
OP8_SQL = f"WITH {_BASE_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT more_failed AS kept FROM f"
