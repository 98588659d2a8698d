"""Chat formatting (operator 6): preference pairs with one shared prompt, in DataFrame functions only.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns is rendered once, as the
prompt; the rest of either is its completion, and the mask lists the character ranges of a completion that
train a model: the assistant's texts with their end marks. Offsets are running sums over a conversation's turns,
so a conversation costs time in proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import common as C

END = "<|end|>\n"


def _seg(role: Column, text: Column) -> Column:
    """A turn as it is rendered."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit(END))


def _conversations(turns: DataFrame, version: str | None) -> DataFrame:
    """conv_id, version (0 without such a column), turns: each turn with the length of its head and the end of it in the rendered conversation, in order."""
    v = F.lit(0) if version is None else F.col(version)
    four = [F.col(c).cast(kind).alias(c) for c, kind in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))]
    turns = turns.select(*four, v.cast("int").alias("version")).where(F.col("conv_id").isNotNull())
    turns = turns.withColumns({"role": F.coalesce("role", F.lit("unknown")), "text": F.coalesce("text", F.lit(""))})
    turns = turns.withColumns({"head": F.length("role") + len("<||>\n"), "size": F.length(_seg(F.col("role"), F.col("text"))).cast("long")})
    w = Window.partitionBy("conv_id", "version").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    turns = turns.withColumns({"at": F.row_number().over(w), "stop": F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return turns.groupBy("conv_id", "version").agg(F.sort_array(F.collect_list(F.struct("at", "role", "text", "head", "size", "stop"))).alias("turns"))


def _common(a: Column, b: Column) -> Column:
    """How many leading turns are the same in role and text."""
    both = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, both), F.slice(b, 1, both), lambda x, y: (x["role"] == y["role"]) & (x["text"] == y["text"]))
    first = F.array_position(same, False)
    return F.when(first == 0, both).otherwise(first - 1).cast("int")


def _tail(turns: Column, n: Column) -> Column:
    return F.slice(turns, n + 1, F.size(turns))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: _seg(t["role"], t["text"])), "")


def _mask(turns: Column, n: Column) -> Column:
    base = F.when(n == 0, F.lit(0).cast("long")).otherwise(F.get(turns, n - 1)["stop"])
    spans = lambda t: F.struct((t["stop"] - t["size"] + t["head"] - base).alias("start"), (t["stop"] - base).alias("stop"))
    return F.transform(F.filter(_tail(turns, n), lambda t: t["role"] == "assistant"), spans)


def preference_pairs(turns: DataFrame, pairs: DataFrame, version: str | None = None) -> DataFrame:
    """chosen_id, rejected_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask of each pair.

    ``turns`` has conv_id, turn, role, text; ``pairs`` has chosen_id and rejected_id. Pairs with an unknown or null
    conversation go. Turns are ordered by turn (null last), role, text, repeated ones included; a null role is
    rendered as ``unknown``, a null text as nothing. Masks are half-open character ranges of the completion. Equal
    conversations give empty completions; no common turn gives an empty prompt; an empty table gives no row. A text of any length is
    rendered whole; a conversation, and a pair of them, is one row.

    ``version`` names a column of both tables, an integer: in ``turns`` it tells apart versions of one conversation, of which version 0 is chosen; in
    ``pairs`` it says which version of the other is rejected, and the result has it too, as ``rejected_version``.
    """
    convs = _conversations(turns, version)
    side = lambda name: convs.select(F.col("conv_id").alias(f"{name}_id"), F.col("version").alias(f"{name}_version"), F.col("turns").alias(f"{name}_turns"))
    pairs = pairs.select(F.col("chosen_id").cast("long").alias("chosen_id"), F.col("rejected_id").cast("long").alias("rejected_id"), (F.lit(0) if version is None else F.col(version)).cast("int").alias("rejected_version"))
    both = pairs.join(side("chosen").where("chosen_version = 0"), "chosen_id").join(side("rejected"), ["rejected_id", "rejected_version"])
    c, r = F.col("chosen_turns"), F.col("rejected_turns")
    n = F.col("n_prompt_turns")
    both = both.withColumn("n_prompt_turns", _common(c, r))
    extra = [] if version is None else ["rejected_version"]
    return both.select("chosen_id", "rejected_id", *extra, "n_prompt_turns", _text(F.slice(c, 1, n)).alias("prompt"), _text(_tail(c, n)).alias("chosen"), _text(_tail(r, n)).alias("rejected"), _mask(c, n).alias("chosen_mask"), _mask(r, n).alias("rejected_mask"))


def with_swaps(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns and pairs for ``preference_pairs`` (column ``version``): 2k over 2k + 1 (version 0), and each conversation c over itself (version 1) with its last assistant turn from c + 1.

    Conversations without an assistant turn, or whose neighbour has none, have no pair of the second kind. A version is told by its own column, so ids may be
    any numbers; a null id has no pair. Other columns are ignored.
    """
    turns = C.only(turns, "conv_id", "turn", "role", "text")
    own = turns.where("role = 'assistant' AND turn IS NOT NULL").groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("x"))
    swaps = own.select("conv_id", F.col("x.turn").alias("last")).join(own.select((F.col("conv_id") - 1).alias("conv_id"), F.col("x.text").alias("other")), "conv_id")
    text = F.when((F.col("role") == "assistant") & (F.col("turn") == F.col("last")), F.col("other")).otherwise(F.col("text"))
    swapped = turns.join(swaps, "conv_id").select("conv_id", "turn", "role", text.alias("text"), F.lit(1).alias("version"))
    pairs = turns.select("conv_id").where(F.col("conv_id") % 2 == 0).distinct().select(F.col("conv_id").alias("chosen_id"), (F.col("conv_id") + 1).alias("rejected_id"), F.lit(0).alias("version"))
    return turns.withColumn("version", F.lit(0)).union(swapped), pairs.union(swaps.select("conv_id", "conv_id", F.lit(1)))


def op6_preference_pairs(spark, sf_dir: str) -> DataFrame:
    """Both kinds of pairs of ``with_swaps``, over ``conversations``; the second kind shows conversation c's own version as -1 - c.

    Of one chosen_id these differ from the first kind's rejected_id, whatever ids there are. Masks as text, ``start:stop`` by commas. See
    ``preference_pairs`` for nulls and ties.
    """
    out = preference_pairs(*with_swaps(spark.read.parquet(f"{sf_dir}/conversations.parquet")), version="version")
    out = out.withColumn("rejected_id", F.when(F.col("rejected_version") == 0, F.col("rejected_id")).otherwise(-1 - F.col("rejected_id")))
    shown = lambda m: F.array_join(F.transform(m, lambda x: F.concat_ws(":", x["start"].cast("string"), x["stop"].cast("string"))), ",").alias(m)
    return out.select("chosen_id", "rejected_id", "n_prompt_turns", "prompt", "chosen", "rejected", shown("chosen_mask"), shown("rejected_mask"))


OP6_SQL = """
WITH u AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
a AS (SELECT conv_id, max(turn) AS last, arg_max(text, (turn, text)) AS text FROM u WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY conv_id),
x AS (SELECT a.conv_id, a.last, o.text AS other FROM a JOIN a o ON o.conv_id = a.conv_id + 1),
t AS (SELECT *, 0 AS v FROM u UNION ALL SELECT -1 - u.conv_id, turn, role, CASE WHEN role = 'assistant' AND turn = last THEN other ELSE text END, 1 FROM u JOIN x USING (conv_id)),
s AS (SELECT conv_id, v, role, '<|' || role || '|>' || chr(10) AS head, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS seg,
             row_number() OVER (PARTITION BY conv_id, v ORDER BY turn NULLS LAST, role, text) AS k FROM t),
p AS (SELECT DISTINCT conv_id AS chosen_id, conv_id + 1 AS rejected_id, 0 AS w FROM u WHERE conv_id % 2 = 0 AND conv_id + 1 IN (SELECT conv_id FROM u) UNION ALL SELECT conv_id, -1 - conv_id, 1 FROM x),
j AS (SELECT chosen_id, rejected_id, w, coalesce(c.k, r.k) AS k, c.seg IS NOT DISTINCT FROM r.seg AS same
      FROM (SELECT * FROM p JOIN s ON conv_id = chosen_id AND v = 0) c FULL JOIN (SELECT chosen_id, rejected_id, w, k, seg FROM p JOIN s ON conv_id = rejected_id AND v = w) r
      USING (chosen_id, rejected_id, w, k)),
n AS (SELECT chosen_id, rejected_id, w, (coalesce(min(k) FILTER (WHERE NOT same), max(k) + 1) - 1)::INTEGER AS n FROM j GROUP BY ALL),
o AS (SELECT n.*, conv_id = chosen_id AS is_chosen, k, role, head, seg,
             sum(CASE WHEN k > n THEN length(seg) ELSE 0 END) OVER (PARTITION BY chosen_id, rejected_id, conv_id ORDER BY k) AS stop
      FROM n JOIN s ON conv_id IN (chosen_id, rejected_id) AND v = CASE WHEN conv_id = chosen_id THEN 0 ELSE w END)
SELECT chosen_id, rejected_id, n AS n_prompt_turns,
       coalesce(string_agg(seg, '' ORDER BY k) FILTER (WHERE is_chosen AND k <= n), '') AS prompt,
       coalesce(string_agg(seg, '' ORDER BY k) FILTER (WHERE is_chosen AND k > n), '') AS chosen,
       coalesce(string_agg(seg, '' ORDER BY k) FILTER (WHERE NOT is_chosen AND k > n), '') AS rejected,
       coalesce(string_agg((stop - length(seg) + length(head))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY k) FILTER (WHERE is_chosen AND k > n AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg((stop - length(seg) + length(head))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY k) FILTER (WHERE NOT is_chosen AND k > n AND role = 'assistant'), '') AS rejected_mask
FROM o GROUP BY chosen_id, rejected_id, n
"""
