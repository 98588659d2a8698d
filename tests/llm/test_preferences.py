"""Preference pairs against a plain loop, with ids of any sign, and against their SQL."""

import random

import duckdb
from pyspark.sql import functions as F

from barloom.llm import preferences


def seg(role, text):
    return f"<|{role}|>\n{text}<|end|>\n"


def rendered(turns):
    """Text and mask of a completion."""
    out, mask = "", []
    for role, text in turns:
        if role == "assistant":
            head = len(f"<|{role}|>\n")
            mask.append(f"{len(out) + head}:{len(out) + len(seg(role, text))}")
        out += seg(role, text)
    return out, ",".join(mask)


def brute(rows):
    convs, last = {}, {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is None, turn or 0, role or "unknown", text or ""))
            if role == "assistant" and turn is not None:
                last[c] = max(last.get(c, (turn, text or "")), (turn, text or ""))
    plain = lambda ts: [t[2:] for t in sorted(ts)]
    pairs = [(c, c + 1, convs[c], convs[c + 1]) for c in convs if c % 2 == 0 and c + 1 in convs]
    for c in last:
        if c + 1 in last:
            at = last[c][0]
            own = [(null, turn, role, last[c + 1][1] if role == "assistant" and not null and turn == at else text) for null, turn, role, text in convs[c]]
            pairs.append((c, -1 - c, convs[c], own))
    out = []
    for chosen_id, rejected_id, a, b in pairs:
        a, b = plain(a), plain(b)
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        (chosen, cm), (rejected, rm) = rendered(a[n:]), rendered(b[n:])
        out.append((chosen_id, rejected_id, n, rendered(a[:n])[0], chosen, rejected, cm, rm))
    return sorted(out)


def rows_of():
    rng = random.Random(4)
    rows = [(None, 0, "user", "no id"), (7, None, "assistant", "late"), (7, 0, None, None)]
    for c in range(-6, 6):
        for turn in range(2 + rng.randrange(3)):
            rows.append((c, turn, ("user", "assistant")[turn % 2], rng.choice(["x", "y", "", None, "long " * 3])))
    rows.append((2, 1, "assistant", "of equal turn"))
    rows += rows[5:8]
    return rows


def test_versions_do_not_meet_conversations_of_negative_ids(spark, tmp_path):
    rows = rows_of()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("version", F.lit("other"))
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    got = sorted(map(tuple, preferences.op6_preference_pairs(spark, str(tmp_path)).collect()))
    want = brute(rows)
    assert got == want and {(-2, -1), (0, -1)} <= {(c, r) for c, r, *_ in got}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    assert sorted(db.execute(preferences.OP6_SQL).fetchall()) == want


def test_texts_of_megabytes(spark, tmp_path):
    long = "word " * 600_000
    rows = [(0, 0, "user", long), (0, 1, "assistant", "a"), (1, 0, "user", long), (1, 1, "assistant", long)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pairs = spark.createDataFrame([(0, 1)], "chosen_id long, rejected_id long")
    r = preferences.preference_pairs(df, pairs).first()
    assert r.n_prompt_turns == 1 and r.prompt == seg("user", long) and r.rejected == seg("assistant", long)
    assert [tuple(x) for x in r.rejected_mask] == [(14, len(r.rejected))]
