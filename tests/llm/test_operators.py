"""Each operator's query against SQL or a brute-force version, and the odd cases: nulls, empty texts, ties, clashing columns."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.llm import common, decontaminate, near, preferences, quality_model, quality_rules, repeats, token_files, toxicity
from barloom.llm.queries import QUERIES, SQL
from tests.helpers import oracle, rows
from tests.llm.test_lines import keys_of

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
#: Ids, texts, and columns whose names the operators use inside.
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (None, "a b c"), (5, "x " * 9000), (6, "tie tie tie"), (6, "tie tie tie"), (7, "é 中 \U0001f600 \x1c"), (8, "word " * 40)]


def docs(spark, pairs):
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    return df.withColumns({c: F.lit("x") for c in ("words", "score", "id", "key", "n", "_s", "bucket", "chunk", "sig", "label")})


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF)
    # from rows, not by toPandas: that makes floats of longs as soon as one is null
    assert rows(pd.DataFrame(map(tuple, got.collect()), columns=got.columns, dtype=object)) == rows(oracle(SF, SQL[name]))


def test_packed_steps():
    rng = np.random.default_rng(1)
    for high in (10, 70_000, 10_000_000):
        x = np.unique(rng.integers(0, high, 500))
        assert (common.unpacked(common.packed(x)) == x).all()
    assert len(common.unpacked(common.packed(np.zeros(0, np.int64)))) == 0


def brute_repeats(pairs, width, key):
    order = sorted(range(len(pairs)), key=lambda i: (math.inf if pairs[i][0] is None else pairs[i][0], key(pairs[i][1])))
    seen, out = set(), []
    for i in order:
        ws = (pairs[i][1] or "").encode().split()
        gone = set()
        for p in range(len(ws) - width + 1):
            w = tuple(ws[p : p + width])
            if w in seen:
                gone.update(range(p, p + width))
            seen.add(w)
        out.append((str(pairs[i][0]), len(ws), len(gone), b" ".join(w for j, w in enumerate(ws) if j not in gone).decode()))
    return sorted(out)


@pytest.mark.parametrize("chunk", [6_000_000, 200])
def test_repeats(spark, monkeypatch, chunk):
    monkeypatch.setattr(repeats, "CHUNK_CHARS", chunk)
    monkeypatch.setattr(repeats, "RANGE_ENTRIES", 100)
    rng = np.random.default_rng(2)
    some = [" ".join(rng.choice(list("abcd"), 12)) for _ in range(12)]
    pairs = [*ODD[:5], *ODD[6:], *((20 + i, "\n".join(rng.choice(some, 4))) for i in range(30))]
    pairs += [(d, "\n".join(rng.choice(some, 3))) for d in (None, None, None, 25, 25, 26)]
    got = repeats.remove_repeats(docs(spark, pairs), width=6).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in got) == brute_repeats(pairs, 6, keys_of(spark, pairs))
    assert repeats.remove_repeats(docs(spark, ODD).limit(0)).count() == 0


def test_quality_rules_on_odd_rows(spark):
    got = {(r.doc_id, r.n_words): r for r in quality_rules.judged(docs(spark, ODD)).collect()}
    assert len(quality_rules.judged(docs(spark, ODD)).collect()) == len(ODD)
    assert got[(1, 0)].base_failed and got[(8, 40)].n_repeat_words == 40 and not got[(8, 40)].kept
    assert got[(7, 4 if (7, 4) in got else 3)].word_chars >= 3
    kept = quality_rules.passing(docs(spark, [*ODD, (9, " ".join(f"Word{chr(97 + i % 26)}{i * 7}" for i in range(40)))]))
    assert [r.doc_id for r in kept.collect()] == [9] and "label" in kept.columns
    assert quality_rules.judged(docs(spark, ODD).limit(0)).count() == 0


def test_rule_order_changes_no_verdict(spark):
    df = docs(spark, ODD)
    t, w = F.col("text"), F.split("text", " ")
    names = list(quality_rules.RULES)
    both = df.fillna({"text": ""}).select(quality_rules.verdict(names, quality_rules.RULES, t, w).alias("a"), quality_rules.verdict(names[::-1], quality_rules.RULES, t, w).alias("b"))
    assert both.where("a <> b").isEmpty()


def test_preferences(spark):
    turns = [(0, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", "bad"), (1, 2, None, None), (2, 0, "user", "a"), (3, 0, "user", "b"), (4, 0, "user", "same"), (5, 0, "user", "same"), (None, 0, "user", "x"), (8, None, "user", "no partner")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("seg", F.lit(1))
    pairs = spark.createDataFrame([(0, 1), (2, 3), (4, 5), (8, 9), (None, 1)], "chosen_id long, rejected_id long")
    got = {r.chosen_id: r for r in preferences.preference_pairs(df, pairs).collect()}
    assert sorted(got) == [0, 2, 4]
    r = got[0]
    assert r.prompt == "<|user|>\nq<|end|>\n" and r.chosen == "<|assistant|>\ngood<|end|>\n"
    assert [r.chosen[s:e] for s, e in r.chosen_mask] == ["good<|end|>\n"] and [r.rejected[s:e] for s, e in r.rejected_mask] == ["bad<|end|>\n"]
    assert r.rejected.endswith("<|unknown|>\n<|end|>\n")
    assert got[2].prompt == "" and got[4].chosen == got[4].rejected == "" and got[4].chosen_mask == []
    assert preferences.preference_pairs(df.limit(0), pairs).count() == 0


def weighted(a, b, df, n):
    weight = lambda g: sum(math.log(2 + math.log((1 + n) / (1 + df[w]))) for w in g.split()) / 5
    grams = lambda t: [" ".join(t[i : i + 5]) for i in range(len(t) - 4)]
    from collections import Counter

    x, y = Counter(grams(a)), Counter(grams(b))
    low = sum(min(x[g], y[g]) * weight(g) for g in x.keys() | y.keys())
    return low / max(1e-9, sum(max(x[g], y[g]) * weight(g) for g in x.keys() | y.keys()))


def test_near_classes_against_all_pairs(spark):
    from collections import Counter

    rng = np.random.default_rng(4)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(300)]
    base = [list(rng.choice(vocabulary, 60)) for _ in range(8)]
    pairs = [*ODD, (9, "one"), (10, "a b c d e f g"), (11, "a  b c\nd e f g")]
    for i in range(120):
        t = list(base[int(rng.integers(8))])
        for _ in range(int(rng.integers(0, 3))):
            t[int(rng.integers(60))] = str(rng.choice(vocabulary))
        pairs.append((100 + i, " ".join(t)))
    out = near.near_classes(docs(spark, pairs)).collect()
    assert len(out) == len(pairs)
    got = {r.doc_id: r.class_id for r in out}
    texts = {d: (t or "").split() for d, t in pairs if d is not None}
    df = Counter(w for _, t in pairs for w in set((t or "").split()))
    parent = {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    sure = []
    for a in texts:
        for b in texts:
            if a < b and texts[a]:
                s = weighted(texts[a], texts[b], df, len(pairs))
                if s >= 0.8 or texts[a] == texts[b]:
                    parent[max(root(a), root(b))] = min(root(a), root(b))
                sure.append(abs(s - 0.8) > 1e-3)
    assert {d: root(d) for d in texts} == {d: c for d, c in got.items() if d is not None}
    assert got[None] is None
    kept = near.one_of_each(docs(spark, pairs)).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted([*map(str, {d for d in texts if root(d) == d}), "None"])
    assert near.near_classes(docs(spark, ODD).limit(0)).count() == 0


def test_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(6)
    h = common.mixed(np.arange(1, 401, dtype=np.uint64))
    w = rng.uniform(0.5, 3, 400).astype(np.float32)
    a, b = np.arange(0, 300), np.arange(60, 400)
    sampler = near.Sampler(2000)
    x, y = (sampler(np.sort(h[i]), w[i][np.argsort(h[i])], np.array([0]))[0] for i in (a, b))
    want = w[60:300].sum() / w.sum()
    assert abs((x == y).mean() - want) < 0.05


def test_spanning_links_join_what_is_similar():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(200)]
    base = list(rng.choice(words, 80))
    texts = []
    for _ in range(30):
        t = list(base)
        for _ in range(int(rng.integers(1, 6))):
            t[int(rng.integers(80))] = str(rng.choice(words))
        texts.append(" ".join(t))
    weight = np.ones(near.DF_CELLS, np.float32)
    h, w, bounds, _ = near.shingles(texts, weight)
    part = lambda i: (h[bounds[i] : bounds[i + 1]], w[bounds[i] : bounds[i + 1]])
    links = near.spanning_links(list(range(30)), texts, np.ones(30, bool), weight, columns=64)
    parent, brute = list(range(30)), list(range(30))

    def root(p, i):
        while p[i] != i:
            i = p[i]
        return i

    for a, b in links:
        assert near.weighted_jaccard(part(a), part(b)) >= 0.8
        parent[root(parent, a)] = root(parent, b)
    for i in range(30):
        for j in range(i):
            if near.weighted_jaccard(part(i), part(j)) >= 0.8:
                brute[root(brute, i)] = root(brute, j)
    group = lambda p: {frozenset(j for j in range(30) if root(p, j) == root(p, i)) for i in range(30)}
    assert group(parent) == group(brute) and len(links) < 30


def test_decontamination(spark):
    question = "Which river flows through the old town of the northern port city near the hills?"
    item = f"{question}\nThe answer is the silver river of glass."
    filler = " ".join(f"filler{i}" for i in range(300))
    pairs = [*ODD, (20, f"{filler} {item} {filler}"), (21, item.upper()), (22, f"{filler} {question} nothing else"), (23, filler)]
    items = spark.createDataFrame([(1, item), (2, "Something else entirely about mountains and lakes of the far south."), (3, None), (4, ""), (None, item)], "item_id long, text string")
    got = decontaminate.contaminated(docs(spark, pairs), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(20, 1), (21, 1)]
    assert sorted(str(r.doc_id) for r in decontaminate.clean(docs(spark, pairs), items).select("doc_id").collect()) == sorted(str(d) for d, _ in pairs if d not in (20, 21))
    assert decontaminate.contaminated(docs(spark, pairs), items.limit(0)).count() == 0
    assert decontaminate.contaminated(docs(spark, pairs).limit(0), items).count() == 0


def test_wand_finds_all_above_the_threshold():
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)]
    index = decontaminate.Index([(i, " ".join(rng.choice(words, 12))) for i in range(70)])
    for _ in range(60):
        q = np.unique(index.known(decontaminate.terms([" ".join(rng.choice(words, 25))])[0]))
        q = q[q >= 0].tolist()
        score = np.zeros(70)
        for t in q:
            score[index.postings[t][0]] += index.postings[t][1]
        for least in (0.2, 0.5):
            assert sorted(i for i, _ in index.wand(q, least)) == np.flatnonzero(score >= least - 1e-12).tolist()


@pytest.mark.parametrize("block", [1 << 16, 7])
def test_token_files(spark, tmp_path, monkeypatch, block):
    from barloom.llm import bpe

    path = str(tmp_path / "t")
    token_files.write(docs(spark, ODD).repartition(3), path, *bpe.default_vocabulary())
    found = token_files.lengths(token_files.blocks(spark, path, block=block)).collect()
    encoder = bpe.Encoder(*bpe.default_vocabulary())
    want = sorted((str(d), len(encoder([t])[0]) // 4) for d, t in ODD)
    assert sorted((str(token_files._doc_id(list(r["head"]))), r["n"] - token_files.HEADER) for r in found) == want
    assert sorted((str(r.doc_id), r.n_tokens) for r in token_files.token_counts(docs(spark, ODD)).collect()) == want
    assert token_files.token_counts(docs(spark, ODD).limit(0)).count() == 0


def test_foreign_token_file_without_last_separator(spark, tmp_path):
    (tmp_path / "f.bin").write_bytes(np.array([5, 6, 9, 9, 7, 9, 8, 8], "<u2").tobytes())
    got = token_files.lengths(token_files.blocks(spark, str(tmp_path), separator=9, header=1, block=3)).orderBy("at").collect()
    assert [(r["at"], r["n"]) for r in got] == [(0, 2), (3, 0), (4, 1), (6, 2)]
    assert [token_files._doc_id(np.frombuffer(token_files._header(i), "<u2").tolist()) for i in (0, -1, 2**62, -(2**63), None)] == [0, -1, 2**62, -(2**63), None]


def test_crf_marginals_are_those_of_all_paths():
    crf = toxicity.Crf()
    rng = np.random.default_rng(9)
    crf.move = rng.normal(size=(2, 2))
    counts = np.array([3, 0, 5, 1])
    odds = rng.normal(size=9)
    got = 1 / (1 + np.exp(-crf.marginals(odds, counts)))
    want = []
    for a, b in zip(np.cumsum(counts) - counts, np.cumsum(counts)):
        e, n = odds[a:b], b - a
        total, ones = 0.0, np.zeros(n)
        for path in range(2**n if n else 0):
            y = [path >> i & 1 for i in range(n)]
            s = np.exp(sum(e[i] * y[i] for i in range(n)) + sum(crf.move[y[i], y[i + 1]] for i in range(n - 1)))
            total += s
            ones += s * np.array(y)
        want += list(ones / total) if n else []
    assert np.allclose(got, want)


@needs_data
@pytest.mark.parametrize("name, label, least", [("op1_toxicity", "toxic", 0.95), ("op9_quality", "quality", 0.97)])
def test_models_on_held_out_rows(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    out = QUERIES[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert out.score.between(0, 1).all() and (out.predicted == out[label]).mean() >= least


def test_models_on_odd_rows(spark):
    clean, toxic = "the quiet river runs down to the sea", "you are such an idiot and a moron my friend"
    texts = [(f"{clean} {i}", 0) for i in range(30)] + [(f"{toxic} {i}", 1) for i in range(30)]
    tagger = toxicity.Tagger(texts)
    got = toxicity.tag(docs(spark, [*ODD, (20, f"x {toxic}")]), tagger).collect()
    assert len(got) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in got)
    hit = next(r for r in got if r.doc_id == 20)
    assert hit.score >= 0.5 and any("idiot" in f"x {toxic}"[s.start : s.stop] for s in hit.spans)
    assert toxicity.Tagger([])([None, "a"])[0][0] < 0.5
    vectors = quality_model.word_vectors(docs(spark, ODD))
    net = quality_model.Network(quality_model.pooled([t for t, _ in texts], vectors), np.array([y for _, y in texts], float))
    assert quality_model.score(docs(spark, ODD), vectors, net).count() == len(ODD)
    assert quality_model.score(docs(spark, ODD).limit(0), vectors, net).count() == 0
    labels = spark.createDataFrame([(1, 1), (4, None), (None, 1), (8, 0), (8, 1)], "doc_id long, toxic int")
    from barloom.llm.models import labelled

    assert {y for _, y in labelled(docs(spark, ODD), labels, "toxic", 10)} <= {0, 1}
