import itertools
import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import common as C
from barloom.llm import lines as L


def edit(a, b, band=8):
    """The edit distance, or ``band`` if it is that or more."""
    if abs(len(a) - len(b)) >= band:
        return band
    row = {j: j for j in range(band)}
    for i, x in enumerate(a, 1):
        new = {}
        for j in range(max(0, i - band), min(len(b), i + band) + 1):
            best = row.get(j, band) + 1
            if j:
                best = min(best, new.get(j - 1, band) + 1, row.get(j - 1, band) + (x != b[j - 1]))
            new[j] = best
        row = new
    return min(band, row.get(len(b), band))


def changed(rng, s, n, letters="abcé中"):
    """``s``, a string or a list of words, after ``n`` edits."""
    for _ in range(n):
        i = rng.randrange(max(1, len(s)))
        new = [rng.choice(letters)] if isinstance(s, list) else rng.choice(letters)
        s = rng.choice([s[:i] + s[i + 1 :], s[:i] + new + s[i:], s[:i] + new + s[i + 1 :]])
    return s


def is_near(s, t):
    """Near by words or by characters, at every length."""
    a, b = s.split(), t.split()
    n = max(len(a), len(b))
    if s == t:
        return False
    by_words = min(4, max(min(2, n // 10), n // 25))
    return (by_words > 0 and edit(a, b) <= by_words) or edit(s, t) <= min(2, max(len(s), len(t)) // 10)


def brute(rows, key=lambda t: 0):
    """Of each row (in order): n_lines, n_removed, n_links, removed; rows of one id are ordered by ``key`` of their text."""
    lines = []
    for k, (doc, text) in enumerate(rows):
        for n, s in enumerate((text or "").split("\n")):
            if s.strip(" \t\n\v\f\r"):
                lines.append((((1 << 63) if doc is None else doc, key(text), n), s, k))
    first = {}
    for place, s, _ in sorted(lines):
        first.setdefault(s, place)
    near = {s: [] for s in first}
    for s, t in itertools.combinations(first, 2):
        if abs(len(s.split()) - len(t.split())) <= 4 and is_near(s, t):
            near[s].append(t)
            near[t].append(s)
    out = [[0, 0, 0, []] for _ in rows]
    for place, s, k in lines:
        gone = place != first[s] or any(first[t] < first[s] for t in near[s])
        out[k][0] += 1
        out[k][1] += gone
        out[k][2] += len(near[s])
        out[k][3] += [place[2]] * gone
    return [(a, b, c, sorted(r)) for a, b, c, r in out]


def keys_of(spark, rows):
    df = spark.createDataFrame([(t,) for t in {t for _, t in rows}], "text string").select("text", F.xxhash64("text").alias("k"))
    return {r.text: r.k for r in df.collect()}.__getitem__


def symbols(s, number={}):
    return np.array([number.setdefault(x, len(number)) for x in s], np.uint32)


def test_banded_distance_is_the_edit_distance():
    rng = random.Random(1)
    for most in (1, 2, 3, 4):
        a = ["".join(rng.choices("abcé", k=rng.randrange(most + 1, 40))) for _ in range(400)]
        b = [s if len(t := changed(rng, s, rng.randrange(6))) <= most else t for s in a]
        want = [min(edit(x, y), most + 1) for x, y in zip(a, b)]
        assert L.distances([symbols(s) for s in a], [symbols(s) for s in b], most).tolist() == want


def test_near_lines_share_a_key():
    rng = random.Random(2)
    met = 0
    for _ in range(600):
        words = rng.random() < 0.7
        if words:
            a = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(rng.randrange(9, 130))]
            b = changed(rng, a, rng.randrange(1, 5))
            a, b = " ".join(a), "  ".join(b)
        else:
            a = "".join(rng.choices("abcdefgh", k=rng.randrange(9, 60)))
            b = changed(rng, a, rng.randrange(1, 3))
        if is_near(a, b):
            met += 1
            x = L.Lines([a + "\n" + b])
            shared = []
            for words in (True, False):
                row, key, index, sig = L.keys(*x.symbols(np.arange(2), words), words)
                assert ((sig < 0) == index).all()
                order = np.lexsort((row, sig, key))
                shared += L.meetings(key[order], sig[order], row[order])[0].tolist()
            found = [len(L.Group([a, b], np.full(2, k)).near(np.array([0]), np.array([1]))[0]) for k in set(shared)]
            assert sum(found) == 1, (a, b)  # in one of the keys where they met
    assert met > 200


def corpus():
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefg é", k=4)).replace(" ", "x") for _ in range(60)]
    base = [rng.choices(words, k=rng.choice([4, 9, 10, 12, 19, 20, 21, 40, 74, 75, 99, 100, 130])) for _ in range(25)]
    base += ["".join(rng.choices("abcdefg é", k=rng.randrange(8, 50))) for _ in range(20)]
    typed = [" ".join(rng.choices(words, k=k)) for k in (9, 10, 11, 15, 19, 30, 60)]
    rows = []
    for i in range(60):
        some = [changed(rng, rng.choice(base), rng.choice([0, 0, 1, 1, 2, 3, 4, 5])) for _ in range(rng.randrange(1, 6))]
        some = [s if isinstance(s, str) else " ".join(s) for s in some]
        some += [changed(rng, rng.choice(typed), rng.choice([0, 1, 1, 2, 2, 3, 6]), "ab ") for _ in range(2)]
        rows.append((i, "\n".join([*some, *rng.choice([[], ["", "  "], ["ok"], ["oh"]])])))
    odd = [(90, None), (91, ""), (92, " \n\t"), (93, " ".join(words) * 4), (94, " ".join(words) * 4 + " end"), (95, "n" * 70_000), (96, "n" * 70_000)]
    same = [(7, rows[3][1]), (None, rows[5][1]), (None, "a text of its own\n" + rows[6][1]), (None, rows[5][1]), (8, rows[8][1]), (8, "also its own\nok"), (None, None)]
    return [*rows, *odd, *same]


@pytest.mark.parametrize("block", [L.BLOCK_ROWS, 3])
def test_query_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK_ROWS", block)
    if block == 3:
        monkeypatch.setattr(L, "WALK_ROWS", 50)
        monkeypatch.setattr(L, "GROUP_LINES", 4)
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, line int, key int").repartition(5)
    want = brute(rows, keys_of(spark, rows))
    show = lambda d, x: (str(d), *x[:3], tuple(x[3]))
    got = [show(r.doc_id, (r.n_lines, r.n_removed, r.n_links, list(r.removed))) for r in L.line_counts(df).collect()]
    assert sorted(got) == sorted(show(d, x) for (d, _), x in zip(rows, want, strict=True))
    assert sum(x[2] for x in want) > 100
    left = []
    for (d, t), n in zip(rows, want, strict=True):
        if n[1] and n[1] == n[0]:
            continue
        left.append((str(d), str("\n".join(s for i, s in enumerate(t.split("\n")) if i not in n[3]) if n[1] else t)))
    assert sorted((str(r.doc_id), str(r.text)) for r in L.without_removed(df).collect()) == sorted(left)


def test_rows_that_share_an_id_lose_no_text_of_their_own(spark):
    rows = [(1, "dup line"), (None, "dup line"), (None, "unique one"), (2, "dup line"), (2, "unique two"), (3, "x\ndup line")]
    names = ("_id", "_lines", "_removed", "row", "own", "key", "id", "removed", "n_lines", "copies")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.concat(F.lit(c), "text") for c in names})
    got = L.without_removed(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r.text, r["_removed"]) for r in got.collect()) == [("1", "dup line", "_removeddup line"), ("2", "unique two", "_removedunique two"), ("3", "x", "_removedx\ndup line"), ("None", "unique one", "_removedunique one")]


def thue_morse(n, a, b):
    return [(b if bin(i).count("1") % 2 else a) for i in range(n)]


@pytest.mark.parametrize("n", [1024, 4096])
def test_lines_that_polynomial_hashes_confuse_are_apart(spark, n):
    rows = [(1, "".join(thue_morse(n, "a", "b"))), (2, "".join(thue_morse(n, "b", "a"))), (3, " ".join(thue_morse(n, "a", "b"))), (4, " ".join(thue_morse(n, "b", "a")))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed, r.n_links) for r in L.line_counts(df).collect()) == [(i, 0, 0) for i in (1, 2, 3, 4)]


def test_a_key_of_many_lines_is_met_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(L, "BLOCK_ROWS", 8)
    monkeypatch.setattr(L, "WALK_ROWS", 16)
    head = " ".join(f"head{i}" for i in range(12))
    rows = [(i, f"{head} n{i} m{i} l{i} k{i} j{i}") for i in range(60)] + [(100 + i, f"{head} n{i} m{i} x{i} k{i} j{i}") for i in range(0, 60, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    L.C.small_batches(spark)
    walked = L._walked(L._keys(L._prepared(df)))
    assert walked.where("line IS NULL AND length(h1) > 64").isEmpty() and walked.where("line IS NULL").count() > 4
    got = {r.doc_id: (r.n_lines, r.n_removed, r.n_links, list(r.removed)) for r in L.line_counts(df).collect()}
    assert got == dict(zip([d for d, _ in rows], brute(rows), strict=True)) and sum(x[2] for x in got.values()) == 18


def test_a_changed_word_makes_a_near_copy(spark):
    first = "the harbour of the northern town was ennton are onst in the cold winter of that year"
    df = spark.createDataFrame([(1, first), (2, first.replace("are onst", "ou onst")), (3, first.replace("harbour", "constellation"))], "doc_id long, text string")
    assert [(r.doc_id, r.n_removed) for r in L.line_counts(df).orderBy("doc_id").collect()] == [(1, 0), (2, 1), (3, 1)]


def test_mistyped_letters_make_a_near_copy_at_every_length(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for n in (8, 9, 10, 11, 19, 20, 100, 1000):
        line = [f"w{rng.randrange(10**6)}word" for _ in range(n)]
        typo, other = line.copy(), line.copy()
        typo[1], typo[-2] = typo[1].replace("word", "wort"), typo[-2].replace("word", "worb")
        for k in range(n // 10 + 5):
            other[k] = f"x{k}yz"
        for k, ws in enumerate((line, typo, other)):
            rows.append((10 * n + k, " ".join(ws)))
            want[10 * n + k] = (int(k == 1), int(k < 2))
    split = " ".join(f"part{i}" for i in range(12))
    rows += [(20_000, split), (20_001, split.replace(" part3 part4 part5", " par t3 part4part5")), (20_002, split.replace(" ", "  "))]
    want |= {20_000: (0, 2), 20_001: (1, 1), 20_002: (1, 1)}
    got = {r.doc_id: (r.n_removed, r.n_links) for r in L.line_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_trimmed_sequences_are_as_far_apart():
    rng = random.Random(8)
    for most in (1, 2, 4):
        a = ["".join(rng.choices("ab", k=rng.randrange(most + 1, 60))) for _ in range(300)]
        b = [t if len(t := changed(rng, s, rng.randrange(5), "ab")) > most else s for s in a]
        short = [L.trimmed(symbols(s), symbols(t), most) for s, t in zip(a, b)]
        assert all(min(map(len, x)) > most for x in short)
        assert L.distances(*zip(*short), most).tolist() == [min(edit(x, y), most + 1) for x, y in zip(a, b)]


def test_texts_of_several_megabytes(spark):
    rng = random.Random(9)
    text = "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) for _ in range(14_000))
    df = spark.createDataFrame([(1, text), (2, text + "\nlast"), (3, "b" * 3_000_000)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_lines, r.n_removed) for r in L.line_counts(df).collect()) == [(1, 14_000, 0), (2, 14_001, 14_000), (3, 1, 0)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert L.line_counts(empty).count() == 0
    assert L.without_removed(empty).count() == 0


def test_a_group_of_millions_of_characters_holds_few_symbols_at_once():
    rng = random.Random(10)
    base = "".join(rng.choices("abcdefgh é", k=100_000))
    texts = [base[: 100 * i] + "#" + base[100 * i :] for i in range(40)]
    C._WORD_POWERS[1].to(2 * L.SYMBOL_CHARS)
    tracemalloc.start()
    group = L.Group(texts, np.zeros(len(texts), np.int64))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    assert group.size[False].tolist() == [100_001] * 40 and group.index[False].shape == (40, 3)


def test_only_keys_of_two_lines_are_dealt_with_their_lines(spark):
    rng = random.Random(11)
    lines = [" ".join(f"w{rng.randrange(10**7)}" for _ in range(rng.randrange(8, 110))) for _ in range(2000)]
    typo = [s[:30] + "#" + s[31:] for s in lines[:20]]
    df = L._prepared(spark.createDataFrame([(i, s) for i, s in enumerate(lines + typo + lines[:300])], "doc_id long, text string").repartition(4))
    own = L._all_lines(df).groupBy("h1", "h2").agg(F.min(F.struct(F.col("doc_id").alias("d"), "key", "line")).alias("own"))
    firsts = spark.sparkContext.broadcast(L._bits(own.select("own.*").mapInArrow(L._first_spots, "h1 long"), 2020))
    shared = spark.sparkContext.broadcast(L._bits(L._shared(df, firsts, 2020), 2000))
    every, dealt = L._keys(df).count(), L._keys(df, firsts, shared)
    assert dealt.count() < every / 10
    near = [L._walked(x).where("line IS NOT NULL").select("key", "line").distinct().collect() for x in (L._keys(df), dealt)]
    assert set(near[0]) == set(near[1]) and len({r.line for r in near[0]}) == 40


def test_keys_of_two_lines_are_found_whatever_part_they_came_in():
    rng = random.Random(12)
    rows = [(rng.randrange(4), rng.randrange(300), rng.random() < 0.5) for _ in range(1500)]
    want = {(r, k) for r, k, probes in rows if not probes and sum(x[:2] == (r, k) for x in rows) > 1}
    parts = {r: [] for r in range(4)}
    for lo in range(0, len(rows), 70):
        for r, codes in L.packed_keys([np.array([r << 32 | k << 1 | probes for r, k, probes in rows[lo : lo + 70]], np.uint64)], 4):
            parts[r].append(codes)
    assert {(r, k) for r, p in parts.items() for k in L.shared_keys(p).tolist()} == want and 0 < len(want) < 1200
    most = L.packed_keys([np.array([6] * 50 + [7] * 50, np.uint64)], 1)
    assert [np.frombuffer(c, "<u4").tolist() for _, c in most] == [[6, 6, 7]]


def test_one_long_pair_does_not_widen_the_others():
    short, long = symbols("abcde"), symbols("ab" * 5_000)
    tracemalloc.start()
    got = L.distances([short] * 3000 + [long], [short] * 3000 + [long[1:]], 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [0] * 3000 + [1] and peak < 20e6


def test_no_task_runs_two_python_workers(spark, monkeypatch):
    plans, frame = [], type(spark.range(0))
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, f=frame.mapInArrow, **b: seen(f(self, *a, **b)))
    near = " ".join(f"w{i}" for i in range(12))
    df = spark.createDataFrame([(1, near), (2, near.replace("w5", "x")), (3, near), (4, "other")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in L.line_counts(df).collect()) == [(1, 0), (2, 1), (3, 1), (4, 0)]
    in_stage = [p.partition("Exchange")[0].count("InArrow ") for p in plans]
    assert len(plans) > 5 and set(in_stage) == {1}
