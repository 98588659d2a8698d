"""License templates: automata against regular expressions on random texts, whole licenses with changed regions, and the query against its SQL."""

import os
import random
import re

import duckdb
import pytest

from barloom.llm import license_scan as L
from barloom.llm.license_texts import PHRASES, TEMPLATES

DOCS = "doc_id long, text string"
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return PATTERN.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def filled(template, rng, longest=False):
    """A text that the template accepts."""
    out = []

    def put(parts):
        for kind, *x in parts:
            if kind == "word":
                out.append(x[0])
            elif kind == "one":
                out.append(rng.choice(x[0]))
            elif kind == "any":
                out.extend(f"any{rng.randrange(99)}" for _ in range(x[1] if longest else rng.randrange(x[0], x[1] + 1)))
            elif rng.random() < 0.5:
                put(x[0])

    put(L.parsed(template))
    return out


def plain(text, templates=TEMPLATES, phrases=PHRASES):
    ws = words(text)
    places = sorted((k, label) for label, p in phrases.items() for k in range(len(ws)) if ws[k : k + len(words(p))] == words(p))
    tagged = "".join(f"<{w}>" for w in ws)
    spans = set()
    for label, t in templates:
        for m in re.finditer(L.regex(L.parsed(t)), tagged):
            spans.add((label, tagged[: m.start()].count(">"), tagged[: m.end()].count(">")))
    base = sorted({label for _, label in places})
    labels = sorted({*base, *(s[0] for s in spans)})
    score = max((e - s for _, s, e in spans), default=0) / len(ws) if spans else 0.0
    ends = (places[0][0], places[-1][0]) if places else (None, None)
    return (len(ws), len(places), *ends, ",".join(base), ",".join(labels), score, sorted(spans, key=lambda s: (s[1], s[2], s[0])))


def rows(df):
    return [(r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, [tuple(s) for s in r.spans])) for r in df.collect()]


def test_scan_equals_regular_expressions(spark):
    rng, texts = random.Random(3), [None, "", "...", "MIT", "mit license", "MIT-License MIT License", "É mit LICENSE", "general public license general public license"]
    noise = ["mit", "license", "this", "work", "is", "licensed", "under", "the", "permission", "2", "0", "version", "general", "public", "é"]
    for _, t in TEMPLATES:
        own = filled(t, rng)
        broken = list(own)
        broken[rng.randrange(len(broken))] = "changed"
        sep = lambda ws: "".join(w.upper() + rng.choice([" ", ", ", "\n# ", " -- "]) if rng.random() < 0.3 else w + " " for w in ws)
        texts += [sep(own), sep(rng.choices(noise, k=9) + own + own + rng.choices(noise, k=5)), sep(broken), sep(own[:-1])]
    texts += [" ".join(rng.choices(noise, k=rng.randrange(60))) for _ in range(150)] + ["permission is hereby granted free of charge " * 2000]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(3, "mit license"), (None, "mit license")], DOCS).selectExpr("*", "1 AS labels", "2 AS `a.b`")
    got = rows(L.license_scan(docs.repartition(3)))
    assert sorted(map(repr, got)) == sorted(repr((i, plain(t))) for i, t in list(enumerate(texts)) + [(3, "mit license"), (None, "mit license")])


@pytest.mark.parametrize("label, template", TEMPLATES, ids=[f"{i}-{t[0]}" for i, t in enumerate(TEMPLATES)])
def test_mandatory_wording_matters_word_for_word(label, template):
    rng = random.Random(7)
    scanner = L.Scanner([(label, template)], {})
    automaton = scanner.automata[0]
    own = filled(template, rng, longest=True)
    number = lambda ws: [scanner.known.number.get(w, -1) for w in ws]
    assert automaton.longest(number(own), 0) == len(own)
    pattern = re.compile(L.regex(L.parsed(template)))
    for k in range(0, len(own), max(1, len(own) // 25)):
        for changed in (own[:k] + own[k + 1 :], own[:k] + ["zzz"] + own[k:], own[:k] + ["zzz"] + own[k + 1 :]):
            m = pattern.match("".join(f"<{w}>" for w in changed))
            assert automaton.longest(number(changed), 0) == (m[0].count(">") if m else -1)


def test_random_templates_equal_regular_expressions():
    rng = random.Random(11)

    def some(depth):
        out = ""
        for _ in range(rng.randrange(1, 4)):
            kind = rng.random()
            out += " " + (f"[[{some(depth + 1)}]]" if kind < 0.25 and depth < 3 else f"{{{{x:{rng.randrange(0, 2)}-{rng.randrange(2, 4)}}}}}" if kind < 0.4 else "{{x=a|c}}" if kind < 0.5 else rng.choice("ab"))
        return out

    for _ in range(200):
        template = "a " + some(0) + " b"
        scanner = L.Scanner([("t", template)], {})
        pattern = re.compile(L.regex(L.parsed(template)))
        text = rng.choices("abcz", k=12)
        tagged = "".join(f"<{w}>" for w in text)
        got = scanner.automata[0].longest([scanner.known.number.get(w, -1) for w in text], 0)
        ends = [k for k in range(1, 13) if re.fullmatch(pattern, "".join(f"<{w}>" for w in text[:k]))]
        assert got == max(ends, default=-1), (template, tagged)


def test_bad_templates_and_empty_table(spark):
    for t in ("[[a", "{{x:1-3}} a", "[[a]]"):
        with pytest.raises(ValueError):
            L.Automaton(L.parsed(t), {"a": 0})
    assert L.license_scan(spark.createDataFrame([], DOCS)).collect() == []


def test_text_of_some_megabytes():
    text = "lorem ipsum " * 300_000 + "Released under the MIT License. " + "dolor " * 50_000
    scanner = L.Scanner(TEMPLATES, PHRASES)
    (_, block), = L.T.blocks([text])
    (row,) = scanner.block(block)
    assert row[:6] == (650_005, 1, 600_003, 600_003, "mit", "MIT,mit") and row[7] == [{"label": "MIT", "start": 600_000, "stop": 600_005}]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data")
def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(L.OP12_SQL).fetchall()
    got = L.op12_license_scan(spark, sf).select(*(d[0] for d in con.description)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and any(r[5] for r in want)
