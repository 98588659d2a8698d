"""License scans (operator 12): templates with optional and replaceable regions, compiled to automata over words.

A template's positions are its words; one of a replaceable region takes any word, or any of some. Regions of at most so many
words are that many positions, of which the later ones are optional, so an automaton has no loops and a match no more words than
positions. Which positions can follow which is computed once; sets of positions that are alive together become states when a text
first needs them, so a word costs one look-up.

Texts are turned into numbers of the templates' words in blocks, with numpy; where two neighbouring words can begin a template, its
automaton runs. It accepts where all mandatory wording stood, word for word: the leftmost start, then the longest end, then on from there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm import common as C
from barloom.llm import terms as T
from barloom.llm.license_texts import PHRASES, TEMPLATES

OUT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, start: long, stop: long>>"
)
_MARKUP = re.compile(r"(\[\[)|(\]\])|\{\{\w+:(\d+)-(\d+)\}\}|\{\{\w+=([^}]*)\}\}|((?:(?!\[\[|\]\]|\{\{).)+)", re.DOTALL)
#: States that an automaton keeps; beyond them it begins anew.
MOST_STATES = 20_000


def words_of(text: str) -> list[str]:
    return [b.term(i) for _, b in T.blocks([text]) for i in range(len(b.begin))]


def parsed(template: str) -> list:
    """A template's parts: ("word", w), ("any", least, most), ("one", words) or ("maybe", parts)."""
    stack = [[]]
    for m in _MARKUP.finditer(template):
        opened, closed, least, most, one, text = m.groups()
        if opened:
            stack.append([])
        elif closed:
            stack[-2].append(("maybe", stack.pop()))
        elif least:
            stack[-1].append(("any", int(least), int(most)))
        elif one:
            stack[-1].append(("one", [words_of(w)[0] for w in one.split("|")]))
        else:
            stack[-1] += [("word", w) for w in words_of(text)]
    if len(stack) > 1:
        raise ValueError(f"optional region without an end: {template[:60]}")
    return stack[0]


def regex(parts: list) -> str:
    """The same language as a regular expression over words in angle brackets."""
    out = ""
    for kind, *x in parts:
        if kind == "word":
            out += f"<{x[0]}>"
        elif kind == "one":
            out += f"<(?:{'|'.join(x[0])})>"
        elif kind == "any":
            out += f"(?:<[^>]*>){{{x[0]},{x[1]}}}"
        else:
            out += f"(?:{regex(x[0])})?"
    return out


class Automaton:
    """Positions of a template and what may follow them; ``numbers`` has the numbers of words, -1 is any other word."""

    def __init__(self, parts: list, numbers: dict[str, int]):
        self.takes: list[frozenset[int] | None] = []  # of a position: numbers of words; None takes any
        self.follow: list[set[int]] = []
        first, last, empty = self._sequence(self._flat(parts, numbers))
        if empty or any(self.takes[p] is None for p in first):
            raise ValueError("a template must begin with mandatory wording")
        self.accept, self.start = frozenset(last), frozenset(first)
        self.follow = [frozenset(x) for x in self.follow]
        self.states: dict[tuple[frozenset, int], frozenset] = {}

    def _flat(self, parts, numbers):
        out = []
        for kind, *x in parts:
            if kind == "word":
                out.append(("take", frozenset([numbers[x[0]]])))
            elif kind == "one":
                out.append(("take", frozenset(numbers[w] for w in x[0])))
            elif kind == "maybe":
                out.append(("maybe", self._flat(x[0], numbers)))
            else:
                rest = []
                for _ in range(x[1] - x[0]):
                    rest = [("maybe", [("take", None), *rest])]
                out += [("take", None)] * x[0] + rest
        return out

    def _sequence(self, parts):
        """First and last positions of a sequence, and whether it may be empty."""
        first, last, empty = set(), set(), True
        for kind, x in parts:
            if kind == "take":
                own = {len(self.takes)}
                self.takes.append(x)
                self.follow.append(set())
                f, e, none = own, own, False
            else:
                f, e, none = self._sequence(x)
                none = True
            for p in last:
                self.follow[p] |= f
            first = first | f if empty else first
            last = last | e if none else set(e)
            empty = empty and none
        return first, last, empty

    def pairs(self) -> set[tuple[int, int | None]]:
        """What the first two words may be; None is any word."""
        out = set()
        for p in self.start:
            for q in self.follow[p]:
                out |= {(a, b) for a in self.takes[p] for b in (self.takes[q] if self.takes[q] is not None else [None])}
            if p in self.accept:
                out |= {(a, None) for a in self.takes[p]}
        return out

    def step(self, state: frozenset, word: int) -> frozenset:
        """The positions that take ``word``, of those in ``state``; what follows them is the next state."""
        got = self.states.get((state, word))
        if got is None:
            if len(self.states) >= MOST_STATES:
                self.states.clear()
            took = frozenset(p for p in state if self.takes[p] is None or word in self.takes[p])
            got = self.states[state, word] = (took & self.accept, frozenset().union(*(self.follow[p] for p in took)))
        return got

    def longest(self, words: list[int], at: int) -> int:
        """Where the longest match that starts at ``at`` ends, or -1."""
        state, end = self.start, -1
        for i in range(at, len(words)):
            accepted, state = self.step(state, words[i])
            if accepted:
                end = i + 1
            if not state:
                break
        return end


class Scanner:
    """All templates and phrases over one numbering of their words."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        parts = [(label, parsed(t)) for label, t in templates]
        self.phrases = [(label, words_of(p)) for label, p in phrases.items()]

        def own(x):
            return [w for kind, *y in x for w in ([y[0]] if kind == "word" else y[0] if kind == "one" else own(y[0]) if kind == "maybe" else [])]

        self.known = T.Vocabulary([w for _, p in parts for w in own(p)] + [w for _, p in self.phrases for w in p])
        self.labels = [label for label, _ in parts]
        self.automata = [Automaton(p, self.known.number) for _, p in parts]
        n = len(self.known.terms) + 1
        starts: dict[tuple[int, int | None], list[int]] = {}
        for k, a in enumerate(self.automata):
            for pair in a.pairs():
                starts.setdefault(pair, []).append(k)
        self.starts, self.n = starts, n
        self.pairs = np.sort(np.array([a * n + b for a, b in starts if b is not None] or [-1]))
        self.singles = np.sort(np.array([a for a, b in starts if b is None] or [-1]))

    def begins(self, number: np.ndarray) -> np.ndarray:
        """Places where the next two words may begin a template."""
        after = np.append(number[1:], -1)
        some = np.flatnonzero(number >= 0)
        pair = np.where(after[some] >= 0, number[some] * self.n + after[some], -2)
        return some[np.isin(pair, self.pairs) | np.isin(number[some], self.singles)]

    def spans(self, words: list[int], begins: list[int]) -> list[tuple[str, int, int]]:
        """Accepted spans of a text: label, first word, word after the last."""
        out, over = set(), [0] * len(self.automata)
        for at in begins:
            nxt = words[at + 1] if at + 1 < len(words) else None
            for k in {*self.starts.get((words[at], nxt), ()), *self.starts.get((words[at], None), ())}:
                if at >= over[k]:
                    end = self.automata[k].longest(words, at)
                    if end > at:
                        over[k] = end
                        out.add((self.labels[k], at, end))
        return sorted(out, key=lambda s: (s[1], s[2], s[0]))

    def block(self, block: T.Block) -> dict[str, list]:
        number, texts = self.known.find(block), len(block.starts) - 1
        text_of = lambda at: np.searchsorted(block.starts, at, "right") - 1
        n = np.diff(block.starts)
        base, first, last = np.zeros(texts, np.int64), np.full(texts, np.iinfo(np.int64).max), np.full(texts, -1)
        labels: dict[int, set[str]] = {}
        for label, phrase in self.phrases:
            at = np.arange(max(0, len(number) - len(phrase) + 1))
            for k, w in enumerate(phrase):
                at = at[number[at + k] == self.known.number[w]]
            doc = text_of(at)
            whole = at + len(phrase) <= block.starts[doc + 1]
            at, doc = at[whole], doc[whole]
            np.add.at(base, doc, 1)
            np.minimum.at(first, doc, at - block.starts[doc])
            np.maximum.at(last, doc, at - block.starts[doc])
            for d in np.unique(doc).tolist():
                labels.setdefault(d, set()).add(label)
        spans: dict[int, list] = {}
        begins = self.begins(number)
        doc = text_of(begins)
        for d in np.unique(doc).tolist():
            a, b = int(block.starts[d]), int(block.starts[d + 1])
            found = self.spans(number[a:b].tolist(), (begins[doc == d] - a).tolist())
            if found:
                spans[d] = found
        rows = []
        for d in range(texts):
            own, named = spans.get(d, []), labels.get(d, set())
            score = max((e - s for _, s, e in own), default=0) / int(n[d]) if own else 0.0
            place = (int(first[d]), int(last[d])) if base[d] else (None, None)
            rows.append((int(n[d]), int(base[d]), *place, ",".join(sorted(named)), ",".join(sorted(named | {x for x, _, _ in own})), score, [{"label": x, "start": s, "stop": e} for x, s, e in own]))
        return rows


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """License labels of each text: OUT.

    ``docs`` has doc_id and text; other columns are ignored. n_words counts the text's words; n_base, first_word and last_word are the number of places of the
    ``phrases`` and the least and greatest word where one starts (null if none); base_labels are theirs, labels those of accepted ``templates`` too,
    distinct, sorted and joined by commas; score is the longest accepted span's share of the text's words, spans are all of them, in words. A null text is
    an empty one: no words, no labels, score 0. Every row gives a row, of repeated or null ids too; an empty table gives none. A text is read whole by one task.
    """
    C.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            for done, block in T.blocks(texts):
                rows = scanner.block(block)
                columns = [pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _FIELDS, strict=True)]
                yield pa.RecordBatch.from_arrays([ids.slice(done, len(rows)), *columns], ["doc_id", *(f.name for f in _FIELDS)])

    return C.only(docs, "doc_id", "text").mapInArrow(run, OUT)


_FIELDS = [
    *(pa.field(n, pa.int64()) for n in ("n_words", "n_base", "first_word", "last_word")),
    pa.field("base_labels", pa.string()),
    pa.field("labels", pa.string()),
    pa.field("score", pa.float64()),
    pa.field("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))),
]


def op12_license_scan(spark, sf_dir: str) -> DataFrame:
    """License labels of every row of ``documents``, without the spans; see ``license_scan`` for nulls, ties and long texts."""
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


def _sql() -> str:
    spans = ", ".join(f"('{label}', '{regex(parsed(t))}')" for label, t in TEMPLATES)
    bases = ", ".join(f"('{label}', '{''.join(f'<{w}>' for w in words_of(p))}')" for label, p in PHRASES.items())
    return rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
j AS (SELECT r, array_to_string(list_transform(ws, lambda x: '<' || x || '>'), '') AS s FROM w),
templates(label, pattern) AS (VALUES {spans}),
phrases(label, phrase) AS (VALUES {bases}),
b AS (SELECT r, label, unnest(string_split(s, phrase)[:-2]) AS part, generate_subscripts(string_split(s, phrase)[:-2], 1) AS k FROM j, phrases WHERE contains(s, phrase)),
c AS (SELECT r, label, sum(len(part) - len(replace(part, '>', ''))) OVER (PARTITION BY r, label ORDER BY k) + (k - 1) * (len(phrase) - len(replace(phrase, '>', ''))) AS pos FROM b JOIN phrases USING (label)),
base AS (SELECT r, count(*) AS n_base, min(pos)::BIGINT AS first_word, max(pos)::BIGINT AS last_word FROM c GROUP BY r),
m AS (SELECT r, label, list_max(list_transform(regexp_extract_all(s, pattern), lambda x: len(x) - len(replace(x, '>', '')))) AS n FROM j, templates WHERE regexp_matches(s, pattern)),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM m UNION ALL SELECT r, label FROM c) GROUP BY r),
bl AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM c GROUP BY r),
best AS (SELECT r, max(n) AS n FROM m GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN best.n IS NULL THEN 0.0::DOUBLE ELSE best.n::DOUBLE / len(ws) END AS score
FROM w LEFT JOIN base USING (r) LEFT JOIN l USING (r) LEFT JOIN bl USING (r) LEFT JOIN best USING (r)
"""


OP12_SQL = _sql()
