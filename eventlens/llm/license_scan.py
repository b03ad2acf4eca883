r"""License scans by template markup, compiled into a token automaton.

A template is the wording of a license with regions marked: ``[[...]]`` is
optional (and may hold further marks), ``{{a b|c|}}`` is one of its alternatives,
``{{m-n}}`` is replaceable by any m to n words. All templates become one automaton
over words (``WORD`` of ``words.py``: case and punctuation do not count), made
deterministic, so a word costs one table look-up. A template is found where
all its mandatory wording stands word by word, with nothing between but what
its regions allow; a word less, more or changed is no match.

Tasks cut a batch of texts into words by numpy and give each the number of its
vocabulary word (compared byte by byte, not by a hash alone; 0: in no
template). Then the automaton starts at every word of the batch at once and all
starts take one step after another; nearly all are dead after one or two. The
automaton has no loop, so the number of steps is bounded by the longest
template. Documents are judged where they stand: one pass, no shuffle.

Beside the templates, plain phrases are counted: places where a phrase's words
stand consecutively.

The score is ``m / (m + 4)`` for the greatest number m of mandatory words among
the templates and phrases found, 0 without any: a phrase of two words scores
0.33, a whole permission notice 0.96 or more.

Defined results: a null or empty text has no words, no labels and score 0; its
first and last word are null, as they are for a text without a phrase; repeated
rows get equal results; an empty table gives an empty result; other columns
pass through untouched, but one named like the added column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.llm.common import read_table
from eventlens.llm.license_templates import TEMPLATES
from eventlens.llm.words import Words, split_words, text_slices

#: Phrases of the contract and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
DEAD = 0
OTHER = 0  # number of a word in no template

_MARKS = re.compile(r"\[\[|\]\]|\{\{.*?\}\}|[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.S)
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _lower(text: str) -> str:
    return text.translate({c: c + 32 for c in range(ord("A"), ord("Z") + 1)})


class _Nfa:
    """Fragments of all templates: states with free moves and moves on a word (None: any word)."""

    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[str | None, int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def word(self, at: int, word: str | None) -> int:
        to = self.state()
        self.moves[at].append((word, to))
        return to

    def add(self, markup: str) -> tuple[int, int, int]:
        """First and last state of a template, and its number of mandatory words."""
        start = at = self.state()
        opened: list[tuple[int, int]] = []
        need = 0
        for mark in _MARKS.findall(_lower(markup)):
            if mark == "[[":
                opened.append((at, need))
            elif mark == "]]":
                if not opened:
                    raise ValueError("]] without [[")
                before, need = opened.pop()
                to = self.state()
                self.free[before].append(to)
                self.free[at].append(to)
                at = to
            elif mark.startswith("{{"):
                span = re.fullmatch(r"(\d+)-(\d+)", mark[2:-2].strip())
                to = self.state()
                if span:
                    least, most = map(int, span.groups())
                    for k in range(most + 1):
                        if k >= least:
                            self.free[at].append(to)
                        if k < most:
                            at = self.word(at, None)
                else:
                    ways = [_WORDS.findall(way) for way in mark[2:-2].split("|")]
                    need += min(map(len, ways))
                    for way in ways:
                        end = at
                        for w in way:
                            end = self.word(end, w)
                        self.free[end].append(to)
                at = to
            else:
                at, need = self.word(at, mark), need + 1
        if opened:
            raise ValueError("[[ without ]]")
        if not need:
            raise ValueError("a template without mandatory words")
        return start, at, need

    def closure(self, states: set[int]) -> frozenset[int]:
        todo, seen = list(states), set(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in seen:
                    seen.add(to)
                    todo.append(to)
        return frozenset(seen)


class Automaton(NamedTuple):
    """Deterministic automaton of all templates, and the vocabulary of templates and phrases."""

    labels: list[str]  # per template
    need: list[int]
    table: np.ndarray  # state x word number (the last one: end of a text) -> state; state 0 is dead, 1 the start
    accepts: np.ndarray  # state x template
    phrases: list[tuple[str, np.ndarray]]  # label, word numbers
    keys: np.ndarray  # sorted keys of the vocabulary
    lanes: np.ndarray  # per key: the word's bytes, 8 in a number, and its length
    number: np.ndarray  # per key: the word's number


def _key(lanes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lanes), np.uint64)
    for k in range(lanes.shape[1]):
        out = (out ^ lanes[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _lanes(words: Words, n: int) -> np.ndarray:
    """The first 8n bytes of each word as numbers, zero behind its end, and its length."""
    data = np.concatenate([words.data, np.zeros(8 * n, np.uint8)])
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    size = words.stop - words.start
    out = np.zeros((len(size), n + 1), np.uint64)
    for k in range(n):
        some = np.flatnonzero(size > 8 * k)
        out[some, k] = eight[words.start[some] + 8 * k] & _KEEP[np.minimum(size[some] - 8 * k, 8)]
    out[:, n] = size
    return out


def compile_templates(templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> Automaton:
    """One automaton of all ``(label, markup)``, by subset construction."""
    nfa = _Nfa()
    ends = [nfa.add(markup) for _, markup in templates]
    wanted = [(label, _WORDS.findall(_lower(p))) for p, label in phrases.items()]
    vocabulary = sorted({w for moves in nfa.moves for w, _ in moves if w is not None} | {w for _, p in wanted for w in p})
    number = {w: k + 1 for k, w in enumerate(vocabulary)}
    begin = nfa.closure({start for start, _, _ in ends})
    states, rows = {frozenset(): DEAD, begin: 1}, []
    todo = [frozenset(), begin]
    for own in todo:  # grows as it goes
        any_word = {to for s in own for w, to in nfa.moves[s] if w is None}
        by_word: dict[str, set[int]] = {}
        for s in own:
            for w, to in nfa.moves[s]:
                if w is not None:
                    by_word.setdefault(w, set(any_word)).add(to)

        def goes(to: set[int]) -> int:
            to = nfa.closure(to)
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            return states[to]

        row = np.full(len(number) + 2, goes(any_word), np.int32)
        for w, to in by_word.items():
            row[number[w]] = goes(to)
        row[-1] = DEAD
        rows.append(row)
    accepts = np.zeros((len(states), len(templates)), bool)
    for own, k in states.items():
        accepts[k] = [end in own for _, end, _ in ends]
    raw = pa.array(vocabulary, pa.string())
    longest = max(len(w.encode()) for w in vocabulary)
    lanes = _lanes(split_words(raw), -(-longest // 8))
    keys = _key(lanes)
    order = np.argsort(keys)
    if len(np.unique(keys)) < len(keys):
        raise ValueError("two words of one key")
    return Automaton([label for label, _ in templates], [need for _, _, need in ends], np.stack(rows), accepts,
                     [(label, np.array([number[w] for w in p])) for label, p in wanted], keys[order], lanes[order],
                     np.arange(1, len(keys) + 1)[order])


def _numbers(auto: Automaton, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts with an end mark after each, and where texts begin."""
    lanes = _lanes(words, auto.lanes.shape[1] - 1)
    at = np.minimum(np.searchsorted(auto.keys, _key(lanes)), len(auto.keys) - 1)
    own = np.where((auto.lanes[at] == lanes).all(axis=1), auto.number[at], OTHER)
    n = words.counts
    out = np.full(len(own) + len(n), auto.table.shape[1] - 1, np.int32)
    out[np.arange(len(own)) + np.repeat(np.arange(len(n)), n)] = own
    return out, words.first[:-1] + np.arange(len(n))


def find_templates(auto: Automaton, flat: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, stop, template)`` in ``flat``: from each start the longest match of each template."""
    start = np.arange(len(flat))
    state = auto.table[1][flat]
    best: dict[tuple[int, int], int] = {}
    at = start
    while True:
        live = state != DEAD
        start, at, state = start[live], at[live], state[live]
        if not len(state):
            return sorted((s, e, t) for (s, t), e in best.items())
        hit = auto.accepts[state]
        for k, t in zip(*(x.tolist() for x in np.nonzero(hit))):
            best[int(start[k]), t] = int(at[k]) + 1
        at = at + 1
        state = auto.table[state, flat[np.minimum(at, len(flat) - 1)]]


def scan(auto: Automaton, texts: pa.Array) -> list[dict]:
    """Per text the fields of ``FOUND``."""
    words = split_words(texts)
    flat, begin = _numbers(auto, words)
    n = words.counts.tolist()
    out = [{"n_words": k, "n_base": 0, "first_word": None, "last_word": None, "base_labels": [], "labels": [],
            "score": 0.0, "found": []} for k in n]
    need = [0] * len(n)
    for label, phrase in auto.phrases:
        m = len(phrase)
        hit = flat[: len(flat) - m + 1] == phrase[0] if len(flat) >= m else np.zeros(0, bool)
        for k in range(1, m):
            hit = hit & (flat[k:len(flat) - m + 1 + k] == phrase[k])
        at = np.flatnonzero(hit)
        doc, first, count = np.unique(np.searchsorted(begin, at, "right") - 1, return_index=True, return_counts=True)
        for d, f, c in zip(doc.tolist(), first.tolist(), count.tolist()):
            row, lo, hi = out[d], int(at[f] - begin[d]), int(at[f + c - 1] - begin[d])
            row["n_base"] += c
            row["first_word"] = lo if row["first_word"] is None else min(lo, row["first_word"])
            row["last_word"] = hi if row["last_word"] is None else max(hi, row["last_word"])
            row["base_labels"].append(label)
            need[d] = max(need[d], m)
    for start, stop, t in find_templates(auto, flat):
        d = int(np.searchsorted(begin, start, "right")) - 1
        out[d]["found"].append({"label": auto.labels[t], "first_word": int(start - begin[d]), "last_word": int(stop - 1 - begin[d])})
        need[d] = max(need[d], auto.need[t])
    for row, m in zip(out, need):
        row["base_labels"] = sorted(set(row["base_labels"]))
        row["labels"] = sorted({*row["base_labels"], *(f["label"] for f in row["found"])})
        row["score"] = m / (m + 4)
    return out


_PLACE = T.StructType().add("label", "string").add("first_word", "long").add("last_word", "long")
FOUND = (T.StructType().add("n_words", "long").add("n_base", "long").add("first_word", "long").add("last_word", "long")
         .add("base_labels", T.ArrayType(T.StringType())).add("labels", T.ArrayType(T.StringType()))
         .add("score", "double").add("found", T.ArrayType(_PLACE)))


def scan_licenses(docs: DataFrame, text_col: str = "text", out: str = "license",
                  templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """``docs`` plus ``out``, a struct of ``FOUND``: words, phrase places, labels,
    score, and where each template stands (first and last word, from 0)."""
    from pyspark.sql.pandas.types import to_arrow_type
    docs = docs.drop(out)
    where, auto, kind = docs.columns.index(text_col), compile_templates(templates, phrases), to_arrow_type(FOUND)
    schema = T.StructType(docs.schema.fields + [T.StructField(out, FOUND)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, where):
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scan(auto, b.column(where)), kind)], names=schema.names)

    return docs.mapInArrow(run, schema)


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(read_table(spark, sf_dir, "documents", "doc_id", "text"), out="found")
    return found.select("doc_id", "found.n_words", "found.n_base", "found.first_word", "found.last_word",
                        F.array_join("found.base_labels", ",").alias("base_labels"),
                        F.array_join("found.labels", ",").alias("labels"), "found.score")


def template_regex(markup: str) -> str:
    """The template as a regular expression over words that each have a space behind them."""
    def alternatives(m: re.Match) -> str:
        body = m.group(1).strip()
        if re.fullmatch(r"\d+-\d+", body):
            return "\0" + "(?:[^ ]+ ){" + body.replace("-", ",") + "}" + "\0"
        ways = ["".join(w + " " for w in _WORDS.findall(way)) for way in body.split("|")]
        return "\0(?:" + "|".join(ways) + ")\0"

    marked = re.sub(r"\{\{(.*?)\}\}", alternatives, _lower(markup), flags=re.S)
    marked = marked.replace("[[", "\0(?:\0").replace("]]", "\0)?\0")
    parts = marked.split("\0")  # plain text and expressions take turns
    return "".join(p if k % 2 else "".join(w + " " for w in _WORDS.findall(p)) for k, p in enumerate(parts))


def license_sql(templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> str:
    """DuckDB SQL for the query's rows: a template is a regular expression there."""
    auto = compile_templates(templates, phrases)
    tests = [(label, need, template_regex(markup)) for (label, markup), need in zip(templates, auto.need)]
    hits = ",\n         ".join(f"CASE WHEN regexp_matches(s, ' {r}') THEN {{'label': '{label}', 'need': {need}}} END" for label, need, r in tests)
    places = "\n      || ".join(
        "list_transform(list_filter(range(1, len(w) + 1), lambda i: " +
        " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split())) +
        f"), lambda i: {{'label': '{label}', 'need': {len(p.split())}, 'at': i - 1}})" for p, label in phrases.items())
    return f"""
WITH cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
marked AS (
  SELECT doc_id, len(w) AS n_words, ' ' || array_to_string(w, ' ') || ' ' AS s, {places} AS base FROM cut),
found AS (
  SELECT *, list_filter([{hits}], lambda x: x IS NOT NULL) AS own FROM marked)
SELECT doc_id, n_words::BIGINT AS n_words, len(base)::BIGINT AS n_base,
       list_min(list_transform(base, lambda x: x.at))::BIGINT AS first_word,
       list_max(list_transform(base, lambda x: x.at))::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(base, lambda x: x.label))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_transform(base, lambda x: x.label) || list_transform(own, lambda x: x.label))), ',') AS labels,
       (m / (m + 4.0::DOUBLE))::DOUBLE AS score
FROM (SELECT *, coalesce(greatest(list_max(list_transform(base, lambda x: x.need)), list_max(list_transform(own, lambda x: x.need))), 0) AS m
      FROM found)
"""


OP13_SQL = license_sql()
