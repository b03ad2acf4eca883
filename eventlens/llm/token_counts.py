r"""Token counts by prefix dynamic programming.

For every text the operator stores the exact number of tokens of **every
prefix** (in code points), so that "how many tokens has the text cut here" and
"where must I cut for this budget" are read off without encoding again.

Method. In byte-pair encoding the encoding of a prefix is the encoding of a
shorter prefix plus one last token: at each byte position the last token is the
one vocabulary entry that ends there and whose pair with the last token of the
position before it stays unmerged. So ``count[i] = count[i - len(last)] + 1``.
Words that share a beginning share these states: the new words of a batch are
sorted, and each starts from the common prefix with the one before.

A text is cut into pretokens (the byte-level pattern), whose tables are looked
up and joined as differences, one signed byte per code point. Three places
where a prefix is cut otherwise than the whole text are put right:
contractions of two letters (``'re``: the prefix ``'r`` is two pretokens), runs
of white space (a run at the end of a prefix is one pretoken), and special
strings (a prefix that ends inside one is ordinary text).

Defined results: a null text counts as an empty one (0 tokens, empty table);
rows are independent, so ties and repeated rows give equal rows; an empty
table gives an empty result; other columns pass through untouched, but those
of the added columns' names (``out`` chooses them) are replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.llm.common import read_table, worker_state

#: Pretoken pattern of byte-level BPE (fixed value, the tokenizer file names it by kind only).
PRETOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words kept in a worker's table; it keeps what was used of late, which changes no result.
CACHE_WORDS = 300_000
CACHED_CHARS = 40  # longer pretokens are rare and computed again each time


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies: printable
    Latin-1 stands for itself, the rest is numbered from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Prefix token counts under one byte-level BPE file (with ranked merges)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        self.id_of = {raw(s): i for s, i in spec["model"]["vocab"].items() if all(c in to_byte for c in s)}
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.rank: dict[tuple[int, int], int] = {}
        #: token -> (left part, right part, rank at which they merge)
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (m if isinstance(m, list) else m.split(" "))
            a, b = raw(a), raw(b)
            x, y, z = self.id_of[a], self.id_of[b], self.id_of[a + b]
            self.rank[x, y] = r
            self.parts.setdefault(z, (x, y, r))
        # Every byte string that ends some vocabulary entry -> its id, or -1 if
        # it is none itself: the backward search stops outside of these.
        self.tails = {t[k:]: -1 for t in self.id_of for k in range(len(t))} | self.id_of
        self.pattern = regex.compile(PRETOKENS)
        self.space_runs = regex.compile(r"\s{2,}(?=\S)")
        self.special = regex.compile("|".join(regex.escape(s) for s in self.specials)) if self.specials else None
        self.fits: dict[int, bool] = {}
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """(part, rank at which it is merged away) along one edge of a token, from the token inwards."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out
            until = self.parts[token][2]
            token = self.parts[token][side]

    def pair_stays(self, a: int, b: int) -> bool:
        """True if a text whose parts encode to ``a`` and ``b`` encodes to just these two."""
        left, stays = self._spine(b, 0), True
        for x, x_until in self._spine(a, 1):
            for y, y_until in left:
                m = self.rank.get((x, y))
                # of equal merges the leftmost goes first
                if m is not None and m < x_until and m <= y_until:
                    stays = False
        return stays

    def states(self, word: bytes, last: list[int], count: list[int]) -> None:
        """Extend the states (last token and count by length) from ``len(last) - 1`` to the whole word."""
        tails, fits = self.tails, self.fits
        for i in range(len(last), len(word) + 1):
            for j in range(i - 1, -1, -1):
                t = tails.get(word[j:i])
                if t is None:
                    raise ValueError(f"no encoding of {word[:i]!r}")
                if t < 0:
                    continue
                if j:
                    key = last[j] << 24 | t
                    ok = fits.get(key)
                    if ok is None:
                        ok = fits[key] = self.pair_stays(last[j], t)
                    if not ok:
                        continue
                last.append(t)
                count.append(count[j] + 1)
                break

    def learn(self, words: list[str]) -> dict[str, list[int]]:
        """Differences of the prefix counts of words, one per code point,
        computed in sorted order on shared prefixes."""
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        out, prev, last, count = {}, b"", [-1], [0]
        for raw, word in sorted([(w.encode("utf-8"), w) for w in words]):
            n = len(raw)
            if raw[:6] == prev[:6]:
                k, top = 6, min(len(prev), n)
            else:
                k, top = 0, min(len(prev), n, 6)
            while k < top and prev[k] == raw[k]:
                k += 1
            del last[min(k, n) + 1:], count[min(k, n) + 1:]
            self.states(raw, last, count)
            prev = raw
            if n == len(word):
                at = count
            else:
                at = [0, *[count[e] for e in accumulate([len(c.encode("utf-8")) for c in word])]]
            if word in ("'re", "'ve", "'ll"):
                at = [0, 1, 2, at[3]]  # before its last letter it is an apostrophe and a letter
            out[word] = [b - a for a, b in zip(at, at[1:])]
        return out

    def run_count(self, run: str) -> int:
        return sum(self.learn([run])[run])

    def _plain(self, text: str, found: list[str], wide: dict[str, list[int]]) -> np.ndarray:
        """Differences of a text without special strings."""
        if not text:
            return np.zeros(0, np.int64)
        table = self.table
        if wide:
            d = np.concatenate([np.array(wide[w]) if w in wide else np.frombuffer(table[w], np.int8) for w in found])
        else:
            d = np.frombuffer(b"".join([table[w] for w in found]), np.int8)
        runs = [m.span() for m in self.space_runs.finditer(text)]
        if runs:
            d = d.astype(np.int64)
        for a, b in runs:
            fix = self.run_count(text[a:b]) - self.run_count(text[a:b - 1]) - self.run_count(text[b - 1])
            d[b - 1] += fix
            d[b] -= fix
        return d

    def batch(self, texts: list[str]) -> list[np.ndarray]:
        """Per text the differences of its prefix counts, one per code point."""
        # Pieces: (ordinary text, special string after it or ''); what stands
        # inside a special string is counted as if the text went on ordinarily.
        pieces: list[list[tuple[str, str]]] = []
        for t in texts:
            if self.special is None or not self.special.search(t):
                pieces.append([(t, "")])
                continue
            own, at = [], 0
            for m in self.special.finditer(t):
                own.append((t[at:m.start()], m.group()))
                at = m.end()
            pieces.append([*own, (t[at:], "")])
        wanted = [[(self.pattern.findall(a), self.pattern.findall(a + s) if s else None) for a, s in p] for p in pieces]
        new: set[str] = set()
        for p in wanted:
            for a, s in p:
                new.update(a)
                if s:
                    new.update(s)
        if len(self.table) > CACHE_WORDS:  # words not asked for since the last change are forgotten
            self.older, self.table = self.table, {}
        new.difference_update(self.table)
        if self.older:
            self.table.update({w: self.older[w] for w in new.intersection(self.older)})
            new.difference_update(self.older)
        wide: dict[str, list[int]] = {}
        for w, d in self.learn(list(new)).items():
            if len(w) > CACHED_CHARS:
                wide[w] = d
            else:
                self.table[w] = bytes([x & 255 for x in d])
        out = []
        for p, ws in zip(pieces, wanted):
            parts = []
            for (a, s), (fa, fs) in zip(p, ws):
                whole = self._plain(a, fa, wide)
                if not s:
                    parts.append(whole)
                    continue
                through = self._plain(a + s, fs, wide).astype(np.int64)
                end = int(whole.sum()) + 1  # the special string is one token
                through[-1] += end - int(through.sum())
                # up to its end the text goes on ordinarily, but the cut before it is a real one
                parts.append(through)
            out.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
        return out


def pack(differences: np.ndarray) -> bytes:
    """Prefix table: one byte for the width, then signed differences of that width."""
    for width, kind in ((1, np.int8), (2, np.int16), (4, np.int32)):
        info = np.iinfo(kind)
        if not len(differences) or (differences.min() >= info.min and differences.max() <= info.max):
            return bytes([width]) + differences.astype(kind).tobytes()
    raise OverflowError("difference of prefix counts")


def unpack(table: bytes) -> np.ndarray:
    """Token counts of all prefixes, from the empty one to the whole text."""
    kind = {1: np.int8, 2: np.int16, 4: np.int32}[table[0]]
    return np.concatenate([[0], np.cumsum(np.frombuffer(table, kind, offset=1), dtype=np.int64)])


def cut_for_budget(table: bytes, budget: int) -> int:
    """Code points of the longest prefix that has at most ``budget`` tokens."""
    return int(np.flatnonzero(unpack(table) <= budget)[-1])


def _longest_within(differences: np.ndarray, budget: int) -> int:
    """Code points of the longest prefix of at most ``budget`` tokens, from a text's own differences."""
    within = np.flatnonzero(np.cumsum(differences, dtype=np.int64) <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def prefix_counts(df: DataFrame, text_col: str = "text", out: str = "tokens",
                  tokenizer: str | None = None, budget: int | None = None) -> DataFrame:
    """``df`` plus ``<out>_prefixes`` (binary table, see ``pack``) and ``<out>_n`` (count of the whole text);
    with a ``budget`` also ``<out>_cut``, the code points of the longest prefix that has at most so many tokens."""
    path = tokenizer or default_tokenizer()
    if budget is not None and budget < 0:
        raise ValueError("budget must not be negative")
    df = df.drop(f"{out}_prefixes", f"{out}_n", *([] if budget is None else [f"{out}_cut"]))
    names = df.columns
    added = [T.StructField(f"{out}_prefixes", T.BinaryType()), T.StructField(f"{out}_n", T.LongType())]
    if budget is not None:
        added.append(T.StructField(f"{out}_cut", T.LongType()))
    schema = T.StructType(df.schema.fields + added)
    where = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_state(f"prefix-counter {path}", lambda: PrefixCounter(path))
        for b in batches:
            texts = [t or "" for t in b.column(where).to_pylist()]
            d = counter.batch(texts)
            made = [pa.array([pack(x) for x in d], pa.binary()), pa.array([int(x.sum()) for x in d], pa.int64())]
            if budget is not None:
                made.append(pa.array([_longest_within(x, budget) for x in d], pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*names, *(f.name for f in added)])

    return df.mapInArrow(run, schema)


def truncated(df: DataFrame, budget: int, text_col: str = "text", table_col: str = "tokens_prefixes",
              out: str = "truncated") -> DataFrame:
    """``df`` plus the longest prefix of the text within ``budget`` tokens, read off the stored table."""
    @F.pandas_udf("int")
    def cut(tables: pd.Series) -> pd.Series:
        return tables.map(lambda t: cut_for_budget(bytes(t), budget)).astype("int32")

    return df.withColumn(out, F.substring(F.col(text_col), F.lit(1), cut(F.col(table_col))))


TOKEN_LIMIT = 1024


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    c = prefix_counts(docs, budget=TOKEN_LIMIT)
    return c.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                    F.col("tokens_n").alias("n_tokens"), (F.col("tokens_n") > TOKEN_LIMIT).alias("over_limit"),
                    F.col("tokens_cut").alias("cut_chars"))
