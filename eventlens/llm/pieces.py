r"""SentencePiece encoding with seeded merge-dropout, and decoding.

Encoding follows the model file's merge rules: of all neighbouring pieces whose
concatenation is a piece, the one of best score is merged, the leftmost of
equals first, until none is left. With dropout, a candidate merge (the span of
a word it would join, and where) is skipped when a hash keyed by seed, document,
place of the word in it, word and span falls below the rate: every occurrence of
a word draws for itself. The same seed always gives the same pieces; other
seeds, documents or places give other segmentations of the same word.

Merges never cross into a space from other text, so texts are cut before each
run of spaces. A table has the pieces of each word without dropout, and the spans
of the merges that make them; an occurrence that skips none of these has the
same pieces. All others of a batch are merged together: words
of one length form a matrix, and each round takes the best candidate of every
row at once. Very long words are merged one by one with a heap.

Decoding joins the pieces' bytes; it is lossless for every text. Characters
without a piece, and a literal U+2581 (the file's sign for a space), are written
as byte pieces. At dropout 0 the pieces are the library's (except for texts with
a literal U+2581, which the library turns into spaces).

Defined results: a null or empty text has no pieces and decodes to an empty
text; a null key is a key like any other; repeated rows give the same pieces;
an empty table gives an empty result; other columns pass through untouched,
but one named like the added column is replaced.
"""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.llm.common import read_table, worker_state
from eventlens.llm.runs import Numbers, Runs, take_runs

DROPOUT = 0.1
SEED = 20_240

SPACE_SIGN = "▁"
CACHE_WORDS = 160_000  # without those of the batch
MATRIX_CHARS = 40  # 63 at most
MATRIX_ROWS = 8192
TEXTS = 500  # cut at a time
NONE = np.int32(2**31 - 1)
_A, _B, _C = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_MASK = (1 << 64) - 1
_LAST = 1 << 62


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def _mix(x):
    """Finaliser of a 64-bit hash, for Python and for numpy numbers."""
    if isinstance(x, np.ndarray):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
    return x ^ (x >> 31)


class PieceDecoder:
    """The bytes of every piece of a model file."""

    def __init__(self, path: str):
        import sentencepiece
        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.normal = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.bytes_of = [b""] * sp.vocab_size()
        for i in self.normal:
            self.bytes_of[i] = sp.id_to_piece(i).replace(SPACE_SIGN, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.size = np.array([len(x) for x in self.bytes_of], np.int64)
        self.begin = np.cumsum(self.size) - self.size

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, ids))
        return raw[1:].decode("utf-8")  # without the space that encoding puts in front

    def decode_many(self, flat: np.ndarray, ends: np.ndarray) -> pa.Array:
        """Texts of encoded documents, ``flat[ends[k]:ends[k + 1]]`` each, as one column."""
        first, count = self.begin[flat], self.size[flat]
        front = ends[:-1][np.diff(ends) > 0]
        first[front] += 1  # the space that encoding puts in front
        count[front] -= 1
        raw = take_runs(self.raw, first, count)
        at = np.concatenate([[0], np.cumsum(count)])[ends].astype(np.int64)
        return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(at.tobytes()), pa.py_buffer(raw.tobytes())).cast(pa.string())


class PieceEncoder(PieceDecoder):
    """Encoder of one model file at one dropout rate and seed."""

    def __init__(self, path: str, dropout: float = DROPOUT, seed: int = SEED):
        super().__init__(path)
        sp, normal = self.sp, self.normal
        if sp.encode(" ﬁ  a ", out_type=str)[-1] != SPACE_SIGN:
            raise ValueError("the model file changes its texts; only unchanged ones decode losslessly")
        piece = {i: sp.id_to_piece(i).replace(SPACE_SIGN, " ") for i in normal}
        self.id_of = {p: i for i, p in piece.items()}
        whole = [p for p in piece.values() if " " in p.lstrip(" ")]
        if whole:
            raise ValueError("a piece goes across words")
        rank_of = {x: k for k, x in enumerate(sorted({-sp.get_score(i) for i in normal}))}
        # The piece of each rank. Only runs of spaces may share a rank; words with one take the heap.
        self.piece_of = np.zeros(len(rank_of), np.int32)
        tied = set()
        self.vocab = sp.vocab_size()
        if self.vocab**2 >= 1 << 31:
            raise ValueError("a pair of pieces has 31 bits")
        #: pair of pieces -> (rank of the score, merged piece)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for i in normal:
            p, rank = piece[i], rank_of[-sp.get_score(i)]
            if len(p) > 1 and p.strip(" "):
                if rank in tied:
                    raise ValueError("scores of pieces tie")
                tied.add(rank)
                self.piece_of[rank] = i
            for k in range(1, len(p)):
                a, b = self.id_of.get(p[:k]), self.id_of.get(p[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = rank, i
        self._make_table()
        self.limit = min(int(dropout * 2.0**64), _MASK)
        self.seed = seed
        self._forget()
        self.char_ids = np.full(0x110000, -1, np.int32)
        for p, i in self.id_of.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        chars = regex.escape("".join(p for p in self.id_of if len(p) == 1), special_only=False)
        self.parts = regex.compile(f"[{chars}]+|[^{chars}]")
        self.line_alone = "\n" not in self.id_of
        self.cut = regex.compile(r"\n| *[^ \n]+| +" if self.line_alone else r" *[^ ]+| +")

    def _forget(self) -> None:
        """An empty table of words: number, digest, characters, pieces without dropout, spans of their merges."""
        self.row = Numbers()
        self.digest = np.zeros(0, np.uint64)
        self.symbols, self.plain, self.spans = Runs(np.int32), Runs(np.int32), Runs(np.uint64)
        self.slow = np.zeros(0, bool)  # always merged anew, by the heap

    def _make_table(self) -> None:
        """Pairs in an open-addressing table for numpy look-ups."""
        bits = max(4, (4 * len(self.pairs)).bit_length())
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.table = np.full(size, -1, np.int64)  # key and rank, 32 bits each
        for (a, b), (rank, _) in self.pairs.items():
            key = a * self.vocab + b
            at = (key * _A & _MASK) >> int(self.shift)
            while self.table[at] >= 0:
                at = (at + 1) % size
            self.table[at] = key << 32 | rank

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, NONE where there is none."""
        key = a.astype(np.int64) * self.vocab + b
        at = ((key.view(np.uint64) * np.uint64(_A)) >> self.shift).astype(np.int64)
        found = self.table[at]
        hit = found >> 32 == key
        out = np.where(hit, found & 0xFFFFFFFF, NONE)
        todo = np.flatnonzero(~hit & (found >= 0))
        while len(todo):  # another pair has the slot: look at the next one
            at[todo] = (at[todo] + 1) % len(self.table)
            found = self.table[at[todo]]
            hit = found >> 32 == key[todo]
            out[todo[hit]] = found[hit] & 0xFFFFFFFF
            todo = todo[~hit & (found >= 0)]
        return out

    def word_key(self, word: str, variant: int) -> int:
        return _mix((xxhash.xxh64_intdigest(word.encode("utf-8"), self.seed & _MASK) + variant * _B) & _MASK)

    @staticmethod
    def _span(start: np.ndarray, middle: np.ndarray, stop: np.ndarray) -> np.ndarray:
        s, m, e = (x.astype(np.uint64) for x in (start, middle, stop))
        return s * np.uint64(_A) + m * np.uint64(_B) + e * np.uint64(_C)

    def skipped(self, key, start, middle, stop):
        """True if the candidate merge of ``start..middle`` and ``middle..stop`` of a word is dropped."""
        if isinstance(key, np.ndarray):
            return _mix(key ^ self._span(start, middle, stop)) < np.uint64(self.limit)
        return _mix(key ^ ((start * _A + middle * _B + stop * _C) & _MASK)) < self.limit

    def merge_one(self, word: str, key: int) -> list[int]:
        """Pieces of a word whose characters all have one, by a heap of candidates."""
        ids = [self.id_of[c] for c in word]
        n = len(ids)
        left, right, start = list(range(-1, n - 1)), [*range(1, n), -1], list(range(n))
        stop = [i + 1 for i in start]
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            j = right[i]
            found = self.pairs.get((ids[i], ids[j])) if j >= 0 else None
            if found is not None:
                heapq.heappush(heap, (found[0], start[i], start[j], stop[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, s, m, e, piece = heapq.heappop(heap)
            # stands for a pair that is still there as it was?
            if ids[s] < 0 or stop[s] != m or right[s] != m or stop[m] != e or self.skipped(key, s, m, e):
                continue
            ids[s], ids[m], stop[s], right[s] = piece, -1, e, right[m]
            if right[s] >= 0:
                left[right[s]] = s
                offer(s)
            if left[s] >= 0:
                offer(left[s])
        return [i for i in ids if i >= 0]

    def merge_many(self, symbols: np.ndarray, keys: np.ndarray | None, spans: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words of one length, a row of ``symbols`` each: all in a row, and
        how many each word has. Every round merges the best candidate of every word
        that still has one. Without ``keys`` nothing is dropped; ``spans`` takes rows
        and spans of the merges.

        Inside, a word is a column and a place of it a line, so that a round runs
        along the words. A symbol stays at the place where it starts."""
        n, length = symbols.shape
        row, size = np.arange(n), n
        s = symbols.T.copy().ravel()
        after = np.repeat(np.arange(1, length + 1, dtype=np.int64), n)  # start of the symbol behind, and before
        before = np.repeat(np.arange(-1, length - 1, dtype=np.int64), n)
        # rank of the merge with the symbol behind, and the place: the least one is the next merge
        best = np.full(length * n, _LAST, np.int64)
        at = np.arange((length - 1) * n)
        self._offer(best, s, keys, at, at + n, at // n, at // n + 1, at // n + 2, at % n)
        out: list = []

        def finish(columns: np.ndarray) -> None:
            left = s.reshape(length, size)[:, columns].T
            kept = left >= 0
            out.append((row[columns], left[kept], kept.sum(axis=1)))

        while True:
            top = best.reshape(length, size).min(axis=0)
            live = np.flatnonzero(top != _LAST)
            if len(live) <= size // 2:  # the words that are done leave
                finish(np.flatnonzero(top == _LAST))
                if not len(live):
                    rows, ids, count = (np.concatenate(x) for x in zip(*out))
                    order = np.argsort(rows)
                    return take_runs(ids, np.cumsum(count)[order] - count[order], count[order]), count[order]
                s, after, before, best = (np.ascontiguousarray(x.reshape(length, size)[:, live]).ravel() for x in (s, after, before, best))
                top, row, keys = top[live], row[live], None if keys is None else keys[live]
                size, live = len(live), np.arange(len(live))
            top = top[live]
            j = top & 63
            here = j * size + live
            m = after[here]
            middle = m * size + live
            e = after[middle]
            if spans is not None:
                spans.append((row[live], self._span(j, m, e)))
            s[here], s[middle] = self.piece_of[top >> 6], -1
            best[here], best[middle], after[here] = _LAST, _LAST, e
            # the new piece with its neighbours
            x = np.flatnonzero(e < length)
            k, jx, ex = live[x], j[x], e[x]
            behind = ex * size + k
            before[behind] = jx
            self._offer(best, s, keys, here[x], behind, jx, ex, after[behind], k)
            x = np.flatnonzero(j > 0)
            k, jx = live[x], j[x]
            p = before[here[x]]
            self._offer(best, s, keys, p * size + k, here[x], p, jx, e[x], k)

    def _offer(self, best: np.ndarray, s: np.ndarray, keys: np.ndarray | None, a: np.ndarray, b: np.ndarray,
               start: np.ndarray, middle: np.ndarray, stop: np.ndarray, word: np.ndarray) -> None:
        """Enters the merges of the symbols at ``a`` and ``b``, where there is one that is not dropped."""
        rank = self._rank(s[a], s[b])
        some = np.flatnonzero(rank != NONE)
        if keys is not None:
            some = some[~self.skipped(keys[word[some]], start[some], middle[some], stop[some])]
        value = np.full(len(a), _LAST, np.int64)
        value[some] = (rank[some].astype(np.int64) << 6) | start[some]
        best[a] = value

    def _slow(self, w: str, variant: int) -> np.ndarray:
        """Pieces of any chunk: runs of characters with a piece by the heap, others as bytes."""
        ids: list[int] = []
        for part in self.parts.findall(w):
            if part[0] in self.id_of:
                ids += self.merge_one(part, self.word_key(part, variant))
            else:
                ids += [self.byte_ids[b] for b in part.encode("utf-8")]
        return np.array(ids, np.int32)

    def _matrices(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of one length whose characters all have a piece: their places and symbols."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(size[size <= MATRIX_CHARS]).tolist():
            own = np.flatnonzero(size == length)
            for at in range(0, len(own), MATRIX_ROWS):
                part = own[at:at + MATRIX_ROWS]
                codes = np.frombuffer("".join([words[k] for k in part]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, length)
                symbols = self.char_ids[codes]
                known = (symbols >= 0).all(axis=1) & ~((codes[:, 1:] == 32) & (codes[:, :-1] == 32)).any(axis=1)
                if known.any():
                    yield part[known], symbols[known]

    def _digests(self, words: list[str]) -> np.ndarray:
        digest, seed = xxhash.xxh64_intdigest, self.seed & _MASK
        return np.fromiter([digest(w, seed) for w in map(str.encode, words)], np.uint64, len(words))

    def _learn_plain(self, words: list[str]) -> None:
        """New words of the table."""
        none = np.zeros(0, np.int64)
        which, symbols, plain, pieces, owner, spans = [none], [none], [none], [none], [none], [np.zeros(0, np.uint64)]
        sizes = [none]
        for part, own in self._matrices(words):
            made: list = []
            ids, count = self.merge_many(own, None, made)
            which.append(part)
            symbols.append(own.ravel())
            sizes.append(np.full(len(part), own.shape[1]))
            plain.append(ids)
            pieces.append(count)
            owner += [part[r] for r, _ in made]
            spans += [x for _, x in made]
        at = np.concatenate(which)
        order = np.argsort(at)
        self.slow = np.concatenate([self.slow, ~np.isin(np.arange(len(words)), at)])
        for runs, flat, count in ((self.symbols, symbols, sizes), (self.plain, plain, pieces)):
            flat, count = np.concatenate(flat), np.concatenate(count)
            full = np.zeros(len(words), np.int64)
            full[at] = count
            runs.add(take_runs(flat, (np.cumsum(count) - count)[order], count[order]), full)
        merged = np.concatenate(owner)
        self.spans.add(np.concatenate(spans)[np.argsort(merged, kind="stable")], np.bincount(merged, minlength=len(words)))
        self.digest = np.concatenate([self.digest, self._digests(words)])

    def _cut(self, text: str) -> list[str]:
        text = " " + text
        if "\0" in text or "  " in text:
            return self.cut.findall(text)
        text = text.replace(" ", "\0 ")
        if self.line_alone:
            text = text.replace("\n", "\0\n\0")
        return [w for w in text.split("\0") if w]

    def encode(self, texts: list[str | None], keys: list[int]) -> list[np.ndarray]:
        """Piece ids per text; ``keys``: 64-bit key of each text's document."""
        if len(texts) > TEXTS:
            return [x for k in range(0, len(texts), TEXTS) for x in self.encode(texts[k:k + TEXTS], keys[k:k + TEXTS])]
        cut = [self._cut(t) if t else [] for t in texts]
        words = [w for own in cut for w in own]
        ends = np.cumsum([0, *map(len, cut)])
        if len(self.row) > CACHE_WORDS:
            self._forget()
        known = len(self.row)
        which = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
        if len(self.row) > known:
            self._learn_plain(list(itertools.islice(reversed(self.row), len(self.row) - known))[::-1])
        turn = np.array([_mix((k ^ self.seed * _C) & _MASK) for k in keys], np.uint64)
        draws = np.repeat(turn - ends[:-1].astype(np.uint64), np.diff(ends)) + np.arange(len(words), dtype=np.uint64)
        own = _mix(self.digest[which] + draws * np.uint64(_B))
        # occurrences that skip a merge of the plain pieces
        first, count = self.spans.first[which], self.spans.count[which]
        anew, live, k = np.zeros(len(which), bool), np.flatnonzero(count > 0), 0
        while len(live):
            skip = _mix(own[live] ^ self.spans.flat[first[live] + k]) < np.uint64(self.limit)
            anew[live[skip]] = True
            k += 1
            live = live[~skip & (count[live] > k)]
        flat, first, count = [self.plain.flat], self.plain.first[which], self.plain.count[which]
        base = len(self.plain.flat)
        for rows, ids, n in self._merged_anew(words, which, own, draws, np.flatnonzero(anew), np.flatnonzero(self.slow[which])):
            flat.append(ids)
            first[rows], count[rows] = base + np.cumsum(n) - n, n
            base += len(ids)
        pieces = take_runs(np.concatenate(flat), first, count).astype(np.int32, copy=False)
        upto = np.concatenate([[0], np.cumsum(count)])[ends].tolist()
        return [pieces[a:b] for a, b in zip(upto, upto[1:])]

    def _merged_anew(self, words: list[str], which: np.ndarray, own: np.ndarray, draws: np.ndarray, anew: np.ndarray,
                     slow: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Occurrences, their pieces in a row and how many each has: matrices by length, the slow ones one by one."""
        size = self.symbols.count[which[anew]]
        for length in np.unique(size).tolist():
            part = anew[size == length]
            for at in range(0, len(part), MATRIX_ROWS):
                rows = part[at:at + MATRIX_ROWS]
                symbols = self.symbols.flat[self.symbols.first[which[rows]][:, None] + np.arange(length)]
                yield rows, *self.merge_many(symbols, own[rows])
        for i in slow.tolist():
            ids = self._slow(words[i], int(draws[i]))
            yield np.array([i]), ids, np.array([len(ids)])


def _encoder(path: str, dropout: float, seed: int) -> PieceEncoder:
    return worker_state(f"pieces {path} {dropout} {seed}", lambda: PieceEncoder(path, dropout, seed))


def encode_pieces(docs: DataFrame, text_col: str = "text", key_col: str = "doc_id", out: str = "pieces",
                  model: str | None = None, dropout: float = DROPOUT, seed: int = SEED,
                  decoded: str | None = None) -> DataFrame:
    """``docs`` plus ``out``, the piece ids of the text, and, with ``decoded``,
    a column of that name with the text that they decode to, made in the same
    pass (which saves a second crossing to Python and its workers)."""
    docs = docs.drop(*[c for c in (out, decoded) if c])
    path, where, key = model or default_model(), docs.columns.index(text_col), f"__{out}_key"
    schema = T.StructType(docs.schema.fields + [T.StructField(out, T.ArrayType(T.IntegerType()))]
                          + ([T.StructField(decoded, T.StringType())] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path, dropout, seed)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                b = whole.slice(at, TEXTS)
                keys = [k & _MASK for k in b.column(b.num_columns - 1).to_pylist()]
                ids = enc.encode(b.column(where).to_pylist(), keys)
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                more = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))]
                if decoded:
                    more.append(enc.decode_many(flat, ends))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *more], names=schema.names)

    return docs.withColumn(key, F.xxhash64(F.col(f"`{key_col}`"))).mapInArrow(run, schema)


def decode_pieces(df: DataFrame, pieces_col: str = "pieces", out: str = "decoded", model: str | None = None) -> DataFrame:
    """``df`` plus ``out``, the text that the pieces stand for (null: empty)."""
    df = df.drop(out)
    path, where = model or default_model(), df.columns.index(pieces_col)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = worker_state(f"piece-bytes {path}", lambda: PieceDecoder(path))
        for b in batches:
            ids = b.column(where)
            texts = [dec.decode(x.values.to_pylist() if x.is_valid else []) for x in ids]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return df.mapInArrow(run, schema)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    both = encode_pieces(docs, decoded="decoded")
    return both.select("doc_id", F.size("pieces").cast("long").alias("n_pieces"),
                       F.xxhash64("pieces").alias("pieces_hash"),
                       F.crc32(F.col("decoded").cast("binary")).alias("decoded_crc32"),
                       (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"))
