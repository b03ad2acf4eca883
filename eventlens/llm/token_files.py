r"""Token ids in bit-packed binary files.

``write_token_files`` encodes documents in ascending id order and writes rows
of a Parquet data set; each row is one *segment*, a self-contained byte string:

    magic ``EVTK``, u8 version, u8 bits, u16 zero, u32 ids per block,
    u64 ids, u32 documents,
    u64 byte offset of each block in the payload, and the payload's length,
    per document: u8 (1: the id is null), i64 document id, u64 ids,
    payload: blocks of ids, each id in ``bits`` bits, little-endian, each
    block starting at a whole byte

(all little-endian). ``bits`` is the least number that holds the vocabulary's
largest id. Blocks are unpacked by numpy as a whole, and the id at any place is
found through the block offsets. A segment holds whole documents, so that a
reader needs no other segment; it is closed when it has ``SEGMENT_IDS`` ids, so
a task holds one segment and one Arrow batch. Spark's writer commits the rows,
so a lost executor's segments are written again and never seen twice; the
container also works in a store that only Spark reaches.

Segments know how many ids stand before them in their part (range partition);
the parts' totals (one row per partition) give the global start.

Defined results: a null text counts as an empty one (only the end id); a null
id sorts first; rows of equal id sort by their text's hash; an empty table gives no segment
and an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.byte_table import ByteTable
from eventlens.llm.common import read_table, worker_state
from eventlens.llm.runs import Runs, take_runs
from eventlens.llm.token_counts import byte_alphabet, default_tokenizer
from eventlens.llm.words import text_slices
from eventlens.session import scratch_path

END_ID = 0
BLOCK_IDS = 4096
SEGMENT_IDS = 1 << 18
HEAD = "<4sBBHIQI"
DOC = np.dtype([("null", "u1"), ("id", "<i8"), ("n", "<u8")])


def bits_for(vocabulary: int) -> int:
    """Least bits that hold the ids 0..vocabulary-1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, little-endian bit order, zero bits up to a whole byte."""
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return raw[:, : bits // 8].tobytes()
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack_ids(data: bytes, n: int, bits: int) -> np.ndarray:
    out = np.zeros((n, 4), np.uint8)
    if bits % 8 == 0:
        out[:, : bits // 8] = np.frombuffer(data, np.uint8, n * bits // 8).reshape(n, bits // 8)
    else:
        flat = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * bits].reshape(n, bits)
        out = np.packbits(np.pad(flat, ((0, 0), (0, 32 - bits))), axis=1, bitorder="little")
    return np.ascontiguousarray(out).view("<u4").ravel()


def make_segment(docs: list[tuple[int | None, np.ndarray]], bits: int, block: int = BLOCK_IDS) -> bytes:
    ids = np.concatenate([x for _, x in docs]) if docs else np.zeros(0, np.uint32)
    blocks = [pack_ids(ids[k:k + block], bits) for k in range(0, len(ids), block)]
    offsets = np.cumsum([0, *map(len, blocks)]).astype("<u8")
    table = np.array([(d is None, d or 0, len(x)) for d, x in docs], DOC)
    head = struct.pack(HEAD, b"EVTK", 1, bits, 0, block, len(ids), len(docs))
    return b"".join([head, offsets.tobytes(), table.tobytes(), *blocks])


class Segment:
    """Reader of one segment: documents, whole blocks, and ids at any place."""

    def __init__(self, data: bytes):
        self.data = data
        magic, version, self.bits, _, self.block, self.n_ids, n_docs = struct.unpack_from(HEAD, data)
        if (magic, version) != (b"EVTK", 1):
            raise ValueError("no token segment")
        n_blocks = -(-self.n_ids // self.block)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, struct.calcsize(HEAD))
        at = struct.calcsize(HEAD) + self.offsets.nbytes
        self.docs = np.frombuffer(data, DOC, n_docs, at)
        self.payload = at + self.docs.nbytes

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start``..``stop - 1``; touches only the blocks they lie in."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        out, first = [], start // self.block
        for k in range(first, -(-stop // self.block)):
            a, b = int(self.offsets[k]), int(self.offsets[k + 1])
            n = min(self.block, self.n_ids - k * self.block)
            out.append(unpack_ids(self.data[self.payload + a:self.payload + b], n, self.bits))
        return np.concatenate(out)[start - first * self.block:stop - first * self.block]


def _white_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is white space (some
    that may be, for a few control characters)."""
    c = data[at - 1]
    out = (c == 32) | ((c >= 9) & (c <= 13)) | ((c >= 28) & (c <= 31))
    far = np.flatnonzero(c >= 0x80)
    if len(far):
        c, b, a = c[far], data[at[far] - 2], data[np.maximum(at[far], 3) - 3]
        out[far] = ((b == 0xC2) & ((c == 0x85) | (c == 0xA0))
                    | (a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE3) & (b == 0x80) & (c == 0x80)
                    | (a == 0xE2) & (b == 0x81) & (c == 0x9F)
                    | (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)))
    return out


class WordEncoder:
    """Ids of whole texts by the tokenizers library, asked once per distinct chunk.

    A chunk begins where a text begins, at a space or line end behind other
    text, at a full stop or comma behind a letter, and at a letter behind a single line
    end; no pretoken of a byte-level tokenizer goes across one of these, so a
    text's ids are its chunks' ids in a row. (Checked against the library on
    whole texts in the tests.) Chunks are cut and numbered by numpy: only new
    ones become Python strings. Ids of chunks are kept until there are many.
    Tokenizers of another kind are asked text by text."""

    WORDS, BYTES = 1_000_000, 32 << 20  # chunks and their bytes, without those of the batch

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        self.by_chunk = (pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
                         and spec["normalizer"] is None and model["type"] == "BPE"
                         and all(t["content"].isascii() and " " not in t["content"] and not t["normalized"]
                                 and not t["lstrip"] and not t["rstrip"] and not t["single_word"]
                                 for t in spec["added_tokens"]))
        self.vocabulary = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.model = self.tokenizer.model
        self.printable = {b: c for c, b in byte_alphabet().items()}
        self.space = self.printable[0x20]
        self.signs = {c: array("I", self.tokenizer.encode(c, add_special_tokens=False).ids).tobytes() for c in ".,\n"}
        self.letters = regex.compile(r"[A-Za-zÀ-ÖØ-öø-ſ]+")
        self._forget()

    def _forget(self) -> None:
        self.table, self.ids, self.held = ByteTable(), Runs(np.uint32), 0

    def ask(self, chunk: str) -> bytes:
        """Ids of one chunk. The plain ones (a space or line end, letters, a
        full stop or comma: one pretoken each) go straight to the library's
        model, in its byte alphabet; the rest goes through the whole tokenizer."""
        first, lead, word, head, tail = chunk[:1], "", chunk, b"", b""
        if first == " ":
            lead, word = self.space, chunk[1:]
        elif first == "\n":
            head, word = self.signs["\n"], chunk[1:]
        last = word[-1:]
        if last == "." or last == ",":
            tail, word = self.signs[last], word[:-1]
        if word.isalpha():
            if word.isascii():
                return head + array("I", [t.id for t in self.model.tokenize(lead + word)]).tobytes() + tail
            if self.letters.fullmatch(word):
                word = word.encode().decode("latin-1").translate(self.printable)
                return head + array("I", [t.id for t in self.model.tokenize(lead + word)]).tobytes() + tail
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def cut(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where chunks begin in the texts ``data[ends[k]:ends[k + 1]]``."""
        line = data == 10
        mark = line | (data == 32)
        mark[0] = False
        at = np.flatnonzero(mark)
        mark[at[_white_before(data, at)]] = False
        letter = ((data | 32) >= 97) & ((data | 32) <= 122)
        mark[1:] |= letter[:-1] & ((data[1:] == 46) | (data[1:] == 44)) | letter[1:] & (line & mark)[:-1]
        mark[ends[:-1][np.diff(ends) > 0]] = True
        return np.flatnonzero(mark)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (a string column; null: empty) in a row, and where each text's begin and end."""
        texts = texts.fill_null("")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        if not self.by_chunk:
            own = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate(own), np.cumsum([0, *map(len, own)])
        texts = texts.cast(pa.large_string())
        ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        if ends[-1] == ends[0]:
            return np.zeros(0, np.uint32), np.zeros(len(ends), np.int64)
        data, ends = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0]:ends[-1]], ends - ends[0]
        start = self.cut(data, ends)
        stop = np.append(start[1:], len(data))
        which, new = self.table.numbers(data, start, stop)
        asked = [self.ask(data[x:y].tobytes().decode("utf-8")) for x, y in zip(start[new].tolist(), stop[new].tolist())]
        self.ids.add(np.frombuffer(b"".join(asked), "<u4"), np.fromiter(map(len, asked), np.int64, len(asked)) // 4)
        self.held += int((stop[new] - start[new]).sum())
        count = self.ids.count[which]
        out = take_runs(self.ids.flat, self.ids.first[which], count)
        if self.table.n > self.WORDS or self.held > self.BYTES:
            self._forget()
        return out, np.concatenate([[0], np.cumsum(count)])[np.searchsorted(start, ends)]


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                      tokenizer: str | None = None, end_id: int = END_ID) -> None:
    """Encode and write all documents in ascending id order (see the module's text)."""
    file = tokenizer or default_tokenizer()
    # Ties go by the text's hash: the range bounds' sample must not carry texts to the driver.
    ordered = (docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(text_col).alias("h"))
               .repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_state(f"word-encoder {file}", lambda: WordEncoder(file))
        bits = bits_for(max(enc.vocabulary, end_id + 1))
        part, before, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()),
                 pa.array([make_segment(held, bits)], pa.binary())], names=["part", "part_start", "n_ids", "segment"])

        for whole in batches:
            for b in text_slices(whole, 1):
                ids, ends = enc.encode(b.column(1))
                ids = np.insert(ids, ends[1:], end_id)
                ends = ends + np.arange(len(ends))
                for doc, x, y in zip(b.column(0).to_pylist(), ends.tolist(), ends[1:].tolist()):
                    held.append((doc, ids[x:y]))
                    size += y - x
                    if size >= SEGMENT_IDS:
                        yield close()
                        before, held, size = before + size, [], 0
        if held:
            yield close()

    (ordered.mapInArrow(run, "part int, part_start long, n_ids long, segment binary")
     .write.option("compression", "zstd").parquet(path))


def read_token_files(spark: SparkSession, path: str, id_name: str = "doc_id", digest: bool = False) -> DataFrame:
    """Per document: id, ``start`` (ids of all documents before it), ``n_tokens``,
    and its ``ids``, or with ``digest`` instead ``ids_crc32``, the crc32 of the
    ids as little-endian unsigned 32-bit integers."""
    files = spark.read.schema("part int, part_start long, n_ids long, segment binary").parquet(path)
    totals = files.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_ids")).alias("n")).collect()
    base, at = {}, 0
    for r in sorted(totals):  # one row per range partition of the writer
        base[r["part"]], at = at, at + r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, before, data in zip(*(b.column(k).to_pylist() for k in range(3))):
                s = Segment(data)
                n = s.docs["n"].astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(n)])
                ids = s.read(0, s.n_ids)
                doc = pa.array(s.docs["id"], pa.int64(), mask=s.docs["null"].astype(bool))
                if digest:
                    value = pa.array([zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(ends, ends[1:])], pa.int64())
                else:
                    value = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([doc, pa.array(base[part] + before + ends[:-1]), pa.array(n), value],
                                                 names=[id_name, "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return files.select("part", "part_start", "segment").mapInArrow(
        run, f"`{id_name}` long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids array<int>"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_token_files(read_table(spark, sf_dir, "documents", "doc_id", "text"), path)
    return read_token_files(spark, path, digest=True)
