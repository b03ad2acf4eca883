import random
import zlib

import pyarrow as pa

from eventlens.llm.words import split_words, text_slices, word_crc32
from llm_helpers import brute_words, odd_texts

def check(texts, array=None):
    w = split_words(pa.array(texts, pa.string()) if array is None else array)
    got = [[w.data[a:b].tobytes().decode() for a, b in zip(w.start[x:y], w.stop[x:y])] for x, y in zip(w.first, w.first[1:])]
    assert got == [brute_words(t) for t in texts]
    assert word_crc32(w).tolist() == [zlib.crc32(x.encode()) for own in got for x in own]


def test_words_and_their_crc():
    texts = odd_texts() + ["É Ab", "b" * 47, "c" * 48, "d" * 49, "漢字", "字", "", "x"]
    check(texts)
    check([])
    check([None])
    whole = pa.array(texts, pa.string())
    check(texts[3:9], whole[3:9])
    r = random.Random(1)
    for _ in range(200):
        check(["".join(r.choice("aZ 9é字.\n") for _ in range(r.randrange(9))) for _ in range(r.randrange(7))])


def test_slices_hold_all_rows():
    b = pa.RecordBatch.from_arrays([pa.array(["ab", None, "c" * 50, "", "d"], pa.string())], ["t"])
    for limit in (0, 1, 3, 60, 1000):
        parts = list(text_slices(b, 0, limit))
        assert pa.Table.from_batches(parts)["t"].to_pylist() == b["t"].to_pylist()
    assert list(text_slices(b.slice(0, 0), 0)) == []
