import random

import numpy as np

from eventlens.llm.byte_table import ByteTable


def test_numbers_are_those_of_a_dictionary():
    r = random.Random(1)
    table, want = ByteTable(bits=2), {}
    for _ in range(40):
        words = [bytes(r.choice(b"ab\0") for _ in range(r.choice([0, 1, 3, 8, 9, 16, 24, 25, 40]))) for _ in range(r.randrange(60))]
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum([0, *map(len, words)]).astype(np.int64)
        number, new = table.numbers(data, ends[:-1], ends[1:])
        for k in new.tolist():
            assert words[k] not in want
            want[words[k]] = len(want)
        assert number.tolist() == [want[w] for w in words] and table.n == len(want)
