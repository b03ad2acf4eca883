import hashlib
import random

import pyarrow as pa

from eventlens.llm.chat import CONTROL, _pieces, escaped, escaped_roles, format_chats, parse_piece, read_chats, unescaped, unescaped_role

SCHEMA = "conv_id long, turn long, role string, text string, part int, seq long"


def odd_strings(n=400):
    r = random.Random(2)
    parts = ["<", "|im_start|>", "\\", "[INST]", "</s>", "<<SYS>>", "a\n", "<s>", "é", "[", "/INST]", "<|im_end|>", ""]
    return ["".join(r.choice(parts) for _ in range(8)) for _ in range(n)]


def test_escaping_is_undone_and_leaves_no_control_string():
    texts = odd_strings()
    for there, back in ((escaped, unescaped), (escaped_roles, unescaped_role)):
        out = there(pa.array(texts)).to_pylist()
        assert [back(x) for x in out] == texts
        assert not any(c in x for x in out for c in CONTROL)


def test_pieces_of_a_batch_are_its_runs_and_read_back():
    texts = odd_strings()
    batch = pa.RecordBatch.from_arrays([pa.array([1] * 200 + [None] * 100 + [2] * 100), pa.array(texts[::-1]), pa.array(texts)],
                                       names=["conv_id", "role", "text"])
    out = _pieces(batch, 0, 0)
    assert out["conv_id"].to_pylist() == [1, None, 2] and out["n_turns"].to_pylist() == [200, 100, 100]
    assert [x for f in out["formatted"].to_pylist() for x in parse_piece(f)] == list(zip(texts[::-1], texts))


def expected(turns):
    order = lambda x: (x is not None, x)
    out = {}
    for conv, turn, role, text in sorted(turns, key=lambda t: [order(x) for x in t]):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {c: (len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest(),
                sum(len(t) for r, t in ts if r == "assistant"),
                hashlib.sha256("".join(t for r, t in ts if r == "assistant").encode()).hexdigest()) for c, ts in out.items()}


def test_digests_of_odd_conversations(spark):
    texts = odd_strings(60)
    turns = [(k % 5, k // 5, ("user", "assistant", "system", None, "a\\n\nb")[k % 5], t) for k, t in enumerate(texts)]
    turns += [(None, 0, "assistant", "x"), (None, None, "assistant", None), (3, 1, "assistant", "tie"), (3, 1, "assistant", "tie"),
              (9, 0, "assistant", "long " * 50_000), (10, 0, None, None)]
    df = spark.createDataFrame([(*t, 1, 2) for t in turns], SCHEMA).repartition(3)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read_chats(format_chats(df)).collect()}
    assert got == expected(turns)


def test_a_conversation_over_many_batches_and_tasks(spark):
    turns = [(1, k, "assistant" if k % 2 else "user", f"turn {k} [INST]") for k in range(3000)]
    pieces = format_chats(spark.createDataFrame([(*t, 1, 2) for t in turns], SCHEMA))
    assert pieces.count() > 1
    r = read_chats(pieces).collect()
    assert len(r) == 1 and (r[0].n_turns, r[0].turns_sha256, r[0].loss_chars, r[0].loss_sha256) == expected(turns)[1]


def test_no_turns(spark):
    assert read_chats(format_chats(spark.createDataFrame([], SCHEMA))).count() == 0
