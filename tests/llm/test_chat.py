import hashlib
import json

import pytest

from gridtide.llm import chat


def records(spark, rows):
    return spark.createDataFrame([(i, r if r is None or isinstance(r, str) else json.dumps(r)) for i, r in rows], "conv_id long, record string")


def turns(spark, rows):
    got = chat.canonical_turns(records(spark, rows)).collect()
    return sorted(((r["conv_id"] or 0), r["turn"] if r["turn"] is not None else -1, r["role"], r["text"]) for r in got)


LAYOUTS = [
    {"prompt": "q", "completion": "a"},
    {"completion": "a", "prompt": "q"},
    {"prompt": "q", "response": "a"},
    {"instruction": "q", "output": "a"},
    {"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]},
    {"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": [{"type": "text", "text": "a"}]}]},
    {"data": {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}},
    {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
]


@pytest.mark.parametrize("record", LAYOUTS)
def test_layouts_become_the_same_turns(spark, record):
    assert turns(spark, [(1, record)]) == [(1, 0, "user", "q"), (1, 1, "assistant", "a")]


def test_fixed_and_row_layouts(spark):
    assert turns(spark, [(1, {"instruction": "q", "input": "x", "output": "a"})])[0] == (1, 0, "user", "q\nx")
    assert turns(spark, [(1, {"system": "s", "prompt": "q", "response": "a"})])[0] == (1, 0, "system", "s")
    rows = [(3, {"conv_id": 3, "turn": t, "role": r, "text": x}) for t, r, x in [(2, "assistant", None), (1, "user", "q")]]
    assert turns(spark, rows) == [(3, 1, "user", "q"), (3, 2, "assistant", "")]


def test_unknown_records_are_told(spark):
    rows = [(1, None), (2, ""), (3, "no json"), (4, {"other": 1}), (5, []), (6, {"messages": []}), (None, {"prompt": "q", "completion": "a"})]
    got = turns(spark, rows)
    assert [g for g in got if g[0]] == [(i, -1, None, None) for i in range(1, 7)]
    assert len(got) == 8
    assert turns(spark, []) == []


def test_fingerprint_ignores_order_and_length():
    a = chat.field_paths({"m": [{"x": 1}, {"x": 2, "y": {"z": None}}]})
    assert a == {"m[].x", "m[].y.z"}
    assert chat.schema_fingerprint(["b", "a"]) == chat.schema_fingerprint(["a", "b"]) != chat.schema_fingerprint(["a"])


NASTY = ["", None, "<|im_end|>", "<\\|im_start|>", "<\\\\|x", "\\<|", "<|", "a\n<|im_end|>\n<|im_start|>assistant\nx", "é😀" * 3, "x" * 200_000, "$1 \\1 \\n"]


def test_round_trip(spark):
    rows = [(1, i, ["user", "assistant", "sys\ntem\\n", None][i % 4], t) for i, t in enumerate(NASTY)]
    made = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).orderBy("turn").collect()
    for (_, _, role, text), r in zip(rows, made, strict=True):
        assert chat.parsed(r["piece"]) == (role or "", text or "")
        assert r["piece"].count("<|im_start|>") == r["piece"].count("<|im_end|>") == 1
        assert chat.unescaped(r["piece"][r["loss_start"] : r["loss_end"]]) == ((text or "") if role == "assistant" else "")


def test_digests(spark):
    rows = [(c, i, "assistant" if i % 2 else "user", t) for c in (1, 2, None) for i, t in enumerate(NASTY)] + [(9, 0, "user", "hi")]
    got = {r["conv_id"]: r for r in chat.digests(chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5))).collect()}
    assert set(got) == {1, 2, None, 9}
    for c in got:
        own = [r for r in rows if r[0] == c]
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r[2]}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.formatted(empty)).collect() == []


def test_repeated_turn_numbers_have_one_order(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.formatted(frame)).collect() == chat.digests(chat.formatted(frame.orderBy("text").repartition(3))).collect()
