"""Layouts, the round trip through the template, and the defined cases."""

from __future__ import annotations

import json
import random

import pytest
from tidemark.llm import chat

SAME = [("system", "be kind"), ("user", "2+2?"), ("assistant", "4")]
RECORDS = {
    "messages_text": {"messages": [{"role": r, "text": t} for r, t in SAME]},
    "messages_content": {"id": 3, "messages": [{"content": t, "role": r} for r, t in SAME]},
    "from_value": {"conversations": [{"from": {"user": "human", "assistant": "gpt"}.get(r, r), "value": t} for r, t in SAME]},
    "instruction": {"system": "be kind", "instruction": "2+2?", "output": "4"},
    "prompt_response": {"prompt": "2+2?", "response": "4", "system": "be kind"},
}


def test_layouts_meet_in_one_form(spark):
    rows = [(name, json.dumps(record)) for name, record in RECORDS.items()]
    got = chat.format_records(spark.createDataFrame(rows, "k string, record string"), "k", "record").collect()
    assert {r["k"]: r["layout"] for r in got} == {name: name for name in RECORDS}
    assert len({r["formatted"] for r in got}) == 1 and chat.parse(got[0]["formatted"]) == SAME
    assert chat.masked(got[0]["formatted"], got[0]["loss_begins"], got[0]["loss_ends"]) == "4"


def test_mappings_are_told_apart():
    assert len(chat.mapping_table()) == sum(len(layout.fingerprints()) for layout in chat.LAYOUTS)
    with pytest.raises(ValueError):
        chat.mapping_table((*chat.LAYOUTS, chat.Layout("again", ("prompt", "response"))))
    input_ = chat.mapping_table()[chat.fingerprint_of(chat.field_paths({"instruction": "a", "input": "b", "output": "c"}))]
    assert input_.read({"instruction": "a", "input": "b", "output": "c"}) == [("user", "a\n\nb"), ("assistant", "c")]


def test_round_trip():
    rng = random.Random(3)
    parts = [*chat.CONTROL, "\\", "\\\\", "<", "[", "|", "\n", "é", "日", "x", ">", "/", "close", "<|tu", "\\n", "s>"]
    for _ in range(2000):
        turns = [(rng.choice(["user", "assistant", "a\nb", "\\", "<s>"]), "".join(rng.choice(parts) for _ in range(rng.randrange(8)))) for _ in range(rng.randrange(5))]
        text, begins, ends = chat.render(turns)
        assert chat.parse(text) == turns
        assert chat.masked(text, begins, ends) == "".join(t for r, t in turns if r == "assistant")
        for mark in chat.CONTROL:
            assert all(mark not in chat.escape(t) for _, t in turns)


def test_defined_cases(spark):
    rows = [(1, None), (2, "not json"), (3, "[1]"), (4, '{"other": 1}'), (5, '{"messages": []}'), (6, json.dumps({"messages": [{"role": None, "text": None}]}))]
    got = {r["k"]: r for r in chat.format_records(spark.createDataFrame(rows, "k long, record string"), "k", "record").collect()}
    assert all(got[k]["layout"] is None and got[k]["formatted"] == "<s></s>" for k in (1, 2, 3, 4, 5))
    assert chat.parse(got[6]["formatted"]) == [("", "")]
    schema = "conv_id long, turn long, role string, text string, record int"
    turns = spark.createDataFrame([(1, 1, "assistant", None, 0), (1, 0, "user", "a", 0), (1, None, None, "first", 0), (1, 0, "user", "a", 0), (None, 0, "user", "n", 0), (2, 0, "user", "z" * 200000, 0)], schema)
    made = {r["conv_id"]: json.loads(r["record"])["messages"] for r in chat.records_of_turns(turns).collect()}
    assert [(m["role"], m["text"]) for m in made[1]] == [("", "first"), ("user", "a"), ("user", "a"), ("assistant", "")]
    assert len(made[2][0]["text"]) == 200000 and None in made
    assert chat.records_of_turns(spark.createDataFrame([], schema)).collect() == []
