"""Token pieces and their packing: exact ids, gapless sequences, few of them."""

from __future__ import annotations

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tidemark.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def fewest(sizes, capacity):
    """The least number of sequences by search."""
    best = [len(sizes)]

    def place(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(rooms)
            return
        for room in set(r for r in rooms if r >= sizes[i]):
            rest = list(rooms)
            rest.remove(room)
            place(i + 1, [*rest, room - sizes[i]])
        place(i + 1, [*rooms, capacity - sizes[i]])

    place(0, [])
    return best[0]


def laid_out(plan):
    rooms = defaultdict(list)
    for length, first, end, sequence, each, offset in plan.runs:
        for rank in range(end - first):
            rooms[sequence + rank // each].append((offset + rank % each * length, length))
    return rooms


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_valid_and_close_to_the_least(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 20, 33])
    sizes = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 9))), reverse=True)
    counts = {s: sizes.count(s) for s in sizes}
    plan = packing.Plan(counts, capacity)
    rooms = laid_out(plan)
    assert sorted(n for items in rooms.values() for _, n in items) == sorted(sizes)
    for items in rooms.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(rooms) == plan.sequences <= fewest(sizes, capacity) + (len(sizes) > 6)


def test_reduction_keeps_an_optimum():
    rng = random.Random(3)
    for _ in range(40):
        sizes = sorted((rng.randint(1, 12) for _ in range(rng.randint(1, 8))), reverse=True)
        plan = packing.Plan.__new__(packing.Plan)
        plan.capacity, plan.sequences, plan.runs = 12, 0, []
        plan.left, plan.used = np.bincount(sizes, minlength=13), np.zeros(13, np.int64)
        plan.reduce()
        rest = list(itertools.chain.from_iterable([s] * int(plan.left[s]) for s in range(12, 0, -1)))
        assert plan.sequences + fewest(rest, 12) == fewest(sizes, 12)


def test_large_counts_need_few_runs():
    rng = random.Random(4)
    counts = {s: rng.randint(1, 10**7) for s in range(1, 2049)}
    plan = packing.Plan(counts, 2048)
    total = sum(s * n for s, n in counts.items())
    assert plan.sequences >= -(-total // 2048)
    assert plan.sequences <= 1.02 * max(total / 2048, sum(n for s, n in counts.items() if s > 1024))
    assert len(plan.runs) < 100_000


def test_documents(spark, table_of):
    rng = random.Random(8)
    words = "Straße naïve don't it's 12ab x,y <|endoftext|> ΟΔΟΣ éa   日本 'll ###".split(" ")
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", "\n", "  ", "\t", " "]) for _ in range(rng.choice([0, 3, 40, 900]))), 1) for i in range(40)]
    rows += [(100, None, 1), (101, "", 1), (102, "a " * 9000, 1), (103, rows[5][1], 1), (103, rows[5][1], 1), (None, "null id", 1)]
    got = packing.pack_documents(table_of(rows), PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for doc, text, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at:at + 2048], "<u4")
            want.append((doc if doc is not None else -1, k, at, len(part), zlib.crc32(part.tobytes())))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, *r[1:5]) for r in got) == sorted(want)
    rooms = defaultdict(list)
    for r in got:
        rooms[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in rooms.values():
        ends = list(itertools.accumulate(n for _, n in sorted(items)))
        assert [o for o, _ in sorted(items)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(rooms) <= -(-sum(r["length"] for r in got) // 2048) + 1
    assert packing.pack_documents(table_of([]), PATH).collect() == []
    ids = packing.cut_pieces(table_of(rows[:3]), PATH, 2048, with_ids=True).collect()
    assert all(len(r["ids"]) == r["length"] for r in ids)
