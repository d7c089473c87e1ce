"""Repairs against every possible edit, long conversations over several levels, and the defined cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import functions as F

from tidemark.llm import repair
from tidemark.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, cost int, key string, audit string"
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
WANTED = re.compile(r"(s?(ua)+)?")


def seal(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def every_repair(rows):
    """The least (cost, audit, repaired rows) over all edits with at most two rows added in a place; rows are (role, text, fault)."""
    best = None
    ways = []
    for role, text, fault in rows:
        own = [("D", 2, None)]
        if fault < 2:
            extra = 5 if fault == 1 else 0
            own += [("K", extra, role), ("R", 1 + extra, "user"), ("R", 1 + extra, "assistant")]
        ways.append([(letter, cost, None if to is None else (to, text)) for letter, cost, to in own])
    gap = [()] + [(a,) for a in ("user", "assistant")] + [("user", "assistant"), ("assistant", "user")]

    def go(i, cost, audit, out):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        shape = "".join(r[:1] or "?" for r, _ in out)
        if not re.fullmatch(r"s?(ua)*u?", shape):
            return
        for added in gap:
            grown = out + [(r, "") for r in added]
            if i == len(rows):
                if WANTED.fullmatch("".join(r[:1] or "?" for r, _ in grown)):
                    found = (cost + 5 * len(added), audit + "I" * len(added), grown)
                    best = found if best is None or found[:2] < best[:2] else best
                continue
            for letter, price, row in ways[i]:
                go(i + 1, cost + 5 * len(added) + price, audit + "I" * len(added) + letter, grown + ([row] if row else []))

    go(0, 0, "", [])
    return best


def faults_of(rows):
    """Rows (turn, role, text) in order, with their first fault."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, seal(r[1], r[2])))
    seen, out = set(), []
    for turn, role, text in rows:
        blank = not re.search(r"[^\x20\x09-\x0D]", text)
        fault = 2 if blank else 3 if (role, text) in seen else 0 if text.rstrip(" \t\n\v\f\r")[-1] in ".!?" else 1
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def plain(conv_id, rows):
    rows = faults_of(rows)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = every_repair([r[1:] for r in rows])
    found = [r[3] for r in rows]
    return (conv_id, gaps, found.count(2), found.count(3), found.count(1), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def run(spark, rows, conversations=None, size=repair.BLOCK):
    df = spark.createDataFrame([(c, t, r, x, 1, "k", "a") for c, t, r, x in rows], SCHEMA)
    ids = spark.createDataFrame([(c,) for c in conversations if True], "conv_id long") if conversations is not None else df
    got = repair.audit_conversations(df, ids, size)
    assert got.columns == NAMES
    return sorted((tuple(r) for r in got.collect()), key=str)


def by_conversation(rows):
    out = {}
    for conv_id, *rest in rows:
        out.setdefault(conv_id, []).append(tuple(rest))
    return out


def test_against_every_edit(spark):
    rng = random.Random(3)
    texts = ["Fine.", "Fine. ", "cut", "", " \t", "Ok!", "What?\n", None, "é", "."]
    roles = ["system", "user", "assistant", "tool", None, "", "User", "u"]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts[:6] if rng.random() < 0.7 else texts)) for c in range(130) for _ in range(rng.randrange(1, 6))]
    assert run(spark, rows) == sorted((plain(c, r) for c, r in by_conversation(rows).items()), key=str)


def test_every_short_run_of_roles(spark):
    rows, conv = [], 0
    for n in (1, 2, 3):
        for kinds in product([(r, x) for r in ("system", "user", "assistant", "tool") for x in ("%d.", "%d")], repeat=n):
            rows += [(conv, i, role, text % i) for i, (role, text) in enumerate(kinds)]
            conv += 1
    assert run(spark, rows) == sorted((plain(c, r) for c, r in by_conversation(rows).items()), key=str)


def test_blocks_of_blocks_give_the_same(spark):
    """A long conversation cut into blocks of two rows, over several levels, against one block."""
    rng = random.Random(8)
    rows = [(c, i, rng.choice(["system", "user", "assistant", "assistant", "tool"]), rng.choice([f"{i}.", f"{i}", "again."])) for c, n in ((1, 61), (2, 17), (3, 2), (4, 1)) for i in range(n)]
    whole = run(spark, rows)
    assert run(spark, rows, size=2) == whole and run(spark, rows, size=7) == whole
    short = {c: r for c, r in by_conversation(rows).items() if c > 2}
    assert [r for r in whole if r[0] > 2] == sorted((plain(c, r) for c, r in short.items()), key=str)


@pytest.mark.parametrize("rows", [
    [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (3, None, "user", "Hi."), (3, None, "user", "Hi.")],
    [(1, 0, "user", "word " * 200_000 + "."), (1, 1, "assistant", "x" * 1_000_000)],
    [(1, 0, None, None), (1, 0, None, None), (2, 9, "assistant", "Only.")],
])
def test_defined_cases(spark, rows):
    assert run(spark, rows) == sorted((plain(c, r) for c, r in by_conversation(rows).items()), key=str)


def test_empty_tables_and_conversations_without_rows(spark):
    assert run(spark, []) == []
    nothing = hashlib.sha256(b"").hexdigest()
    assert run(spark, [], [5, None]) == sorted([(5, 0, 0, 0, 0, 0, 0, "", nothing), (None, 0, 0, 0, 0, 0, 0, "", nothing)], key=str)


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Why?"), (1, 3, "assistant", "So."), (2, 0, "user", "")]
    got = repair.repair_conversations(spark.createDataFrame([(c, t, r, x, 1, "k", "a") for c, t, r, x in rows], SCHEMA)).orderBy("conv_id", "place").collect()
    cost, audit, out = every_repair([(r, x, 0) for _, _, r, x in rows[:4]])
    assert [(r["role"], r["text"]) for r in got] == out and [r["place"] for r in got] == list(range(len(out)))


def test_query(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    damaged = []
    for conv, turn, role, text in rows:
        act = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        if act:
            changed = (conv, turn, "user" if act == 4 else role, "" if act == 1 else re.sub("[.!?]", "", text) if act == 2 else text)
            damaged += [changed] * (2 if act == 3 else 1)
    short = {c: r for c, r in by_conversation(damaged).items() if len(r) <= 5}
    got = {r["conv_id"]: tuple(r) for r in QUERIES["op12_conversation_repair"](spark, folder).collect()}
    assert set(got) == {r[0] for r in rows} and short
    assert [got[c] for c in short] == [plain(c, r) for c, r in short.items()]
    assert spark.read.parquet(f"{folder}/conversations.parquet").select(F.count_distinct("conv_id")).first()[0] == len(got)
