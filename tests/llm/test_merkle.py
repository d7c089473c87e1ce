"""The manifest against a plain tree, the midstates of a parent, and the defined cases."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import merkle
from tidemark.llm.queries import QUERIES

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, position string, root string"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text) -> str:
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[1], row[2], row[3], text)))


def tree_of(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i:i + 16]) for i in range(0, len(below), 16)])
    return levels


def plain(rows):
    """Rows (doc_id, source, lang, n_chars, text) to sorted result rows."""
    by = defaultdict(list)
    for row in rows:
        own = leaf_of(row, row[4])
        text = row[4]
        if row[0] is not None and text is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        by[row[1]].append((row[0] is not None, row[0] or 0, own, leaf_of(row, text), row[0]))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        by[name].sort(key=lambda r: r[:3])
        trees[name] = tree_of([r[2] for r in by[name]])
    top = tree_of([trees[name][-1][0] for name in names])
    out = []
    for number, name in enumerate(names):
        for at, (_, _, own, changed, doc_id) in enumerate(by[name]):
            folded, siblings, place = changed, [], at
            for level in [*trees[name][:-1], None, *top[:-1]]:
                if level is None:
                    place = number
                    continue
                begin = place // 16 * 16
                run = level[begin:begin + 16]
                siblings += run[:place - begin] + run[place - begin + 1:]
                folded = digest(*run[:place - begin], folded, *run[place - begin + 1:])
                place //= 16
            out.append((doc_id, own, trees[name][-1][0], top[-1][0], digest(*siblings), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def run(spark, rows, levels=merkle.BLOCK_LEVELS):
    df = spark.createDataFrame([(*r, 1, "x", None) for r in rows], SCHEMA)
    got = merkle.verify_documents(df, levels=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def test_against_plain(spark):
    rng = random.Random(5)
    rows = [(i * 3 % 1009, f"s{rng.randrange(20)}" if i % 3 else "hot", rng.choice(["en", None]), i, rng.choice(["Some Text", "no capitals", "", None, "É A"]) ) for i in range(700)]
    assert run(spark, rows) == plain(rows)


def test_more_leaves_than_a_block(spark):
    """Blocks of one level: several stages climb and come down, over groups and over their tops."""
    rows = [(i, "hot" if i < 300 else f"s{i % 40}", "en", 1, "Text") for i in range(420)]
    assert run(spark, rows, 1) == plain(rows)


@pytest.mark.parametrize("rows", [
    [(7, None, None, None, None)],
    [(None, "a", "en", 1, "X"), (None, "a", "en", 1, "X"), (None, None, "en", None, "Y"), (5, "a", "en", 1, "X")],
    [(1, "a", "en", 1, "long " * 100_000), (1, "a", "en", 1, "B"), (1, "a", "en", 1, "B"), (2, "", "en", 0, "")],
    [(i, "one", "en", 1, "T") for i in range(17)],
])
def test_defined_cases(spark, rows):
    assert run(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_a_parent_resumes_its_states():
    children = [hashlib.sha256(bytes([i])).hexdigest().encode() for i in range(16)]
    parent = merkle.Run(children)
    for slot in range(16):
        for other in (children[slot], b"f" * 64):
            assert parent.fold(slot, other).decode() == hashlib.sha256(b"".join([*children[:slot], other, *children[slot + 1:]])).hexdigest()
    assert len(parent.states) == 16 and parent.fold(3, children[3]) == parent.digest
    path = [(3, parent), (0, merkle.Run([parent.digest]))]
    back = merkle.unpack_path(merkle.pack_path(path))
    assert [(s, r.children, r.digest) for s, r in back] == [(s, r.children, r.digest) for s, r in path]


def test_query_finds_every_change(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select(*merkle.FIELDS).collect()]
    order = [0, 1, 2, 3, 4]
    got = sorted((tuple(r) for r in QUERIES["op11_merkle_manifest"](spark, folder).collect()), key=str)
    assert got == plain([tuple(r[i] for i in order) for r in rows])
