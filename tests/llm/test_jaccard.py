"""The Jaccard join against all pairs, its index, and its defined cases."""

from __future__ import annotations

import random
import re
from functools import partial

import numpy as np
import pyarrow as pa
import pytest
from tidemark.llm import jaccard
from tidemark.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(len(words) - 4, 1)))


def plain(rows):
    """doc_id -> (size, smallest id reachable), by all pairs."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if x and y and 100 * both >= 75 * (len(x) + len(y) - both):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {(d, len(s), find(d)) for d, s in sets}


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    common = " ".join(rng.choice(words) for _ in range(55))
    texts = []
    for _ in range(n):
        kind = rng.random()
        if kind < 0.35 or not texts:
            body = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 6, 7, 8, 9, 12, 30, 80, 200]))]
            texts.append(" ".join(body) + (f" {common}" if rng.random() < 0.4 else ""))
        else:
            own = rng.choice(texts).split(" ")
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                own[rng.randrange(len(own))] = rng.choice(words).upper()
            if rng.random() < 0.3:
                own = own[:max(1, int(len(own) * rng.choice([0.75, 0.8, 0.9])))]
            texts.append(("\n" if rng.random() < 0.2 else " ").join(own))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, table_of, seed):
    texts = corpus(seed)
    rows = [(i * 3 + 1, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, texts[0]), (905, texts[0])]
    got = jaccard.jaccard_components(table_of([(d, t, 1) for d, t in rows]))
    assert {tuple(r) for r in got.collect()} == plain(rows)
    assert got.count() == len(rows)


def test_every_link_meets_in_the_index():
    """Any two sets at the threshold share an entry, with and without common shingles."""
    rng = np.random.default_rng(3)
    for common in (0, 1):
        for _ in range(1500):
            n = int(rng.choice([3, 4, 5, 7, 8, 15, 16, 17, 40, 100]))
            base = rng.integers(0, 1 << 62, n * 2).astype(np.uint64)
            x = base[:n]
            drop = int(rng.integers(0, max(1, n // 4) + 1))
            add = int(rng.integers(0, max(1, n // 3) + 1))
            y = np.concatenate([x[drop:], base[n:n + add]])
            both = n - drop
            if 4 * both < 3 * (n + len(y) - both) or np.array_equal(np.sort(x), np.sort(y)):
                continue
            keys = np.concatenate([np.sort(x), np.sort(y)])
            names = np.sort(x[: n // 2]) if common else x[:0]
            entries, of = jaccard.index_entries(keys, np.array([0, n, n + len(y)]), (names, np.full(len(names), 9, np.uint64)))
            assert set(entries[of == 0]) & set(entries[of == 1]), (n, len(y), both)


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    entries, of = rng.integers(0, 1 << 63, 500).astype(np.uint64), rng.integers(0, 20, 500)
    names = rng.integers(-(1 << 60), 1 << 60, 20)
    parts, payloads = jaccard.pack_entries(entries, of, names, 7)
    back = [(int(p), int(s), int(n)) for p, x in zip(parts, payloads, strict=True) for s, n in zip(*jaccard.unpack_entries(x), strict=True)]
    want = [(int((e >> np.uint64(44)) % np.uint64(7)), int(e & np.uint64((1 << 48) - 1)), int(names[o])) for e, o in zip(entries, of, strict=True)]
    assert sorted(back) == sorted(want)


def test_a_large_group_of_near_copies(spark, table_of):
    rng = random.Random(9)
    words = [f"v{i}" for i in range(120)]
    rows = []
    for i in range(300):
        own = list(words)
        own[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own)))
    got = jaccard.jaccard_components(table_of([(d, t, 1) for d, t in rows])).collect()
    assert {tuple(r) for r in got} == plain(rows)


A, B = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))


@pytest.mark.parametrize("rows", [
    [(1, A), (1, B), (2, A + " x"), (3, B + " y")],
    [(5, A), (5, B), (2, A + " x"), (3, B + " y")],
    [(2, A), (2, B), (1, A + " x"), (3, B + " y"), (3, A)],
    [(4, A), (4, B), (4, "short"), (4, ""), (2, B), (7, "Short"), (9, A + " z")],
])
def test_an_id_with_several_texts_joins_their_components(spark, table_of, rows):
    got = jaccard.jaccard_components(table_of([(d, t, 1) for d, t in rows])).collect()
    want = {d: c for d, _, c in plain(rows)}
    assert len({c for d, c in want.items() if d != 0}) == 1
    assert all(r["component_id"] == (want[r["doc_id"]] if r["n_shingles"] else r["doc_id"]) for r in got) and len(got) == len(rows)


def test_keep_one_keeps_an_unlinked_text_of_a_linked_id(spark, table_of):
    rows = [(1, A, 1), (2, A + " x", 2), (2, B, 3), (3, "a b c d e", 4), (3, "A b c d e", 5), (4, B + " y", 6), (4, B + " y", 7)]
    kept = sorted(tuple(r) for r in jaccard.keep_one(table_of(rows)).collect())
    assert [r[:2] for r in kept[:2]] == [(1, A), (2, B)] and len(kept) == 3 and kept[2][0] == 3


def test_clashing_names_come_back(spark):
    names = ["doc_id", "text", "th", "node", "row", "_text", "n", "label"]
    rows = [(1, A, 1, 2, 3, "four", 5, 6), (2, A, 1, 2, 3, "five", 5, 6), (1, A, 9, 9, 9, "nine", 9, 9)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, th int, node int, row int, _text string, n int, label int"))
    assert kept.columns == names and [tuple(r) for r in kept.collect()] in ([rows[0]], [rows[2]])


def test_small_blocks_give_the_same(spark, table_of, monkeypatch):
    monkeypatch.setattr(jaccard, "_blocked", partial(jaccard._blocked, block_bytes=600))
    monkeypatch.setattr(jaccard, "_across", partial(jaccard._across, block=4))
    rows = list(enumerate(corpus(5, 160)))
    got = jaccard.jaccard_components(table_of([(d, t, 1) for d, t in rows]))
    assert {tuple(r) for r in got.collect()} == plain(rows)


def test_keep_one_and_empty(spark, table_of):
    rows = [(5, "a b c d e f", 1), (3, "A b c d e f", 1), (3, "A b c d e f", 1), (None, "a b c d e f", 1), (7, "", 1), (8, None, 1), (9, "z y x", 1)]
    kept = jaccard.keep_one(table_of(rows)).collect()
    assert sorted((r[0] is None, r[0]) for r in kept) == [(False, 3), (False, 7), (False, 8), (False, 9), (True, None)]
    assert jaccard.jaccard_components(table_of([])).collect() == []
    null = jaccard.jaccard_components(table_of(rows)).where("doc_id is null").collect()
    assert null[0]["component_id"] is None and null[0]["n_shingles"] == 2


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (50, 60), (60, 50)]
    got = {tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {(i, 0) for i in range(41)} | {(x, 90) for x in (90, 95, 100)} | {(50, 50), (60, 50)}


def test_short_texts():
    keys, bounds, sets = jaccard.shingle_sets(pa.array(["A b", "a  b", None, "a b c d e", ""]))
    assert list(np.diff(bounds)) == [1, 1, 0, 1, 0]
    assert tuple(sets[0]) == tuple(sets[1]) != tuple(sets[3])
