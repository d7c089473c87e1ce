"""Winnowing against a plain version, and its defined cases."""

from __future__ import annotations

import hashlib
import random
import re

import xxhash
from tidemark.llm import winnow

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def plain(text, k=winnow.K, w=winnow.WINDOW):
    words = WORD.findall(text or "")
    if not words:
        return []
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in words]
    grams = []
    for i in range(max(len(words) - k, 0) + 1):
        h = 42
        for x in hashes[i:i + k]:
            h = xxhash.xxh64_intdigest(x.to_bytes(8, "little"), seed=h)
        grams.append(signed(h))
    chosen = []
    for start in range(max(len(grams) - w, 0) + 1):
        window = grams[start:start + w]
        low = min(window)
        at = start + max(i for i, h in enumerate(window) if h == low)
        if not chosen or chosen[-1][1] != at:
            chosen.append((low, at))
    return chosen


def alike(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def test_against_plain(spark, table_of):
    rng = random.Random(5)
    rows = [(i * 7, " ".join(rng.choice("ab c d é 日本 xyz".split()) for _ in range(rng.randrange(0, 60))) + rng.choice(["", "\n", " \t"]), i) for i in range(60)]
    rows += [(1, None, 1), (2, "", 2), (3, "   ", 3), (4, "one", 4), (5, "x " * 5000, 5), (7, rows[1][1], 0), (7, "other text here", 0)]
    got = winnow.compare_with_next(table_of(rows)).collect()
    texts = sorted(((i, t or "") for i, t, _ in rows), key=lambda r: (-r[0], -signed(xxhash.xxh64_intdigest(r[1].encode(), seed=42))))
    want = []
    for n, (doc, text) in enumerate(texts):
        following = texts[(n + 1) % len(texts)][1]
        edited = text[:len(text) - len(text) // 2] + following[:len(text) // 2]
        prints = plain(text), plain(edited)
        want.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), *prints, round(alike(*prints), 9), round(alike(prints[0], plain(following)), 9)))
    found = [(*r[:3], [tuple(g) for g in r[3]], [tuple(g) for g in r[4]], round(r[5], 9), round(r[6], 9)) for r in got]
    assert sorted(found) == sorted(want)


def test_match_guarantee(spark):
    rng = random.Random(6)
    shared = [f"w{rng.randrange(999)}" for _ in range(winnow.K + winnow.WINDOW - 1)]
    for _ in range(20):
        a, b = ([f"{c}{rng.randrange(999)}" for _ in range(rng.randrange(50))] for c in "pq")
        left, right = plain(" ".join(a + shared + b)), plain(" ".join(b + shared + a))
        assert {h for h, _ in left} & {h for h, _ in right}


def test_empty_single_and_null(spark, table_of):
    assert winnow.compare_with_next(table_of([])).collect() == []
    one = winnow.compare_with_next(table_of([(9, "a b c", 1)])).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    nulls = winnow.compare_with_next(table_of([(None, None, 1), (None, "a", 1), (3, "b c", 1)])).collect()
    assert sorted(r["n_chars"] for r in nulls) == [0, 1, 3]


def test_other_widths(spark, table_of):
    text = " ".join(str(i * i % 17) for i in range(80))
    df = table_of([(1, text, 0)])
    for k, w in ((1, 1), (3, 4), (5, 7), (2, 13)):
        row = df.select(winnow.fingerprint(df["text"], k, w).alias("f")).first()
        assert [tuple(g) for g in row["f"]] == plain(text, k, w)
