"""Occurrences of test windows against a plain search, suffix arrays against sorting, and the defined cases."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import contamination
from tidemark.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, n_words int, items string, spans string"
TESTS = "item_id long, text string, longest int"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, tests, window=10):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest) of each document."""
    windows, whole = {}, []
    for item, text in tests:
        own = words(text)
        size = min(window, len(own))
        whole.append((own, size))
        for j in range(len(own) - size + 1 if size else 0):
            windows.setdefault(tuple(own[j:j + size]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        own = words(text)
        hit, items, longest = set(), set(), 0
        for w, names in windows.items():
            for p in range(len(own) - len(w) + 1):
                if tuple(own[p:p + len(w)]) == w:
                    hit |= set(range(p, p + len(w)))
                    items |= names
        if hit:
            for test, size in whole:
                for j in range(len(test)):
                    for p in range(len(own)):
                        n = 0
                        while j + n < len(test) and p + n < len(own) and test[j + n] == own[p + n]:
                            n += 1
                        longest = max(longest, n if n >= size else 0)
        out.append((doc_id, len(own), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit), longest))
    return sorted(out, key=str)


def run(spark, docs, tests, **options):
    d = spark.createDataFrame([(*r, 1, "i", "s") for r in docs], DOCS)
    t = spark.createDataFrame([(*r, 1) for r in tests], TESTS)
    return sorted((tuple(r) for r in contamination.judge_documents(d, t, **options).collect()), key=str)


def made(seed, n_docs=60, n_tests=12, letters="abcd"):
    rng = random.Random(seed)
    tests = [(i, " ".join(rng.choice(letters) for _ in range(rng.randrange(0, 25)))) for i in range(n_tests)]
    docs = []
    for i in range(n_docs):
        text = " ".join(rng.choice(letters + "x") for _ in range(rng.randrange(0, 40)))
        if i % 3 == 0:
            text += rng.choice([" ", ", ", "\n-- "]) + rng.choice(tests)[1].upper().replace(" ", rng.choice([" ", "; "])) + " " + text
        docs.append((i, text))
    return docs, tests


@pytest.mark.parametrize("seed", range(3))
def test_against_plain(spark, seed):
    docs, tests = made(seed)
    assert run(spark, docs, tests) == plain(docs, tests)


def test_small_windows_and_several_blocks(spark):
    docs, tests = made(9, letters="abcdefgh")
    want = plain(docs, tests, 3)
    assert run(spark, docs, tests, window=3) == want
    total = sum(len(t) for _, t in tests)
    assert run(spark, docs, tests, window=3, block_bytes=total // 3) == want


LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


@pytest.mark.parametrize(("docs", "tests"), [
    ([(1, None), (2, ""), (None, LONG), (None, LONG), (3, "...")], [(7, LONG), (7, LONG.upper()), (None, LONG), (8, None), (9, ""), (10, "!?")]),
    ([(1, "Short One"), (2, "short-one short one"), (3, "shorter one"), (4, "x" * 300_000 + " " + "word " * 60_000 + "short one")], [(1, "short one"), (2, "word " * 30), (3, "one")]),
    ([(1, "größe über " * 6), (2, "große uber " * 6), (3, LONG + " " + LONG), (4, LONG.replace(" ", " "))], [(1, "Größe über " * 5), (2, LONG)]),
    ([(1, "a b"), (2, "c")], [(1, None)]),
    ([(1, "a b")], []),
])
def test_defined_cases(spark, docs, tests):
    if any(len(t or "") > 1000 for _, t in docs):
        got = run(spark, docs, tests)
        assert [(r[0], r[2], r[3]) for r in got] == [(1, 2, 2), (2, 4, 2), (3, 1, 1), (4, 60_002, 3)]
    else:
        assert run(spark, docs, tests) == plain(docs, tests)


def test_no_documents(spark):
    assert run(spark, [], [(1, LONG)]) == []


def test_removal_keeps_clean_documents_and_their_columns(spark):
    docs = spark.createDataFrame([(1, "before " + LONG, 1, "i", "s"), (2, "alpha beta gamma", 2, "j", None), (None, None, None, None, None)], DOCS)
    kept = contamination.remove_contaminated(docs, spark.createDataFrame([(1, LONG, 1)], TESTS))
    assert kept.columns == docs.columns
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([(2, "alpha beta gamma", 2, "j", None), (None,) * 5], key=str)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        tokens = np.append(rng.integers(0, 4, n), 0)
        starts = np.flatnonzero(tokens)
        got = contamination.suffix_array(tokens, starts, n + 1)
        assert got.tolist() == sorted(starts.tolist(), key=lambda i: tokens[i:].tolist())


def test_words_with_one_hash_are_told_apart(monkeypatch):
    """Every word gets one of three hashes: what is found must be spelled as the test."""
    tests = contamination.tests_of(["t"], pa.array(["aa bb cc"]), 3)
    real = contamination.WordBatch.word_hashes
    monkeypatch.setattr(contamination.WordBatch, "word_hashes", property(lambda self: np.sort(tests.hashes)[np.array([int(self.data[a]) % 3 for a in self.words[0]], np.int64)]))
    lookup = {int(b) % 3: h for b, h in zip(b"abc", np.sort(tests.hashes), strict=True)}
    assert len(lookup) == 3 and real is not None
    spelled = contamination.tests_of(["t"], pa.array(["aa bb cc"]), 3)
    n_words, _, spans, items = contamination.judge_batch(pa.array(["aa bb cc", "dd ee ff", "x aa bb cc y", "aa bb cd"]), spelled)
    assert spans == [[(0, 3)], [], [(1, 4)], []] and items == [["t"], [], ["t"], []]
    assert n_words.tolist() == [3, 3, 5, 3]


def test_query(spark, folder):
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    tests = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op13_benchmark_decontamination"](spark, folder).collect()), key=str)
    windows = {}
    for item, text in tests:
        own = words(text)
        for j in range(max(1, len(own) - 9)):
            windows.setdefault(tuple(own[j:j + 10]), set()).add(str(item))
    want = []
    for doc_id, text in docs:
        own, hit, items = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for p in range(len(own) - size + 1):
                if (names := windows.get(tuple(own[p:p + size]))):
                    hit |= set(range(p, p + size))
                    items |= names
        want.append((doc_id, len(own), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want, key=str)
