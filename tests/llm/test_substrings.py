"""Substring deduplication: planted passages, near-equal lines, and the defined cases."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from tidemark.llm import substrings


def prose(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(100000)}" for _ in range(n)]


def windows(text, k):
    words = text.split()
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages(spark, table_of, seed):
    rng = random.Random(seed)
    passages = [prose(rng, rng.randrange(60, 90)) for _ in range(4)]
    rows, holding = [], {}
    for i in range(60):
        words = prose(rng, rng.randrange(20, 300))
        for at in range(40, len(words), 70):
            if rng.random() < 0.3:
                words[at] += "\n"
        if rng.random() < 0.5:
            k = rng.randrange(4)
            at = rng.randrange(len(words) + 1)
            words[at:at] = passages[k]
            holding[i] = k
        rows.append((i, " ".join(words).replace("\n ", "\n")))
    got = {r["doc_id"]: r for r in substrings.dedup_substrings(table_of([(d, t, 1) for d, t in rows])).collect()}
    first = {}
    for i, k in sorted(holding.items()):
        first.setdefault(k, i)
    for i, text in rows:
        if i not in holding or first[holding[i]] == i:
            assert got[i]["text"] == text and got[i]["n_removed"] == 0
        else:
            passage = " ".join(passages[holding[i]])
            assert passage not in " ".join(got[i]["text"].split())
            assert not windows(passage, 40) & windows(got[i]["text"], 40)
            assert first[holding[i]] in got[i]["kept_in"]
            own = [w for w in text.split() if w not in set(passages[holding[i]])]
            assert [w for w in got[i]["text"].split() if w not in set(passages[holding[i]])] == own


def jaccard(a, b):
    x, y = windows(a, 5), windows(b, 5)
    return len(x & y) / max(1, len(x | y))


def test_near_equal_lines(spark, table_of):
    rng = random.Random(3)
    lines = [prose(rng, 60) for _ in range(10)]
    rows, kept = [], {}
    for i in range(80):
        k = rng.randrange(10)
        words = list(lines[k])
        for _ in range(rng.randrange(0, 2)):
            words[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(prose(rng, 30)) + "\n" + " ".join(words)))
        kept.setdefault(k, i)
    got = {r["doc_id"]: r["text"] for r in substrings.dedup_substrings(table_of([(d, t, 1) for d, t in rows])).collect()}
    stay = {i for i, t in rows if len(got[i].split("\n")) == 2}
    texts = dict(rows)
    for i in stay:
        for j in stay:
            assert i == j or jaccard(texts[i].split("\n")[1], texts[j].split("\n")[1]) < 0.75
    assert {got[i].split("\n")[0] for i in got} == {texts[i].split("\n")[0] for i in got}


def test_bands_catch_the_threshold():
    rng = np.random.default_rng(1)
    missed = 0
    for _ in range(1000):
        base = rng.integers(0, 1 << 62, 70).astype(np.uint64)
        x, y = base[:60], np.concatenate([base[:52], base[60:68]])
        keys, of = np.concatenate([np.sort(x), np.sort(y)]), np.repeat([0, 1], 60)
        bands = substrings.band_hashes(keys, of)
        missed += not (bands[0] == bands[1]).any()
    assert missed <= 6


def test_bucket_links_join_what_all_pairs_join(monkeypatch):
    rng = np.random.default_rng(4)
    for cells in (1 << 22, 200):
        monkeypatch.setattr(substrings, "CELLS_AT_A_TIME", cells)
        base = rng.integers(0, 1 << 62, 40).astype(np.uint64)
        sets = [np.sort(np.concatenate([base[rng.random(40) < 0.9], rng.integers(0, 1 << 62, rng.integers(0, 6)).astype(np.uint64)])) for _ in range(60)]
        for i, both in substrings.common_counts(sets):
            assert all(k == i or both[k] == len(np.intersect1d(sets[i], s)) for k, s in enumerate(sets))
        links = substrings.bucket_links(np.arange(60), np.arange(60), sets)
        assert all(substrings.similar(sets[a].tobytes(), sets[b].tobytes()) for a, b in links)

        def joined(pairs):
            label = list(range(60))
            for a, b in pairs:
                old, new = label[b], label[a]
                label = [new if x == old else x for x in label]
            return [label.index(x) for x in label]

        every = [(a, b) for a in range(60) for b in range(a) if substrings.similar(sets[a].tobytes(), sets[b].tobytes())]
        assert joined(links) == joined(every) and len(links) < 60


def test_pieces_depend_on_near_words_only():
    rng = random.Random(5)
    passage = prose(rng, 80)
    cuts = []
    for _ in range(5):
        before = prose(rng, rng.randrange(1, 50))
        units = substrings.Units(pa.array([" ".join(before + passage + prose(rng, 30))]))
        inside = units.pieces[0] - len(before)
        cuts.append([int(c) for c in inside if 6 <= c < 74])
    assert all(c == cuts[0] for c in cuts) and len(cuts[0]) > 3


def test_defined_cases(spark, table_of):
    rng = random.Random(6)
    long = " ".join(prose(rng, 60))
    rows = [(4, long, 1), (2, long, 1), (2, long, 1), (None, long, 1), (5, None, 1), (6, "", 1), (7, " \n ", 1), (8, "short text\nshort text", 1), (9, "x " * 3000, 1), (10, f"own line\n{long}\nlast", 1)]
    got = substrings.dedup_substrings(table_of(rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r["text"])
    assert len(got) == len(rows)
    assert by[2] == [long, long] and by[4] == [""] and by[None] == [""] and by[5] == [None] and by[6] == [""] and by[7] == [" \n "]
    assert by[8] == ["short text\nshort text"] and by[10] == ["own line\nlast"]
    assert substrings.dedup_substrings(table_of([])).collect() == []


def test_rows_of_one_id_are_told_apart(spark, table_of):
    rng = random.Random(7)
    passage, own, other = (" ".join(prose(rng, n)) for n in (60, 30, 40))
    rows = [(1, passage, 1), (None, f"{own}\n{passage}\n{other}", 1), (None, "a short one", 1), (3, f"{other} end\n{passage}", 1), (3, "another\ntext", 1)]
    got = {(r["doc_id"], r["n_words"]): (r["text"], r["n_removed"]) for r in substrings.dedup_substrings(table_of(rows).repartition(1)).collect()}
    assert got == {(1, 60): (passage, 0), (None, 130): (own, 100), (None, 3): ("a short one", 0), (3, 101): (f"{other} end", 60), (3, 2): ("another\ntext", 0)}


def test_only_what_stood_in_one_place_goes(spark, table_of):
    rng = random.Random(8)
    lines = [" ".join(prose(rng, 6)) for _ in range(12)]
    block = "\n".join(lines)
    rows = [(i, f"{line}\n" + " ".join(prose(rng, 8)), 1) for i, line in enumerate(lines)]
    rows += [(50, block, 1), (51, f"own\n{block}\nend", 1), (52, "x " * 45, 1), (53, "\n".join(lines[::-1]), 1)]
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in substrings.dedup_substrings(table_of(rows)).collect()}
    want = {d: (text, 0) for d, text, _ in rows}
    assert got == want | {51: ("own\nend", 72), 52: ("x " * 20, 25)}


def test_wrapping_does_not_hide_a_passage(spark, table_of):
    rng = random.Random(9)
    rows = []
    for i in range(20):
        passage = prose(rng, 60)
        wrapped = "\n".join(" ".join(passage[k:k + 6]) for k in range(0, 60, 6))
        rows += [(i, " ".join(prose(rng, 9) + passage + prose(rng, 9)), 1), (100 + i, f"own {i}\n{wrapped}\nend {i}", 1)]
    got = {r["doc_id"]: r for r in substrings.dedup_substrings(table_of(rows)).collect()}
    plain, fed = (substrings.Units(pa.array([text])).pieces[0].tolist() for text in (rows[1][1].replace("\n", " "), rows[1][1]))
    assert plain == fed
    assert all(got[d]["text"] == text for d, text, _ in rows if d < 100)
    for d, text, _ in rows[1::2]:
        assert got[d]["kept_in"] == [d - 100] and got[d]["n_removed"] >= 40
        assert not windows(text, 20) & windows(got[d]["text"], 20)
