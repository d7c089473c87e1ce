"""Line deduplication against all pairs, the edit distance, and the defined cases."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from tidemark.llm import lines, linking


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def edited(rng, text, n):
    own = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(own) + 1), rng.random()
        if kind < 0.4 and own:
            own[at - 1] = rng.choice("abcxyzé日 ")
        elif kind < 0.7:
            own.insert(at, rng.choice("abcxyzé日 "))
        elif own:
            own.pop(at - 1)
    return "".join(own)


def test_edit_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 14)))
        b = edited(rng, a, rng.randrange(0, 5))
        for threshold in (1, 2, 3):
            assert lines.within(a, b, threshold) == (distance(a, b) <= threshold), (a, b, threshold)


def test_near_lines_share_a_probe_and_a_sketch():
    rng = random.Random(2)
    for _ in range(400):
        a = "".join(rng.choice("abcdefghij é日") for _ in range(rng.randrange(20, 60)))
        b = edited(rng, a, 2).replace("\n", " ")
        if len(b) < 20:
            continue
        held = []
        for text in (a, b):
            code = lines.CodeLines(pa.array([text]))
            found = set()
            for i, which, begin, size in lines.probes(code.ends - code.starts, 2, 20):
                found |= {(i, int(h)) for h in code.hashes(begin + code.starts[which], begin + size + code.starts[which])}
            held.append((found, code.sketches(np.array([0]))))
        assert held[0][0] & held[1][0]
        assert lines.near_sketches(held[0][1], held[1][1]).all()


def plain(rows, threshold=2, shortest=20):
    places = []
    for doc, text in rows:
        for n, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\n\v\f\r"):
                places.append(((doc is None, doc or 0, n), doc, n, line))
    texts = sorted({p[3] for p in places})
    root = {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if min(len(a), len(b)) >= shortest and abs(len(a) - len(b)) <= threshold and distance(a, b) <= threshold:
                root[find(a)] = find(b)
    first = {}
    for place in sorted(places, key=lambda p: p[0]):
        first.setdefault(find(place[3]), place[0])
    gone = {p[0] for p in places if first[find(p[3])] != p[0]}
    out = []
    for doc, text in rows:
        if text is None:
            out.append((doc, 0, None))
            continue
        kept = [(n, line) for n, line in enumerate(text.split("\n")) if (doc is None, doc or 0, n) not in gone]
        out.append((doc, len(text.split("\n")) - len(kept), "\n".join(line for _, line in kept)))
    return out


def test_against_all_pairs(spark, table_of):
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdefgh é") for _ in range(rng.choice([0, 3, 12, 19, 20, 21, 25, 40, 70]))) for _ in range(60)]
    rows = [(i, "\n".join(edited(rng, rng.choice(pool), rng.choice([0, 0, 1, 2, 4])).replace("\n", " ") for _ in range(rng.randrange(0, 9)))) for i in range(60)]
    rows += [(70, None), (71, ""), (72, "\n\n \n"), (None, pool[0] + "\nonly here")]
    got = lines.dedup_lines(table_of([(d, t, 1) for d, t in rows])).collect()
    assert sorted(((r["doc_id"], r["n_removed"], r["text"]) for r in got), key=str) == sorted(plain(rows), key=str)


def test_a_large_group_of_near_lines(spark, table_of):
    rng = random.Random(7)
    line = "the quick brown fox jumps over the lazy dog, every day of the week"
    rows = [(i, edited(rng, line, 1) + "\n" + "".join(rng.choice("mnopqr") for _ in range(30))) for i in range(120)]
    got = lines.dedup_lines(table_of([(d, t, 1) for d, t in rows])).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["text"]) for r in got) == sorted(plain(rows))
    assert sum(r["n_removed"] for r in got) == 119


def test_repeated_rows_and_empty(spark, table_of):
    text = "one line of some length here\nanother line of some length"
    got = lines.dedup_lines(table_of([(1, text, 1), (1, text, 1), (2, text, 1)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, text), (1, text), (2, "")]
    assert lines.dedup_lines(table_of([])).collect() == []


def test_filter_never_loses(spark):
    keys = spark.createDataFrame([(x,) for x in (-5, 0, 3, 1 << 40, -(1 << 62))], "k long")
    held = linking.filter_of(keys).value
    assert linking.may_hold(held, np.array([-5, 0, 3, 1 << 40, -(1 << 62)])).all()
    assert not linking.may_hold(held, np.array([1, 2, 77])).any()
