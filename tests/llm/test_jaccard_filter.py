"""What is ruled out before shingles are fetched: unlike sets of any size, and never a link."""

from __future__ import annotations

import numpy as np
from tidemark.llm import jaccard


def test_unlike_large_texts_are_not_verified(spark, table_of, monkeypatch):
    shared = " ".join(f"s{i}" for i in range(1200))
    rows = [(i, shared + " " + " ".join(f"t{i}x{k}" for k in range(1200)), 1) for i in range(6)]
    rows += [(10, rows[0][1] + " end", 1)]
    verified, sent = jaccard._verified, []
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, *rest: sent.append(pairs.count()) or verified(pairs, *rest))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(table_of(rows)).collect()}
    assert got == {i: i for i in range(6)} | {10: 0}
    assert sum(sent) == 1


def test_parities_never_rule_out_a_link():
    rng = np.random.default_rng(7)
    kept = far = 0
    for n in (1, 5, 33, 64, 65, 400, 1000, 70_000):
        for _ in range(20):
            base = rng.integers(0, 1 << 62, 2 * n + 2).astype(np.uint64)
            drop, add = int(rng.integers(0, n // 4 + 1)), int(rng.integers(0, n // 3 + 1))
            x, y = base[:n], np.concatenate([base[drop:n], base[n:n + add]])
            linked = 4 * (n - drop) >= 3 * (n + add)
            sizes, profiles = [len(x), len(y)], [jaccard.parities(x), jaccard.parities(y)]
            near = bool(jaccard.near_rows(*(np.array([v]) for v in sizes), *([v] for v in profiles))[0])
            order = np.argsort(sizes, kind="stable")
            listed = jaccard.near_across(np.arange(2), np.arange(2), np.array(sizes)[order], [profiles[i] for i in order])
            assert near == bool(listed) and (near or not linked)
            kept += linked
            far += not near
    assert kept and far
