"""Base figures against a plain version, the cascade's order, and the defined cases."""

from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
from tidemark.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    seen, copies = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            copies += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), copies, len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def texts():
    rng = random.Random(1)
    made = [None, "", " ", "\n\n", "a", "a b c a b c", "x " * 5000, "é日本 \x0b\x0c| ## <>", "\u00a0 \u2003 a"]
    for _ in range(80):
        words = [rng.choice("aa bb cc dd ee ff gg |x| é".split(" ")) + str(rng.randrange(rng.choice([2, 200]))) for _ in range(rng.randrange(0, 200))]
        made.append("".join(w + rng.choice([" ", "\n", "\t", "  "]) for w in words))
    return made


def test_figures_against_plain(spark, table_of):
    made = texts()
    got = rules.judge(table_of([(i, t, 1) for i, t in enumerate(made)])).collect()
    assert len(got) == len(made)
    for row in got:
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"], row["base_failed"]) == plain(made[row["doc_id"]])
        assert not (row["base_failed"] and row["kept"])


def test_order_never_changes_the_verdict():
    made = pa.array(texts())
    forward, _ = rules.run_cascade(made, list(rules.RULES))
    backward, by = rules.run_cascade(made, list(rules.RULES)[::-1])
    assert (forward == backward).all() and ((by == -1) == backward).all()


def test_rules_run_by_rejection_per_cost(spark, table_of):
    measured = [("few_words", 1.0, 0.1), ("repetitive", 0.5, 0.4), ("shouting", 0.1, 0.0)]
    chosen = tuple(r for r in rules.RULES if r.name in {m[0] for m in measured})
    assert [r.name for r in rules.order_rules(chosen, measured)] == ["repetitive", "few_words", "shouting"]
    found = rules.measure(table_of([(i, t, 1) for i, t in enumerate(texts())]), rules.RULES)
    assert [f[0] for f in found] == [r.name for r in rules.RULES] and all(f[1] > 0 and 0 <= f[2] <= 1 for f in found)


def test_empty_and_columns(spark, table_of):
    assert rules.judge(table_of([])).collect() == [] and rules.apply_rules(table_of([])).collect() == []
    long = " ".join(f"word{i}" for i in range(80))
    kept = rules.apply_rules(table_of([(1, long, 7), (1, long, 7), (None, long, None), (2, "short", 7), (3, None, 7)])).collect()
    assert sorted((r["doc_id"] or 0, r["fingerprint"] or 0) for r in kept) == [(0, 0), (1, 7), (1, 7)]
