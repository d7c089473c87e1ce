"""Quality rules run as a short-circuit cascade.

Each rule looks at a batch of texts and says which to reject. The cost of a rule
(seconds a text) and its selectivity (share of texts rejected) are estimated on
a sample inside a Spark task; the cascade then runs the rules by rejection per
cost, highest first, and each rule sees only texts that all before it kept. The
order changes the work, never the verdict: a text is kept when no rule rejects it.

Defined cases: a null text has no words; an empty text or table, ties and
repeated rows are handled row by row; other columns pass through untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textbatch import TextBatch, repeated, slices

SYMBOLS = b"#*$%&|<>"
#: Texts of the sample that costs and selectivities are estimated on.
SAMPLE_TEXTS = 2000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


@dataclass(frozen=True)
class Rule:
    """A named test; ``rejects`` maps a batch to one boolean a text."""

    name: str
    rejects: Callable[[TextBatch], np.ndarray]


def word_chars(batch: TextBatch) -> np.ndarray:
    return batch.per_text(batch.characters & ~batch.blank)


def symbols(batch: TextBatch) -> np.ndarray:
    return batch.per_text(_SYMBOL[batch.data])


def duplicate_lines(batch: TextBatch) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    starts, ends, of = batch.lines
    full = batch.count_words(starts, ends) > 0
    starts, ends, of = starts[full], ends[full], of[full]
    keys = batch.hashes(starts, ends)
    order = np.lexsort((keys, of))
    same = (keys[order][1:] == keys[order][:-1]) & (of[order][1:] == of[order][:-1])
    return np.bincount(of[order][1:][same], minlength=batch.n).astype(np.int64)


def filled_lines(batch: TextBatch) -> np.ndarray:
    starts, ends, of = batch.lines
    return np.bincount(of[batch.count_words(starts, ends) > 0], minlength=batch.n)


def repeat_words(batch: TextBatch, window: int = 3) -> np.ndarray:
    """Words inside windows that occur at least twice in their text, each word once."""
    keys, of, at = batch.grams(window)
    covered = np.zeros(len(batch.words[0]), bool)
    hit = at[repeated(keys, of)]
    for i in range(window):
        covered[hit + i] = True
    return np.bincount(batch.words[2][covered], minlength=batch.n).astype(np.int64)


def few_words(batch: TextBatch) -> np.ndarray:
    return batch.n_words < 50


def repetitive(batch: TextBatch) -> np.ndarray:
    return 100 * repeat_words(batch) > 50 * batch.n_words


def symbol_heavy(batch: TextBatch) -> np.ndarray:
    return 10 * symbols(batch) > batch.n_words


def shouting(batch: TextBatch) -> np.ndarray:
    """More than half of the ASCII letters are capitals."""
    upper = (batch.data >= 0x41) & (batch.data <= 0x5A)
    lower = (batch.data >= 0x61) & (batch.data <= 0x7A)
    return batch.per_text(upper) > batch.per_text(lower)


def line_copies(batch: TextBatch) -> np.ndarray:
    return 100 * duplicate_lines(batch) > 50 * filled_lines(batch)


def long_words(batch: TextBatch) -> np.ndarray:
    """Words of more than 20 characters on average."""
    return word_chars(batch) > 20 * batch.n_words


BASE_RULES = (Rule("few_words", few_words), Rule("repetitive", repetitive))
EXTRA_RULES = (Rule("symbol_heavy", symbol_heavy), Rule("shouting", shouting), Rule("line_copies", line_copies), Rule("long_words", long_words))
RULES = BASE_RULES + EXTRA_RULES


def measure(docs: DataFrame, rules: tuple[Rule, ...], text: str = "text", sample_texts: int = SAMPLE_TEXTS) -> list[tuple[str, float, float]]:
    """Seconds a text and share rejected of every rule on a sample, as ``(rule, cost, selectivity)``."""
    total = docs.count()
    if not total:
        return [(rule.name, 1.0, 0.0) for rule in rules]
    sample = docs.select(F.col(text).cast("string").alias("text")).sample(fraction=min(1.0, sample_texts / total), seed=7)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            for start, stop in slices(record.column(0)):
                texts = record.column(0).slice(start, stop - start)
                found = []
                for rule in rules:
                    began = time.perf_counter()
                    rejected = int(rule.rejects(TextBatch(texts)).sum())
                    found.append((rule.name, time.perf_counter() - began, rejected, stop - start))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], ["rule", "seconds", "rejected", "texts"])

    sums = sample.mapInArrow(run, "rule string, seconds double, rejected long, texts long").groupBy("rule").agg(F.sum("seconds"), F.sum("rejected"), F.sum("texts")).collect()
    known = {row[0]: (row[1] / row[3], row[2] / row[3]) for row in sums}
    return [(rule.name, *known.get(rule.name, (1.0, 0.0))) for rule in rules]


def order_rules(rules: tuple[Rule, ...], measured: list[tuple[str, float, float]]) -> list[Rule]:
    """Rules by rejection per cost, highest first; ties keep the given order."""
    gain = {name: share / max(cost, 1e-12) for name, cost, share in measured}
    return sorted(rules, key=lambda rule: -gain[rule.name])


def run_cascade(texts: pa.Array, rules: list[Rule], alive: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which texts no rule rejects, and the position of the rule that did (-1: none)."""
    by = np.full(len(texts), -1, np.int32)
    alive = np.arange(len(texts)) if alive is None else np.flatnonzero(alive)
    batch = None
    for k, rule in enumerate(rules):
        if not len(alive):
            break
        batch = batch or TextBatch(texts.take(pa.array(alive)))
        out = rule.rejects(batch)
        if out.any():
            by[alive[out]] = k
            alive, batch = alive[~out], None
    kept = np.zeros(len(texts), bool)
    kept[alive] = True
    return kept, by


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """Documents that every rule keeps, with the columns they had."""
    ordered = order_rules(rules, measure(docs, rules, text))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            for start, stop in slices(record.column(at)):
                part = record.slice(start, stop - start)
                kept, _ = run_cascade(part.column(at), ordered)
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Base figures, ``base_failed`` and the verdict ``kept`` of every document.

    The base figures are wanted for every row; the other rules run as a cascade
    over the documents that the base rules leave.
    """
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    ordered = order_rules(EXTRA_RULES, measure(docs, EXTRA_RULES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            for start, stop in slices(record.column(1)):
                texts = record.column(1).slice(start, stop - start)
                batch = TextBatch(texts)
                repeats = repeat_words(batch)
                failed = (batch.n_words < 50) | (100 * repeats > 50 * batch.n_words)
                figures = [batch.n_words, word_chars(batch), symbols(batch), duplicate_lines(batch), repeats]
                kept, _ = run_cascade(texts, ordered, ~failed)
                yield pa.RecordBatch.from_arrays(
                    [record.column(0).slice(start, stop - start), *(pa.array(x, pa.int64()) for x in figures), pa.array(failed), pa.array(kept)],
                    ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
