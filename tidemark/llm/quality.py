"""A quality classifier on document statistics, with random Fourier features.

Statistics of a text (lengths, shares of character classes, repetition) are
standardised and mapped to random cosines that approximate a Gaussian kernel.
Each partition sums its part of the normal equations, for each fold apart; the
sums give a ridge fit for every fold left out, whose scores on that fold calibrate
the final fit by isotonic regression. Only sums of fixed size reach the driver.

Defined cases: a null text is an empty one, with statistics of zero, and gets a
score as any other; a document with several labels counts with their mean, a null
label not at all; without any label every score is 0.5; rows are scored one by
one, so repeated rows get equal scores; an empty table gives an empty result;
columns other than id and text are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import rules
from tidemark.llm.textbatch import TextBatch, distinct_per_text, slices
from tidemark.session import materialise

STATISTICS = (
    "log_words", "log_characters", "word_length", "symbols", "capitals", "digits", "marks", "shouts", "bars", "stops", "beyond_ascii",
    "distinct_words", "top_word", "repeated", "copied_lines", "line_words", "short_words", "initial_capitals",
)
FEATURES, RIDGE, SEED = 256, 1e-3, 11
#: Width of the bins that raw scores are calibrated in, and their range.
BIN, LOW, HIGH = 0.002, -1.0, 2.0


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text."""
    batch = TextBatch(texts)
    data, words = batch.data, np.maximum(batch.n_words, 1)
    letters = rules.word_chars(batch)
    characters = np.maximum(letters, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return batch.per_text(mask) / characters

    starts, ends, of = batch.words
    keys, owner = distinct_per_text(batch.word_hashes, of)
    distinct = np.bincount(owner, minlength=batch.n)
    order = np.lexsort((batch.word_hashes, of))
    key, who = batch.word_hashes[order], of[order]
    begin = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (who[1:] != who[:-1]))) if len(key) else np.zeros(0, np.int64)
    top = np.zeros(batch.n)
    np.maximum.at(top, who[begin], np.diff(np.append(begin, len(key))))
    upper = (data >= 0x41) & (data <= 0x5A)
    lines = np.maximum(rules.filled_lines(batch), 1)
    brief = np.bincount(of[ends - starts <= 2], minlength=batch.n)
    heads = np.bincount(of[upper[starts]], minlength=batch.n)
    return np.stack([
        np.log1p(batch.n_words), np.log1p(letters), letters / words, rules.symbols(batch) / words, share(upper),
        share((data >= 0x30) & (data <= 0x39)), share(((data > 0x20) & (data < 0x30)) | ((data > 0x39) & (data < 0x41)) | ((data > 0x5A) & (data < 0x61))),
        share(data == 0x21), share(data == 0x7C), share(data == 0x2E), share(data >= 0xC0),
        distinct / words, top / words, rules.repeat_words(batch) / words, rules.duplicate_lines(batch) / lines, np.log1p(batch.n_words / lines),
        brief / words, heads / words,
    ], axis=1)


def statistics_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, remainder (of the id's checksum) and its statistics ``x``."""
    remainder = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 4
    docs = docs.select(F.col(key).alias("doc_id"), remainder.cast("int").alias("remainder"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            for start, stop in slices(record.column(2)):
                x = statistics(record.column(2).slice(start, stop - start))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([record.column(0).slice(start, stop - start), record.column(1).slice(start, stop - start), lists], ["doc_id", "remainder", "x"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, remainder int, x array<double>")


@dataclass(frozen=True)
class Cosines:
    """Standardisation and random directions: statistics to features."""

    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray

    @classmethod
    def draw(cls, mean: np.ndarray, scale: np.ndarray, features: int = FEATURES, seed: int = SEED) -> Cosines:
        rng = np.random.default_rng(seed)
        width = np.sqrt(len(mean))
        return cls(mean, np.where(scale > 0, scale, 1.0), rng.normal(size=(len(mean), features)) / width, rng.uniform(0, 2 * np.pi, features))

    def of(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.column_stack([np.cos(z @ self.directions + self.phases) * np.sqrt(2 / len(self.phases)), np.ones(len(x))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, len(STATISTICS)))


def normal_equations(rows: DataFrame, cosines: Cosines) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per fold the sums of outer products and of products with the label, of rows (remainder, x, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for record in batches:
            z, fold, y = cosines.of(_matrix(record.column(1))), record.column(0).to_numpy(), record.column(2).to_numpy()
            for f in np.unique(fold):
                own = z[fold == f]
                part = np.column_stack([own.T @ own, own.T @ y[fold == f]])
                sums[int(f)] = sums[int(f)] + part if int(f) in sums else part
        for f, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(total), f, np.int32)), pa.array(np.arange(len(total), dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["fold", "row", "sums"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = _matrix(table.column("sums").combine_chunks()).sum(axis=0)
        return pa.table({"fold": [key[0].as_py()], "row": [key[1].as_py()], "sums": pa.array([total], pa.list_(pa.float64()))}, schema=pa.schema([("fold", pa.int32()), ("row", pa.int32()), ("sums", pa.list_(pa.float64()))]))

    schema = "fold int, row int, sums array<double>"
    found: dict[int, dict[int, np.ndarray]] = {}
    for row in rows.select("remainder", "x", "y").mapInArrow(run, schema).groupBy("fold", "row").applyInArrow(add, schema).collect():
        found.setdefault(row["fold"], {})[row["row"]] = np.array(row["sums"])
    out = {}
    for fold, by_row in found.items():
        total = np.stack([by_row[i] for i in range(len(by_row))])
        out[fold] = (total[:, :-1], total[:, -1])
    return out


def ridge(parts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    a, b = sum(p[0] for p in parts), sum(p[1] for p in parts)
    return np.linalg.solve(a + RIDGE * max(a[-1, -1], 1.0) * np.diag([*np.full(len(a) - 1, 1.0 / len(a)), 0.0]) + 1e-9 * np.eye(len(a)), b)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing least-squares fit, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x, y, weight, strict=True):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def calibration(rows: DataFrame, cosines: Cosines, weights: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic knots from the scores that each fold gets of the fit without it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            z, fold = cosines.of(_matrix(record.column(1))), record.column(0).to_numpy()
            raw = np.zeros(len(fold))
            for f in np.unique(fold):
                raw[fold == f] = z[fold == f] @ weights[int(f)]
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(np.clip(raw, LOW, HIGH) / BIN).astype(np.int64)), record.column(2)], ["bin", "y"])

    bins = rows.select("remainder", "x", "y").mapInArrow(run, "bin long, y double").groupBy("bin").agg(F.sum("y"), F.count("*")).collect()
    bins = np.array(sorted(tuple(map(float, r)) for r in bins))
    return isotonic((bins[:, 0] + 0.5) * BIN, bins[:, 1] / bins[:, 2], bins[:, 2])


@dataclass(frozen=True)
class Classifier:
    cosines: Cosines
    weights: np.ndarray | None
    knots: tuple[np.ndarray, np.ndarray] | None

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated scores; inside a flat stretch the raw score orders texts by a hair."""
        if self.weights is None:
            return np.full(len(x), 0.5)
        raw = np.clip(self.cosines.of(x) @ self.weights, LOW, HIGH)
        return np.clip(np.interp(raw, *self.knots) * (1 - 1e-6) + 1e-6 * (raw - LOW) / (HIGH - LOW), 0.0, 1.0)


def fit(table: DataFrame, labels: DataFrame, held_out: int = 2) -> Classifier:
    """A classifier from the labelled rows of a statistics table, the held-out remainder left aside."""
    moments = table.select(*(f(F.col("x")[i]) for i in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop))).first()
    values = np.array([0.0 if v is None else v for v in moments]).reshape(-1, 2)
    cosines = Cosines.draw(values[:, 0], values[:, 1])
    means = labels.where("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("y"))
    rows = materialise(table.where(F.col("remainder") != held_out).join(means, "doc_id").select("remainder", "x", "y"))
    parts = normal_equations(rows, cosines)
    if not parts:
        return Classifier(cosines, None, None)
    without = {f: ridge([p for g, p in parts.items() if g != f] or [parts[f]]) for f in parts}
    return Classifier(cosines, ridge(list(parts.values())), calibration(rows, cosines, without))


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", held_out: int = 2, at_least: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted."""
    table = materialise(statistics_table(docs, key, text))
    model = fit(table, labels.select(F.col("doc_id"), F.col("quality").cast("double")), held_out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for record in batches:
            score = model.score(_matrix(record.column(2)))
            yield pa.RecordBatch.from_arrays([record.column(0), pa.array(record.column(1).to_numpy() == held_out), pa.array(score), pa.array((score >= at_least).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = table.schema["doc_id"].dataType.simpleString()
    return table.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
