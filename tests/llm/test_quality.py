"""The classifier on held-out rows, its parts, and the defined cases."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from tidemark.llm import quality


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    good = label == 1
    return (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    got = quality.score_documents(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    both = got[got.held_out].merge(labels.toPandas(), on="doc_id")
    assert auc(both.score.to_numpy(), both.quality.to_numpy()) > 0.97
    assert (both.predicted == both.quality).mean() > 0.95


def test_normal_equations_equal_a_plain_fit(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, len(quality.STATISTICS)))
    y = (x[:, 0] > 0).astype(float)
    cosines = quality.Cosines.draw(np.zeros(x.shape[1]), np.ones(x.shape[1]), features=20)
    rows = spark.createDataFrame([(int(i % 3), row.tolist(), float(t)) for i, (row, t) in enumerate(zip(x, y, strict=True))], "remainder int, x array<double>, y double").repartition(5)
    parts = quality.normal_equations(rows, cosines)
    z = cosines.of(x)
    for f in range(3):
        own = np.arange(200) % 3 == f
        assert np.allclose(parts[f][0], z[own].T @ z[own]) and np.allclose(parts[f][1], z[own].T @ y[own])


def test_isotonic():
    x = np.arange(6.0)
    knots = quality.isotonic(x, np.array([0.0, 2.0, 1.0, 3.0, 2.0, 5.0]), np.ones(6))
    assert np.allclose(np.interp([0, 1.5, 3.5, 5], *knots), [0, 1.5, 2.5, 5])
    rng = np.random.default_rng(1)
    knots = quality.isotonic(np.arange(50.0), rng.normal(size=50) + np.arange(50) / 20, rng.integers(1, 5, 50))
    assert (np.diff(knots[1]) > 0).all()


def test_cosines_approximate_the_kernel():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(30, 18))
    z = quality.Cosines.draw(np.zeros(18), np.ones(18), features=20000).of(x)[:, :-1]
    true = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 2 / 18)
    assert np.abs(z @ z.T - true).max() < 0.05


def test_defined_cases(spark, table_of):
    docs = table_of([(1, None, 1), (2, "", 1), (3, "a b c", 1), (3, "a b c", 1), (None, "x", 1)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.score_documents(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(1, 0), (3, 1), (3, None), (3, 1), (9, 1)], "doc_id long, quality int")
    got = quality.score_documents(docs, some).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_documents(table_of([]), some).collect() == []
    assert np.isfinite(quality.statistics(pa.array([None, "", " ", "|||", "é" * 100000]))).all()
