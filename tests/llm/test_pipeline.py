"""The pipeline's stages: what each removes, what it leaves, and the columns between them."""

from __future__ import annotations

import sys
from pathlib import Path

import pyarrow as pa

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402
from test_jaccard import plain as components_of  # noqa: E402
from test_lines import plain as lines_of  # noqa: E402
from tidemark.llm import rules  # noqa: E402
from tidemark.llm.textbatch import TextBatch  # noqa: E402


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "n-gram Jaccard join", "substring dedup", "best-fit packing"]
    before = rows(docs)

    kept = corpus_pipeline.materialise(stages["quality rules"](spark, docs, folder))
    texts = [before[d]["text"] for d in sorted(before)]
    verdict = {d: not any(rule.rejects(TextBatch(pa.array([t])))[0] for rule in rules.RULES) for d, t in zip(sorted(before), texts, strict=True)}
    assert {d: tuple(r) for d, r in rows(kept).items()} == {d: tuple(before[d]) for d in before if verdict[d]}

    cut = corpus_pipeline.materialise(stages["line dedup"](spark, kept, folder))
    assert cut.columns == docs.columns
    want = {d: t for d, n, t in lines_of(sorted((d, r["text"]) for d, r in rows(kept).items())) if not n or t.split()}
    assert {d: r["text"] for d, r in rows(cut).items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows(cut).values())

    single = corpus_pipeline.materialise(stages["n-gram Jaccard join"](spark, cut, folder))
    assert single.columns == docs.columns
    groups = components_of(sorted((d, r["text"]) for d, r in rows(cut).items()))
    assert set(rows(single)) == {d for d, _, c in groups if d == c}

    rest = corpus_pipeline.materialise(stages["substring dedup"](spark, single, folder))
    assert rest.columns == docs.columns and set(rows(rest)) <= set(rows(single))
    for d, r in rows(rest).items():
        assert len(r["text"]) <= len(rows(single)[d]["text"]) or r["text"] == rows(single)[d]["text"]

    packed = stages["best-fit packing"](spark, rest, folder).collect()
    assert {r["doc_id"] for r in packed} == set(rows(rest))


def test_empty_and_null_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    nothing = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", None, 0), (None, "a b\nc", None, "s", 5), (2, "", "en", None, 0)], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, "").collect() == []
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert len(stage(spark, odd, "").collect()) in (3, 4)
    assert corpus_pipeline.STAGES[0][1](spark, odd, "").collect() == []
