from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("LLM_SF_DIR", SF)


@pytest.fixture
def table_of(spark):
    """A DataFrame of documents with an extra column whose names clash with ours."""

    def make(rows, extra="text string, fingerprint int"):
        return spark.createDataFrame(rows, f"doc_id long, {extra}")

    return make
