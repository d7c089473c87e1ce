"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest
from harness import compare, connect

from tidemark.plans import load_all
from tidemark.registry import ORACLES, QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
# An iterative fit has no SQL; its rows and budget are checked here.
WITHOUT_SQL = {"st12_fit_score"}
load_all()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLES:
        assert compare(got, con.execute(ORACLES[name]).df()) is None
    else:
        assert name in WITHOUT_SQL
        assert len(got) and got.score.between(0, 1).all() and (got.budget > 0).all()
