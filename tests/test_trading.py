"""The number of matched-random draws."""

from __future__ import annotations

from test_oracles import FOLDER

from tidemark.registry import QUERIES


def test_every_trip_has_a_hundred_draws(spark):
    got = QUERIES["ex05_seeded_draw"](spark, FOLDER).toPandas()
    assert sorted(set(got.draw)) == list(range(100))
    assert (got.groupby(["o", "l", "p", "entry_day", "ts_code"]).draw.nunique() == 100).all()
