"""Rank correlations of a day."""

from __future__ import annotations

import datetime as dt
import math

import pandas as pd

from tidemark.operators import screen


def test_ranks_of_a_day_take_no_window(spark, capsys):
    rows = [(1, dt.date(2024, 1, 2), float(i % 7), float(i), float(-i), None if i % 5 == 0 else float(i % 4), float(i)) for i in range(40)]
    grid = spark.createDataFrame(rows, "di int, trade_date date, score double, ret_1 double, step_1 double, score_before double, neutral double")
    ics = screen.metric_ics(grid, [1], 8)
    ics.explain()
    assert "Window" not in capsys.readouterr().out
    frame = pd.DataFrame(rows, columns=grid.columns)
    for row in ics.collect():
        a, b = {"autocorr": ("score", "score_before"), "ic": ("score", "ret_1"), "ic_marginal": ("score", "step_1"), "ic_size_neutral": ("neutral", "ret_1")}[row.metric]
        pair = frame[[a, b]].astype(float).dropna()
        assert row.pairs == len(pair) and math.isclose(row.ic, pair[a].rank().corr(pair[b].rank()), abs_tol=1e-12)
