"""User functions over views: signals, and fit/score pairs by period."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calendar import due_days
from .screen import KEYS, check_signal

Signal = Callable[[DataFrame], DataFrame]
SIGNALS: dict[str, Signal] = {}


def register_signal(name: str, fn: Signal) -> Signal:
    """Register ``fn(panel) -> (trade_date, ts_code, score)`` under a name."""
    SIGNALS[name] = fn
    return fn


def compute_signal(name: str, panel: DataFrame) -> DataFrame:
    """A registered signal's checked scores."""
    return check_signal(SIGNALS[name](panel))


def pandas_signal(fn: Callable[[pd.DataFrame], pd.Series], columns: Sequence[str]) -> Signal:
    """A per-name pandas function as a signal.

    A name has one row per date, so its group is bounded by the calendar; the
    function gets the name's rows in date order and returns a score per row.
    """

    def scored(panel: DataFrame) -> DataFrame:
        kinds = {field.name: field.dataType.simpleString() for field in panel.schema.fields}

        def one(rows: pd.DataFrame) -> pd.DataFrame:
            ordered = rows.sort_values("trade_date", kind="stable").reset_index(drop=True)
            return ordered[KEYS].assign(score=pd.Series(fn(ordered), dtype="float64").to_numpy())

        wanted = list(dict.fromkeys([*KEYS, *columns]))
        return panel.select(*wanted).groupBy("ts_code").applyInPandas(one, f"trade_date {kinds['trade_date']}, ts_code string, score double")

    return scored


def fit_score(panel: DataFrame, period: str, fit: Callable[[DataFrame], DataFrame], score: Callable[[DataFrame, DataFrame], DataFrame], day: str = "trade_date") -> DataFrame:
    """Refit at every new period and score the period's rows with that fit.

    ``fit`` gets rows labelled with ``fit_day``, each period's own history
    (strictly earlier rows), and returns parameters keyed by ``fit_day``;
    ``score`` joins them to the rows of the period. History is not copied per
    period: ``fit`` receives every row once with the day it first counts for
    and accumulates, which running aggregates do in one pass.
    """
    days = panel.select(F.col(day).alias("cal_date")).distinct()
    firsts = due_days(days, period).select(F.col("cal_date").alias("fit_day"), F.col("period_start").alias("_period"))
    unit = F.col(day) if period == "day" else F.trunc(day, period)
    rows = panel.withColumn("_period", unit).join(F.broadcast(firsts), "_period").drop("_period")
    return score(rows, fit(rows))
