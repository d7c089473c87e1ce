"""Ordered work over groups too large for a task agrees with plain windows."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.operators.executions import deciles, round_trips, unpaired_sells
from tidemark.operators.ordered import Running, average_rank, day_quantiles, day_rank, keep_first, keep_last, lay_out, quantiles, running, windowed


def skewed(spark, rows=900, seed=3):
    """One key holds most rows; values tie often; some are null."""
    rng = random.Random(seed)
    data = [((None if seed % 2 == 0 else "hot") if rng.random() < 0.7 else f"k{rng.randrange(20)}", i, rng.randrange(40), None if rng.random() < 0.3 else float(rng.randrange(15))) for i in range(rows)]
    return spark.createDataFrame(data, "key string, at int, qty int, val double").repartition(5)


SPECS = {
    "total": Running("sum", "qty"), "before": Running("sum", "qty", exclusive=True), "top": Running("max", "val"), "held": Running("last", "val"),
}


@pytest.mark.parametrize("seed", [3, 4])
def test_running_over_range_partitions_matches_windows(spark, many_tasks, seed):
    """Hot and null keys span several tasks; both directions."""
    df = skewed(spark, seed=seed)
    laid = lay_out(df, ["key"], ["at"])
    assert laid.groupBy("key").agg(F.count_distinct("_task").alias("n")).agg(F.max("n")).first()[0] > 1
    for backwards in (False, True):
        plain = windowed(df, ["key"], ["at"], SPECS, backwards).toPandas().sort_values("at").reset_index(drop=True)
        split = running(df, ["key"], ["at"], SPECS, backwards=backwards).toPandas().sort_values("at").reset_index(drop=True)
        pd.testing.assert_frame_equal(plain, split[plain.columns])


def test_running_over_the_whole_table(spark, many_tasks):
    df = skewed(spark)
    got = running(df, [], ["at"], SPECS).toPandas().sort_values("at")
    want = df.toPandas().sort_values("at")
    np.testing.assert_allclose(got["total"], want["qty"].cumsum())
    np.testing.assert_allclose(got["held"].astype(float), want["val"].ffill(), equal_nan=True)


def test_ranks_and_quantiles_match_pandas(spark, many_tasks):
    df = skewed(spark)
    pdf = df.toPandas()
    want = pdf.assign(want=pdf.groupby("key")["val"].rank(method="average")).sort_values("at").reset_index(drop=True)["want"]
    any_size = average_rank(df, ["key"], "val", "rank", count_name="n")
    for got in (any_size, df.withColumn("rank", day_rank(["key"], "val"))):
        np.testing.assert_allclose(got.toPandas().sort_values("at")["rank"].astype(float), want, equal_nan=True)
    for make in (quantiles, day_quantiles):
        cuts = make(df, ["key"], "val", {"low": 0.3, "high": 0.85}).toPandas().set_index("key")
        for name, q in (("low", 0.3), ("high", 0.85)):
            np.testing.assert_allclose(cuts[name].sort_index(), pdf.groupby("key")["val"].quantile(q).reindex(cuts.index).sort_index())


def test_keep_first_and_last_are_order_independent(spark):
    df = skewed(spark)
    first = keep_first(df, ["key"], "qty", "at").toPandas().sort_values("key")
    again = keep_first(df.repartition(11).orderBy(F.rand(1)), ["key"], "qty", "at").toPandas().sort_values("key")
    pd.testing.assert_frame_equal(first.reset_index(drop=True), again.reset_index(drop=True))
    last = keep_last(df, ["key"], "at").toPandas()
    assert set(last["at"]) == set(df.groupBy("key").agg(F.max("at").alias("m")).toPandas()["m"])


def fifo(rows):
    """Row-by-row pairing of one symbol: the oracle of the interval form."""
    lots, trips, lost = [], [], 0
    for at, action, qty in rows:
        if action == "buy":
            lots.append([at, qty])
            continue
        while qty and lots:
            taken = min(qty, lots[0][1])
            trips.append((lots[0][0], at, taken))
            lots[0][1] -= taken
            qty -= taken
            if not lots[0][1]:
                lots.pop(0)
        lost += qty
    return sorted(trips + [(at, None, qty) for at, qty in lots], key=str), lost


def test_round_trips_match_row_by_row(spark, many_tasks):
    rng = random.Random(11)
    data = {f"s{n}": [(i, rng.choice(["buy", "sell"]), rng.randrange(1, 9)) for i in range(600 if n == 0 else rng.randrange(1, 60))] for n in range(30)}
    rows = [(symbol, at, action, qty) for symbol, seq in data.items() for at, action, qty in seq]
    df = spark.createDataFrame(rows, "ts_code string, at int, action string, quantity long").repartition(6)
    got = round_trips(df, ["ts_code"], ["at"], ["at"]).toPandas()
    lost = dict(unpaired_sells(df, ["ts_code"], ["at"]).collect())
    for symbol, seq in data.items():
        trips, unpaired = fifo(seq)
        mine = got[got.ts_code == symbol]
        pairs = sorted([(int(e), None if pd.isna(x) else int(x), int(q)) for e, x, q in zip(mine.entry_at, mine.exit_at, mine.trip_quantity)], key=str)
        assert pairs == trips
        assert lost.get(symbol, 0) == unpaired


def test_asof_join_matches_merge_asof(spark):
    rng = random.Random(5)
    left = pd.DataFrame([(rng.choice("ab"), rng.randrange(200), i) for i in range(120)], columns=["k", "t", "id"])
    right = pd.DataFrame([(k, t, t * 10) for k in "ab" for t in rng.sample(range(200), 60)], columns=["k", "u", "v"])
    for strict in (False, True):
        got = asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "t", "u", ["v"], strict=strict).toPandas().sort_values("id")
        want = pd.merge_asof(left.sort_values("t"), right.sort_values("u"), left_on="t", right_on="u", by="k", allow_exact_matches=not strict).sort_values("id")
        np.testing.assert_allclose(got["v"].astype(float), want["v"], equal_nan=True)


def test_deciles_share_ties(spark):
    df = spark.createDataFrame([("d", f"c{i}", float(i // 5)) for i in range(50)], "trade_date string, ts_code string, circ_mv double")
    got = deciles(df).toPandas()
    assert got.groupby("circ_mv")["decile"].nunique().eq(1).all()
    want = np.minimum((got["circ_mv"].rank(method="min", pct=True) * 10).astype(int), 9)
    assert (got["decile"] == want).all()
