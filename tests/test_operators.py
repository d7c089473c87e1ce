"""Hand-made fixtures: expected values, invariants and refusals."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.functions import codes, values
from tidemark.functions.times import market_time, months_after_rolling
from tidemark.operators import asof, auction, executions, inference, intraday, panel, quality, screen, stamps, stats, style, universe, versions
from tidemark.operators import calendar as cal_ops


def labels():
    start = dt.datetime(2021, 10, 8, 9, 30)
    morning = [start + dt.timedelta(minutes=i) for i in range(121)]
    noon = dt.datetime(2021, 10, 8, 13, 1)
    return morning + [noon + dt.timedelta(minutes=i) for i in range(120)]


def session(spark, close, vol, first_open, code="600000.SH"):
    times = labels()
    opens = [first_open, *close[:-1]]
    rows = [(code, "20211008", t.strftime("%Y-%m-%d %H:%M:%S"), float(o), float(c), float(v), float(c * v)) for t, o, c, v in zip(times, opens, close, vol)]
    return spark.createDataFrame(rows, "ts_code string, trade_date string, trade_time string, open double, close double, vol double, amount double")


def test_intraday_stats_on_a_written_out_session(spark):
    close = [10.0] + [10.2] * 120 + [10.1] * 119 + [10.0]
    vol = [100] + [10] * 240
    row = intraday.intraday_stats(session(spark, close, vol, 9.9)).first()
    returns = np.log(np.array([10.0 / 9.9, 10.2 / 10.0, 10.1 / 10.2, 10.0 / 10.1]))
    rv = (returns**2).sum()
    assert row.n_bars == 241
    assert row.rv == pytest.approx(rv)
    assert row.rv_down_share == pytest.approx((returns[returns < 0] ** 2).sum() / rv)
    assert row.rsk == pytest.approx(np.sqrt(241) * (returns**3).sum() / rv**1.5)
    assert row.vol_open30_share == pytest.approx(400 / 2500)
    assert row.vol_close30_share == pytest.approx(300 / 2500)
    assert row.ret_open30 == pytest.approx(10.2 / 9.9 - 1)


def test_flat_day_has_no_moments_and_halts_are_dropped(spark):
    flat = intraday.intraday_stats(session(spark, [10.0] * 241, [10] * 241, 10.0)).first()
    assert flat.rv == 0 and flat.rsk is None and flat.rku is None and flat.rv_down_share is None
    assert intraday.intraday_stats(session(spark, [10.0] * 241, [0] * 241, 10.0)).count() == 0
    assert intraday.intraday_flow(session(spark, [10.0] * 241, [1] * 241, 10.0, "830001.BJ")).count() == 0


def test_flow_skips_lunch_and_reads_signs(spark):
    close = [10.0 + 0.01 * i for i in range(241)]
    row = intraday.intraday_flow(session(spark, close, [10] * 241, 10.0)).first()
    assert row.nret == 239
    assert row.ofi_1d == pytest.approx(239 / 241)


def test_bad_minute_price_fails(spark):
    with pytest.raises(Exception, match="positive price"):
        intraday.intraday_stats(session(spark, [10.0] * 240 + [0.0], [10] * 241, 10.0)).collect()


def test_visible_at_is_the_inverse_of_rolling_cutoffs(spark):
    rng = np.random.default_rng(4)
    base = pd.Timestamp("2024-03-01")
    datasets = ["margin", "kpl_list", "report_rc", "top_list"]
    rows = [(i, "events", datasets[i % 4], (base + pd.Timedelta(minutes=int(m))).to_pydatetime()) for i, m in enumerate(rng.integers(0, 20 * 1440, 120))]
    df = spark.createDataFrame(rows, "id long, domain string, dataset string, available_at timestamp_ntz")
    shown = asof.visible_at(asof.assign_nodes(df, spark), spark, "2024-02-28", "2024-03-25").toPandas()
    instances = asof.node_instances(spark, "2024-02-15", "2024-04-10").toPandas()
    for row in shown.itertuples():
        mine = instances[instances.node.isin(list(row.nodes))]

        def seen(when):
            done = mine[mine.ready <= when]
            return len(done) and row.available_at <= done.start.max()

        assert seen(row.visible_at) and not seen(row.visible_at - pd.Timedelta(seconds=1))


def test_market_time_spellings(spark):
    texts = ["2024-01-02 03:04:05", "2024-01-02T03:04:05+08:00", "2024-01-01T19:04:05Z", "2024-01-02 00:34:05+05:30", "soon", "2024-13-01 00:00:00"]
    got = [row[0] for row in spark.createDataFrame([(t,) for t in texts], "t string").select(market_time(F.col("t"))).collect()]
    assert got[:4] == [dt.datetime(2024, 1, 2, 3, 4, 5)] * 4 and got[4:] == [None, None]


def test_tax_months_roll_to_the_first(spark):
    df = spark.createDataFrame([("2024-01-31",), ("2024-01-15",)], "d string").select(months_after_rolling(F.col("d").cast("date"), 1))
    assert [row[0] for row in df.collect()] == [dt.date(2024, 3, 1), dt.date(2024, 2, 15)]


def test_canonical_values_agree(spark):
    df = spark.createDataFrame([("1.0",), ("1",), (" 1.00 ",), ("1e0",), ("NaN",), (None,), ("0.0",), ("abc",), ("1.50",), ("100",)], "t string")
    assert [row[0] for row in df.select(values.canonical(F.col("t"))).collect()] == ["1", "1", "1", "1", "", "", "0", "abc", "1.5", "100"]


def test_lot_rules(spark):
    df = spark.createDataFrame([("600000.SH", 1234), ("688001.SH", 199), ("688001.SH", 234), ("830001.BJ", 150), ("300001.SZ", 99)], "c string, s int")
    got = [row[0] for row in df.select(codes.lot_quantity(F.col("s").cast("double"), F.lit(1.0), F.col("c"))).collect()]
    assert got == [1200, 0, 234, 150, 0]


def test_share_multiplier_and_whole_shares(spark):
    df = spark.createDataFrame([(10.0, 5.0, 0.0), (10.0, 9.5, 0.5), (10.0, 10.003, 0.0), (10.0, 4.75, 0.5)], "last double, pre double, cash double")
    got = [row[0] for row in df.select(values.share_multiplier(F.col("last"), F.col("pre"), F.col("cash"))).collect()]
    assert got[0] == 2.0 and got[1] is None and got[2] is None and got[3] == pytest.approx(2.0)


def test_next_open_day_and_coverage(spark):
    days = pd.date_range("2024-02-08", "2024-02-21")
    closed = {d for d in days if d.weekday() >= 5 or pd.Timestamp("2024-02-09") <= d <= pd.Timestamp("2024-02-17")}
    cal = spark.createDataFrame([(d.date(), d not in closed) for d in days], "cal_date date, is_open boolean")
    rows = spark.createDataFrame([("20240208",), ("20240220",)], "trade_date string")
    out = stamps.stamp_official(rows, "trade_date", catalog.OFFICIAL["next_open_09"], cal).select("available_at").collect()
    assert out[0][0] == dt.datetime(2024, 2, 19, 9, 0)
    with pytest.raises(Exception, match="calendar"):
        cal_ops.open_days(cal, "2024-02-01", "2024-02-20").collect()
    late = spark.createDataFrame([("20240221",)], "trade_date string")
    with pytest.raises(Exception, match="calendar ends"):
        stamps.stamp_official(late, "trade_date", catalog.OFFICIAL["next_open_09"], cal).collect()


def test_refusals(spark):
    bars = spark.createDataFrame([("d", "c", 1.0), ("d", "c", 2.0)], "trade_date string, ts_code string, score double")
    with pytest.raises(Exception, match="duplicate keys"):
        panel.unique_or_fail(bars, ["trade_date", "ts_code"], "daily").collect()
    with pytest.raises(Exception, match="duplicate keys"):
        screen.check_signal(bars).collect()
    with pytest.raises(ValueError):
        catalog.checked({"x": catalog.Clock("x", "trade_date", "09:00", "weeks", 1)})
    bad = spark.createDataFrame([("fatal", "c", "m", {"a": "b"})], "severity string, check string, message string, details map<string,string>")
    with pytest.raises(Exception, match="invalid finding"):
        quality.report(bad).collect()
    wrong = spark.createDataFrame([("600000.SH", 10.0, 100.0, 0.0)], "ts_code string, price double, vol double, amount double")
    with pytest.raises(Exception, match="inconsistent"):
        auction.clean_auction(wrong).collect()
    old = spark.createDataFrame([("SSE", "20240102", "1")], "exchange string, cal_date string, is_open string")
    new = spark.createDataFrame([("SSE", "20240102", "0")], "exchange string, cal_date string, is_open string")
    with pytest.raises(ValueError, match="elapsed"):
        versions.merge_calendar(old, new, F.lit("20240201"))
    with pytest.raises(ValueError, match="empty answer"):
        versions.merge_window(old, old.where("false"), "cal_date", "20240101", "20240131")


def test_publish_decisions(spark):
    rows = lambda n, extra=0: spark.createDataFrame([(f"c{i}", float(i + extra)) for i in range(n)], "ts_code string, vol double")
    outcome = lambda old, new: versions.classify_publish(old, new, ["ts_code"]).first().outcome
    assert outcome(rows(4), rows(4)) == "unchanged"
    assert outcome(rows(4), rows(6)) == "appended"
    assert outcome(rows(4), rows(4, 1)) == "restated"
    assert outcome(rows(4), rows(2)) == "restated"  # exactly half is accepted
    assert outcome(rows(4), rows(1)) == "staged"
    assert outcome(rows(4), rows(0)) == "defect"


def test_diff_is_symmetric_and_counts_multisets(spark):
    a = spark.createDataFrame([("k", "1.0"), ("k", "2"), ("m", "3")], "k string, v string")
    b = spark.createDataFrame([("k", "2.00"), ("k", "1"), ("n", "4")], "k string, v string")
    status = lambda x, y: {r.k: r.status for r in versions.diff(x, y, ["k"]).collect()}
    assert status(a, b) == {"k": "same", "m": "removed", "n": "added"}
    assert status(b, a) == {"k": "same", "m": "added", "n": "removed"}


def test_planted_signal_is_found_and_noise_is_not(spark):
    rng = np.random.default_rng(20)
    days = pd.bdate_range("2024-01-01", periods=60)
    hidden = rng.normal(size=(60, 60))
    rets = 0.03 * hidden + rng.normal(scale=0.02, size=hidden.shape)
    opens = 10 * np.cumprod(1 + np.vstack([np.zeros(60), np.zeros(60), rets[:-2]]), axis=0)
    rows = [(d.date(), f"{600000 + j}.SH", float(opens[i, j]), float(opens[i, j]), 1.0, 1e9, 0.0, 1e5 + j, False) for i, d in enumerate(days) for j in range(60)]
    daily = spark.createDataFrame(rows, "trade_date date, ts_code string, open double, close double, adj_factor double, up_limit double, down_limit double, circ_mv double, is_suspended boolean")
    frame = lambda matrix: spark.createDataFrame([(d.date(), f"{600000 + j}.SH", float(matrix[i, j])) for i, d in enumerate(days) for j in range(60)], "trade_date date, ts_code string, score double")
    planted = screen.run_screen(daily, frame(hidden), (1,)).first()
    noise = screen.run_screen(daily, frame(rng.normal(size=hidden.shape)), (1,)).first()
    assert planted.ic_mean > 0.5 and planted.top_excess_mean > 0.02
    grid = screen.prepare(daily, frame(hidden), (1,))
    apart = screen.rank_ic(grid.select("di", F.col("score").alias("a"), F.col("ret_1").alias("b")), ["di"], 30).where("ic is not null")
    assert apart.agg(F.avg("ic")).first()[0] == pytest.approx(planted.ic_mean, rel=1e-9)
    assert abs(noise.ic_mean) < 0.1


def test_spread_of_a_day(spark):
    rng = np.random.default_rng(8)
    rows = [(dt.date(2024, 1, 1), float(v), float(r)) for v, r in rng.normal(size=(400, 2))]
    df = spark.createDataFrame(rows, "trade_date date, prior double, pct_chg double")
    got = style.spread(df, ["trade_date"]).first()
    prior, change = (np.array([row[k] for row in rows]) for k in (1, 2))
    low, high = np.quantile(prior, [style.TAIL, 1 - style.TAIL])
    assert got.spread == pytest.approx(change[prior >= high].mean() - change[prior <= low].mean(), rel=1e-12) and got.names == 400


def test_known_betas_are_recovered_and_collinear_legs_flagged(spark):
    rng = np.random.default_rng(2)
    legs = rng.normal(scale=0.01, size=(300, 2))
    y = 0.001 + legs @ np.array([0.8, -0.4]) + rng.normal(scale=1e-4, size=300)
    rows = [("s", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(y[i]), float(legs[i, 0]), float(legs[i, 1]), float(2 * legs[i, 0])) for i in range(300)]
    df = spark.createDataFrame(rows, "run_id string, trade_date date, y double, a double, b double, c double")
    fit = style.factor_ols(df, ["run_id"], "y", ["a", "b"]).first()
    design = np.column_stack([np.ones(300), legs])
    want, rss, *_ = np.linalg.lstsq(design, y, rcond=None)
    assert [fit.intercept, fit.beta_a, fit.beta_b] == pytest.approx(want.tolist(), rel=1e-9)
    assert fit.rss == pytest.approx(float(rss[0]), rel=1e-6)
    assert style.factor_ols(df, ["run_id"], "y", ["a", "c"]).first().collinear
    assert inference.residual_reading(df, ["run_id"], "y", ["a", "c"], 0.05).first().problem == "collinear"


def test_bootstrap_bound_agrees_with_numpy_draws(spark):
    rng = np.random.default_rng(9)
    series = rng.normal(0.0005, 0.01, 250)
    df = spark.createDataFrame([("s", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(series)], "run_id string, trade_date date, value double")
    bound = inference.block_bootstrap(df, ["run_id"], F.lit(1), 0.9).first().lower_bound
    starts = rng.integers(0, 231, size=(4000, 13))
    picked = (starts[:, :, None] + np.arange(20)).reshape(4000, -1)[:, :250]
    want = np.quantile(series[picked].mean(axis=1), 0.1) * 244
    assert bound == pytest.approx(want, abs=0.02)
    again = inference.block_bootstrap(df.repartition(7), ["run_id"], F.lit(1), 0.9).first().lower_bound
    assert again == pytest.approx(bound, abs=1e-12)
    with pytest.raises(Exception, match="bootstrap block"):
        inference.block_bootstrap(df.limit(5), ["run_id"], F.lit(1), 0.9).collect()


def test_compounding_handles_total_losses(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", -1.0), ("b", -1.5), ("b", 0.2), ("c", 0.1)], "k string, value double")
    got = dict(df.groupBy("k").agg(stats.compounded(F.col("value"))).collect())
    assert got["a"] == -1.0 and got["b"] == pytest.approx(-0.5 * 1.2 - 1) and got["c"] == pytest.approx(0.1)


def test_positions_map_becomes_holdings(spark):
    curve = spark.createDataFrame([("r", "20240102", {"600000.SH": 100, "000001.SZ": 0})], "run_id string, trade_date string, positions map<string,bigint>")
    assert [tuple(row) for row in style.holdings(curve).collect()] == [("r", "20240102", "600000.SH", 100)]


def test_draws_are_uniform_over_the_exact_pool(spark):
    day, out = dt.date(2024, 1, 2), dt.date(2024, 1, 5)
    bars = [(day, f"{600000 + i}.SH", 10.0 + i, 0) for i in range(12)] + [(out, f"{600000 + i}.SH", 10.0, 0) for i in range(12) if i != 7]
    daily = spark.createDataFrame(bars, "trade_date date, ts_code string, open double, bucket int")
    trips = spark.createDataFrame([("600003.SH", day, out, 0, 1850.0, 100, 1)], "ts_code string, entry_day date, exit_day date, bucket int, notional double, quantity long, o long")
    pool = executions.pool_positions(trips, daily, "bucket", ["main"])
    sized = executions.affordable(trips, pool, "bucket")
    # 100 shares at 10..18 are affordable: nine names, less itself and the one without an exit bar.
    assert sized.first().pool_size == 7
    drawn = executions.draw(sized, pool, "bucket", 7000, 1, ["ts_code", "o"]).groupBy("drawn_code").count().toPandas()
    assert set(drawn.drawn_code) == {f"{600000 + i}.SH" for i in (0, 1, 2, 4, 5, 6, 8)}
    assert drawn["count"].min() > 850 and drawn["count"].max() < 1150


def test_universe_screen_fails_closed(spark):
    names = spark.createDataFrame([("600000.SH", "Alpha", "19990101"), ("600001.SH", "*ST Beta", "19990101"), ("600002.SH", None, "19990101"), ("300003.SZ", "Young", "20240101")], "ts_code string, name string, list_date string")
    basics = spark.createDataFrame([("600000.SH", 10.0, 5e5), ("300003.SZ", 10.0, 5e5)], "ts_code string, close double, circ_mv double")
    kept = universe.screen_universe(names, basics, universe.Screen(listed_days=100, min_cap=1.0), "2024-02-01")
    assert [row[0] for row in kept.collect()] == ["600000.SH"]


def test_file_named_partitions(spark, tmp_path):
    from tidemark.sources import lake

    for day in ("20240102", "20240103", "20240110"):
        pd.DataFrame({"ts_code": ["600000.SH"], "vol": [1.0]}).to_parquet(tmp_path / f"trade_date={day}.parquet")
    got = lake.read_range(spark, str(tmp_path), "20240102", "20240103", ["vol", lake.PARTITION])
    assert sorted(row[1] for row in got.collect()) == ["20240102", "20240103"]
    assert lake.read_range(spark, str(tmp_path), "20240110", "20240101").count() == 0
    assert lake.read_window(spark, str(tmp_path), "20240103", "20240131").count() == 2


def test_canonical_keeps_every_digit(spark):
    from decimal import Decimal, localcontext

    from tidemark.functions.values import canonical

    texts = ["1.0", "1", "1e0", "-0", "1e-20", "3e-19", "1.5E-19", "1.0E21", "000123.4500", "+7", ".5", "5.", "1234567890123456789012345678901234567890.10", "-12.340", "1e-3"]
    got = [row[0] for row in spark.createDataFrame([(t,) for t in texts], "v string").select(canonical(F.col("v"))).collect()]
    with localcontext() as context:
        context.prec = 100
        assert [Decimal(t) for t in texts] == [Decimal(g) for g in got]
    assert len(set(got[:3])) == 1 and got[3] == "0" and len(set(got[4:8])) == 4
    assert not any("e" in g.lower() for g in got)
    odd = spark.createDataFrame([("NaN",), ("",), (None,), (" x ",), ("1e9999",), ("10e9998",)], "v string").select(canonical(F.col("v"))).collect()
    assert [row[0] for row in odd][:4] == ["", "", "", "x"] and odd[4] == odd[5]


def test_builds_refuse_before_writing(spark, tmp_path):
    from tidemark.sources import sinks

    bars = spark.createDataFrame([("20240101", 1.0), ("20240102", -1.0)], "trade_date string, vol double")
    folder = str(tmp_path / "derived")
    with pytest.raises(ValueError, match="1 source partitions"):
        sinks.build_missing(bars, folder, lambda df: df.where("vol > 0"))
    assert sinks.held_partitions(spark, folder, "trade_date") is None
    built = sinks.build_missing(bars.where("vol > 0"), folder, lambda df: df)
    assert [tuple(r) for r in built.collect()] == [("20240101", 1)]
    later = sinks.build_missing(bars, folder, lambda df: df)
    assert [tuple(r) for r in later.collect()] == [("20240102", 1)]


def test_twins_draw_names_of_their_own(spark):
    from tidemark.operators import executions

    trips = spark.createDataFrame([("2024-01-02", "A", 100, None, 1.0e9, 3, None)] * 4, "entry_day string, ts_code string, quantity long, exit_day string, notional double, pool_size long, own_place long")
    trips = trips.withColumns({"entry_day": F.col("entry_day").cast("date"), "exit_day": F.col("exit_day").cast("date"), "_exit": F.lit("9999-12-31").cast("date"), "decile": F.lit(0).cast("long")})
    pool = spark.createDataFrame([(i + 1, f"60000{i}.SH", 10.0) for i in range(3)], "place long, ts_code string, pool_open double").withColumns({"entry_day": F.lit("2024-01-02").cast("date"), "_exit": F.lit("9999-12-31").cast("date"), "decile": F.lit(0).cast("long")})
    drawn = executions.draw(trips, pool, "decile", 30, 7, ["entry_day", "ts_code", "quantity"]).groupBy("draw").agg(F.count_distinct("drawn_code").alias("n")).collect()
    assert len(drawn) == 30 and max(r["n"] for r in drawn) > 1
