"""Style factors, loadings and book exposures.

Per-day tables (cuts, fits) have one row per date and are joined as broadcasts;
a date's own cross-section is never gathered into one task unless it is small.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import board
from .asof import asof_join
from .ordered import day_quantiles, day_rank, present
from .screen import with_index

TRADING_DAYS = 244
# Tails, minimum names, turnover window of the factor legs.
TAIL, MIN_NAMES, TURNOVER_DAYS, TURNOVER_MIN_DAYS = 0.30, 30, 20, 10
UNCLASSIFIED = "未分类"


def spread(rows: DataFrame, group: Sequence[str], *, tail: float = TAIL, min_names: int = MIN_NAMES) -> DataFrame:
    """Top-minus-bottom mean of ``pct_chg`` sorted by ``prior``, per group."""
    usable = rows.where("prior is not null and pct_chg is not null and not isnan(prior) and not isnan(pct_chg)")
    cuts = day_quantiles(usable, group, "prior", {"_low": tail, "_high": 1.0 - tail})
    joined = usable.join(F.broadcast(cuts), list(group))
    high = F.avg(F.when(F.col("prior") >= F.col("_high"), F.col("pct_chg")))
    low = F.avg(F.when(F.col("prior") <= F.col("_low"), F.col("pct_chg")))
    days = joined.groupBy(*group).agg((high - low).alias("spread"), F.count(F.lit(1)).alias("names"))
    return days.where((F.col("names") >= min_names) & F.col("spread").isNotNull())


def spread_factor(daily: DataFrame, column: str, key: Column | None = None, **options) -> DataFrame:
    """Spread on each name's previous own row of ``column`` (``key`` re-maps ``prior``)."""
    own = Window.partitionBy("ts_code").orderBy("trade_date")
    rows = daily.select("trade_date", "ts_code", F.lag(column).over(own).alias("prior"), "pct_chg")
    rows = rows.withColumn("prior", key) if key is not None else rows
    return spread(rows, ["trade_date"], **options)


def factor_legs(
    daily: DataFrame, boards: Sequence[str], first_day: Column | None = None, *, tail: float = TAIL, min_names: int = MIN_NAMES,
    window: int = TURNOVER_DAYS, min_days: int = TURNOVER_MIN_DAYS,
) -> DataFrame:
    """Size, value and turnover legs by date, in one pass over the panel.

    Sorting values come from the name's previous row; the turnover mean counts
    trading dates. Only names on permitted ``boards`` enter.
    """
    if not boards:
        raise ValueError("factor legs need the boards the account may buy on")
    pool = with_index(daily.where(board(F.col("ts_code")).isin(*boards)))
    own = Window.partitionBy("ts_code").orderBy("di")
    recent = own.rangeBetween(-(window - 1), 0)
    mean = F.when(F.count("turnover_rate").over(recent) >= min_days, F.avg("turnover_rate").over(recent))
    pool = pool.withColumn("_turnover", mean)
    pb = F.lag("pb").over(own)
    legs = F.array(
        F.struct(F.lit("size").alias("leg"), F.lag("circ_mv").over(own).alias("prior"), F.lit(-1.0).alias("sign")),
        F.struct(F.lit("value").alias("leg"), F.when(pb > 0, 1.0 / pb).alias("prior"), F.lit(1.0).alias("sign")),
        F.struct(F.lit("turnover").alias("leg"), F.lag("_turnover").over(own).alias("prior"), F.lit(-1.0).alias("sign")),
    )
    rows = pool.withColumn("_legs", legs).select("trade_date", "pct_chg", F.explode("_legs").alias("l")).select(
        "trade_date", "pct_chg", "l.leg", "l.prior", "l.sign")
    days = spread(rows, ["leg", "sign", "trade_date"], tail=tail, min_names=min_names)
    out = days.select("leg", "trade_date", (F.col("sign") * F.col("spread")).alias("value"), "names")
    return out.where(F.col("trade_date") >= first_day) if first_day is not None else out


def benchmark_returns(index_rows: DataFrame, code: str) -> DataFrame:
    """Finite daily returns of one index; the source is in percent."""
    value = F.col("pct_chg").try_cast("double") / 100.0
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return index_rows.where((F.col("ts_code") == code) & finite).select("trade_date", value.alias("value"))


def curve_returns(curve: DataFrame, run: str = "run_id") -> DataFrame:
    """Daily returns of equity curves; the first day starts from the initial equity.

    A run has one row per trading day.
    """
    order = Window.partitionBy(run).orderBy("trade_date")
    clean = curve.where("equity is not null and not isnan(equity)")
    opening = F.coalesce(F.lag("equity").over(order), F.col("initial_equity"))
    return clean.withColumn("_open", opening).where("_open > 0").select(run, "trade_date", (F.col("equity") / F.col("_open") - 1).alias("value"))


# -- regression ---------------------------------------------------------------

FIT_SCHEMA = "intercept double, betas array<double>, rss double, tss double, n bigint, collinear boolean"


def factor_ols(df: DataFrame, group: Sequence[str], y: str, legs: Sequence[str]) -> DataFrame:
    """Least squares of ``y`` on an intercept and legs, one fit per group.

    Only means and covariances are aggregated (combinable, any group size); a
    k x k system per group is solved in vectorised batches.
    """
    whole = df.where(" and ".join(f"{name} is not null and not isnan({name})" for name in [y, *legs]))
    names = [y, *legs]
    moments = [F.avg(name).alias(f"_m{i}") for i, name in enumerate(names)]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    moments += [F.covar_pop(names[i], names[j]).alias(f"_c{i}_{j}") for i, j in pairs]
    sums = whole.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), *moments)
    k = len(legs)

    @F.pandas_udf(FIT_SCHEMA)
    def solve(table: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in table.to_dict("records"):
            cross = np.array([[row[f"_c{min(i, j)}_{max(i, j)}"] for j in range(1, k + 1)] for i in range(1, k + 1)])
            target = np.array([row[f"_c0_{i}"] for i in range(1, k + 1)])
            scale = np.sqrt(np.diag(cross))
            flat = bool((scale <= 0).any()) or row["_n"] <= k
            if not flat:
                flat = np.linalg.matrix_rank(cross / np.outer(scale, scale), tol=1e-10) < k
            if flat:
                out.append((None, None, None, row["_n"] * row["_c0_0"], row["_n"], True))
                continue
            betas = np.linalg.solve(cross, target)
            intercept = row["_m0"] - betas @ np.array([row[f"_m{i}"] for i in range(1, k + 1)])
            rss = max(row["_n"] * (row["_c0_0"] - betas @ target), 0.0)
            out.append((intercept, betas.tolist(), rss, row["_n"] * row["_c0_0"], row["_n"], False))
        return pd.DataFrame(out, columns=["intercept", "betas", "rss", "tss", "n", "collinear"])

    inputs = F.struct("_n", *[f"_m{i}" for i in range(k + 1)], *[f"_c{i}_{j}" for i, j in pairs])
    fitted = sums.withColumn("_fit", solve(inputs)).select(*group, "_fit.*")
    shares = [F.try_element_at("betas", F.lit(i + 1)).alias(f"beta_{name}") for i, name in enumerate(legs)]
    degrees = F.col("n") - (k + 1)
    return fitted.select(
        *group, "n", "intercept", *shares, "rss", "collinear",
        F.sqrt(F.try_divide(F.col("rss"), degrees) * TRADING_DAYS).alias("tracking_error"),
        (1 - F.try_divide("rss", "tss")).alias("r2"),
    )


def residuals(df: DataFrame, fits: DataFrame, group: Sequence[str], y: str, legs: Sequence[str]) -> DataFrame:
    """``y`` minus its fitted value; fits are one row per group."""
    joined = df.join(fits.select(*group, "intercept", *[f"beta_{name}" for name in legs]), list(group))
    fitted = F.col("intercept")
    for name in legs:
        fitted = fitted + F.col(f"beta_{name}") * F.col(name)
    return joined.withColumn("residual", F.col(y) - fitted)


# -- exposures ----------------------------------------------------------------


def holdings(curve: DataFrame, run: str = "run_id") -> DataFrame:
    """Positions map to one row per held name and day."""
    rows = curve.select(run, "trade_date", F.explode("positions").alias("ts_code", "quantity"))
    return rows.where("quantity > 0")


def valued_holdings(held: DataFrame, daily: DataFrame, run: str = "run_id") -> DataFrame:
    """Holdings with value, weight and percentile ranks of their day's names."""
    wanted = daily.join(held.select("trade_date").distinct(), "trade_date", "left_semi")
    ranked = wanted
    for column, name in (("circ_mv", "size"), ("pb", "pb"), ("turnover_rate", "turnover")):
        count = F.count_if(present(column)).over(Window.partitionBy("trade_date"))
        ranked = ranked.withColumn(f"rank_{name}", F.coalesce(F.try_divide(day_rank(["trade_date"], column), count), F.lit(0.5)))
    priced = ranked.where("close > 0").select("trade_date", "ts_code", "close", "rank_size", "rank_pb", "rank_turnover")
    rows = held.join(priced, ["trade_date", "ts_code"]).withColumn("held_value", F.col("quantity") * F.col("close"))
    gross = rows.groupBy(run, "trade_date").agg(F.sum("held_value").alias("gross")).where("gross > 0")
    return rows.join(gross, [run, "trade_date"]).withColumn("weight", F.col("held_value") / F.col("gross"))


def style_tilts(valued: DataFrame, run: str = "run_id") -> DataFrame:
    """Value-weighted 2 x (rank - 0.5), averaged over days with holdings."""
    tilt = lambda name: F.sum(F.col("weight") * (F.col(f"rank_{name}") - 0.5) * 2)
    days = valued.groupBy(run, "trade_date").agg(
        *[tilt(name).alias(name) for name in ("size", "pb", "turnover")], F.count(F.lit(1)).alias("names"), F.first("gross").alias("gross"))
    return days.groupBy(run).agg(
        F.count(F.lit(1)).alias("days"), *[F.avg(name).alias(f"tilt_{name}") for name in ("size", "pb", "turnover")],
        F.avg("names").alias("avg_names"), F.avg("gross").alias("avg_long_gross"))


def industry_weights(valued: DataFrame, vintages: DataFrame, run: str = "run_id", top: int = 8) -> DataFrame:
    """Average industry weight under the vintage in force, largest ``top``.

    ``vintages`` has (vintage, ts_code, l1_name); a name missing from the
    vintage is unclassified.
    """
    dates = vintages.select("vintage").distinct()
    days = asof_join(valued.select("trade_date").distinct(), dates, [], "trade_date", "vintage", ["vintage"], bounded=True)
    labelled = valued.join(F.broadcast(days), "trade_date").join(vintages, ["vintage", "ts_code"], "left")
    name = F.when(F.coalesce("l1_name", F.lit("")) == "", UNCLASSIFIED).otherwise(F.col("l1_name"))
    total = valued.groupBy(run).agg(F.count_distinct("trade_date").alias("_days"))
    sums = labelled.groupBy(run, name.alias("industry")).agg(F.sum("weight").alias("_sum")).join(total, run)
    shares = sums.select(run, "industry", (F.col("_sum") / F.col("_days")).alias("weight"))
    order = Window.partitionBy(run).orderBy(F.col("weight").desc(), "industry")
    return shares.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= top)


def active_series(strategy: DataFrame, baseline: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Strategy minus baseline by day; a day without baseline fails."""
    joined = strategy.join(baseline.withColumnRenamed("value", "_base"), list(keys), "left")
    missing = F.raise_error(F.lit("baseline has no return for a strategy day")).cast("double")
    return joined.select(*keys, (F.col("value") - F.coalesce("_base", missing)).alias("value"))


# -- feature panel ------------------------------------------------------------


def feature_panel(daily: DataFrame) -> DataFrame:
    """5/20-day return, 20-day volatility, their daily z-scores, and the label.

    The label says whether the name's next five-day return beats the day's
    median; rows whose future is unknown have none.
    """
    indexed = with_index(daily)
    order = Window.partitionBy("ts_code").orderBy("di")
    close = F.col("close")
    moves = indexed.withColumn("_ret", close / F.lag(close).over(order) - 1)
    recent = order.rowsBetween(-19, 0)
    rows = moves.withColumns({
        "ret_5": close / F.lag(close, 5).over(order) - 1, "ret_20": close / F.lag(close, 20).over(order) - 1,
        "vol_20": F.when(F.count("_ret").over(recent) >= 20, F.stddev_samp("_ret").over(recent)),
        "fwd_5": F.lead(close, 5).over(order) / close - 1,
    }).drop("_ret")
    stats = rows.groupBy("trade_date").agg(*[
        f(name).alias(f"_{tag}_{name}") for name in ("ret_5", "ret_20", "vol_20") for tag, f in (("m", F.avg), ("s", F.stddev_samp))])
    medians = day_quantiles(rows, ["trade_date"], "fwd_5", {"_median": 0.5})
    joined = rows.join(F.broadcast(stats), "trade_date").join(F.broadcast(medians), "trade_date", "left")
    for name in ("ret_5", "ret_20", "vol_20"):
        joined = joined.withColumn(f"z_{name}", F.try_divide(F.col(name) - F.col(f"_m_{name}"), f"_s_{name}")).drop(f"_m_{name}", f"_s_{name}")
    label = F.when(F.col("fwd_5").isNotNull(), (F.col("fwd_5") > F.col("_median")).cast("double"))
    return joined.withColumn("label", label).drop("_median")


def fit_score(panel: DataFrame, features: Sequence[str], train_until: Column, label: str = "label") -> DataFrame:
    """Fit a logistic model on the rows up to a day, score the rows after it."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    ready = panel.dropna(subset=list(features))
    vectors = VectorAssembler(inputCols=list(features), outputCol="_x").transform(ready)
    train = vectors.where((F.col("trade_date") <= train_until) & F.col(label).isNotNull())
    model = LogisticRegression(featuresCol="_x", labelCol=label, probabilityCol="_p", regParam=0.01).fit(train)
    scored = model.transform(vectors.where(F.col("trade_date") > train_until))
    return scored.withColumn("score", vector_to_array("_p")[1]).drop("_x", "_p", "rawPrediction", "prediction")


def equal_budget(scored: DataFrame, n: int, budget: float) -> DataFrame:
    """The ``n`` best scores per date with an equal share of the budget."""
    order = Window.partitionBy("trade_date").orderBy(F.col("score").desc(), "ts_code")
    top = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    counts = top.groupBy("trade_date").agg(F.count(F.lit(1)).alias("_n"))
    return top.join(F.broadcast(counts), "trade_date").withColumn("budget", F.lit(budget) / F.col("_n")).drop("_n")

