"""Listed universe and research screens."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import board
from .ordered import keep_first


@dataclass(frozen=True)
class Screen:
    """Research-universe limits; float cap in units of 1e8, source in 1e4."""

    exclude_st: bool = True
    listed_days: int = 0
    boards: tuple[str, ...] = ()
    min_cap: float | None = None
    max_cap: float | None = None
    min_price: float | None = None
    max_price: float | None = None


def universe_asof(statuses: dict[str, DataFrame], day: Column) -> DataFrame:
    """Codes listed by the day and not delisted by it, first status first."""
    stacked = None
    for rank, df in enumerate(statuses.values()):
        part = df.withColumn("_rank", F.lit(rank))
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    single = keep_first(stacked, ["ts_code"], "_rank", "list_date").drop("_rank")
    out = F.col("delist_date")
    gone = out.isNotNull() & ~out.isin("", "None") & (out <= day)
    return single.where((F.coalesce("list_date", F.lit("")) <= day) & ~gone).drop("delist_date")


def screen_universe(universe: DataFrame, basics: DataFrame, screen: Screen, day: str) -> DataFrame:
    """Codes passing every limit; a missing attribute fails its limit.

    ``basics`` is the latest visible basics partition; ``day`` is YYYY-MM-DD.
    """
    kept = universe
    if screen.exclude_st:
        name = F.upper(F.coalesce("name", F.lit("")))
        kept = kept.where((name != "") & ~name.contains("ST"))
    if screen.listed_days:
        cutoff = F.date_format(F.date_sub(F.lit(day).cast("date"), screen.listed_days), "yyyyMMdd")
        listed = F.coalesce("list_date", F.lit(""))
        kept = kept.where((listed != "") & (listed <= cutoff))
    if screen.boards:
        kept = kept.where(board(F.col("ts_code")).isin(*screen.boards))
    limits = [(F.col("circ_mv") / 1e4, screen.min_cap, screen.max_cap), (F.col("close"), screen.min_price, screen.max_price)]
    if any(low is not None or high is not None for _, low, high in limits):
        kept = kept.join(basics.select("ts_code", "close", "circ_mv"), "ts_code", "left")
        for value, low, high in limits:
            kept = kept.where(value >= low) if low is not None else kept
            kept = kept.where(value <= high) if high is not None else kept
    return kept.select("ts_code").distinct()


def latest_basics(basics: DataFrame, when: Column) -> DataFrame:
    """The newest basics partition public by ``when``."""
    seen = basics.where(F.col("available_at") <= when)
    newest = seen.agg(F.max("trade_date").alias("trade_date"))
    return seen.join(F.broadcast(newest), "trade_date", "left_semi")


# Three-digit prefixes of funds and of B shares.
FUND_PREFIXES = (
    "510", "511", "512", "513", "515", "516", "517", "518", "519", "520", "560", "561", "562", "563", "588",
    "159", "160", "161", "162", "163", "164", "165", "166", "167", "168", "169",
)
B_SHARE_PREFIXES = ("900", "200")


def code_types(df: DataFrame) -> DataFrame:
    """Distinct codes by kind."""
    code = F.col("ts_code")
    prefix, suffix = F.substring(code, 1, 3), F.regexp_extract(code, r"\.([^.]*)$", 1)
    kind = (
        F.when(suffix == "BJ", "BJ").when(prefix.isin(*B_SHARE_PREFIXES), "B_share_like")
        .when(prefix.isin(*FUND_PREFIXES), "fund_or_etf_like").when(suffix.isin("SH", "SZ"), "A_share_like")
        .when(suffix != "", suffix).otherwise("unknown")
    )
    return df.select("ts_code").distinct().groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("codes"))


def active_years(listings: DataFrame, start: str, end: str) -> DataFrame:
    """A listing exploded into calendar-year windows clipped to the span."""
    begin = F.greatest(F.col("list_day"), F.lit(start).cast("date"))
    stop = F.least(F.coalesce("delist_day", F.lit(end).cast("date")), F.lit(end).cast("date"))
    years = listings.where(begin <= stop).withColumns({"_b": begin, "_e": stop}).withColumn("year", F.explode(F.sequence(F.year("_b"), F.year("_e"))))
    return years.select(
        "ts_code", "year",
        F.greatest("_b", F.make_date("year", F.lit(1), F.lit(1))).alias("window_start"),
        F.least("_e", F.make_date("year", F.lit(12), F.lit(31))).alias("window_end"),
    )
