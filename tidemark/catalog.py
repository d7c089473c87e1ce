"""Declared facts about datasets: publication rules, refresh jobs, windows."""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple


class Clock(NamedTuple):
    """One row of the publication table: when rows of a source date become public.

    ``unit`` says what ``offset`` counts: ``days`` of the calendar or ``opens``
    of the market. A ``latest_only`` clock holds for fresh rows alone.
    """

    label: str
    key: str
    clock: str
    unit: str = "days"
    offset: int = 0
    latest_only: bool = False


def checked(table: dict[str, Clock]) -> dict[str, Clock]:
    """The table itself, if every row counts forward in a known unit."""
    wrong = [name for name, row in table.items() if row.unit not in ("days", "opens") or row.offset < 0]
    if wrong:
        raise ValueError(f"bad publication rows: {', '.join(wrong)}")
    return table


@dataclass(frozen=True)
class RefreshNode:
    """A daily job: rows stamped up to ``start`` are queryable from ``start + minutes``.

    ``weekdays`` holds active ISO weekdays (1 = Monday); empty means every day.
    """

    name: str
    start: str
    minutes: int
    weekdays: tuple[int, ...] = ()


# Clocks of the daily tables.
CLOSE_CLOCK = "17:30"
CONTRACTS = checked({
    "daily": Clock("contract_1730_from:trade_date", "trade_date", "17:30"),
    "daily_basic": Clock("contract_1800_from:trade_date", "trade_date", "18:00"),
    "adj_factor": Clock("contract_0930_from:trade_date", "trade_date", "09:30"),
    "stk_limit": Clock("contract_0845_from:trade_date", "trade_date", "08:45"),
    "suspend_d": Clock("contract_0845_from:trade_date", "trade_date", "08:45"),
    "intraday_flow": Clock("contract_1730_from:trade_date", "trade_date", "17:30"),
    "intraday_stats": Clock("contract_1730_from:trade_date", "trade_date", "17:30"),
})

# Macro tables that are public at the close of their data date.
MACRO_CLOSE_KEYS = {
    "shibor": "date", "shibor_quote": "date", "shibor_lpr": "date",
    "repo_daily": "trade_date", "index_daily": "trade_date", "index_dailybasic": "trade_date",
    "sw_daily": "trade_date", "ci_daily": "trade_date", "ths_daily": "trade_date",
    "daily_info": "trade_date", "sz_daily_info": "trade_date", "moneyflow_mkt_dc": "trade_date",
    "fut_basic": "list_date", "fut_mapping": "trade_date", "fut_daily": "trade_date",
    "opt_basic": "list_date", "opt_daily": "trade_date", "cb_basic": "list_date",
    "cb_daily": "trade_date", "index_weight": "trade_date",
}
MACRO_CONTRACTS = checked({name: Clock(f"contract_1730_from:{key}", key, CLOSE_CLOCK) for name, key in MACRO_CLOSE_KEYS.items()})

# Official publication clocks.
OFFICIAL = checked({
    "next_open_09": Clock("official_next_trading_day_09_from:trade_date", "trade_date", "09:00", "opens", 1),
    "preopen_09": Clock("official_preopen_09_from:trade_date", "trade_date", "09:00"),
    "day_16": Clock("official_16_from:trade_date", "trade_date", "16:00"),
    "day_19": Clock("official_19_from:trade_date", "trade_date", "19:00"),
    "day_20": Clock("official_20_from:trade_date", "trade_date", "20:00"),
    "next_day_0830": Clock("official_next_day_0830_from:trade_date", "trade_date", "08:30", "days", 1),
    "latest_2230": Clock("official_latest_2230_from:trade_date", "trade_date", "22:30", latest_only=True),
})

AUCTION_CLOCK = "09:29"
EVENT_CLOCK = "18:00"

# Text stamps are believed within this many days of their date.
TEXT_DAYS_BEFORE, TEXT_DAYS_AFTER = 1.0, 3.0
TEXT_FALLBACK_CLOCKS = {"report_rc": "22:00:00"}

# Refresh jobs, their launch clock and duration in minutes.
EVENING, TEXT, PIT_EVENTS = "cn_evening_full", "cn_nightly_text_full", "cn_nightly_pit_event_build"
NODES = (
    RefreshNode(EVENING, "23:35", 210, (1, 2, 3, 4, 5)),
    RefreshNode(TEXT, "23:15", 15),
    RefreshNode("cn_nightly_anns_full", "23:15", 15),
    RefreshNode("cn_nightly_disclosure_full", "09:45", 10),
    RefreshNode("cn_nightly_global_full", "23:25", 15),
    RefreshNode(PIT_EVENTS, "03:35", 30, (2, 3, 4, 5, 6)),
    RefreshNode("cn_preopen_board_backfill_0850", "08:50", 5),
    RefreshNode("cn_preopen_margin_secs_backfill_0903", "09:03", 2),
    RefreshNode("cn_preopen_margin_secs_retry_0913", "09:13", 2),
    RefreshNode("cn_preopen_margin_backfill_0905", "09:05", 2),
    RefreshNode("cn_preopen_margin_retry_0915", "09:15", 2),
    RefreshNode("cn_open_auction_capture_0927", "09:27", 4),
)

# Which jobs land a dataset; the domain default applies otherwise.
DOMAIN_NODES = {
    "daily": (EVENING,), "intraday_1min": (EVENING,), "macro": (EVENING,), "events": (EVENING,),
    "auction": (), "fundamentals": (PIT_EVENTS,), "text": (TEXT,),
}
DATASET_NODES = {
    ("events", "margin_secs"): ("cn_preopen_margin_secs_backfill_0903", "cn_preopen_margin_secs_retry_0913"),
    ("events", "margin"): ("cn_preopen_margin_backfill_0905", "cn_preopen_margin_retry_0915"),
    ("events", "margin_detail"): ("cn_preopen_margin_backfill_0905", "cn_preopen_margin_retry_0915"),
    ("events", "kpl_list"): (EVENING, "cn_preopen_board_backfill_0850"),
    ("events", "limit_step"): (EVENING, "cn_preopen_board_backfill_0850"),
    ("events", "limit_cpt_list"): (EVENING, "cn_preopen_board_backfill_0850"),
    ("events", "top10_holders"): ("cn_nightly_disclosure_full",),
    ("events", "top10_floatholders"): ("cn_nightly_disclosure_full",),
    ("events", "stk_holdernumber"): ("cn_nightly_disclosure_full",),
    ("events", "stk_holdertrade"): ("cn_nightly_disclosure_full",),
    ("events", "report_rc"): (TEXT,),
    ("text", "anns_d"): ("cn_nightly_anns_full",),
    ("macro", "index_global"): ("cn_nightly_global_full",),
    ("macro", "fx_daily"): ("cn_nightly_global_full",),
    ("macro", "us_tycr"): ("cn_nightly_global_full",),
    ("macro", "us_trycr"): ("cn_nightly_global_full",),
    ("macro", "us_tbr"): ("cn_nightly_global_full",),
    ("macro", "us_tltr"): ("cn_nightly_global_full",),
    ("macro", "eco_cal"): ("cn_nightly_global_full",),
}
REGISTRY_FLOOR = "1990-01-01"
