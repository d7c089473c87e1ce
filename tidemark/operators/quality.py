"""Data-quality audits: combinable aggregates that end in finding rows.

A finding is (severity, check, message, details). Counts per key or partition
are aggregated first; only summary rows are ever compared or listed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import compact_date
from .asof import visible_from
from .auction import PRICE_TOLERANCE

SEVERITIES = ("error", "warning", "info")
# Floors and run lengths of the audits.
COVERAGE_FLOOR, ZERO_RUN, CAP_MIN_PERIODS, CAP_MIN_ROWS = 0.90, 60, 3, 1000
PAGE_LIMITS = (5000, 6000, 8000, 10000)
BSE_START = "20230213"
STOCK_CODE = r"^(6\d{5}\.SH|[03]\d{5}\.SZ|\d{6}\.BJ)$"
ANY_CODE = r"^\d{6}\.(SH|SZ|BJ)$"


def blank(column: Column) -> Column:
    return F.trim(F.coalesce(column.cast("string"), F.lit(""))) == ""


def finding(df: DataFrame, severity: Column, check: Column, message: Column, **details: str) -> DataFrame:
    """Summary rows as findings; ``details`` maps a name to a column."""
    entries = []
    for name, column in details.items():
        entries += [F.lit(name), F.col(column).cast("string")]
    return df.select(severity.alias("severity"), check.alias("check"), message.alias("message"), F.create_map(*entries).alias("details"))


# -- reports -------------------------------------------------------------------


def check_findings(findings: DataFrame) -> DataFrame:
    """Fail on a severity outside the vocabulary or a blank check or message."""
    bad = ~F.col("severity").isin(*SEVERITIES) | blank(F.col("check")) | blank(F.col("message")) | F.col("details").isNull()
    refused = F.raise_error(F.concat(F.lit("invalid finding: "), F.coalesce("check", F.lit("?")))).cast("boolean")
    return findings.where(F.when(bad, refused).otherwise(True))


def status_of(errors: Column, warnings: Column) -> Column:
    return F.when(errors > 0, "error").when(warnings > 0, "warning").otherwise("ok")


def report(findings: DataFrame) -> DataFrame:
    """Counts by severity and the report's status, as one row."""
    counts = check_findings(findings).agg(*[F.count_if(F.col("severity") == name).alias(name) for name in SEVERITIES])
    return counts.withColumn("status", status_of(F.col("error"), F.col("warning")))


def owners(checks: DataFrame, datasets: DataFrame) -> DataFrame:
    """The dataset of each check: the longest name that equals it or its beginning up to a ``_``; none: left out."""
    words = F.split("check", "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), "_"))
    cut = checks.select("check").distinct().withColumn("dataset", F.explode(prefixes))
    return cut.join(datasets.select("dataset").distinct(), "dataset").groupBy("check").agg(F.max_by("dataset", F.length("dataset")).alias("dataset"))


def dataset_summary(findings: DataFrame, datasets: DataFrame) -> DataFrame:
    """Counts per dataset; a finding belongs to the longest name prefixing its check."""
    counted = check_findings(findings).groupBy("severity", "check").agg(F.count(F.lit(1)).alias("_n"))
    named = counted.join(owners(counted, datasets), "check")
    sums = named.groupBy("dataset").agg(*[F.sum(F.when(F.col("severity") == s, F.col("_n")).otherwise(0)).alias(s) for s in SEVERITIES])
    whole = datasets.select("dataset").distinct().join(sums, "dataset", "left").na.fill(0, list(SEVERITIES))
    return whole.withColumn("status", status_of(F.col("error"), F.col("warning")))


def gates(reports: DataFrame, domains: DataFrame, generation_at: Column | None = None) -> DataFrame:
    """What each enabled domain's report means for a build.

    ``reports`` has (domain, status, created_at, digest); ``domains`` has
    (domain, critical). A missing or failed report stops a critical domain and
    warns elsewhere; a report older than the data warns.
    """
    joined = domains.join(reports, "domain", "left")
    stale = F.col("created_at") < generation_at if generation_at is not None else F.lit(False)
    problem = F.when(F.col("status").isNull(), "status file missing").when(F.col("status") == "error", "audit status is error")
    note = problem
    note = F.when(problem.isNotNull(), problem).when(F.coalesce(stale, F.lit(False)), "audit status predates current data").when(F.col("status") == "warning", "audit status is warning")
    action = F.when(problem.isNotNull() & F.col("critical"), "stop").when(note.isNotNull(), "warn").otherwise("pass")
    return joined.select("domain", "critical", action.alias("action"), note.alias("note"), "digest")


def require_gates(gated: DataFrame) -> DataFrame:
    """Fail the build when any critical domain stops."""
    stopped = gated.where("action = 'stop'").select("domain", "note").limit(20).collect()
    if stopped:
        raise ValueError(f"data-quality gate failed: {[tuple(row) for row in stopped]}")
    return gated


def digest(findings: DataFrame, severity: str, shown: int = 3) -> DataFrame:
    """One line: how many findings of a severity, then the first few by check."""
    chosen = findings.where(F.col("severity") == severity)
    total = chosen.agg(F.count(F.lit(1)).alias("n"))
    first = chosen.orderBy("check", "message").limit(shown).agg(F.array_sort(F.collect_list(F.concat_ws(": ", "check", "message"))).alias("lines"))
    more = F.when(F.col("n") > shown, F.concat(F.lit("; (+"), (F.col("n") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    head = F.concat(F.col("n").cast("string"), F.lit(f" {severity} findings"))
    return total.join(first).select(F.concat(F.array_join(F.concat(F.array(head), F.col("lines")), "; "), more).alias("digest"))


# -- tables --------------------------------------------------------------------


def audit_keys(df: DataFrame, keys: Sequence[str], partition: str | None = None, day: str | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Rows, blank keys, repeated keys, and rows filed under another partition."""
    missing = [key for key in keys if key not in df.columns]
    if missing:
        raise ValueError(f"table lacks key columns {missing}")
    any_blank = F.lit(False)
    for key in keys:
        any_blank = any_blank | blank(F.col(key))
    wrong = (F.col(partition) != F.col(day)) if partition and day else F.lit(False)
    copies = df.groupBy(*group, *[k for k in keys if k not in group]).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(any_blank).alias("_blank"), F.count_if(F.coalesce(wrong, F.lit(True))).alias("_wrong"))
    return copies.groupBy(*group).agg(
        F.sum("_n").alias("rows"), F.sum("_blank").alias("blank_key_rows"), F.sum(F.col("_n") - 1).alias("duplicate_rows"), F.sum("_wrong").alias("misfiled_rows"))


def audit_available(df: DataFrame, text: str = "available_at", group: Sequence[str] = ()) -> DataFrame:
    """Blank and unreadable availability stamps."""
    from ..functions.times import market_time

    stamp = market_time(F.col(text))
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(blank(F.col(text))).alias("blank"), F.count_if(~blank(F.col(text)) & stamp.isNull()).alias("unreadable"))


def inventory(df: DataFrame, dataset: str, partition: str) -> DataFrame:
    """Rows per partition, ready for the inventory audit."""
    return df.groupBy(F.col(dataset).alias("dataset"), F.col(partition).alias("partition")).agg(F.count(F.lit(1)).alias("rows"))


def audit_inventory(files: DataFrame, expected: DataFrame) -> DataFrame:
    """Per dataset: zero, page-limit-sized, missing and unexpected partitions, span."""
    want = expected.select("dataset", "partition").distinct().withColumn("_want", F.lit(True))
    both = files.join(want, ["dataset", "partition"], "full_outer")
    return both.groupBy("dataset").agg(
        F.count("rows").alias("files"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count_if(F.col("rows") == 0).alias("zero_files"),
        F.count_if(F.col("rows").isin(*PAGE_LIMITS)).alias("limit_files"), F.count_if(F.col("rows").isNull()).alias("missing_files"),
        F.count_if(F.col("_want").isNull()).alias("extra_files"), F.min(F.when(F.col("rows") > 0, F.col("partition"))).alias("first_nonzero"),
        F.max(F.when(F.col("rows") > 0, F.col("partition"))).alias("last_nonzero"))


def stale_sources(files: DataFrame, source: str = "source", run: int = ZERO_RUN) -> DataFrame:
    """Trailing run of empty partitions per source; a long one means a dead feed."""
    last = files.groupBy(source).agg(F.max(F.when(F.col("rows") > 0, F.col("partition"))).alias("_last"))
    tail = files.join(last, source).where(F.col("_last").isNull() | (F.col("partition") > F.col("_last")))
    runs = tail.groupBy(source).agg(F.count(F.lit(1)).alias("trailing_zero"))
    out = last.select(source, F.col("_last").alias("last_nonzero")).join(runs, source, "left").na.fill(0, ["trailing_zero"])
    return out.withColumn("dead", F.col("trailing_zero") >= run)


def audit_payload(df: DataFrame, partition: str, keys: Sequence[str], expected: Sequence[str] = (), require: bool = False) -> DataFrame:
    """Newest non-empty partition: missing fields, all-blank columns, hollow payload."""
    skipped = {partition, *keys, "available_at", "available_at_rule"}
    business = [name for name in df.columns if name not in skipped]
    newest = df.agg(F.max(partition).alias("_p"))
    latest = df.join(F.broadcast(newest), F.col(partition) == F.col("_p"))
    counts = latest.groupBy(F.col("_p").alias("partition")).agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(~blank(F.col(name))).alias(f"_{name}") for name in business])
    empty = F.array_compact(F.array(*[F.when(F.col(f"_{name}") == 0, F.lit(name)) for name in business])) if business else F.array().cast("array<string>")
    lost = sorted(set(expected) - set(df.columns))
    wanted = [name for name in expected if name not in skipped]
    hollow = (F.size(empty) == len(business)) if business else F.lit(require)
    if wanted and all(name in lost for name in wanted):
        hollow = F.lit(True)
    severity = F.when(hollow, "error").when(F.lit(bool(lost)), "warning").otherwise("info")
    return counts.select("partition", "rows", F.lit(len(business)).cast("long").alias("business_columns"), empty.alias("all_null_columns"),
                         F.lit(",".join(lost)).alias("missing_fields"), hollow.alias("payload_empty"), severity.alias("severity"))


def audit_coverage(tables: DataFrame, base: DataFrame, floor: float = COVERAGE_FLOOR) -> DataFrame:
    """Share of each day's base codes a full-market table carries.

    ``tables`` has (dataset, trade_date, ts_code). Days without rows on either
    side belong to the inventory audit.
    """
    keys = ["trade_date", "ts_code"]
    codes = base.select(*keys).distinct()
    sizes = codes.groupBy("trade_date").agg(F.count(F.lit(1)).alias("base_codes"))
    held = tables.select("dataset", *keys).distinct().join(codes.withColumn("_in", F.lit(True)), keys, "left")
    days = held.groupBy("dataset", "trade_date").agg(F.count(F.lit(1)).alias("dataset_codes"), F.count("_in").alias("_shared"))
    joined = days.join(F.broadcast(sizes), "trade_date").withColumn("coverage", F.col("_shared") / F.col("base_codes"))
    return joined.select("dataset", "trade_date", "dataset_codes", "base_codes", "coverage", (F.col("coverage") < floor).alias("low"))


def cross_coverage(left: DataFrame, right: DataFrame) -> DataFrame:
    """Codes only one of two tables has, per day; days both tables lack are absent."""
    keys = ["trade_date", "ts_code"]
    stacked = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    per_code = stacked.groupBy(*keys).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    return per_code.groupBy("trade_date").agg(
        F.sum("_l").alias("left_codes"), F.sum("_r").alias("right_codes"), F.count_if((F.col("_l") == 1) & (F.col("_r") == 0)).alias("left_only"),
        F.count_if((F.col("_l") == 0) & (F.col("_r") == 1)).alias("right_only"))


def worst_day(days: DataFrame) -> DataFrame:
    """The day with most one-sided codes, and totals."""
    gap = F.col("left_only") + F.col("right_only")
    return days.agg(F.count(F.lit(1)).alias("days"), F.sum("left_only").alias("left_only"), F.sum("right_only").alias("right_only"),
                    F.min_by("trade_date", F.struct(-gap, F.col("trade_date"))).alias("worst_day"), F.max(gap).alias("worst_gap"))


def audit_exchanges(df: DataFrame, day: str = "trade_date", exchange: str = "exchange_id") -> DataFrame:
    """Required exchanges each day lacks; one joined the list on a fixed date."""
    days = df.groupBy(day).agg(F.collect_set(exchange).alias("_have"))
    required = F.when(F.col(day) >= BSE_START, F.array(F.lit("SSE"), F.lit("SZSE"), F.lit("BSE"))).otherwise(F.array(F.lit("SSE"), F.lit("SZSE")))
    return days.withColumn("missing", F.array_sort(F.array_except(required, "_have"))).where(F.size("missing") > 0).drop("_have")


def cap_plateau(counts: DataFrame, min_periods: int = CAP_MIN_PERIODS, min_rows: int = CAP_MIN_ROWS) -> DataFrame:
    """Datasets with several periods pinned at exactly their largest row count."""
    peaks = counts.groupBy("dataset").agg(F.max("rows").alias("max_rows"))
    pinned = counts.join(F.broadcast(peaks), "dataset").where(F.col("rows") == F.col("max_rows"))
    out = pinned.groupBy("dataset", "max_rows").agg(F.count(F.lit(1)).alias("periods_at_max"), F.min("period").alias("first_period"))
    return out.where((F.col("max_rows") >= min_rows) & (F.col("periods_at_max") >= min_periods))


def audit_identity(df: DataFrame) -> DataFrame:
    """Physical events dated more than once: groups, stale rows, undated rows."""
    holder = F.regexp_replace(F.coalesce("holder_name", F.lit("")), r"\s+", "")
    marked = df.select("ts_code", "float_date", holder.alias("_h"), "share_type", F.coalesce(F.trim("ann_date"), F.lit("")).alias("_ann"))
    dated = marked.groupBy("ts_code", "float_date", "_h", "share_type", "_ann").agg(F.count(F.lit(1)).alias("_n"))
    events = dated.groupBy("ts_code", "float_date", "_h", "share_type").agg(
        F.count(F.lit(1)).alias("_datings"), F.sum("_n").alias("_rows"), F.max(F.struct("_ann", "_n")).alias("_newest"),
        F.sum(F.when(F.col("_ann") == "", F.col("_n")).otherwise(0)).alias("_undated"))
    multi = events.where("_datings > 1")
    return multi.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("_rows") - F.col("_newest._n")), F.lit(0)).alias("stale_rows"), F.coalesce(F.sum("_undated"), F.lit(0)).alias("undated_rows"))


def audit_reference(df: DataFrame, slices: Sequence[str], slice_column: str, keys: Sequence[str], required: Sequence[str] = ()) -> DataFrame:
    """Reference table: required slices, repeated keys, blank required columns."""
    blanks = [F.count_if(blank(F.col(name))).alias(f"blank_{name}") for name in required]
    rows = df.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(*keys).alias("_keys"), F.collect_set(slice_column).alias("_have"), *blanks)
    missing = F.array_join(F.array_sort(F.array_except(F.array(*[F.lit(s) for s in slices]), "_have")), ",")
    return rows.select("rows", (F.col("rows") - F.col("_keys")).alias("duplicates"), missing.alias("missing_slices"), *[f"blank_{name}" for name in required])


def section_months(weights: DataFrame, start: str, end: str) -> DataFrame:
    """Months without a constituent section, per index."""
    from .asof import missing_months

    have = weights.select(F.col("index_code").alias("dataset"), F.date_format("trade_date", "yyyyMM").alias("available_month"))
    return missing_months(have, start, end).withColumnsRenamed({"dataset": "index_code", "available_month": "month"})


def audit_events(events: DataFrame, start: Column, end: Column, allowed_rules: str, happened: Sequence[str] = ()) -> DataFrame:
    """Event store per dataset: stamps, window, month, rule, source, backdating, copies."""
    stamp = F.col("available_at")
    visible = visible_from(stamp, F.col("first_seen_at") if "first_seen_at" in events.columns else None)
    late = F.lit(False)
    for name in happened:
        late = late | F.coalesce(stamp < compact_date(F.col(name)).cast("timestamp_ntz"), F.lit(False))
    flags = {
        "unreadable": stamp.isNull(), "outside_window": F.coalesce((visible < start) | (visible > end), F.lit(False)),
        "wrong_month": F.coalesce(F.date_format(stamp, "yyyyMM") != F.col("available_month"), F.lit(False)),
        "bad_rule": ~F.coalesce(F.col("available_at_rule").rlike(allowed_rules), F.lit(False)), "blank_source": blank(F.col("source_path")),
        "wrong_source": ~F.coalesce(F.expr("contains(source_path, concat('/', dataset, '/'))"), F.lit(False)), "blank_write_id": blank(F.col("source_write_id")),
        "bad_row_id": F.col("source_row_id").isNull(), "backdated": late,
    }
    copies = events.groupBy("dataset", "business_key", "available_at").agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(flag).alias(name) for name, flag in flags.items()])
    sums = copies.groupBy("dataset").agg(F.sum("_n").alias("rows"), *[F.sum(name).alias(name) for name in flags], F.sum(F.when(F.col("_n") > 1, F.col("_n")).otherwise(0)).alias("duplicate_rows"))
    hard = [name for name in flags if name != "blank_write_id"]
    errors = sum((F.col(name) for name in hard), F.lit(0))
    return sums.withColumn("severity", F.when(errors > 0, "error").when((F.col("duplicate_rows") > 0) | (F.col("blank_write_id") > 0), "warning").otherwise("info"))


def audit_commits(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Data files against their records: write id, row count, strays, orphans."""
    both = files.join(meta, "path", "full_outer")
    problem = (
        F.when(F.col("path").rlike(r"(\.tmp|\.staged|~)$"), "stray_file").when(F.col("file_rows").isNull(), "record_without_file")
        .when(F.col("meta_rows").isNull(), "file_without_record").when(~F.col("file_id").eqNullSafe(F.col("meta_id")), "write_id_mismatch")
        .when(F.col("file_rows") != F.col("meta_rows"), "row_count_mismatch"))
    return both.withColumn("problem", problem).where("problem is not null").select("path", "problem")


def rotation_offset(seed: str, size: int) -> int:
    """Start of a rotated sample: the seed's digest within the list."""
    return int(hashlib.md5(seed.encode(), usedforsecurity=False).hexdigest()[:7], 16) % max(size, 1)


def rotate_sample(keys: DataFrame, column: str, n: int, seed: str) -> DataFrame:
    """``n`` consecutive keys of the ordered list, starting at the seed's offset.

    The list is a calendar or partition inventory, so it is small.
    """
    size = keys.select(column).distinct().count()
    start = rotation_offset(seed, size)
    numbered = keys.select(column).distinct().withColumn("_i", F.row_number().over(Window.orderBy(column)) - 1)
    return numbered.where(F.pmod(F.col("_i") - start, F.lit(max(size, 1))) < n).select(column)


def sentinel(old: DataFrame, new: DataFrame, dates: DataFrame, keys: Sequence[str], day: str = "trade_date", *, structural_keys: int = 20, structural_share: float = 0.20) -> DataFrame:
    """Key differences per sampled date between the lake and a fresh answer."""
    from .versions import diff, diff_counts

    chosen = F.broadcast(dates.select(day).distinct())
    changes = diff(old.join(chosen, day, "left_semi"), new.join(chosen, day, "left_semi"), [day, *[k for k in keys if k != day]])
    counts = diff_counts(changes, [day])
    touched = F.col("removed") + F.col("changed")
    structural = (touched > structural_keys) & (touched > structural_share * F.col("old_keys"))
    return counts.withColumns({"event": (F.col("added") + touched) > 0, "structural": structural})


def sentinel_verdict(days: DataFrame, min_dates: int = 5, ratio: float = 0.25) -> DataFrame:
    """Escalate when many sampled dates changed structurally."""
    out = days.agg(F.count(F.lit(1)).alias("checked"), F.count_if("event").alias("events"), F.count_if("structural").alias("structural"))
    return out.withColumn("massive_revision", (F.col("structural") >= min_dates) & (F.col("structural") >= ratio * F.col("checked")))


def validate_auction(df: DataFrame, floor: int = 0, ratio: float = 0.85, feed: Sequence[str] = ()) -> DataFrame:
    """Auction capture per day, its row floor taken from the day before.

    Rows of one day and code are copies of each other unless they differ in the ``feed`` columns.
    """
    price, vol, amount = (F.col(name).cast("double") for name in ("price", "vol", "amount"))
    bad_vol = vol.isNull() | F.isnan(vol) | (vol < 0)
    bad_amount = amount.isNull() | F.isnan(amount) | (amount < 0)
    fine = ~bad_vol & ~bad_amount
    both = fine & (vol > 0) & (amount > 0)
    priced = price.isNotNull() & (price > 0)
    recovered = F.try_divide(amount, vol)
    off = both & priced & (F.abs(price - recovered) > PRICE_TOLERANCE + 1e-9 * F.abs(recovered))
    per_code = df.groupBy("trade_date", "ts_code", *feed).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(bad_vol).alias("_v"), F.count_if(bad_amount).alias("_a"),
        F.count_if(fine & ((vol > 0) | (amount > 0)) & ~both).alias("_i"), F.count_if(off).alias("_m"), F.count_if(fine & (vol == 0) & (amount == 0) & priced).alias("_h"))
    days = per_code.groupBy("trade_date").agg(
        F.sum("_n").alias("rows"), F.sum(F.col("_n") - 1).alias("duplicate_keys"), F.count_if(~F.col("ts_code").rlike(ANY_CODE)).alias("invalid_codes"),
        F.sum(F.when(F.col("ts_code").rlike(STOCK_CODE), F.col("_n")).otherwise(0)).alias("stock_rows"), F.sum("_v").alias("invalid_vol"), F.sum("_a").alias("invalid_amount"),
        F.sum("_i").alias("inconsistent"), F.sum("_m").alias("price_mismatch"), F.sum("_h").alias("hidden_price"))
    previous = F.lag("stock_rows").over(Window.orderBy("trade_date"))
    least = F.greatest(F.lit(floor), F.floor(F.coalesce(previous, F.lit(0)) * ratio))
    return days.withColumn("min_rows", least).withColumn("truncated", F.col("stock_rows") < F.col("min_rows"))


def audit_universe(basic: DataFrame, others: dict[str, DataFrame]) -> DataFrame:
    """Codes of the listing table against each other table's."""
    held = basic.select("ts_code").distinct().withColumn("_b", F.lit(1))
    out = None
    for name, df in others.items():
        both = held.join(df.select("ts_code").distinct().withColumn("_o", F.lit(1)), "ts_code", "full_outer")
        row = both.agg(F.lit(name).alias("other"), F.count_if(F.col("_b").isNotNull() & F.col("_o").isNotNull()).alias("shared"),
                       F.count_if(F.col("_o").isNull()).alias("basic_only"), F.count_if(F.col("_b").isNull()).alias("other_only"))
        out = row if out is None else out.unionByName(row)
    return out


def profile(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Nulls, smallest and largest value of every column, in one aggregate pass."""
    names = [name for name in df.columns if name not in group]
    aggs = [F.count(F.lit(1)).alias("rows")]
    for i, name in enumerate(names):
        text = F.col(name).cast("string")
        aggs += [F.count_if(F.col(name).isNull()).alias(f"_n{i}"), F.min(text).alias(f"_lo{i}"), F.max(text).alias(f"_hi{i}")]
    wide = df.groupBy(*group).agg(*aggs)
    rows = F.explode(F.array(*[
        F.struct(F.lit(name).alias("column"), F.col(f"_n{i}").alias("nulls"), F.col(f"_lo{i}").alias("smallest"), F.col(f"_hi{i}").alias("largest")) for i, name in enumerate(names)]))
    return wide.select(*group, "rows", rows.alias("r")).select(*group, "rows", "r.*")


def asof_ranges(view: DataFrame, group: str = "domain", day: str = "event_date") -> DataFrame:
    """Rows and first and last date per domain."""
    return view.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.min(day).alias("first"), F.max(day).alias("last"))


def require_history(tables: dict[str, DataFrame], code: str, start: Column) -> DataFrame:
    """Whether an index exists in each table and begins before the start."""
    out = None
    for name, df in tables.items():
        row = df.where(F.col("ts_code") == code).agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), F.min("trade_date").alias("first_day"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("covered", (F.col("rows") > 0) & (F.col("first_day") < start))


def compare_readings(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], value: str = "value", tolerance: float = 0.0) -> DataFrame:
    """Readings whose recomputed value differs, or that exist on one side only."""
    joined = stored.withColumn("_s", F.lit(1)).withColumnRenamed(value, "stored").join(
        fresh.withColumn("_f", F.lit(1)).withColumnRenamed(value, "recomputed"), list(keys), "full_outer")
    equal = F.col("stored").eqNullSafe(F.col("recomputed")) | F.coalesce(F.abs(F.col("stored") - F.col("recomputed")) <= tolerance, F.lit(False))
    problem = F.when(F.col("_s").isNull(), "not_stored").when(F.col("_f").isNull(), "not_recomputed").when(~equal, "differs")
    return joined.withColumn("problem", problem).where("problem is not null").select(*keys, "stored", "recomputed", "problem")
