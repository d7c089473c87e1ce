"""Lake reads, ledgers, sinks and streams, through the shared scratch folder."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import stamps
from ..registry import query
from ..session import scratch_folder
from ..sources import events as event_store, lake, ledger, sinks
from ..sources.tables import table
from ..streaming import streams
from .adapters import DATASET_NAMES, FILINGS_SQL, MINUTES_SQL, NOTICES_SQL, filings, minutes, notices, r, text_of, with_sql
from .corpus import LOG_SQL, trace
from .intraday import PATH_SQL, SIGN_SQL
from .visibility import ASSIGN_SQL, INSTANCES_SQL, VISIBLE_SQL, nodes_values, span


def lake_of(spark, sf, key="month", width=6):
    """The notices written as a ``key=value`` lake; days carry their clock-free date."""
    folder = scratch_folder(spark, "lake")
    df = notices(spark, sf).select("id", "dataset", "event_date", "amount", F.substring("event_date", 1, width).alias(key))
    df.repartition(key).write.partitionBy(key).parquet(folder)
    return folder


@query("src01_range_scan", with_sql(NOTICES_SQL) + "select id, dataset, left(event_date, 6) as partition_value from notices where left(event_date, 6) between '199701' and '199806'")
def _(spark, sf):
    return lake.read_range(spark, lake_of(spark, sf), "199701", "199806", ["id", "dataset", lake.PARTITION])


@query("src01_hive_scan", with_sql(NOTICES_SQL) + "select id, amount from notices where left(event_date, 6) between '199701' and '199806'")
def _(spark, sf):
    return lake.read_hive(spark, lake_of(spark, sf), "month", "199701", "199806", ["id", "amount"])


@query("src02_window_pruning", with_sql(NOTICES_SQL) + "select id from notices where left(event_date, 4) between '1997' and '1998'")
def _(spark, sf):
    return lake.read_window(spark, lake_of(spark, sf, "year", 4), "19970315", "19980620").select("id")


# Each dataset brings its own columns: id and one of amount, ts_code, priority.
_OWN = {name: ("amount", "ts_code", "priority")[n % 3] for n, name in enumerate(DATASET_NAMES)}
_OWN_SQL = ", ".join("count(case when dataset in ({}) then {} end) as {}".format(", ".join(f"'{n}'" for n, c in _OWN.items() if c == column), column, f"{column}s") for column in ("amount", "ts_code", "priority"))


@query("src03_dataset_union", with_sql(NOTICES_SQL) + f"select dataset, count(*) as rows, {_OWN_SQL} from notices group by all")
def _(spark, sf):
    df = notices(spark, sf)
    union = lake.union_datasets({name: df.where(F.col("dataset") == name).select("id", column) for name, column in _OWN.items()})
    return union.groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"{c}s") for c in ("amount", "ts_code", "priority")])


@query("src04_padded_union", with_sql(NOTICES_SQL) + "select id, cast(null as double) as pages, cast(null as varchar) as note, cast(null as boolean) as final from notices")
def _(spark, sf):
    declared = T.StructType([T.StructField("id", T.LongType()), T.StructField("pages", T.IntegerType()), T.StructField("note", T.StringType()), T.StructField("final", T.BooleanType())])
    return lake.pad_union(notices(spark, sf).select("id"), [declared])


@query("src05_source_trees", with_sql(NOTICES_SQL) + "select dataset as src, count(*) as rows from notices where dataset in ('margin', 'report_rc') and left(event_date, 6) between '199701' and '199712' group by all")
def _(spark, sf):
    folder = scratch_folder(spark, "news")
    notices(spark, sf).select("id", F.col("dataset").alias("src"), F.substring("event_date", 1, 6).alias("month")).repartition("src").write.partitionBy("src", "month").parquet(folder)
    return lake.read_sources(spark, folder, ["margin", "report_rc"], ("199701", "199712")).groupBy("src").agg(F.count(F.lit(1)).alias("rows"))


LEDGER_SCHEMA = T.StructType([T.StructField("event_id", T.StringType()), T.StructField("dataset", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("detected_at", T.StringType())])


def revisions(spark, sf):
    return notices(spark, sf).select(F.col("id").cast("string").alias("event_id"), "dataset", F.col("code_no").alias("rows"), F.col("event_date").alias("detected_at"))


@query("src06_ledger_read", with_sql(NOTICES_SQL) + "select count(*) as lines, count(*) filter (where id % 100 = 0) as damaged from notices")
def _(spark, sf):
    folder = scratch_folder(spark, "ledger")
    lines = revisions(spark, sf).select(F.when(F.col("event_id").cast("long") % 100 == 0, F.lit('{"event_id": "cut')).otherwise(F.to_json(F.struct("*"))).alias("value"))
    lines.write.option("compression", "none").format("text").save(f"{folder}/text")
    return spark.read.text(f"{folder}/text").select(F.from_json("value", T.StructType([*LEDGER_SCHEMA.fields, T.StructField("_damaged", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"}).alias("r")).agg(
        F.count(F.lit(1)).alias("lines"), F.count("r._damaged").alias("damaged"))


@query("src06_ledger_rows", with_sql(NOTICES_SQL) + "select cast(id as varchar) as event_id, dataset, code_no as rows from notices")
def _(spark, sf):
    folder = scratch_folder(spark, "ledger")
    revisions(spark, sf).write.json(folder)
    return ledger.read_jsonl(spark, folder, LEDGER_SCHEMA).select("event_id", "dataset", "rows")


@query("src07_unique_append", with_sql(NOTICES_SQL) + "select cast(id as varchar) as event_id, count(*) as copies from notices where id % 3 = 0 or id % 5 = 0 group by all")
def _(spark, sf):
    folder = scratch_folder(spark, "ledger")
    rows = revisions(spark, sf)
    rows.where("event_id % 3 = 0").write.json(folder)
    held = ledger.read_jsonl(spark, folder, LEDGER_SCHEMA)
    ledger.append_unique(folder, held, rows.where("event_id % 5 = 0").unionByName(rows.where("event_id % 15 = 0")), "event_id")
    return ledger.read_jsonl(spark, folder, LEDGER_SCHEMA).groupBy("event_id").agg(F.count(F.lit(1)).alias("copies"))


@query("src08_date_major", with_sql(MINUTES_SQL) + "select trade_date, count(*) as bars, count(distinct ts_code) as codes, round(sum(vol), 2) as vol from minutes group by all")
def _(spark, sf):
    folder = scratch_folder(spark, "bars")
    lake.repartition_by_date(minutes(spark, sf), folder, target_bytes=20_000)
    back = spark.read.parquet(folder).withColumn("trade_date", F.col("trade_date").cast("string"))
    return back.groupBy("trade_date").agg(F.count(F.lit(1)).alias("bars"), F.count_distinct("ts_code").alias("codes"), r(F.sum("vol"), 2).alias("vol"))


@query("sink01_missing_build", with_sql(MINUTES_SQL) + "select trade_date, count(*) as rows from (select distinct trade_date, ts_code from minutes where trade_date >= '20240111') group by all")
def _(spark, sf):
    folder = scratch_folder(spark, "derived")
    bars = minutes(spark, sf)
    reduce = lambda df: df.groupBy("trade_date", "ts_code").agg(F.sum("vol").alias("vol"))
    sinks.build_missing(bars.where("trade_date < '20240111'"), folder, reduce)
    return sinks.build_missing(bars, folder, reduce)


@query("sink02_event_months", with_sql(FILINGS_SQL, """ev as (select *, try_strptime(coalesce(f_ann_date, nullif(ann_date, '')), '%Y%m%d') + interval 18 hour as av from filings),
   dd as (select ts_code || '|' || end_date as k, av, max(id) as id from ev where strftime(av, '%Y%m') in ('199701', '199702', '199703') group by all)""") + """
select m.available_month, cast(coalesce(n, 0) as bigint) as rows from (select unnest(['199701', '199702', '199703', '202001']) as available_month) m left join (select strftime(av, '%Y%m') as available_month, count(*) as n from dd group by all) using (available_month)""")
def _(spark, sf):
    df = stamps.stamp_fundamental("income_vip", filings(spark, sf))
    rows = df.select(F.lit("income_vip").alias("dataset"), "ts_code", F.concat_ws("|", "ts_code", "end_date").alias("business_key"), "available_at", F.date_format("available_at", "yyyyMM").alias("available_month"),
                     F.lit(0).alias("version_rank"), F.col("id").alias("source_row_id"), "amount")
    folder = scratch_folder(spark, "events")
    months = ["199701", "199702", "199703", "202001"]
    event_store.write_event_months(rows, folder, months, ["income_vip"])
    return event_store.write_event_months(rows, folder, months, ["income_vip"]).select("available_month", "rows")


@query("sink03_orders_export", "select cast(o_orderkey as varchar) as symbol, round(o_totalprice, 2) as price from orders")
def _(spark, sf):
    folder = scratch_folder(spark, "csv")
    sinks.export_orders(table(spark, sf, "orders").select(F.col("o_orderkey").alias("symbol"), F.col("o_totalprice").alias("price")), folder)
    back = spark.read.option("header", "true").csv(folder)
    return back.select("symbol", r(F.col("price").cast("double"), 2).alias("price"))


@query("sink04_view_manifest", with_sql(NOTICES_SQL) + """
select 'decision' as kind, '1998-06-15 09:25:00' as decision_time, domain, '1997-06-15' as window_start, count(*) as rows, min(event_date) as coverage_start, max(event_date) as coverage_end, string_agg(distinct dataset, ',' order by dataset) as datasets
from notices where available_at <= timestamp '1998-06-15 09:25:00' group by domain""")
def _(spark, sf):
    seen = notices(spark, sf).where(F.col("available_at") <= F.lit("1998-06-15 09:25:00").cast("timestamp_ntz"))
    domains = {name: seen.where(F.col("domain") == name) for name in ("events", "macro")}
    rows = sinks.manifest(domains, "decision", "1998-06-15 09:25:00", dict.fromkeys(domains, "1997-06-15"), dict.fromkeys(domains, "event_date"))
    folder = scratch_folder(spark, "manifest")
    sinks.write_manifest(rows, folder)
    return spark.read.json(folder)


# -- streams ------------------------------------------------------------------------

def as_stream(spark, parts, files=4):
    """Tables written one after the other, as many files each, and read back in order, one table per micro-batch."""
    folder = scratch_folder(spark, "incoming")
    for part in parts:
        part.repartition(files).write.mode("append").parquet(folder)
    return streams.read_stream(spark, folder, parts[0].schema, files_per_batch=files)


def dealt(df, column, parts=4):
    """The rows of a table by remainder, in order."""
    return [df.where(F.col(column) % parts == n) for n in range(parts)]


@query("str01_incremental_visibility", with_sql(NOTICES_SQL, ASSIGN_SQL, nodes_values(), INSTANCES_SQL, VISIBLE_SQL) + "select id, cast(visible_at as varchar) as visible_at from shown")
def _(spark, sf):
    stream = as_stream(spark, dealt(notices(spark, sf), "id"))
    out = scratch_folder(spark, "visible")
    shown = streams.stream_visible(stream, spark, *span(spark, sf), first_seen="seen_at").select("id", "visible_at")
    shown.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_folder(spark, "cp")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("id", text_of(F.col("visible_at")).alias("visible_at"))


# Receipts come by remainder of the id, each remainder a day later; the first lot comes again at the end.
@query("str02_first_seen", with_sql(NOTICES_SQL) + """
select ts_code, dataset, 1::bigint as copies, strftime(min(event_day + to_days(cast(lot as integer))), '%Y-%m-%d') as first_seen_at
from (select *, id % 4 as lot, min(id % 4) over (partition by ts_code, dataset) as first_lot from notices) where lot = first_lot group by all""")
def _(spark, sf):
    out = scratch_folder(spark, "seen")
    rows = notices(spark, sf).select("id", "ts_code", "dataset", F.date_add("event_day", (F.col("id") % 4).cast("int")).alias("received"))
    lots = dealt(rows, "id")
    stream = as_stream(spark, [*lots, lots[0]])
    streams.track_first_seen(stream, out, scratch_folder(spark, "cp"), ["ts_code", "dataset"], "received").awaitTermination()
    seen = spark.read.parquet(out).groupBy("ts_code", "dataset").agg(F.count(F.lit(1)).alias("copies"), F.min("first_seen_at").alias("first_seen_at"))
    return seen.withColumn("first_seen_at", F.col("first_seen_at").cast("string"))


def publish_answers(spark, answers, keys, columns, dataset=""):
    """The folder of a stream that published these answers, rows and claims, in order."""
    folder = scratch_folder(spark, "publish")
    stream = as_stream(spark, answers)
    step = streams.publish_step(folder, "dataset", keys, columns, dataset=dataset, claim="claim")
    streams.run_batches(stream, step, scratch_folder(spark, "cp")).awaitTermination()
    return folder


def claims_of(rows, *names):
    """Rows that claim partitions and hold nothing else."""
    blank = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != "dataset" else F.col("dataset") for f in rows.schema.fields]
    return rows.where(F.col("dataset").isin(*names)).groupBy("dataset").agg(F.max("dataset").alias("_")).select(*blank, F.lit(True).alias("claim"))


@query("str03_versioned_upsert", with_sql(NOTICES_SQL) + "select dataset, count(*) as rows, round(sum(amount + case when id % 7 = 0 then 1 else 0 end), 2) as amount from notices group by all")
def _(spark, sf):
    rows = notices(spark, sf).select("id", "dataset", "amount").withColumn("claim", F.lit(False))
    # Three answers in order: part of the rows, all rows, all rows with restated amounts.
    restated = rows.withColumn("amount", F.when(F.col("id") % 7 == 0, F.col("amount") + 1).otherwise(F.col("amount")))
    folder = publish_answers(spark, [rows.where("id % 2 = 0"), rows, restated], ["id"], ["id", "dataset", "amount"])
    shown = streams.visible_rows(spark, folder, "dataset", ["id", "dataset", "amount"])
    return shown.groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"), r(F.sum("amount"), 2).alias("amount"))


# The second answer empties 'margin', keeps a tenth of 'kpl_list', re-dates half of 'report_rc', appends to
# 'daily_info', repeats 'index_global' and says nothing of 'fut_basic'. Of a dividend's key the date is filled in late.
@query("str03_defect", with_sql(NOTICES_SQL, """first as (select dataset, id, event_date as ann_date, amount from notices where not (dataset = 'daily_info' and id % 5 = 0)),
  second as (select dataset, id, case when dataset = 'report_rc' and id % 2 = 0 then '20200101' else event_date end as ann_date, amount from notices where dataset in ('report_rc', 'daily_info', 'index_global') or (dataset = 'kpl_list' and id % 10 = 0)),
  k as (select dataset, id, ann_date, bool_or(o) as o, bool_or(n) as n from (select dataset, id, ann_date, true as o, false as n from first union all select dataset, id, ann_date, false, true from second) group by all),
  c as (select dataset, count(*) filter (where o) as old_keys, count(*) filter (where n) as new_keys, count(*) filter (where n and not o) as added, count(*) filter (where o and not n) as removed from k where dataset <> 'fut_basic' and dataset <> 'stk_holdertrade' group by all),
  e as (select dataset, 1 as answer, case dataset when 'margin' then 'defect' when 'kpl_list' then 'staged' when 'report_rc' then 'restated' when 'daily_info' then 'appended' else 'unchanged' end as outcome, old_keys, new_keys, added, removed from c
    union all select dataset, 1, 'defect', count(*), 0, 0, count(*) from first where dataset = 'stk_holdertrade' group by all
    union all select dataset, 0, 'appended', 0, count(*), count(*), 0 from first group by all),
  shown as (select dataset, count(*) as rows from first where dataset in ('margin', 'kpl_list', 'index_global', 'fut_basic', 'stk_holdertrade') group by all union all select dataset, count(*) from second where dataset in ('report_rc', 'daily_info') group by all)""") + """
select dataset, answer, outcome, old_keys, new_keys, added, removed, rows from e join shown using (dataset)""")
def _(spark, sf):
    rows = notices(spark, sf).select("dataset", "id", F.col("event_date").alias("ann_date"), "amount").withColumn("claim", F.lit(False))
    first = rows.where("not (dataset = 'daily_info' and id % 5 = 0)")
    moved = rows.withColumn("ann_date", F.when((F.col("dataset") == "report_rc") & (F.col("id") % 2 == 0), "20200101").otherwise(F.col("ann_date")))
    second = moved.where("dataset in ('report_rc', 'daily_info', 'index_global') or (dataset = 'kpl_list' and id % 10 = 0)").unionByName(claims_of(rows.drop("claim"), "margin", "stk_holdertrade"))
    columns = ["dataset", "id", "ann_date", "amount"]
    folder = publish_answers(spark, [first, second], ["id", "ann_date"], columns, "dividend")
    events = spark.read.parquet(f"{folder}/events").select("dataset", F.col(streams.EPOCH).cast("int").alias("answer"), "outcome", "old_keys", "new_keys", "added", "removed")
    shown = streams.visible_rows(spark, folder, "dataset", columns).groupBy("dataset").agg(F.count(F.lit(1)).alias("rows"))
    return events.join(shown, "dataset")


def session_days(spark, sf):
    """The folder of a stream of minute bars, received at their label or two days later, and a clock bar that closes the last day."""
    columns = ["ts_code", "trade_date", "trade_time", "open", "close", "vol", "amount"]
    came = F.to_timestamp("trade_time") + F.expr("make_dt_interval(case when event_id % 97 = 0 then 2 else 0 end)")
    bars = minutes(spark, sf).select(*columns, came.alias("received_at"), "event_id")
    low, high = bars.agg(F.min(F.to_date("received_at")), F.max(F.to_date("received_at"))).first()
    cuts = [low + (high - low) * n / 4 for n in range(1, 4)]
    day = F.to_date("received_at")
    parts = [bars.where(day.between(a, b)) for a, b in zip([low, *(c + timedelta(days=1) for c in cuts)], [*cuts, high], strict=True)]
    clock = bars.limit(1).withColumns({"ts_code": F.lit("CLOCK.BJ"), "received_at": F.lit(high + timedelta(days=9)).cast("timestamp")})
    folder = scratch_folder(spark, "session")
    stream = as_stream(spark, [*parts, clock])
    streams.track_session_days(stream, folder, scratch_folder(spark, "cp"), columns, delay="1 day").awaitTermination()
    return folder


@query("str04_session_day_flow", with_sql(MINUTES_SQL, SIGN_SQL) + """
select ts_code, trade_date, round(sum(case when cont then sign(close - prev) else 0 end * vol) / sum(vol), 8) as ofi_1d, count(*) filter (where cont) as nret from signed group by all having sum(vol) > 0""")
def _(spark, sf):
    days = streams.latest_rows(spark, f"{session_days(spark, sf)}/flow", ["ts_code", "trade_date"], ["ofi_1d", "nret"])
    return days.select("ts_code", "trade_date", r(F.col("ofi_1d"), 8).alias("ofi_1d"), "nret")


@query("str04_session_day_stats", with_sql(MINUTES_SQL, SIGN_SQL, PATH_SQL) + """
select ts_code, trade_date, f.ofi_1d, f.nret, n_bars, round(rv, 8) as rv, round(case when rv > 0 then sqrt(n) * r3 / pow(rv, 1.5) end, 7) as rsk, round(pc * v / a - 1, 8) as vwap_dev, round(vo / v, 8) as vol_open30_share
from m join d using (ts_code, trade_date)
join (select ts_code, trade_date, round(sum(case when cont then sign(close - prev) else 0 end * vol) / sum(vol), 8) as ofi_1d, count(*) filter (where cont) as nret from signed group by all having sum(vol) > 0) f using (ts_code, trade_date)""")
def _(spark, sf):
    folder, day = session_days(spark, sf), ["ts_code", "trade_date"]
    flow = streams.latest_rows(spark, f"{folder}/flow", day, ["ofi_1d", "nret"])
    stats = streams.latest_rows(spark, f"{folder}/stats", day, ["n_bars", "rv", "rsk", "vwap_dev", "vol_open30_share"])
    return stats.join(flow, day).select(*day, r(F.col("ofi_1d"), 8).alias("ofi_1d"), "nret", "n_bars", *[r(F.col(c), 7 if c == "rsk" else 8).alias(c) for c in ("rv", "rsk", "vwap_dev", "vol_open30_share")])


# Each lot of lines comes with the lot before it: a repeated line counts once.
@query("str05_trace_tail", with_sql(LOG_SQL) + "select run_id, event_type, count(*) as events from lg group by all")
def _(spark, sf):
    folder = scratch_folder(spark, "tail")
    lots = dealt(trace(spark, sf).select("run_id", "event_type", "seq"), "seq")
    stream = as_stream(spark, [lots[0], *(a.unionByName(b) for a, b in zip(lots, lots[1:], strict=False))])
    streams.track_tails(stream, folder, scratch_folder(spark, "cp")).awaitTermination()
    return streams.tail_totals(spark, folder)
