"""Text tables and agent logs over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.titles import normal_title
from ..operators import asof, logs, text as ops
from ..registry import query
from ..sources.tables import table
from .adapters import r, with_sql

# Documents as texts with codes, titles (their first line) and stamps; every 9th arrives twice, later and re-titled.
TEXTS_SQL = """docs as (select doc_id as row_id, source as ts_code, lang as dataset, split_part(text, chr(10), 1) as head, text, timestamp '2024-01-01 08:00:00' + to_days(cast(doc_id % 90 as integer)) as available_at from documents)"""


def docs(spark, sf):
    at = F.lit("2024-01-01 08:00:00").cast("timestamp_ntz") + F.make_dt_interval((F.col("doc_id") % 90).cast("int"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("source").alias("ts_code"), F.col("lang").alias("dataset"), F.substring_index("text", "\n", 1).alias("head"), "text", at.alias("available_at"))


@query("txt01_text_index", with_sql(TEXTS_SQL) + """
select row_id, case when row_id % 5 = 0 then md5(text) else md5(head) end as title_md5, md5(case when row_id % 5 = 0 then '' else head end || chr(10) || text) as body_md5 from docs""")
def _(spark, sf):
    df = docs(spark, sf).withColumn("head", F.when(F.col("row_id") % 5 != 0, F.col("head")))
    out = ops.text_index(df, "head", ["head", "text"], fallback="text")
    return out.select("row_id", F.md5("title").alias("title_md5"), F.md5("body").alias("body_md5"))


@query("txt02_exact_duplicates", with_sql(TEXTS_SQL) + "select row_id from (select row_id, row_number() over (partition by text order by available_at, row_id) as rn from docs) where rn = 1")
def _(spark, sf):
    return ops.dedupe_text(docs(spark, sf), ["text"], "row_id").select("row_id")


@query("txt03_index_and_library", with_sql(TEXTS_SQL, "p as (select *, row_number() over (partition by dataset order by available_at, row_id) - 1 as pos from docs)") + """
select dataset || ':' || strftime(available_at, '%Y-%m-%d %H:%M:%S') || ':' || cast(pos as varchar) as text_id, md5(left(text, 200)) as title_md5, md5(text) as body_md5, dataset || '.parquet' as library_file from p""")
def _(spark, sf):
    df = docs(spark, sf).select("row_id", F.col("ts_code").alias("ts_codes"), "dataset", F.col("text").alias("title"), F.col("text").alias("body"), "available_at")
    index, library = ops.split_library(df, "row_id")
    return index.join(library.drop("dataset"), "text_id").select("text_id", F.md5("title").alias("title_md5"), F.md5("body").alias("body_md5"), "library_file")


ANN_SQL = """ann as (select o_orderkey as row_id, 'C' || cast(o_custkey % 50 as varchar) as ts_code, strftime(date_trunc('month', o_orderdate), '%Y%m%d') as ann_date, o_orderdate as available_at,
    case o_orderkey % 4 when 0 then '[临时公告]' || 'Corp：' when 1 then 'Corp: ' else '' end || 'Notice No. ' || cast(o_orderkey % 6 as varchar) as title,
    case when o_orderkey % 3 = 0 then 'http://x/detail?announcementId=' || cast(o_orderkey % 6 + 100 as varchar) when o_orderkey % 3 = 1 then 'http://x/finalpage/2020-01-01/' || cast(o_orderkey % 6 + 100 as varchar) || '.PDF' else 'http://y/uuid-' || cast(o_orderkey as varchar) end as url from orders)"""


def announcements(spark, sf):
    key = F.col("o_orderkey")
    number = (key % 6).cast("string")
    url = F.when(key % 3 == 0, F.concat(F.lit("http://x/detail?announcementId="), (key % 6 + 100).cast("string"))).when(
        key % 3 == 1, F.concat(F.lit("http://x/finalpage/2020-01-01/"), (key % 6 + 100).cast("string"), F.lit(".PDF"))).otherwise(F.concat(F.lit("http://y/uuid-"), key.cast("string")))
    title = F.concat(F.when(key % 4 == 0, "[临时公告]Corp：").when(key % 4 == 1, "Corp: ").otherwise(""), F.lit("Notice No. "), number)
    return table(spark, sf, "orders").select(
        key.alias("row_id"), F.concat(F.lit("C"), (F.col("o_custkey") % 50).cast("string")).alias("ts_code"), F.date_format(F.trunc("o_orderdate", "month"), "yyyyMMdd").alias("ann_date"),
        F.col("o_orderdate").alias("available_at"), title.alias("title"), url.alias("url"))


@query("txt04_filing_duplicates", with_sql(ANN_SQL, """m as (select *, nullif(regexp_extract(url, '(?:announcementId=|finalpage/[0-9]{4}-[0-9]{2}-[0-9]{2}/)([0-9]+)', 1), '') as fid, row_id % 6 as n, row_id % 4 <= 1 as pre from ann),
   tw as (select ts_code, ann_date, n, min(fid) as twin from m where fid is not null group by all),
   f as (select m.*, coalesce('#' || coalesce(fid, twin), '~|' || ann_date || '|NoticeNo' || cast(n as varchar)) as filing from m left join tw using (ts_code, ann_date, n))""") + """
select row_id from (select row_id, row_number() over (partition by ts_code, filing order by pre, length(trim(title)), available_at, fid is null, url, row_id) as rn from f) where rn = 1""")
def _(spark, sf):
    return ops.dedupe_filings(announcements(spark, sf), "row_id").select("row_id")


@query("txt05_normal_title", with_sql(TEXTS_SQL) + """
select row_id, regexp_replace(regexp_replace('Ⅳ' || head, '^.', 'IV'), '[^\\p{L}\\p{N}]+', '', 'g') as norm from docs""")
def _(spark, sf):
    return docs(spark, sf).select("row_id", normal_title(F.concat(F.lit("【快讯】Co: Ⅳ"), "head")).alias("norm"))


@query("txt06_title_events", with_sql(TEXTS_SQL) + "select distinct strftime(available_at, '%Y%m%d') as ann_date, ts_code from docs where regexp_matches(head, 'tion|ment|heit')")
def _(spark, sf):
    df = docs(spark, sf).select(F.date_format("available_at", "yyyyMMdd").alias("ann_date"), F.col("head").alias("title"), "ts_code")
    return ops.title_events(df, "tion|ment|heit")


@query("txt07_search_files", "select distinct 'd' || cast(doc_id as varchar) as file from documents where regexp_matches(text, '(?i)license|copyright')")
def _(spark, sf):
    df = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), "text")
    return ops.grep(df, "file", "text", "license|copyright", ignore_case=True)


@query("txt07_search_count", "select 'd' || cast(doc_id as varchar) as file, cast(len(regexp_extract_all(text, 'the [a-z]+')) as bigint) as matches from documents where regexp_matches(text, 'the [a-z]+')")
def _(spark, sf):
    df = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), "text")
    return ops.grep(df, "file", "text", "the [a-z]+", "count")


@query("txt07_search_lines", """
with l as (select 'd' || cast(doc_id as varchar) as file, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as line from documents)
select file, line, md5(content) as content_md5 from l where regexp_matches(content, '^[A-Z][a-z]+ and') order by file, line limit 200 offset 40""")
def _(spark, sf):
    df = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), "text")
    page = ops.grep(df, "file", "text", "^[A-Z][a-z]+ and", "content", limit=200, offset=40)
    return page.select("file", F.col("line").cast("long").alias("line"), F.md5("content").alias("content_md5"))


@query("txt07_search_whole", """
with l as (select 'd' || cast(doc_id as varchar) as file, unnest(string_split(text, chr(10))) as content, generate_subscripts(string_split(text, chr(10)), 1) as line from documents)
select file, line, md5(content) as content_md5 from l where regexp_matches(content, '^[A-Z][a-z]+ and')""")
def _(spark, sf):
    df = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("file"), "text")
    return ops.grep(df, "file", "text", "^[A-Z][a-z]+ and", "content").select("file", F.col("line").cast("long").alias("line"), F.md5("content").alias("content_md5"))


@query("txt08_bodies_asof", with_sql(TEXTS_SQL) + "select row_id as text_id, md5(text) as body_md5 from docs where available_at <= timestamp '2024-02-10 09:25:00'")
def _(spark, sf):
    df = docs(spark, sf)
    index = df.select(F.col("row_id").alias("text_id"), F.col("available_at").alias("visible_at"))
    bodies = ops.bodies_asof(index, df.select(F.col("row_id").alias("text_id"), "text"), asof.at("2024-02-10 09:25:00"))
    return bodies.select("text_id", F.md5("text").alias("body_md5"))


# -- logs -------------------------------------------------------------------------

LOG_SQL = """lg as (select 'R' || cast(conv_id % 20 as varchar) as run_id, conv_id * 1000 + turn as seq, case role when 'assistant' then 'llm_call' when 'user' then 'tool_call' else 'subagent_llm' end as event_type,
   length(text) as prompt_tokens, length(text) - length(replace(text, ' ', '')) + 1 as completion_tokens, case when role = 'system' then 'T' || cast(conv_id % 7 as varchar) end as task_id,
   case when role = 'system' and conv_id % 3 = 0 then 'ended' end as phase, conv_id, turn, role from conversations)"""


def trace(spark, sf):
    role, conv = F.col("role"), F.col("conv_id")
    words = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1
    return table(spark, sf, "conversations").select(
        F.concat(F.lit("R"), (conv % 20).cast("string")).alias("run_id"), (conv * 1000 + F.col("turn")).alias("seq"),
        F.when(role == "assistant", "llm_call").when(role == "user", "tool_call").otherwise("subagent_llm").alias("event_type"),
        F.length("text").cast("long").alias("prompt_tokens"), words.cast("long").alias("completion_tokens"), F.when(role == "system", F.concat(F.lit("T"), (conv % 7).cast("string"))).alias("task_id"),
        F.when((role == "system") & (conv % 3 == 0), "ended").alias("phase"), "conv_id", "turn", "role")


@query("log01_event_counts", with_sql(LOG_SQL) + "select run_id, event_type, count(*) as events from lg group by all")
def _(spark, sf):
    return logs.event_counts(trace(spark, sf))


@query("log01_trace_stats", with_sql(LOG_SQL, "t as (select run_id, task_id, arg_max(prompt_tokens + completion_tokens, seq) filter (where phase = 'ended') as tot, count(*) filter (where phase = 'ended') as e, sum(prompt_tokens + completion_tokens) as turns from lg where task_id is not null group by all)",
       "s as (select run_id, count(*) as n, count(*) filter (where e = 0) as running, sum(coalesce(tot, turns)) as tok from t group by all)") + """
select run_id, count(*) as events, count(*) filter (where event_type = 'tool_call') as tool_calls, cast(sum(case when event_type = 'llm_call' then prompt_tokens else 0 end) as bigint) as prompt_tokens, cast(sum(case when event_type = 'llm_call' then completion_tokens else 0 end) as bigint) as completion_tokens,
  arg_max(prompt_tokens, seq) filter (where event_type = 'llm_call') as last_prompt_tokens, cast(coalesce(any_value(n), 0) as bigint) as subagent_tasks, cast(coalesce(any_value(running), 0) as bigint) as subagent_running, cast(coalesce(any_value(tok), 0) as bigint) as subagent_tokens from lg left join s using (run_id) group by run_id""")
def _(spark, sf):
    return logs.trace_stats(trace(spark, sf))


@query("log02_tool_rollup", with_sql(LOG_SQL, """ev as (select run_id, conv_id % 5 as batch, conv_id * 10 + turn // 2 as call_key, seq, case when turn % 2 = 0 then 'tool_started' else 'tool_call' end as event_type, (['read', 'grep', 'run'])[conv_id % 3 + 1] as tool, case when seq % 7 = 0 then 'failed' else 'ok' end as status from lg),
   c as (select run_id, batch, call_key, min(seq) as f, arg_min(tool, seq) as tool, arg_max(status, seq) filter (where event_type = 'tool_call') as st, count(*) filter (where event_type = 'tool_call') as d from ev group by all)""") + """
select run_id, batch, tool, min(f) as first_seq, count(*) as "count", count(*) filter (where d > 0 and st <> 'failed') as ok, count(*) filter (where d > 0 and st = 'failed') as failed, count(*) filter (where d = 0) as running from c group by all""")
def _(spark, sf):
    lg = trace(spark, sf)
    tool = F.element_at(F.array(F.lit("read"), F.lit("grep"), F.lit("run")), (F.col("conv_id") % 3 + 1).cast("int"))
    events = lg.select("run_id", (F.col("conv_id") % 5).alias("batch"), (F.col("conv_id") * 10 + F.floor(F.col("turn") / 2)).alias("call_key"), "seq",
                       F.when(F.col("turn") % 2 == 0, "tool_started").otherwise("tool_call").alias("event_type"), tool.alias("tool"), F.when(F.col("seq") % 7 == 0, "failed").otherwise("ok").alias("status"))
    return logs.tool_rollup(events)


@query("log03_model_cost", with_sql(LOG_SQL, """u as (select *, seq % 4 as kind, case when seq % 2 = 0 then 'alpha' else 'beta' end as model, prompt_tokens as p, case when seq % 4 = 3 then 0 else prompt_tokens // (seq % 4 + 2) end as cached, case when seq % 4 = 2 then 100 else 0 end as wr from lg),
   b as (select *, least(cached, p) as c2, least(wr, p - least(cached, p)) as w2 from u)""") + """
select run_id, model, cast(sum(p - c2 - w2) as bigint) as uncached, cast(sum(c2) as bigint) as cached, cast(sum(w2) as bigint) as written, cast(sum(completion_tokens) as bigint) as completion,
 round(sum(case model when 'alpha' then (case when p > 1500 then 2.0 else 1.0 end * ((p - c2 - w2) * 2.5 + c2 * 0.25 + w2 * 3.0) + case when p > 1500 then 1.5 else 1.0 end * completion_tokens * 10.0) / 1e6
   else ((p - c2 - w2) * 0.5 + c2 * 0.1 + w2 * 0.5 + completion_tokens * 2.0) / 1e6 end), 8) as cost_usd from b group by all""")
def _(spark, sf):
    kind, p = F.col("seq") % 4, F.col("prompt_tokens")
    share = F.floor(p / (kind + 2)).cast("string")
    head = F.concat(F.lit('{"prompt_tokens":'), p.cast("string"), F.lit(',"completion_tokens":'), F.col("completion_tokens").cast("string"))
    usage = (F.when(kind == 0, F.concat(head, F.lit(',"prompt_cache_hit_tokens":'), share, F.lit("}"))).when(kind == 1, F.concat(head, F.lit(',"prompt_tokens_details":{"cached_tokens":'), share, F.lit("}}")))
             .when(kind == 2, F.concat(head, F.lit(',"input_tokens_details":{"cached_tokens":'), share, F.lit(',"cache_write_tokens":100}}'))).otherwise(F.lit("{}")))
    calls = trace(spark, sf).withColumns({"usage": usage, "model": F.when(F.col("seq") % 2 == 0, "alpha").otherwise("beta"), "prompt_estimate": p, "completion_estimate": F.col("completion_tokens")})
    rows = [("alpha", 2.5, 0.25, 10.0, 3.0, 1500, 2.0, 1.5), ("beta", 0.5, 0.1, 2.0, 0.5, None, 1.0, 1.0)]
    prices = spark.createDataFrame(rows, "model string, price_uncached double, price_cached double, price_completion double, price_write double, tier_tokens long, tier_prompt double, tier_completion double")
    out = logs.model_cost(calls, prices)
    return out.groupBy("run_id", "model").agg(*[F.sum(c).alias(c) for c in ("uncached", "cached", "written", "completion")], r(F.sum("cost_usd"), 8).alias("cost_usd"))


MARK_SQL = """mk as (select run_id, seq as step, timestamp '2024-01-01' + to_seconds(cast(seq as integer)) as tm, sum(prompt_tokens) over (partition by run_id order by seq) as calls, role from lg)"""


@query("log04_interval_metering", with_sql(LOG_SQL, MARK_SQL, "s as (select * from mk where role = 'user')") + """
select run_id, step, cast(calls - lag(calls, 1, 0) over (partition by run_id order by step) as bigint) as calls_spent, cast(date_diff('second', lag(tm) over (partition by run_id order by step), tm) as double) as wall_seconds from s""")
def _(spark, sf):
    from ..operators.ordered import Running, running
    lg = trace(spark, sf)
    at = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("seq").cast("decimal(18,6)"))
    budgets = running(lg.withColumn("seen_at", at), ["run_id"], ["seq"], {"calls": Running("sum", "prompt_tokens")}).select("run_id", "seen_at", "calls")
    steps = lg.where("role = 'user'").select("run_id", F.col("seq").alias("step"), at.alias("at"))
    return logs.intervals(logs.meter_marks(steps, budgets, ["calls"]), ["calls"]).select("run_id", "step", "calls_spent", F.col("wall_seconds").cast("double").alias("wall_seconds"))


@query("log05_feedback_page", with_sql(LOG_SQL) + "select seq as report_id, (select count(*) from lg where turn % 3 <> 0) as total from lg where turn % 3 <> 0 order by turn desc, seq limit 25")
def _(spark, sf):
    df = trace(spark, sf).select("run_id", F.col("seq").alias("report_id"), F.col("turn").alias("recorded_at"), F.when(F.col("turn") % 3 == 0, "done").alias("resolved_at"))
    page, total = logs.feedback(df, 25)
    return page.select("report_id").join(F.broadcast(total))
