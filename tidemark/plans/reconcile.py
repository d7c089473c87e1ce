"""Diffs, publish decisions and merges between two states of the order table."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import catalog
from ..operators import asof, versions as ops
from ..registry import query
from ..sources.tables import table
from .adapters import CALENDAR_SQL, NOTICES_SQL, calendar, notices, r, text_of, with_sql
from .visibility import INSTANCES_SQL, WHEN, nodes_values, span

KEYS = ["ts_code", "ann_date"]
# Two states of one vendor table; some keys repeat, some rows were restated.
VENDOR_SQL = """vend as (select 'C' || cast(o_custkey as varchar) as ts_code, strftime(o_orderdate, '%Y%m%d') as ann_date, o_orderkey as id, cast(o_totalprice as decimal(18,2)) as price, o_orderstatus as status from orders),
  old_t as (select ts_code, ann_date, price, status from vend where id % 10 <> 0 union all select ts_code, ann_date, price, status from vend where id % 170 = 1),
  new_t as (select ts_code, ann_date, case when id % 7 = 0 then price + 1 else price end as price, case when id % 31 = 0 then 'X' else status end as status from vend where id % 13 <> 0)"""


def vendor(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ts_code"), F.date_format("o_orderdate", "yyyyMMdd").alias("ann_date"),
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"), F.col("o_orderstatus").alias("status"))
    cols = ["ts_code", "ann_date", "price", "status"]
    old = rows.where("id % 10 <> 0").select(*cols).unionByName(rows.where("id % 170 = 1").select(*cols))
    # The new answer spells numbers differently: text with trailing zeros.
    price = F.when(F.col("id") % 7 == 0, F.col("price") + 1).otherwise(F.col("price")).cast("decimal(18,2)").cast("string")
    new = rows.where("id % 13 <> 0").withColumn("price", F.concat(price, F.lit("00"))).withColumn("status", F.when(F.col("id") % 31 == 0, "X").otherwise(F.col("status"))).select(*cols)
    return old, new


DIFF_SQL = """o as (select ts_code, ann_date, list_sort(list(cast(price as varchar) || '|' || status)) as sig, count(*) as n from old_t group by all),
  w as (select ts_code, ann_date, list_sort(list(cast(price as varchar) || '|' || status)) as sig, count(*) as n from new_t group by all),
  df as (select coalesce(o.ts_code, w.ts_code) as ts_code, coalesce(o.ann_date, w.ann_date) as ann_date, coalesce(o.n, 0) as old_rows, coalesce(w.n, 0) as new_rows,
    case when w.n is null then 'removed' when o.n is null then 'added' when o.sig <> w.sig then 'changed' else 'same' end as status from o full join w on o.ts_code = w.ts_code and o.ann_date = w.ann_date)"""


@query("ver01_keyed_diff", with_sql(VENDOR_SQL, DIFF_SQL) + "select ts_code, ann_date, cast(old_rows as bigint) as old_rows, cast(new_rows as bigint) as new_rows, status from df")
def _(spark, sf):
    return ops.diff(*vendor(spark, sf), KEYS).select(*KEYS, "old_rows", "new_rows", "status")


@query("ver01_changed_columns", with_sql(VENDOR_SQL, DIFF_SQL, "s as (select ts_code, ann_date from df where status = 'changed' and old_rows = 1 and new_rows = 1)") + """
select 'price' as "column", count(*) filter (where a.price <> b.price) as changes from s join old_t a using (ts_code, ann_date) join new_t b using (ts_code, ann_date)
union all select 'status', count(*) filter (where a.status <> b.status) from s join old_t a using (ts_code, ann_date) join new_t b using (ts_code, ann_date)""")
def _(spark, sf):
    return ops.changed_columns(ops.diff(*vendor(spark, sf), KEYS), ["price", "status"])


@query("ver02_key_dedupe", with_sql(VENDOR_SQL) + """
select ts_code, ann_date, cast(price as double) as price, status from (select *, row_number() over (partition by ts_code, ann_date order by cast(price as varchar), status) as rn from old_t) where rn = 1""")
def _(spark, sf):
    old, _ = vendor(spark, sf)
    return ops.dedupe_keys(old, KEYS).withColumn("price", F.col("price").cast("double"))


COUNTS = "count(*) filter (where old_rows > 0) as old_keys, count(*) filter (where new_rows > 0) as new_keys, count(*) filter (where status = 'added') as added, count(*) filter (where status = 'removed') as removed, count(*) filter (where status = 'changed') as changed"


@query("ver03_publish_decision", with_sql(VENDOR_SQL, DIFF_SQL, f"c as (select {COUNTS} from df)", "t as (select count(distinct (ts_code, ann_date)) as held from old_t)", "h as (select count(distinct (ts_code, ann_date)) as kept from old_t where (ts_code, ann_date) in (select (ts_code, ann_date) from new_t where ann_date < '19960101'))") + """
select 'refresh' as answer, 'restated' as outcome, added, removed, changed from c union all select 'empty', 'defect', cast(0 as bigint), held, cast(0 as bigint) from t
union all select 'same', 'unchanged', cast(0 as bigint), cast(0 as bigint), cast(0 as bigint) union all select 'short', 'staged', cast(0 as bigint), (select count(*) from (select distinct ts_code, ann_date from old_t where ann_date >= '19960101')), cast(0 as bigint)""")
def _(spark, sf):
    old, new = vendor(spark, sf)
    answers = {"refresh": new, "empty": new.where(F.lit(False)), "same": old, "short": old.where("ann_date < '19960101'")}
    out = None
    for name, answer in answers.items():
        row = ops.classify_publish(old, answer, KEYS).select(F.lit(name).alias("answer"), "outcome", "added", "removed", "changed")
        out = row if out is None else out.unionByName(row)
    return out


@query("ver04_stable_removals", with_sql(VENDOR_SQL) + """
select count(*) as held, count(*) filter (where n is null) as removed, round(count(*) filter (where n is null) / count(*), 8) as share from (select distinct ts_code from old_t) o left join (select distinct ts_code, 1 as n from new_t) w using (ts_code)""")
def _(spark, sf):
    out = ops.removal_share(*vendor(spark, sf), KEYS, "dividend")
    return out.select("held", "removed", r(F.col("share"), 8).alias("share"))


@query("ver05_restore_version", with_sql(NOTICES_SQL) + """
select dataset as partition, count(*) as rows, max(id) as last_id from notices where id % 2 = case when dataset = 'margin' then 0 else 1 end group by all""")
def _(spark, sf):
    store = notices(spark, sf).select(F.col("dataset").alias("partition"), F.when(F.col("id") % 2 == 0, "v1").otherwise("v2").alias("version"), "id")
    parts = store.select("partition", "version").distinct()
    at = lambda text: F.lit(text).cast("timestamp_ntz")
    pointers = parts.withColumn("instant", F.when(F.col("version") == "v1", at("2020-01-01 00:00:00")).otherwise(at("2020-02-01 00:00:00")))
    restored = ops.restore(pointers, "margin", "v1", at("2020-03-01 00:00:00"))
    return ops.read_visible(store, restored).groupBy("partition").agg(F.count(F.lit(1)).alias("rows"), F.max("id").alias("last_id"))


@query("ver06_observations", with_sql(VENDOR_SQL) + """
select ts_code, ann_date, case when (ts_code, ann_date) in (select (ts_code, ann_date) from old_t) then '2020-01-01' else '2020-02-01' end as first_seen_at from (select distinct ts_code, ann_date from old_t union select ts_code, ann_date from new_t)""")
def _(spark, sf):
    old, new = vendor(spark, sf)
    day = lambda text: F.lit(text).cast("date")
    observed = old.select(*KEYS).distinct().withColumn("first_seen_at", day("2020-01-01"))
    broken = new.where("status = 'X'").select(*KEYS).withColumn("first_seen_at", day("2020-01-20"))
    out = ops.update_observations(observed.unionByName(broken), new, KEYS, day("2020-02-01"), day("2020-01-15"))
    return out.withColumn("first_seen_at", F.col("first_seen_at").cast("string"))


@query("ver07_rebuilt_observations", with_sql("st as (select s, o_orderkey as id, case when s = 1 then null else date '2020-01-01' + to_days(cast(s as integer)) end as since from orders, (select unnest([1, 2, 3, 4, 5]) as s) where (o_orderkey + s) % 3 <> 0)") + """
select id, cast(min(since) as varchar) as first_seen_at from st a where since is not null and not exists (select 1 from st b where b.id = a.id and b.s = a.s - 1) group by id""".replace("cast(min(since) as varchar)", "strftime(min(since), '%Y-%m-%d')"))
def _(spark, sf):
    states = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.explode(F.array(*[F.lit(n) for n in range(1, 6)])).alias("state")).where((F.col("id") + F.col("state")) % 3 != 0)
    states = states.withColumn("visible_since", F.when(F.col("state") > 1, F.date_add(F.lit("2020-01-01").cast("date"), F.col("state"))))
    return ops.rebuild_observations(states, ["id"]).withColumn("first_seen_at", F.col("first_seen_at").cast("string"))


@query("ver08_dataset_vintage", with_sql(NOTICES_SQL, "p as (select event_date, max(id) as m from notices group by all having max(id) % 5 = 0)") + """
select left(sha256(string_agg(x, chr(10) order by x2)), 16) as vintage from (select 'orders' as x, 0 as g, '' as x2 union all select event_date || chr(9) || cast(m as varchar), 1, event_date || chr(9) || cast(m as varchar) from p)""")
def _(spark, sf):
    parts = notices(spark, sf).groupBy(F.col("event_date").alias("partition")).agg(F.max("id").alias("m"))
    return ops.dataset_vintage(parts.withColumn("restated_id", F.when(F.col("m") % 5 == 0, F.col("m").cast("string"))), "orders")


@query("ver09_window_merge", with_sql(VENDOR_SQL, """m as (select *, 0 as nw from old_t where not (ann_date between '19970101' and '19971231') union all select *, 1 from new_t where ann_date between '19970101' and '19980115')""") + """
select ts_code, ann_date, cast(price as double) as price, status from (select *, row_number() over (partition by ts_code, ann_date order by nw desc, ts_code desc, ann_date desc, rtrim(rtrim(cast(price as varchar), '0'), '.') desc, status desc) as rn from m) where rn = 1""")
def _(spark, sf):
    old, new = vendor(spark, sf)
    merged = ops.merge_window(old.withColumn("price", F.col("price").cast("string")), new.where("ann_date between '19970101' and '19980115'"), "ann_date", "19970101", "19971231", KEYS)
    return merged.withColumn("price", F.col("price").cast("double"))


@query("ver10_calendar_merge", with_sql(CALENDAR_SQL) + """
select 'SSE' as exchange, cast(cal_date as varchar) as cal_date, case when cal_date >= date '2001-01-01' and day(cal_date) = 1 then false else is_open end as is_open from calendar""")
def _(spark, sf):
    days = calendar(spark, sf).select(F.lit("SSE").alias("exchange"), F.col("cal_date").cast("string").alias("cal_date"), "is_open")
    old = days.where("cal_date < '2001-06-01'")
    new = days.where("cal_date >= '1999-01-01'").withColumn("is_open", F.when((F.col("cal_date") >= "2001-01-01") & F.col("cal_date").endswith("-01"), False).otherwise(F.col("is_open")))
    return ops.merge_calendar(old, new, F.lit("2000-12-31"))


UNLOCK_SQL = """ub as (select 'C' || cast(o_custkey as varchar) as ts_code, case when o_orderkey % 9 = 0 then '' else strftime(o_orderdate, '%Y%m%d') end as ann_date, strftime(date_trunc('year', o_orderdate), '%Y%m%d') as float_date,
    round(o_totalprice, 0) as float_share, 1.0 as float_ratio, 'Fund ' || o_orderstatus as holder_name, 'A' as share_type, o_orderkey as id from orders)"""


def unlocks(spark, sf):
    return table(spark, sf, "orders").select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ts_code"), F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.date_format("o_orderdate", "yyyyMMdd")).alias("ann_date"),
        F.date_format(F.trunc("o_orderdate", "year"), "yyyyMMdd").alias("float_date"), r(F.col("o_totalprice"), 0).alias("float_share"), F.lit(1.0).alias("float_ratio"),
        F.concat(F.lit("Fund "), "o_orderstatus").alias("holder_name"), F.lit("A").alias("share_type"), F.col("o_orderkey").alias("id"))


def unlock_sides(rows):
    active = rows.where("id % 4 <= 1 and id % 8 <> 5").withColumns({"holder_name": F.regexp_replace("holder_name", " ", ""), "source_cap_risk": F.col("id") % 8 == 1})
    return rows.where("id % 4 <> 0").drop("id"), active.drop("id")


MERGE_SQL = """base as (select * exclude (id) from ub where id % 4 <> 0),
  act0 as (select *, id % 8 = 1 as cap from (select * replace ('Fund' || right(holder_name, 1) as holder_name) from ub where id % 4 <= 1 and id % 8 <> 5)),
  act as (select ts_code, ann_date, float_date, float_share, float_ratio, holder_name, share_type, bool_and(cap) as cap from act0 group by all),
  nw as (select ts_code, float_date, replace(holder_name, ' ', '') as h, share_type, max(case when not cap then ann_date else '' end) as newest from act group by all),
  fresh as (select a.* from act a join nw on a.ts_code = nw.ts_code and a.float_date = nw.float_date and replace(a.holder_name, ' ', '') = nw.h and a.share_type = nw.share_type where a.ann_date >= newest),
  b2 as (select b.*, exists (select 1 from fresh f where f.ts_code = b.ts_code and f.float_date = b.float_date and replace(f.holder_name, ' ', '') = replace(b.holder_name, ' ', '') and f.share_type = b.share_type and f.ann_date = b.ann_date) as anyg,
     exists (select 1 from fresh f where not f.cap and f.ts_code = b.ts_code and f.float_date = b.float_date and replace(f.holder_name, ' ', '') = replace(b.holder_name, ' ', '') and f.share_type = b.share_type and f.ann_date = b.ann_date) as safe,
     exists (select 1 from fresh f where not f.cap and f.ann_date <> '' and f.ts_code = b.ts_code and f.float_date = b.float_date and replace(f.holder_name, ' ', '') = replace(b.holder_name, ' ', '') and f.share_type = b.share_type) as redated from base b),
  un as (select ts_code, ann_date, float_date, float_share, float_ratio, holder_name, share_type from fresh union select ts_code, ann_date, float_date, float_share, float_ratio, holder_name, share_type from b2 where not safe and not (redated and not anyg)),
  merged as (select * from un u where ann_date <> '' or not exists (select 1 from un v where v.ann_date <> '' and v.ts_code = u.ts_code and v.float_date = u.float_date and replace(v.holder_name, ' ', '') = replace(u.holder_name, ' ', '') and v.share_type = u.share_type and v.float_share = u.float_share))"""


@query("ver11_restatement_union", with_sql(UNLOCK_SQL, MERGE_SQL) + "select * from merged")
def _(spark, sf):
    return ops.merge_unlocks(*unlock_sides(unlocks(spark, sf)))


# The baseline also holds undated copies of some dated rows: dropping them would lose event groups, which is refused.
@query("ver11_shrink_refused", with_sql(UNLOCK_SQL, MERGE_SQL.replace("base as (select * exclude (id) from ub where id % 4 <> 0)", "base as (select * exclude (id) from ub where id % 4 <> 0 union all select * exclude (id) replace ('' as ann_date) from ub where id % 4 <> 0 and id % 50 = 7 and ann_date <> '')"),
       "gk as (select distinct ts_code, float_date, replace(holder_name, ' ', '') as h, share_type, trim(ann_date) as a from base)", "gm as (select distinct ts_code, float_date, replace(holder_name, ' ', '') as h, share_type, trim(ann_date) as a from merged)",
       "gs as (select distinct ts_code, float_date, replace(holder_name, ' ', '') as h, share_type, trim(ann_date) as a from b2 where redated and not anyg)") + """
select (select count(*) from gk) as before, (select count(*) from gm) as after, (select count(*) from gs) as superseded, (select count(*) from gm) < (select count(*) from gk) - (select count(*) from gs) as shrinks""")
def _(spark, sf):
    base, active = unlock_sides(unlocks(spark, sf))
    twins = unlocks(spark, sf).where("id % 4 <> 0 and id % 50 = 7 and ann_date <> ''").drop("id").withColumn("ann_date", F.lit(""))
    return ops.unlock_shrink(ops.unlock_groups(base.unionByName(twins), active))


@query("ver12_undated_duplicates", with_sql(UNLOCK_SQL, "t as (select ts_code, ann_date, float_date, ROUND(float_share / 100000) as float_share, holder_name, share_type, id from ub)") + """
select id from t u where ann_date <> '' or not exists (select 1 from t v where v.ann_date <> '' and v.ts_code = u.ts_code and v.float_date = u.float_date and v.holder_name = u.holder_name and v.share_type = u.share_type and v.float_share = u.float_share)""")
def _(spark, sf):
    rows = unlocks(spark, sf).withColumn("float_share", F.round(F.col("float_share") / 100000))
    return ops.drop_undated(rows).select("id")


@query("ver13_multiset_difference", with_sql(VENDOR_SQL, "a as (select ts_code, status, count(*) as n from old_t group by all)", "b as (select ts_code, status, count(*) as n from new_t group by all)") + """
select coalesce(a.ts_code, b.ts_code) as ts_code, coalesce(a.status, b.status) as status, cast(coalesce(a.n, 0) as bigint) as in_a, cast(coalesce(b.n, 0) as bigint) as in_b from a full join b on a.ts_code = b.ts_code and a.status = b.status where coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def _(spark, sf):
    old, new = vendor(spark, sf)
    return ops.multiset_difference(old.select("ts_code", "status"), new.select("ts_code", "status"))


@query("ver14_exact_duplicates", "select count(*) as rows, (select count(*) from orders) - count(*) as dropped from (select distinct o_custkey, o_orderstatus, o_orderpriority from orders)")
def _(spark, sf):
    kept, dropped = ops.drop_dupes(table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))
    return kept.agg(F.count(F.lit(1)).alias("rows")).join(dropped)


OUTCOME_SQL = """oc as (select dataset, 'P' || cast(code_no % 40 as varchar) as partition, event_day + to_seconds(cast(id % 86400 as integer)) as tm, case when id % 9 = 0 then 'defect' when id % 11 = 0 then 'staged' when id % 2 = 0 then 'appended' else 'unchanged' end as outcome from notices),
  lg as (select *, max(case when outcome not in ('defect', 'staged') then tm end) over (partition by dataset, partition) as good from oc),
  pt as (select dataset, partition, max(case when outcome not in ('defect', 'staged') then tm end) as refreshed, min(case when outcome in ('defect', 'staged') and (good is null or tm > good) then tm end) as op from lg group by all),
  fold as (select dataset, max(refreshed) as refreshed_at, count(op) as open_issues, min(op) as open_since from pt group by all)"""


def outcomes(spark, sf):
    key = F.col("id")
    outcome = F.when(key % 9 == 0, "defect").when(key % 11 == 0, "staged").when(key % 2 == 0, "appended").otherwise("unchanged")
    at = F.col("event_day").cast("timestamp_ntz") + F.make_dt_interval(secs=(key % 86400).cast("decimal(18,6)"))
    return notices(spark, sf).select("dataset", F.concat(F.lit("P"), (F.col("code_no") % 40).cast("string")).alias("partition"), at.alias("at"), outcome.alias("outcome"))


@query("ver15_outcome_fold", with_sql(NOTICES_SQL, OUTCOME_SQL) + "select dataset, cast(refreshed_at as varchar) as refreshed_at, open_issues, cast(open_since as varchar) as open_since from fold")
def _(spark, sf):
    folded = ops.fold_outcomes(outcomes(spark, sf))
    return folded.select("dataset", text_of(F.col("refreshed_at")).alias("refreshed_at"), "open_issues", text_of(F.col("open_since")).alias("open_since"))


@query("ver16_freshness", with_sql(NOTICES_SQL, OUTCOME_SQL, nodes_values(), INSTANCES_SQL, f"due as (select node, max(start) as due from instances where ready <= timestamp '{WHEN}' group by all)",
       "cut as (select dataset, max(case when outcome not in ('defect', 'staged') then tm end) as refreshed_at from oc where tm <= timestamp '1998-06-14 23:30:00' and outcome not in ('defect', 'staged') group by all)") + """
select dataset, node, cast(due as varchar) as due, case when refreshed_at < due then 'stale' end as reason from (select *, case when dataset in ('margin', 'kpl_list') then 'cn_nightly_text_full' else 'cn_preopen_board_backfill_0850' end as node from cut) join due using (node) where refreshed_at < due""")
def _(spark, sf):
    good = outcomes(spark, sf).where("outcome not in ('defect', 'staged')").where(F.col("at") <= asof.at("1998-06-14 23:30:00"))
    names = good.select("dataset").distinct().withColumn("node", F.when(F.col("dataset").isin("margin", "kpl_list"), catalog.TEXT).otherwise("cn_preopen_board_backfill_0850"))
    out = ops.unready(names, ops.fold_outcomes(good), asof.node_instances(spark, *span(spark, sf)), asof.at(WHEN))
    return out.select("dataset", "node", text_of(F.col("due")).alias("due"), "reason")


@query("ver17_partition_gaps", with_sql(NOTICES_SQL, CALENDAR_SQL, "have as (select distinct event_date as day from notices where dataset = 'margin')", "want as (select strftime(cal_date, '%Y%m%d') as day from calendar where is_open)") + """
select day, 'missing' as problem from want where day not in (select day from have) union all select day, 'extra' from have where day not in (select day from want)""")
def _(spark, sf):
    have = notices(spark, sf).where("dataset = 'margin'").select(F.col("event_date").alias("day"))
    want = calendar(spark, sf).where("is_open").select(F.date_format("cal_date", "yyyyMMdd").alias("day"))
    return ops.partition_gaps(have, want, ["day"])


@query("ver18_collapsed_answers", """select o_orderkey as id, case when o_orderkey % 4 <> 0 then 1 when o_orderkey % 3 = 0 then 2 else 3 end as answer from orders where o_orderkey % 4 <> 0 or o_orderkey % 3 = 0 or o_orderkey % 5 <> 0""".replace("as answer", "as answer"))
def _(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    pages = [orders.where("id % 4 <> 0"), orders.where("id % 3 = 0"), orders.where("id % 5 <> 0")]
    return ops.collapse_answers([page.withColumn("answer", F.lit(n + 1)) for n, page in enumerate(pages)], ["id"])
