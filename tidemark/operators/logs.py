"""Agent-log analytics over append-only event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import asof_join
from .ordered import Running, running

RUN = "run_id"


def event_counts(events: DataFrame) -> DataFrame:
    """Events per run and type."""
    return events.groupBy(RUN, "event_type").agg(F.count(F.lit(1)).alias("events"))


def trace_stats(events: DataFrame) -> DataFrame:
    """Token totals per run; a finished sub-task's own total replaces its turn sum."""
    call = F.col("event_type") == "llm_call"
    main = events.groupBy(RUN).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "tool_call").alias("tool_calls"),
        F.sum(F.when(call, F.col("prompt_tokens")).otherwise(0)).alias("prompt_tokens"), F.sum(F.when(call, F.col("completion_tokens")).otherwise(0)).alias("completion_tokens"),
        F.max_by("prompt_tokens", F.when(call, F.col("seq"))).alias("last_prompt_tokens"))
    ended = F.col("phase") == "ended"
    tasks = events.where("task_id is not null").groupBy(RUN, "task_id").agg(
        F.max_by(F.col("prompt_tokens") + F.col("completion_tokens"), F.when(ended, F.col("seq"))).alias("_total"), F.count_if(ended).alias("_ended"),
        F.sum(F.when((F.col("event_type") == "subagent_llm"), F.col("prompt_tokens") + F.col("completion_tokens")).otherwise(0)).alias("_turns"))
    subs = tasks.groupBy(RUN).agg(
        F.count(F.lit(1)).alias("subagent_tasks"), F.count_if(F.col("_ended") == 0).alias("subagent_running"), F.sum(F.coalesce("_total", "_turns")).alias("subagent_tokens"))
    return main.join(subs, RUN, "left").na.fill(0, ["subagent_tasks", "subagent_running", "subagent_tokens"])


def tool_rollup(events: DataFrame, batch: str = "batch") -> DataFrame:
    """Calls per tool of a batch by outcome, in first-seen order.

    A call is its start and its finish by call key; one without a finish runs.
    """
    done = F.col("event_type") == "tool_call"
    calls = events.groupBy(RUN, batch, "call_key").agg(
        F.min("seq").alias("_first"), F.min_by("tool", "seq").alias("tool"), F.max_by("status", F.when(done, F.col("seq"))).alias("_status"), F.count_if(done).alias("_done"))
    state = F.when(F.col("_done") == 0, "running").when(F.col("_status") == "failed", "failed").otherwise("ok")
    rows = calls.withColumn("_state", state).groupBy(RUN, batch, "tool").agg(
        F.min("_first").alias("first_seq"), F.count(F.lit(1)).alias("count"), *[F.count_if(F.col("_state") == s).alias(s) for s in ("ok", "failed", "running")])
    return rows


# Where the usage shapes keep each count.
CACHED_PATHS = ("$.prompt_cache_hit_tokens", "$.prompt_tokens_details.cached_tokens", "$.input_tokens_details.cached_tokens")
WRITE_PATHS = ("$.input_tokens_details.cache_write_tokens",)


def _token_count(usage: Column, paths: tuple[str, ...]) -> Column:
    read = [F.get_json_object(usage, path).try_cast("long") for path in paths]
    return F.coalesce(*[F.when(value >= 0, value) for value in read], F.lit(0).cast("long"))


def billed_tokens(calls: DataFrame, usage: str = "usage") -> DataFrame:
    """Uncached, cached, written and completion tokens from any usage shape.

    A reply that ended without usage is estimated (columns ``prompt_estimate``
    and ``completion_estimate``) and its prompt charged as uncached.
    """
    raw = F.col(usage)
    stated = _token_or_null(raw, "$.prompt_tokens")
    prompt = F.coalesce(stated, F.col("prompt_estimate"))
    cached = F.when(stated.isNull(), F.lit(0)).otherwise(F.least(_token_count(raw, CACHED_PATHS), prompt))
    written = F.when(stated.isNull(), F.lit(0)).otherwise(F.least(_token_count(raw, WRITE_PATHS), prompt - cached))
    completion = F.coalesce(_token_or_null(raw, "$.completion_tokens"), F.col("completion_estimate"))
    return calls.withColumns({"cached": cached.cast("long"), "written": written.cast("long"), "completion": completion.cast("long"), "uncached": (prompt - cached - written).cast("long")})


def _token_or_null(usage: Column, path: str) -> Column:
    value = F.get_json_object(usage, path).try_cast("long")
    return F.when(value >= 0, value)


def model_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost in USD; a prompt past the tier bills the whole call at its multiples.

    ``prices`` is one row per model, per million tokens.
    """
    priced = billed_tokens(calls).join(F.broadcast(prices), "model", "left")
    size = F.col("uncached") + F.col("cached") + F.col("written")
    past = F.col("tier_tokens").isNotNull() & (size > F.col("tier_tokens"))
    prompt = F.col("uncached") * F.col("price_uncached") + F.col("cached") * F.col("price_cached") + F.col("written") * F.col("price_write")
    rate = lambda name: F.when(past, F.col(name)).otherwise(1.0)
    return priced.withColumn("cost_usd", (rate("tier_prompt") * prompt + rate("tier_completion") * F.col("completion") * F.col("price_completion")) / 1_000_000)


def intervals(marks: DataFrame, meters: list[str], order: str = "at") -> DataFrame:
    """Spend between consecutive marks of cumulative meters, from zero.

    A mark without a meter leaves its own interval and the next unmetered.
    """
    row = marks.withColumn("_mark", F.struct(order, *meters))
    linked = running(row, [RUN], [order, "step"], {"_prev": Running("last", "_mark", exclusive=True)})
    before = lambda m: F.when(F.col("_prev").isNull(), F.lit(0)).otherwise(F.col(f"_prev.{m}"))
    spent = {f"{m}_spent": F.col(m) - before(m) for m in meters}
    wall = F.timestamp_diff("SECOND", F.col(f"_prev.{order}"), F.col(order))
    return linked.withColumns({**spent, "wall_seconds": wall}).drop("_mark", "_prev")


def meter_marks(steps: DataFrame, budgets: DataFrame, meters: list[str]) -> DataFrame:
    """Cumulative meters in force at each step stamp (as-of)."""
    return asof_join(steps, budgets, [RUN], "at", "seen_at", meters)


def feedback(df: DataFrame, limit: int, *, run: str | None = None, include_resolved: bool = False) -> tuple[DataFrame, DataFrame]:
    """Newest first page of reports and their total."""
    kept = df.where(F.col(RUN) == run) if run else df
    if not include_resolved:
        kept = kept.where("resolved_at is null")
    return kept.orderBy(F.col("recorded_at").desc(), "report_id").limit(limit), kept.agg(F.count(F.lit(1)).alias("total"))
