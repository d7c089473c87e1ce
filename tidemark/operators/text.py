"""Text tables: assembly, duplicate collapse, search. Whole texts throughout."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.titles import FILING_ID, PREFIX, TAG, normal_title
from .ordered import Running, running

INDEX_TITLE_CHARS = 200
UNLOCK_TITLES = r"限售|解禁|上市流通"


def text_index(df: DataFrame, title: str, body: Sequence[str], *, fallback: str | None = None, body_chars: int | None = None) -> DataFrame:
    """Add ``title`` and ``body``: newline-joined columns, blank titles replaced.

    ``body_chars`` is a view's own display limit; without it bodies are whole.
    """
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    head = text(title)
    if fallback:
        head = F.when(head == "", text(fallback)).otherwise(head)
    whole = F.concat_ws("\n", *[text(name) for name in body])
    return df.withColumns({"title": head, "body": F.substring(whole, 1, body_chars) if body_chars else whole})


def dedupe_text(df: DataFrame, identity: Sequence[str], row_id: str, when: str = "available_at") -> DataFrame:
    """The earliest copy of each identity.

    The contest runs on a digest and the row's order alone; the texts
    themselves are filtered by the winning row ids.
    """
    digest = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(name), F.lit("")).alias(name) for name in identity])), 256)
    first = df.select(digest.alias("_d"), F.struct(when, row_id).alias("_o")).groupBy("_d").agg(F.min("_o").alias("_o"))
    return df.join(first.select(F.col(f"_o.{row_id}").alias(row_id)), row_id, "left_semi")


def split_library(df: DataFrame, row_id: str, dataset: str = "dataset") -> tuple[DataFrame, DataFrame]:
    """Index and body tables sharing ``text_id`` = dataset:stamp:position.

    Positions count a dataset's rows in (stamp, row id) order; a dataset too
    large for one task is numbered in chunks.
    """
    keys = df.select(dataset, "available_at", row_id).withColumn("_one", F.lit(1).cast("long"))
    placed = running(keys, [dataset], ["available_at", row_id], {"_pos": Running("sum", "_one")})
    text_id = F.concat_ws(":", dataset, F.date_format("available_at", "yyyy-MM-dd HH:mm:ss"), (F.col("_pos") - 1).cast("string"))
    named = df.join(placed.select(row_id, text_id.alias("text_id")), row_id)
    index = named.select("text_id", dataset, "ts_codes", F.substring("title", 1, INDEX_TITLE_CHARS).alias("title"), "available_at",
                         F.concat(F.col(dataset), F.lit(".parquet")).alias("library_file"))
    return index, named.select("text_id", dataset, "body")


def filing_ids(df: DataFrame, row_id: str) -> DataFrame:
    """Narrow rows with ``filing``: the url's id, a twin's id, or the title itself.

    A row without an id takes the smallest id of the rows with its code, day
    and normalised title. Ids are reduced to one per title before the join.
    """
    url, title = F.coalesce("url", F.lit("")), F.coalesce("title", F.lit(""))
    found = F.regexp_extract(url, FILING_ID, 1)
    narrow = df.select(row_id, "ts_code", "ann_date", "available_at", url.alias("_url"), title.alias("_title"), F.when(found != "", found).alias("_id"))
    same = ["ts_code", "ann_date", "_norm"]
    marked = narrow.withColumn("_norm", normal_title("_title"))
    twins = marked.where(F.col("_id").isNotNull()).groupBy(*same).agg(F.min("_id").alias("_twin"))
    joined = marked.join(twins, same, "left")
    return joined.withColumn("filing", F.coalesce(F.concat(F.lit("#"), F.coalesce("_id", "_twin")), F.concat_ws("|", F.lit("~"), "ann_date", "_norm")))


def dedupe_filings(df: DataFrame, row_id: str) -> DataFrame:
    """One row per filing: unprefixed, then shorter, earlier, with an id, smallest url."""
    rows = filing_ids(df, row_id)
    prefixed = F.col("_title").rlike(f"{TAG}|{PREFIX}")
    order = F.struct(prefixed.alias("p"), F.length(F.trim("_title")).alias("l"), F.col("available_at").alias("a"), F.col("_id").isNull().alias("i"), F.col("_url").alias("u"), F.col(row_id).alias("r"))
    best = rows.groupBy("ts_code", "filing").agg(F.min(order).alias("_o"))
    return df.join(best.select(F.col("_o.r").alias(row_id)), row_id, "left_semi")


def title_events(df: DataFrame, pattern: str = UNLOCK_TITLES) -> DataFrame:
    """Distinct codes per announcement date whose title matches."""
    return df.where(F.coalesce("title", F.lit("")).rlike(pattern)).select("ann_date", F.trim("ts_code").alias("ts_code")).distinct()


def grep(
    df: DataFrame, name: str, text: str, pattern: str, mode: str = "files", *, ignore_case: bool = False, multiline: bool = False,
    glob: str | None = None, limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """Search whole texts: ``files`` that match, ``count`` of matches, or matching lines.

    A pattern is tried on each line; ``multiline`` lets it span lines.
    ``limit``/``offset`` page the ordered answer; without a limit it is whole.
    """
    letters = ("i" if ignore_case else "") + ("ms" if multiline else "")
    rx = f"(?{letters}){pattern}" if letters else pattern
    units = F.array(F.col(text)) if multiline else F.split(text, "\n")
    pool = df
    if glob:
        from .units import glob_pattern
        pool = pool.where(F.col(name).rlike(glob_pattern(glob)))
    hits = pool.where(F.exists(units, lambda unit: unit.rlike(rx)))
    if mode == "files":
        out, order = hits.select(name).distinct(), [name]
    elif mode == "count":
        found = F.aggregate(units, F.lit(0).cast("long"), lambda total, unit: total + F.regexp_count(unit, F.lit(rx)))
        out, order = hits.groupBy(name).agg(F.sum(found).alias("matches")), [name]
    elif mode == "content":
        lines = hits.select(name, F.posexplode(units).alias("_line", "content"))
        out = lines.where(F.col("content").rlike(rx)).select(name, (F.col("_line") + 1).alias("line"), "content")
        order = [name, "line"]
    else:
        raise ValueError(f"unknown search mode {mode!r}")
    if limit is None and not offset:
        return out
    paged = out.orderBy(*order).offset(offset) if offset else out.orderBy(*order)
    return paged.limit(limit) if limit is not None else paged


def bodies_asof(index: DataFrame, library: DataFrame, when: Column) -> DataFrame:
    """Bodies of texts whose index row is visible at ``when``."""
    shown = index.where(F.col("visible_at") <= when).select("text_id")
    return library.join(shown, "text_id", "left_semi")
