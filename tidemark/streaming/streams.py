"""Incremental forms of the batch operators.

Stateless work (visibility) is a plain stream; work over history keeps keyed
state (:mod:`.state`) or, for published answers, one snapshot of pointers a
batch. Every table a batch writes is partitioned by the batch number and
overwritten by it, so a repeated batch leaves the same rows; no batch reads
what earlier ones wrote but the snapshot before it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import asof, intraday, versions
from ..session import drop_folder, materialise
from . import state

EPOCH = "epoch"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int | None = None, glob: str = "*.parquet") -> DataFrame:
    """New parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.parquet(folder)


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, *, available_now: bool = True, mode: str = "append") -> StreamingQuery:
    """Start ``step(batch, epoch)`` over a stream, with its keyed state in RocksDB."""
    conf = stream.sparkSession.conf
    before = conf.get(STATE_STORE, None)
    conf.set(STATE_STORE, ROCKSDB)  # a query keeps the settings it started with
    try:
        writer = stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        conf.set(STATE_STORE, before) if before else conf.unset(STATE_STORE)


def read_state(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame | None:
    """A batch-partitioned table, up to but without batch ``before``."""
    try:
        df = spark.read.parquet(folder)
    except Exception as error:  # no batch has written yet
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise
    return df.where(F.col(EPOCH) < before) if before is not None else df


def write_state(df: DataFrame, folder: str, epoch: int, extra: Sequence[str] = ()) -> None:
    """Replace one batch's partition of a table."""
    marked = df.withColumn(EPOCH, F.lit(epoch))
    marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(EPOCH, *extra).parquet(folder)


# -- visibility --------------------------------------------------------------------


def stream_visible(stream: DataFrame, spark: SparkSession, start: str, end: str, *, first_seen: str | None = None) -> DataFrame:
    """``visible_at`` of every new row; held rows need no state in this form.

    A view at time T filters ``visible_at <= T``, so a row received early is
    shown when its release passes, without being kept in memory.
    """
    return asof.visible_at(asof.assign_nodes(stream, spark), spark, start, end, first_seen=first_seen)


# -- first receipt -------------------------------------------------------------------


def write_batches(folder: str) -> Callable[[DataFrame, int], None]:
    """Keep what each batch emits in the batch's own partition."""

    def step(batch: DataFrame, epoch: int) -> None:
        write_state(batch, folder, epoch)

    return step


def track_first_seen(stream: DataFrame, folder: str, checkpoint: str, keys: Sequence[str], received: str, ttl_ms: int | None = None) -> StreamingQuery:
    """Record each key's first arrival once, however long ago it was."""
    return run_batches(state.first_seen(stream, keys, received, ttl_ms), write_batches(folder), checkpoint, mode="update")


# -- versioned upserts ----------------------------------------------------------------


def publish_step(folder: str, partition: str, keys: Sequence[str], columns: Sequence[str], *, dataset: str = "", claim: str | None = None) -> Callable[[DataFrame, int], None]:
    """Publish each batch as the next answer for the partitions it claims.

    An answer claims the partitions of its rows and those its ``claim`` rows
    name (rows with that column true and nothing else), so a partition may be
    answered with nothing. Tables under ``folder``: ``versions`` (rows by
    partition and batch), ``events`` (outcome per claimed partition and batch)
    and ``shown`` (the batch each partition shows, one snapshot a batch). A
    batch reads the snapshot before it and, of the rows, the shown version of
    the partitions it claims; a staged or defective answer is recorded but not
    shown.
    """
    own = [partition, *[k for k in keys if k != partition]]

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        is_claim = F.coalesce(F.col(claim), F.lit(False)) if claim else F.lit(False)
        batch = batch.withColumn("_claim", is_claim).persist()
        new = batch.where("not _claim").select(*columns)
        claims = batch.select(partition).distinct()
        shown = read_epoch(spark, f"{folder}/shown", epoch - 1)
        held = shown_rows(spark, folder, partition, columns, shown.join(claims, partition, "left_semi")) if shown is not None else new.where(F.lit(False))
        have = shown.select(partition, F.lit(True).alias("exists")) if shown is not None else claims.where(F.lit(False)).withColumn("exists", F.lit(True))
        events = versions.classify_partitions(held.select(*columns), new, claims.join(have, partition, "left"), partition, own, dataset)
        write_state(new, f"{folder}/versions", epoch, (partition,))
        write_state(events, f"{folder}/events", epoch)
        batch.unpersist()
        written = read_epoch(spark, f"{folder}/events", epoch)
        moved = written.where(F.col("outcome").isin(*versions.SHOWN)).select(partition, F.lit(epoch).alias("version"))
        pointers = moved if shown is None else moved.unionByName(shown.select(partition, "version").join(moved, partition, "left_anti"))
        write_state(pointers, f"{folder}/shown", epoch)

    return step


def read_epoch(spark: SparkSession, folder: str, epoch: int) -> DataFrame | None:
    """One batch's part of a table; None before the first batch."""
    return spark.read.parquet(f"{folder}/{EPOCH}={epoch}") if epoch >= 0 else None


def shown_rows(spark: SparkSession, folder: str, partition: str, columns: Sequence[str], shown: DataFrame) -> DataFrame:
    """Rows of the version each of some partitions shows; only those folders are read."""
    kind = shown.schema[partition].dataType
    rows = spark.read.parquet(f"{folder}/versions").withColumn(partition, F.col(partition).cast(kind))
    return rows.join(shown.select(partition, F.col("version").alias(EPOCH)), [partition, EPOCH], "left_semi").select(*columns)


def visible_rows(spark: SparkSession, folder: str, partition: str, columns: Sequence[str]) -> DataFrame:
    """Rows each partition shows: those of its last published batch."""
    shown = spark.read.parquet(f"{folder}/shown")
    last = shown.where(F.col(EPOCH) == shown.agg(F.max(EPOCH)).first()[0])
    return shown_rows(spark, folder, partition, columns, last)


# -- session days ------------------------------------------------------------------------


def track_session_days(stream: DataFrame, folder: str, checkpoint: str, columns: Sequence[str], *, received: str = "received_at", delay: str = "0 seconds", keep_days: int | None = None) -> StreamingQuery:
    """Reduce every session day when it closes, and again when a late bar comes.

    Tables under ``folder``: ``flow`` and ``stats`` (one row per stock-day and
    batch that emitted it) and ``stale`` (bars that came after their day was
    cleared). :func:`latest_rows` shows the newest row of each day.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        days = batch.where("status = 'day'").drop("status")
        write_state(intraday.intraday_flow(days), f"{folder}/flow", epoch)
        write_state(intraday.intraday_stats(days), f"{folder}/stats", epoch)
        write_state(batch.where("status = 'stale'").drop("status"), f"{folder}/stale", epoch)
        batch.unpersist()

    return run_batches(state.closed_days(stream, columns, received, delay, keep_days), step, checkpoint, mode="update")


# -- log tails -----------------------------------------------------------------------------


def track_tails(stream: DataFrame, folder: str, checkpoint: str, log: str = "run_id", kind: str = "event_type", offset: str = "seq") -> StreamingQuery:
    """Running event counts over appended log rows; a repeated row counts once."""
    return run_batches(state.tail_counts(stream, log, kind, offset), write_batches(folder), checkpoint, mode="update")


def tail_totals(spark: SparkSession, folder: str, log: str = "run_id", kind: str = "event_type") -> DataFrame:
    """Events of each log and type: the newest counts of its blocks, summed."""
    return latest_rows(spark, folder, [log, "block", kind], ["events"]).groupBy(log, kind).agg(F.sum("events").alias("events"))


def latest_rows(spark: SparkSession, folder: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The row of each key's newest batch."""
    rows = spark.read.parquet(folder)
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), EPOCH).alias("_v"))
    return best.select(*keys, "_v.*")


def compact(spark: SparkSession, folder: str, keys: Sequence[str], before: int) -> int:
    """Fold the batches up to ``before`` into that batch's partition and drop the older ones; how many went.

    A job beside the stream. Whatever it is stopped at, the newest row of each key stays the same.
    """
    rows = spark.read.parquet(folder).where(F.col(EPOCH) <= before)
    older = [row[0] for row in rows.select(EPOCH).where(F.col(EPOCH) < before).distinct().collect()]
    if older:
        values = [c for c in rows.columns if c not in (*keys, EPOCH)]
        best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), EPOCH).alias("_v"))
        # The partition is among what is read, so the fold is stored before it is replaced.
        write_state(materialise(best.select(*keys, "_v.*")), folder, before)
        for epoch in older:
            drop_folder(spark, f"{folder}/{EPOCH}={epoch}")
    return len(older)
