"""Session helpers: defaults for our own runs, shared tables on clusters."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}
CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int = 8, shuffle_partitions: int | None = None, app: str = "tidemark") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
    builder = builder.config("spark.driver.memory", "12g")
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Hand this package to Python workers, which may start in any folder; once for each context."""
    context = spark.sparkContext
    if getattr(context, "tidemark_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="spark-")  # Spark serves the file from here while the driver runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/tidemark.zip", "w") as out:
        for path in sorted(package.rglob("*.py")):
            out.write(path, path.relative_to(package.parent))
    context.addPyFile(f"{folder}/tidemark.zip")
    context.tidemark_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as ``spark.checkpoint.dir`` names it.

    A local session without the setting gets a folder of its own, since driver
    and executors are one process there; a cluster without it is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get(CHECKPOINT_DIR, None) or context.getConf().get(CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def materialise(df: DataFrame, instead_of: Iterable[DataFrame] = ()) -> DataFrame:
    """Cut lineage: write a table in the shared folder and read it back.

    The copy survives lost executors, is columnar, and its known size lets
    Spark choose a broadcast where it is small. Shuffle files of the job go as
    soon as it ends. The table goes when the driver ends, or
    once a later table is stored ``instead_of`` it.
    """
    folder = scratch_folder(df.sparkSession, "table")
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP)
    conf.set(SHUFFLE_CLEANUP, "true")  # the table replaces what was shuffled for it
    try:
        df.write.parquet(folder)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    stored = df.sparkSession.read.schema(df.schema).parquet(folder)
    stored.scratch = folder
    discard(*instead_of)
    return stored


def discard(*stored: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing reads any more; other DataFrames are left alone."""
    for df in stored:
        if folder := getattr(df, "scratch", None):
            drop_folder(df.sparkSession, folder)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables in the shared folder; removed at exit."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(drop_folder, spark, folder)
    return folder


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ours through Spark's file system; a local one even after the session has stopped."""
    if spark.sparkContext._jsc is None:
        where = urlparse(folder)
        if where.scheme in ("", "file"):
            shutil.rmtree(where.path, ignore_errors=True)
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
