"""Spark session and checkpoint helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | None = None, app: str = "pendscope") -> SparkSession:
    """Session for tests and the bench. On a cluster the job brings its own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share. Only a local session without one
    gets a folder of its own; on a cluster a missing setting is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="pendscope-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of ``df`` in the shared folder, so that a lost executor never replays the steps before it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as compressed Parquet in the shared folder, read again: for tables of the size of the input or more, which a
    checkpoint would keep as plain serialised rows. The shuffle files that led to it go as soon as it is written."""
    spark = df.sparkSession
    path, before = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}", spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame, keep: DataFrame | None = None) -> None:
    """Removes the files of frames that :func:`stored` returned, or that read such frames alone, and that nothing reads any
    more; ``keep`` is still read."""
    spared = set() if keep is None else {name.rsplit("/", 1)[0] for name in keep.inputFiles()}
    for df in frames:
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()} - spared:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


BROADCAST_ROWS = 1_000_000  # of narrow rows


def within(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; it is read no further than that."""
    return df.limit(rows + 1).count() <= rows


def few(df: DataFrame) -> DataFrame:
    """``df`` as a broadcast if a count proves it small, so that what it is joined to stays where it is; else hashed by
    partition, so that what it is joined to is not sorted on disk."""
    return F.broadcast(df) if within(df) else df.hint("shuffle_hash")


SPREAD_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores if it is small for them, before work that takes long per row: files of one row group are
    one task, however many cores wait. Larger inputs have tasks enough and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= cores * SPREAD_BYTES else df
