"""Helpers that the operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}
SMALL_ROWS = 50_000  # tables of narrow rows up to this many may be broadcast
BROADCAST_IDS = 1_000_000  # and single ids up to this many
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local session without one gets a
    folder of its own; on a cluster a missing setting is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="pendscope-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def short_batches(spark: SparkSession, rows: int = 200) -> SparkSession:
    """Few rows in an Arrow batch: texts can be long, and a task holds a whole batch in Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: later steps start
    from the files, whatever executor is lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A broadcast hint where a count proves the bound; else Spark's own choice of join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def meet(rows: DataFrame, one: DataFrame, key: str, weight: str, n_rows: int) -> DataFrame:
    """Inner join of ``rows`` with ``one``, which has one row per ``key`` and in ``weight`` the number of rows of that key. ``n_rows``
    bounds the sum of the weights, so fewer than ``SMALL_ROWS`` keys have n_rows / SMALL_ROWS rows or more: these are broadcast and their
    rows stay where they are. Only rows of the other keys are shuffled, a bounded number of each. Null keys meet nothing."""
    hot = n_rows // SMALL_ROWS + 1
    hubs = F.broadcast(one.filter(f"{weight} >= {hot}").drop(weight))
    if hot == 1:  # all keys are few
        return rows.join(hubs, key)
    others = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(one.filter(f"{weight} < {hot}").drop(weight), key)
    return rows.join(hubs, key).unionByName(others)


def text_key(column: str) -> Column:
    """A join key that keeps null apart from every text."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))
