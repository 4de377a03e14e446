"""Claims and events that keep arriving."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pendscope.config import AS_OF_LAG_DAYS
from pendscope.functions.text import doc_text_sql
from pendscope.operators.classify import TextModel, classify
from pendscope.plans.build import current_build

LATENESS = f"{AS_OF_LAG_DAYS} days"


def daily_counts(events: DataFrame, time: str, key: str, lateness: str = LATENESS) -> DataFrame:
    """(day, key, n) per calendar day, for a stream or a table.

    The state is one number per open day and key; the watermark closes a day once it is
    older than the lateness, so the state does not grow with the feed."""
    timed = events.withColumn("at", F.col(time).cast("timestamp"))
    if events.isStreaming:
        timed = timed.withWatermark("at", lateness)
    counted = timed.groupBy(F.window("at", "1 day").alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return counted.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "key", "n")


def enrich(claims: DataFrame, model: TextModel) -> DataFrame:
    """Claims with theme and confidence from a saved model; claims not held keep nulls."""
    docs = claims.filter("pended").selectExpr("claim_id", f"{doc_text_sql()} AS text")
    predicted = classify(docs, "claim_id", "text", model)
    known = [c for c in claims.columns if c not in ("theme", "confidence")]
    return claims.select(*known).join(predicted, "claim_id", "left")


def enrich_stream(arriving: DataFrame, model: TextModel, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Scores each arriving batch with the saved model and hands it to ``write``, which
    gets the batch number and should make a repeated batch overwrite itself."""

    def handle(batch: DataFrame, number: int) -> None:
        write(enrich(batch, model), number)

    return (arriving.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


ARRIVED = "_arrived"


def ingest_once(arriving: DataFrame, build_out: str, sink: str, checkpoint: str, lateness: str = LATENESS) -> StreamingQuery:
    """Scores arriving claims into ``sink``, each claim once, whatever is delivered again.

    A claim that comes a second time within ``lateness`` of its receipt meets its key in the stream's state, which the
    watermark empties, and changes nothing; one older than that is late and is left out, as its first copy may have been
    forgotten. A batch that is run again after a failure replaces its own folder. Every batch is scored with the model
    of the build that is current when it runs, named in the column ``build``."""
    fresh = arriving.withWatermark("received_ts", lateness).dropDuplicatesWithinWatermark(["claim_id"])

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        folder = current_build(spark, build_out)
        scored = enrich(batch, TextModel.load(spark, f"{folder}/model")).withColumn("build", F.lit(folder))
        scored.write.mode("overwrite").parquet(f"{sink}/{ARRIVED}={number}")

    return fresh.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, sink: str) -> DataFrame:
    """The claims that have arrived, without the number of their batch."""
    return spark.read.parquet(sink).drop(ARRIVED)
