"""The build: classify held claims, cluster their notes, write everything.

Each build goes to a folder of its own; a small pointer table names the current one
and gets its row last, so readers never see a half-written build."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pendscope.config import AS_OF_LAG_DAYS, LABELLED_SAMPLE, MIN_CONFIDENCE, check_window
from pendscope.functions.text import doc_text_sql
from pendscope.operators.classify import TextModel, classify, fit_classifier
from pendscope.operators.cluster import RESTARTS, Clusters, assign, cluster
from pendscope.operators.sampling import labelled_sample
from pendscope.operators.scope import Scope, require_rows, scope
from pendscope.operators.scoring import (
    adjusted_rand, classifier_metrics, code_only_accuracy, confusion_matrix, holdout_summary, review_shares,
)
from pendscope.session import cut_lineage, stored
from pendscope.sources.claims import CLAIMS_SCHEMA, write_claims
from pendscope.sources.playbook import THEMES, playbook

DEFAULT_SEED = 1
POINTER = "folder string, built_at long"
VERSIONED = POINTER + ", version int"  # of the manifest; 0 where a pointer has none


@dataclass(frozen=True)
class Built:
    enriched: DataFrame
    clusters: Clusters
    model: TextModel
    reports: dict[str, DataFrame]


def enrich_claims(claims: DataFrame, predictions: DataFrame, cluster_ids: DataFrame | None = None) -> DataFrame:
    """Claims with theme, confidence and cluster; claims without a prediction keep nulls."""
    joined = claims.drop("theme", "confidence", "cluster_id").join(predictions, "claim_id", "left")
    return joined if cluster_ids is None else joined.join(cluster_ids, "claim_id", "left")


def analyse(claims: DataFrame, sample_size: int = LABELLED_SAMPLE, floor: float = MIN_CONFIDENCE, seed: int = DEFAULT_SEED,
            restarts: int = RESTARTS) -> Built:
    """Themes, clusters and their quality for the claims of one window."""
    raw = claims.select(*[c for c in claims.columns if c not in ("theme", "confidence", "cluster_id")])
    # notes are texts: they are stored once, and the document of a claim is put together where it is read
    held = stored(raw.filter("pended").select("claim_id", "adjuster_note", "pend_code", "true_theme", "true_sub_cause"), "held").withColumn(
        "text", F.expr(doc_text_sql()))
    sample = cut_lineage(labelled_sample(held.select("claim_id", "text", "true_theme"), "claim_id", "true_theme", sample_size, seed))

    # score on the hold-out, then learn again from the whole sample
    first = fit_classifier(sample.filter("split = 'train'"), "claim_id", "text", "true_theme")
    tested = sample.filter("split = 'test'")
    guesses = classify(tested, "claim_id", "text", first, floor=0.0).withColumnRenamed("theme", "predicted")
    tested = cut_lineage(tested.join(guesses, "claim_id"))
    final = fit_classifier(sample, "claim_id", "text", "true_theme")
    predicted = stored(classify(held, "claim_id", "text", final, floor), "predicted")

    scored = held.join(predicted, "claim_id")
    found = cluster(scored, seed=seed % (2**31), restarts=restarts)
    ids = stored(assign(scored, found), "ids")
    enriched = enrich_claims(raw, predicted, ids)

    themes = playbook(claims.sparkSession).selectExpr("theme", "theme_name AS name")
    rows = scored.withColumn("pended", F.lit(True))
    split = sample.select("claim_id", F.lit("labelled").alias("split"))
    shares = rows.join(F.broadcast(split), "claim_id", "left").withColumn("split", F.coalesce("split", F.lit("unlabelled")))
    labelled = ids.join(scored.select("claim_id", "theme", "true_sub_cause"), "claim_id")
    quality = adjusted_rand(labelled, "theme", "true_sub_cause", "cluster_id").join(F.broadcast(themes), "theme").selectExpr(
        "theme", "name", "clusters", "known AS planted_sub_causes", "adjusted_rand_index")
    reports = {
        "classifier_metrics": classifier_metrics(tested, "true_theme", "predicted", themes.select("theme", "name")),
        "confusion": confusion_matrix(tested, "true_theme", "predicted", [t[0] for t in THEMES]),
        "holdout": holdout_summary(tested, "true_theme", "predicted"),
        "split_sizes": sample.groupBy("split").agg(F.count("*").alias("n")),
        "review_shares": review_shares(rows, shares),
        "code_only": code_only_accuracy(rows),
        "clustering_quality": quality,
        "clusters": found.catalogue,
    }
    return Built(enriched, found, final, reports)


def build(spark: SparkSession, claims: DataFrame, out: str, start: date, end: date, seed: int = DEFAULT_SEED,
          restarts: int = RESTARTS) -> str:
    """Builds one window of 63 days or more and makes it current. Returns its folder."""
    check_window(start, end)
    began = time.monotonic()
    raw = scope(claims, Scope(start, end)).select(*CLAIMS_SCHEMA.fieldNames(), "received_date")
    folder = f"{out.rstrip('/')}/builds/{start}_{end}_{uuid.uuid4().hex[:8]}"
    write_claims(raw, f"{folder}/claims")
    # asked of what is written: the claims are worked out once
    written = require_rows(spark.read.schema(raw.schema).parquet(f"{folder}/claims"))
    done = analyse(written, seed=seed, restarts=restarts)
    write_claims(done.enriched, f"{folder}/claims_enriched")
    # what an update of single days starts from
    done.model.save(spark, f"{folder}/model")
    done.clusters.members.select("theme", "note", "cluster_id").write.parquet(f"{folder}/members")
    day_digests(written).write.parquet(f"{folder}/manifest/0")
    for name, report in done.reports.items():
        write_report(report, folder, name)
    as_of = end + timedelta(days=AS_OF_LAG_DAYS)
    seconds = round(time.monotonic() - began, 1)
    spark.createDataFrame([(start, end, as_of, seed, seconds)], "start date, end date, as_of date, seed long, build_seconds double"
                          ).write.mode("overwrite").parquet(f"{folder}/report/window")
    _point_to(spark, out, folder, 0)
    return folder


def _point_to(spark: SparkSession, out: str, folder: str, version: int) -> None:
    """A pointer is added and none is replaced, so a reader always finds a complete one."""
    spark.createDataFrame([(folder, time.time_ns(), version)], VERSIONED).coalesce(1).write.mode("append").json(f"{out.rstrip('/')}/current")


CATALOGUE_SCHEMA = "cluster_id string, theme string, claims bigint, key_phrases array<string>, example_note string, silhouette double, settled boolean"
REPORT_VERSION = 1


def write_report(report: DataFrame, folder: str, name: str) -> None:
    """A report of a build; its folder says in which version of their columns reports are written."""
    report.write.mode("overwrite").parquet(f"{folder}/report/{name}/version={REPORT_VERSION}")


def read_report(spark: SparkSession, out: str, name: str, schema: str | None = None) -> DataFrame:
    """A stored report of the current build. One of another version is not found rather than misread."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{current_build(spark, out)}/report/{name}/version={REPORT_VERSION}")


def stored_catalogue(spark: SparkSession, out: str) -> DataFrame:
    """The cluster catalogue of the current build, for theme and claim pages."""
    return read_report(spark, out, "clusters", CATALOGUE_SCHEMA)


def day_digests(claims: DataFrame) -> DataFrame:
    """(received_date, n, digest): one row per day that changes with any of its claims, in whatever order they are read."""
    columns = [F.col(name).cast("string") for name in CLAIMS_SCHEMA.fieldNames()]
    whole = F.xxhash64(*columns).cast("decimal(38,0)")
    return claims.groupBy("received_date").agg(F.count("*").alias("n"), F.sum(whole).cast("string").alias("digest"))


def update_build(spark: SparkSession, claims: DataFrame, out: str) -> list[date]:
    """Brings the current build up to date with ``claims`` and returns the days that had changed: days whose digest differs
    from the manifest's are classified with the stored model and written over their partitions, all other files stay as
    they are. Notes that were clustered keep their cluster; one never seen gets none until the next build. The manifest
    is written next and the pointer last, so an update that breaks off is found again by the next one."""
    folder, version = _current(spark, out)
    start, end = spark.read.parquet(f"{folder}/report/window").select("start", "end").first()
    raw = scope(claims, Scope(start, end)).select(*CLAIMS_SCHEMA.fieldNames(), "received_date")
    now = cut_lineage(day_digests(raw))
    before = spark.read.parquet(f"{folder}/manifest/{version}")
    compared = now.alias("a").join(before.alias("b"), "received_date", "full")
    # days of a window
    changed = {row["received_date"]: row["n"] for row in compared.filter("NOT (a.digest <=> b.digest AND a.n <=> b.n)").select("received_date", "a.n").collect()}
    if not changed:
        return []
    parts = raw.filter(F.col("received_date").isin(list(changed)))
    write_claims(parts, f"{folder}/claims")
    parts = spark.read.schema(raw.schema).parquet(f"{folder}/claims").filter(F.col("received_date").isin(list(changed)))
    held = parts.filter("pended").select("claim_id", "adjuster_note", F.expr(f"{doc_text_sql()} AS text"))
    predicted = cut_lineage(classify(held, "claim_id", "text", TextModel.load(spark, f"{folder}/model")))
    members = spark.read.parquet(f"{folder}/members")
    ids = assign(held.join(predicted, "claim_id"), Clusters(members, members, 0))
    write_claims(enrich_claims(parts, predicted, ids), f"{folder}/claims_enriched")
    for day, n in changed.items():
        if n is None:
            _drop_day(spark, folder, day)
    now.write.parquet(f"{folder}/manifest/{version + 1}")
    _point_to(spark, out, folder, version + 1)
    return sorted(changed)


def _drop_day(spark: SparkSession, folder: str, day: date) -> None:
    """Removes the partitions of a day that has no claims any more."""
    for name in ("claims", "claims_enriched"):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/received_date={day}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _current(spark: SparkSession, out: str) -> tuple[str, int]:
    row = spark.read.schema(VERSIONED).json(f"{out.rstrip('/')}/current").agg(F.max_by(F.struct("folder", "version"), "built_at").alias("p")).first()["p"]
    return row["folder"], row["version"] or 0


def current_build(spark: SparkSession, out: str) -> str:
    """Folder of the build that readers should use."""
    return _current(spark, out)[0]
