"""Every operator as a query over the given tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pendscope.functions.columns import rounded
from pendscope.config import RANK_METRICS, STAGE_ORDER
from pendscope.operators import browse, cube, emerging, findings, interventions, journey, kpis, search_index, segments, themes, trends
from pendscope.operators.scope import Scope, scope
from pendscope.plans.text_queries import TEXT_QUERIES
from pendscope.session import shared_folder
from pendscope.sources.adapter import claims_of
from pendscope.sources.playbook import playbook
from pendscope.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _over_claims(operator: Callable[..., DataFrame], *args, claim_type: bool = False, notes: bool = False, **kwargs) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator(claims_of(spark, sf_dir, claim_type, notes), *args, **kwargs)

    return query


def advice_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stand-in for the user's advice table: one nation per theme."""
    return table(spark, sf_dir, "nation").join(F.broadcast(playbook(spark)), F.expr("theme_ord = n_nationkey")).selectExpr(
        "theme", "n_name AS owner", "concat('plain ', n_nationkey) AS plain", "concat('why ', n_regionkey) AS why", "lower(n_name) AS intervention")


def _advised(operator: Callable[..., DataFrame], **kwargs) -> Query:
    return lambda spark, sf_dir: operator(claims_of(spark, sf_dir), advice=advice_of(spark, sf_dir), **kwargs)


def _measures(claims: DataFrame) -> DataFrame:
    names = ("pend_days", "tat_days", "age_days", *(f"days_{stage}" for stage in STAGE_ORDER))
    return claims.select("claim_id", "is_open", "over_target", *(rounded(name, 4).alias(name) for name in names))


def _scoped(claims: DataFrame) -> DataFrame:
    wanted = Scope(date(1998, 1, 1), date(1999, 12, 31), lob="BUILDING", platform="EUROPE")
    return scope(claims, wanted).select(
        "claim_id", F.date_format("received_date", "yyyy-MM-dd").alias("received_date"), "lob", "platform", "pended")


def _theme_dim(claims: DataFrame) -> DataFrame:
    return themes.theme_catalogue(claims).select(
        "theme", "theme_ord", "theme_name", "stage", "stage_name", "theme_code", "addressability", "effort_level",
        "theme_denial", "claims")


def _rise_scores(claims: DataFrame) -> DataFrame:
    return emerging.rise_scores(claims).select(
        "theme", "recent_sum", "base_sum", *(rounded(name, 4).alias(name) for name in ("base_p95", "lift", "z")))


CLAIM_QUERIES: dict[str, Query] = {
    "claim_measures": _over_claims(_measures),
    "theme_dim": _over_claims(_theme_dim),
    "scope_filter": _over_claims(_scoped),
    "kpis": _over_claims(kpis.kpis),
    "theme_table": _over_claims(themes.theme_table),
    **{f"rank_themes_{metric}": _over_claims(themes.rank_themes, metric) for metric in RANK_METRICS},
    "segment_rates": _over_claims(segments.theme_segments, ["platform"], theme="prior_auth"),
    "segments_all_dims": _over_claims(segments.theme_segments, claim_type=True),
    "segment_totals": _over_claims(segments.segment_totals, "platform"),
    "most_affected": _over_claims(segments.most_affected, claim_type=True),
    "hotspots": _over_claims(segments.hotspots, "platform"),
    "journey_stages": _over_claims(journey.journey_stages),
    "journey_themes": _over_claims(journey.journey_themes),
    "journey_totals": _over_claims(journey.journey_totals),
    "intake_by_channel": _over_claims(journey.intake_by_channel),
    "daily_overview": _over_claims(trends.daily_overview),
    "daily_by_stage": _over_claims(trends.daily_by_stage),
    "daily_by_theme": _over_claims(trends.daily_by_theme),
    "emerging": _over_claims(emerging.emerging, claim_type=True),
    "emerging_driver": _over_claims(emerging.emerging_driver, claim_type=True),
    "emerging_onset": _over_claims(emerging.emerging_onset),
    "emerging_status": _over_claims(emerging.emerging_status),
    "emerging_top_cluster": _over_claims(emerging.emerging_top_cluster),
    "rise_scores": _over_claims(_rise_scores),
    "volume_basis": _over_claims(kpis.volume_basis),
    "generic_code_share": _over_claims(kpis.generic_code_share),
    "meta": _over_claims(kpis.meta),
    "interventions": _advised(interventions.interventions),
    "interventions_top": _advised(interventions.interventions, top_n=4),
    "theme_playbook": _advised(themes.theme_playbook),
    "business_case": _over_claims(interventions.business_case),
    "key_findings": _over_claims(findings.key_findings, claim_type=True),
    "cluster_profile": _over_claims(themes.cluster_profile),
    "top_providers": _over_claims(themes.top_providers),
    "sample_notes": _over_claims(themes.sample_notes, notes=True),
    "claim_list": _over_claims(browse.claim_list, page=2),
    "claim_page": _over_claims(browse.claim_page, page=150),
    "claim_list_filtered": _over_claims(browse.claim_list, theme="fwa_review", status="Paid", over_target=True, size=50),
    "claim_search": _over_claims(lambda claims: browse.list_view(browse.find_claims(claims, query=" Idiot ")), notes=True),
    "claim_detail": _over_claims(browse.claim_detail, claim_type=True, notes=True),
    "claim_lookup": _over_claims(browse.claim_detail, " c2600000007\t", claim_type=True, notes=True),
    "claim_timeline": _over_claims(browse.claim_timeline),
    "claim_stage_days": _over_claims(browse.claim_stage_days),
}

def _from_cube(output: Callable[[DataFrame], DataFrame]) -> Query:
    """The cube is written, read back and asked."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = f"{shared_folder(spark)}/cube-{uuid.uuid4().hex}"
        cube.write_cube(claims_of(spark, sf_dir, claim_type=True), path)
        rows = cube.read_cube(spark, path)
        return output(cube.at(rows, cube.as_of(rows)))

    return query


CUBE_QUERIES: dict[str, Query] = {
    "cube_kpis": _from_cube(cube.kpis_of), "cube_themes": _from_cube(cube.themes_of), "cube_segments": _from_cube(cube.segments_of),
    "cube_stages": _from_cube(cube.stages_of), "cube_daily": _from_cube(cube.daily_of), "cube_daily_themes": _from_cube(cube.daily_themes_of),
}


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The claims and their index are written, read back and searched."""
    path = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"
    claims = claims_of(spark, sf_dir, notes=True)
    search_index.write_searchable(claims, f"{path}/claims")
    stored = spark.read.schema(claims.schema).parquet(f"{path}/claims")
    search_index.index_files(stored).write.parquet(f"{path}/index")
    return browse.list_view(search_index.find_indexed(stored, search_index.read_index(spark, f"{path}/index"), " Idiot "))


QUERIES: dict[str, Query] = {**CLAIM_QUERIES, **CUBE_QUERIES, "claim_search_indexed": _searched, **TEXT_QUERIES}
