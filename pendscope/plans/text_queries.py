"""Queries over notes, documents, embeddings, conversations and events."""

from __future__ import annotations

import uuid
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pendscope.config import MIN_CONFIDENCE, NEEDS_REVIEW
from pendscope.functions.text import doc_text_sql
from pendscope.operators import cluster as clusters
from pendscope.operators import kmeans, scoring
from pendscope.operators.browse import claim_detail
from pendscope.operators.classify import TERM_SCHEMA, TOLERANCE, TextModel, certificate, class_probabilities, classify, fit_classifier
from pendscope.operators.routing import route_questions
from pendscope.operators.sampling import label_split, labelled_sample
from pendscope.operators.scope import confidence_floor
from pendscope.operators.themes import cluster_profile
from pendscope.operators.terms import doc_text, term_counts, tfidf, tokenise, vocabulary
from pendscope.plans.build import _point_to, build, current_build, enrich_claims, stored_catalogue, update_build, write_report
from pendscope.plans.reconcile import reconcile
from pendscope.session import cut_lineage, discard, shared_folder, spread, stored
from pendscope.sources.adapter import claims_of
from pendscope.sources.claims import read_claims
from pendscope.sources.playbook import THEMES, playbook
from pendscope.sources.tables import table
from pendscope.streaming.feed import daily_counts


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims_of(spark, sf_dir).filter("pended")


# a short list for the token query, stated here so that its SQL twin can use it too
COMMON_WORDS = ("the", "and", "of", "to", "in", "is", "it", "for", "on", "with", "as", "by", "at", "le", "la", "de", "el", "die", "der", "und")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word and pair counts of every document, with and without stop words, and a
    digest of the sequences."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    plain = tokenise(docs).selectExpr(
        "doc_id", "text", "size(words) AS n_words", "size(pairs) AS n_pairs", "md5(concat_ws(' ', words)) AS words_md5",
        "md5(concat_ws('|', pairs)) AS pairs_md5")
    return tokenise(plain, stop_words=COMMON_WORDS).selectExpr(
        "doc_id", "n_words", "n_pairs", "words_md5", "pairs_md5", "size(words) AS n_kept", "md5(concat_ws(' ', words)) AS kept_md5")


def document_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary(term_counts(table(spark, sf_dir, "documents"), ["doc_id"]), 3)


def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = tfidf(table(spark, sf_dir, "documents"), "doc_id", min_df=3)
    return weights.selectExpr("doc_id", "term", "round(weight, 6) AS weight")


SPLIT_SAMPLE = 150  # smaller than any table, so that rows stay unlabelled


def document_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_split(table(spark, sf_dir, "documents"), "doc_id", "lang", SPLIT_SAMPLE)


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _held(spark, sf_dir).select("true_theme", "theme")


def classifier_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = playbook(spark).selectExpr("theme", "theme_name AS name")
    return scoring.classifier_metrics(_classified(spark, sf_dir), "true_theme", "theme", names)


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.confusion_matrix(_classified(spark, sf_dir), "true_theme", "theme", [t[0] for t in THEMES])


def holdout_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.holdout_summary(_classified(spark, sf_dir), "true_theme", "theme")


def review_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.review_shares(claims_of(spark, sf_dir))


def code_only_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.code_only_accuracy(claims_of(spark, sf_dir))


def floored(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _held(spark, sf_dir).selectExpr("claim_id", "true_theme AS theme", "confidence")
    return confidence_floor(raw, MIN_CONFIDENCE, NEEDS_REVIEW)


def enrich_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = claims_of(spark, sf_dir)
    predictions = claims.filter("pended").select("claim_id", "theme", "confidence", "cluster_id")
    return enrich_claims(claims.select("claim_id", "status", "pended"), predictions)


def adjusted_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    clustered = _held(spark, sf_dir).filter("cluster_id IS NOT NULL")
    return scoring.adjusted_rand(clustered, "theme", "true_sub_cause", "cluster_id")


K_RULES = {f"k{k}": f"label % {k}" for k in (2, 3, 4, 5)}


def silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.silhouette(table(spark, sf_dir, "embeddings"), "embedding", ["label"])
    return found.selectExpr("labelling", "points", "round(silhouette, 5) AS silhouette")


def silhouette_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.silhouette_sampled(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return found.selectExpr("points", "round(silhouette, 5) AS silhouette")


def _named(spark: SparkSession, claims: DataFrame) -> DataFrame:
    """A catalogue stated by formula, stored as the report of a build and read back by its pointer."""
    out = f"{shared_folder(spark)}/named-{uuid.uuid4().hex}"
    stated = claims.filter("cluster_id IS NOT NULL").groupBy("cluster_id", "theme").agg(F.count("*").alias("claims")).selectExpr(
        "cluster_id", "theme", "claims", "array(upper(cluster_id), concat('of ', theme)) AS key_phrases", "concat('note of ', cluster_id) AS example_note",
        "cast(NULL AS double) AS silhouette", "true AS settled")
    write_report(stated, f"{out}/one", "clusters")
    _point_to(spark, out, f"{out}/one", 0)
    return stored_catalogue(spark, out)


def cluster_profile_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = claims_of(spark, sf_dir)
    return cluster_profile(claims, _named(spark, claims)).withColumn("key_phrases", F.concat_ws("; ", "key_phrases"))


def claim_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases on every claim's page; a held claim without a cluster has none, one not held has null."""
    claims = claims_of(spark, sf_dir, claim_type=True, notes=True)
    detail = claim_detail(claims, catalogue=_named(spark, claims))
    return detail.selectExpr("claim_id", "pended", "array_join(cluster_phrases, '; ') AS cluster_phrases")


def _k_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "embedding", *(f"{rule} AS {name}" for name, rule in K_RULES.items()))
    found = scoring.silhouette(points, "embedding", list(K_RULES))
    return found.selectExpr("part", "int(substr(labelling, 2)) AS k", "silhouette")


def choose_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.choose_k(_k_scores(spark, sf_dir)).selectExpr("k", "round(silhouette, 5) AS silhouette")


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the questions get a claim id made from their own number, another the name of a platform."""
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").selectExpr(
        "conv_id", "turn", "CASE conv_id % 4 WHEN 0 THEN concat(text, ' (c26', lpad(cast(conv_id AS string), 8, '0'), ')') "
        "WHEN 1 THEN concat(text, ' in asia') ELSE text END AS text")
    platforms = [row["r_name"] for row in table(spark, sf_dir, "region").select("r_name").distinct().collect()]  # a catalogue of 5 rows
    return route_questions(asked, platforms=platforms).drop("text")


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_counts(table(spark, sf_dir, "events"), "ts", "event_type")


def documents_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_text(claims_of(spark, sf_dir, notes=True))


def reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile(claims_of(spark, sf_dir))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from a sample of the labelled ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").selectExpr("doc_id", "concat('quality ', quality) AS quality")
    sample = labelled_sample(docs.join(labels, "doc_id"), "doc_id", "quality")
    return classify(docs, "doc_id", "text", fit_classifier(sample, "doc_id", "text", "quality")).withColumnRenamed("theme", "quality")


def classified_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from a sample."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_classifier(labelled_sample(docs, "doc_id", "lang"), "doc_id", "text", "lang")
    return classify(docs, "doc_id", "text", model).withColumnRenamed("theme", "lang")


def fit_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof of the language model: it is stored, read back, and no entry of the gradient of its loss is over the tolerance."""
    sample = cut_lineage(labelled_sample(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "doc_id", "lang"))
    path = f"{shared_folder(spark)}/model-{uuid.uuid4().hex}"
    fit_classifier(sample, "doc_id", "text", "lang").save(spark, path)
    found = certificate(sample, "doc_id", "text", "lang", TextModel.load(spark, path))
    return found.selectExpr("documents", "labels", "terms", f"largest <= {TOLERANCE} AS proven")


# a model stated by formula over COMMON_WORDS, so that scoring alone can be checked
STATED_LABELS = ("it's", "b", "c")
STATED_BIAS = (0.25, -0.5, 0.125)


def stated_term(i: int) -> tuple[str, float, list[float]]:
    return COMMON_WORDS[i], 1 + i / 8, [((i * 7 + j * 3) % 11 - 5) / 2 for j in range(len(STATED_LABELS))]


def scored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeliest label and its probability, left for review below the floor, under a stated model."""
    terms = spark.createDataFrame([stated_term(i) for i in range(len(COMMON_WORDS))], TERM_SCHEMA)
    model = TextModel(STATED_LABELS, STATED_BIAS, terms, len(COMMON_WORDS))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = confidence_floor(class_probabilities(docs, "doc_id", "text", model), MIN_CONFIDENCE, NEEDS_REVIEW)
    return found.selectExpr("doc_id", "theme AS label", "round(confidence, 6) AS confidence")


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as notes, their language as the theme."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "lang AS theme", "text AS adjuster_note")


def _clusters(spark: SparkSession, sf_dir: str):
    return clusters.cluster(_notes(spark, sf_dir))


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir).members.select("theme", "note_id", "claims", "cluster_id", "distance")


def cluster_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clusters(spark, sf_dir).catalogue


def _plain_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The vectors of the notes with numbers for terms, and their names; the steps that led to them are gone."""
    found, names = clusters.weigh_numbered(clusters.distinct_notes(_notes(spark, sf_dir), "theme", "adjuster_note"), stop_words=())
    vectors = stored(found, "vectors")
    discard(found, keep=names)
    return vectors, names


def cluster_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of the fit by joins, the second under bounds: sizes and squared lengths of two clusters per theme."""
    (vectors, names), runs = _plain_vectors(spark, sf_dir), kmeans.Runs.of((2,), 1)
    discard(names)
    start = stored(kmeans.start_centres(vectors, runs, 1), "centres")
    state = stored(kmeans.nearest(kmeans.pairs(vectors, runs), vectors, start, 2).drop("gaps", "gap"), "state")
    moved = stored(kmeans.average(vectors, state, start, 2), "centres")
    centres = moved.drop("old")
    state = stored(kmeans.reassign(state, cut_lineage(kmeans.moves(moved, 2)), vectors, centres, 2), "state")
    again = kmeans.average(vectors, state, centres, 2).groupBy("theme").agg(F.expr("array(sum(v[0] * v[0]), sum(v[1] * v[1])) AS lengths"))
    sizes = state.groupBy("theme").agg(F.expr("array(sum(if(label = 0, claims, 0)), sum(if(label = 1, claims, 0))) AS sizes"))
    rows = sizes.join(again, "theme").selectExpr("theme", "lengths", "posexplode(sizes) AS (cluster, size)")
    return rows.selectExpr("theme", "cluster", "size", "round(lengths[cluster], 6) AS length")


def key_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Key phrases of clusters stated by formula: three per language, by the notes' digests."""
    vectors, names = _plain_vectors(spark, sf_dir)
    members = vectors.selectExpr("theme", "note_id", "claims", "concat(theme, ':', ascii(note_id) % 3) AS cluster_id")
    return clusters.key_phrases(vectors, members, names=names).withColumn("key_phrases", F.concat_ws("; ", "key_phrases"))


def _stated_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a cluster and a distance stated by formula."""
    return clusters.relabel(table(spark, sf_dir, "documents").selectExpr(
        "lang AS theme", "int(doc_id % 7 % 4) AS label", "1L + doc_id % 3 AS claims", "text AS note", "doc_id * 37 % 101 / 8D AS distance"))


def cluster_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stated_members(spark, sf_dir).groupBy("theme", "label", "cluster_id").agg(F.sum("claims").alias("claims"))


def cluster_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.examples(_stated_members(spark, sf_dir)).selectExpr("cluster_id", "theme", "claims", "md5(example_note) AS example_md5")


REBUILT_DAYS = 90


def _built(spark: SparkSession, sf_dir: str, days: int | None) -> tuple[DataFrame, str, date]:
    """The claims, the place of a build over their latest days (all with None), and the last day."""
    claims = claims_of(spark, sf_dir, claim_type=True, notes=True)
    day = F.expr("cast(o_orderdate AS date)")
    first, last = table(spark, sf_dir, "orders").agg(F.min(day), F.max(day)).first()
    out = f"{shared_folder(spark)}/rebuild-{uuid.uuid4().hex}"
    build(spark, claims, out, first if days is None else last - timedelta(days=days - 1), last)
    return claims, out, last


def _raw_of(spark: SparkSession, folder: str) -> DataFrame:
    return read_claims(spark, f"{folder}/claims", enriched=False).select("claim_id", "status", "pended", "pend_code", "billed_amount")


def _rebuilt(spark: SparkSession, sf_dir: str, days: int | None) -> tuple[str, DataFrame]:
    """Folder and raw claims of a build that is current then."""
    folder = current_build(spark, _built(spark, sf_dir, days)[1])
    return folder, _raw_of(spark, folder)


def _plain_columns(spark: SparkSession, folder: str, raw: DataFrame) -> DataFrame:
    found = read_claims(spark, f"{folder}/claims_enriched").selectExpr("claim_id", "theme IS NOT NULL AS has_theme")
    return _with_as_of(spark, folder, raw.join(found, "claim_id"))


def _with_as_of(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    window = spark.read.parquet(f"{folder}/report/window").selectExpr("date_format(as_of, 'yyyy-MM-dd') AS as_of")
    return rows.withColumn("billed_amount", F.col("billed_amount").cast("double")).withColumn("as_of", window.scalar())


def rebuilt_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest days through the whole build, in the plain columns that SQL can check; ``rebuilt_span`` is the whole."""
    return _plain_columns(spark, *_rebuilt(spark, sf_dir, REBUILT_DAYS))


def rebuilt_span_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days through the whole build, in the columns that SQL can check."""
    return _plain_columns(spark, *_rebuilt(spark, sf_dir, None))


def rebuilt_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A build of the latest days that is brought up to date after the claims of one day, ten days before the last, have
    changed: their bills rise by one, and half of them are denied."""
    claims, out, last = _built(spark, sf_dir, REBUILT_DAYS)
    day = F.col("received_date") == F.lit(last - timedelta(days=10))
    changed = claims.withColumns({
        "billed_amount": F.when(day, F.expr("cast(billed_amount + 1 AS decimal(12,2))")).otherwise(F.col("billed_amount")),
        "status": F.when(day & F.expr("int(substr(claim_id, 4)) % 2 = 0"), "Denied").otherwise(F.col("status"))})
    assert update_build(spark, changed, out) == [last - timedelta(days=10)]
    folder = current_build(spark, out)
    return _plain_columns(spark, folder, _raw_of(spark, folder))


def rebuilt_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days from first to last receipt through the whole build, with theme, confidence and cluster of every claim."""
    folder, raw = _rebuilt(spark, sf_dir, None)
    found = read_claims(spark, f"{folder}/claims_enriched").select("claim_id", "theme", "confidence", "cluster_id")
    return _with_as_of(spark, folder, raw.join(found, "claim_id"))


TEXT_QUERIES = {
    "tokens": tokens,
    "vocabulary": document_vocabulary,
    "tfidf_weights": tfidf_weights,
    "label_split": document_split,
    "doc_text": documents_text,
    "confidence_floor": floored,
    "enrich_join": enrich_join,
    "classifier_metrics": classifier_metrics,
    "confusion_matrix": confusion_matrix,
    "holdout_summary": holdout_summary,
    "review_shares": review_shares,
    "code_only_accuracy": code_only_accuracy,
    "adjusted_rand": adjusted_rand,
    "silhouette": silhouette,
    "silhouette_sampled": silhouette_sampled,
    "cluster_profile_named": cluster_profile_named,
    "claim_phrases": claim_phrases,
    "choose_k": choose_k,
    "route_questions": routed,
    "events_daily": events_daily,
    "reconcile": reconciled,
    "classify": classified,
    "classify_documents": classified_documents,
    "cluster": clustered,
    "cluster_catalogue": cluster_catalogue,
    "cluster_step": cluster_step,
    "key_phrases": key_phrases,
    "cluster_relabel": cluster_relabel,
    "cluster_examples": cluster_examples,
    "fit_check": fit_check,
    "score_documents": scored_documents,
    "rebuild_window": rebuilt_window,
    "rebuild_span": rebuilt_span,
    "rebuild_span_plain": rebuilt_span_plain,
    "rebuild_changed_day": rebuilt_day,
}

