"""Terms, classifier, clusters and their scores, checked by brute force."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from pendscope.functions.text import doc_text_sql, english_stop_words
from pendscope.operators import cluster as clusters
from pendscope.operators import kmeans
from pendscope.operators import scoring
from pendscope.operators.classify import TextModel, classify, fit_classifier
from pendscope.operators.cluster import assign, cluster, pick_k
from pendscope.operators.sampling import label_split, labelled_sample
from pendscope.operators.terms import tfidf, tokenise
from pendscope.sources.tables import table

TEXTS = ["The café café closed, item_3 a b", "closed again: the café", "", "Über 22 items, items items", "closed the item_3"]


def words(text: str) -> list[str]:
    return re.findall(r"(?u)\b\w\w+\b", text.lower())


def test_words_and_pairs(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    for row in tokenise(df).collect():
        mine = words(row["text"])
        assert row["words"] == mine and row["pairs"] == [f"{a} {b}" for a, b in zip(mine, mine[1:])]
    stop = english_stop_words()
    kept = {r["id"]: r for r in tokenise(df, stop_words=stop).collect()}
    assert "the" in stop and kept[1]["pairs"] == ["closed café"]


def test_tfidf_against_plain_python(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {(r["id"], r["term"]): r["weight"] for r in tfidf(df, "id", min_df=2).collect()}
    counts = {}
    for i, text in enumerate(TEXTS):
        mine = words(text)
        counts[i] = Counter(mine + [f"{a} {b}" for a, b in zip(mine, mine[1:])])
    frequency = Counter(term for c in counts.values() for term in c)
    want = {}
    for i, c in counts.items():
        raw = {t: (1 + math.log(n)) * (math.log((1 + len(TEXTS)) / (1 + frequency[t])) + 1) for t, n in c.items() if frequency[t] >= 2}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        want |= {(i, t): v / norm for t, v in raw.items()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_document_text_of_missing_parts(spark):
    df = spark.createDataFrame([("on hold", "PND-220"), (None, None)], "adjuster_note string, pend_code string")
    assert [r[0] for r in df.select(F.expr(doc_text_sql())).collect()] == ["on hold pendcode_pnd_220", " pendcode_none"]


@pytest.fixture(scope="module")
def held(spark):
    docs = table(spark, SF_DIR, "documents").filter("length(text) > 200")
    return docs.selectExpr("cast(doc_id AS string) AS claim_id", "lang AS true_theme", "text").persist()


def test_classifier_beats_the_floor_and_survives_saving(spark, held, tmp_path):
    sample = labelled_sample(held, "claim_id", "true_theme", size=100)
    model = fit_classifier(sample.filter("split = 'train'"), "claim_id", "text", "true_theme")
    split = label_split(held, "claim_id", "true_theme", size=100)
    scored = classify(held, "claim_id", "text", model).withColumnRenamed("theme", "predicted").join(split, "claim_id").persist()
    assert scored.count() == held.count()
    right = scored.filter("split <> 'train' AND predicted <> 'needs_review'").agg(F.avg(F.expr("if(predicted = true_theme, 1, 0)"))).first()[0]
    assert right > 0.9
    assert scored.filter("(confidence < 0.55) <> (predicted = 'needs_review')").count() == 0
    model.save(spark, str(tmp_path / "model"))
    again = classify(held, "claim_id", "text", TextModel.load(spark, str(tmp_path / "model")))
    assert sorted(again.collect()) == sorted(scored.select("claim_id", F.col("predicted").alias("theme"), "confidence").collect())
    nothing_known = spark.createDataFrame([("x", "qqq zzz"), ("y", "")], "claim_id string, text string")
    assert classify(nothing_known, "claim_id", "text", model).count() == 2


def test_labelled_sample_is_repeatable_and_stratified(held):
    sample = labelled_sample(held, "claim_id", "true_theme", size=100)
    rows = sample.select("claim_id", "true_theme", "split").collect()
    assert len(rows) == 100 and sorted(rows) == sorted(labelled_sample(held.repartition(5), "claim_id", "true_theme", size=100).select("claim_id", "true_theme", "split").collect())
    sizes = Counter(r["true_theme"] for r in rows)
    tests = Counter(r["true_theme"] for r in rows if r["split"] == "test")
    assert all(tests[t] == int(n * 0.25) for t, n in sizes.items())


def test_clusters_recover_planted_groups(spark):
    texts = {"left": "letter mailed to member about other cover", "right": "contract rate missing, vendor asked for price"}
    rows = [(f"c{i}", "cob", f"{texts[side]} {i % 4}", side) for i, side in enumerate(["left", "right"] * 60)]
    rows += [(f"s{i}", "pricing", "too few claims to split", "only") for i in range(10)]
    rows += [("n0", "needs_review", "vague", "none")]
    claims = spark.createDataFrame(rows, "claim_id string, theme string, adjuster_note string, truth string")
    found = cluster(claims, restarts=3)
    assert found.rounds < 50
    ids = assign(claims, found)
    joined = ids.join(claims, "claim_id")
    assert ids.count() == 130
    quality = {r["theme"]: r for r in scoring.adjusted_rand(joined, "theme", "truth", "cluster_id").collect()}
    assert quality["cob"]["adjusted_rand_index"] == 1.0 and quality["cob"]["clusters"] == 2 and quality["pricing"]["clusters"] == 1
    catalogue = {r["cluster_id"]: r for r in found.catalogue.collect()}
    assert set(catalogue) == {"cob:1", "cob:2", "pricing:1"}
    assert catalogue["pricing:1"]["silhouette"] is None and catalogue["pricing:1"]["key_phrases"] == []
    for row in (catalogue["cob:1"], catalogue["cob:2"]):
        chosen = [set(p.split()) for p in row["key_phrases"]]
        assert len(chosen) == 4
        assert not any(a <= b or b <= a for i, a in enumerate(chosen) for b in chosen[i + 1:])


def test_small_themes_stay_whole(spark):
    claims = spark.createDataFrame([("a", "cob", "one note"), ("b", "cob", None)], "claim_id string, theme string, adjuster_note string")
    found = cluster(claims)
    assert {r["cluster_id"] for r in assign(claims, found).collect()} == {"cob:1"}
    row = found.catalogue.first()
    assert (row["claims"], row["key_phrases"], row["silhouette"]) == (2, [], None)


def silhouette_by_hand(x: np.ndarray, label: np.ndarray) -> float:
    """Squared Euclidean, every point against every other."""
    scores = []
    for i in range(len(x)):
        gap = ((x - x[i]) ** 2).sum(axis=1)
        own = (label == label[i]) & (np.arange(len(x)) != i)
        if not own.any():
            scores.append(0.0)
            continue
        a = gap[own].mean()
        b = min(gap[label == c].mean() for c in set(label) - {label[i]})
        scores.append((b - a) / max(a, b))
    return float(np.mean(scores))


def test_silhouette_and_choice_of_k(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.4, (20, 3)) for c in (0, 3, 6)])
    three, two = np.repeat([0, 1, 2], 20), np.repeat([0, 1, 1], 20)
    three[0] = 9  # a cluster of one
    df = spark.createDataFrame([(i, x[i].tolist(), int(three[i]), int(two[i])) for i in range(60)], "id int, v array<double>, k3 int, k2 int")
    got = {r["labelling"]: r["silhouette"] for r in scoring.silhouette(df, "v", ["k3", "k2"]).collect()}
    assert got["k3"] == pytest.approx(silhouette_by_hand(x, three)) and got["k2"] == pytest.approx(silhouette_by_hand(x, two))
    scores = spark.createDataFrame([("a", 2, 0.50), ("a", 3, 0.52), ("a", 4, 0.53), ("a", 5, 0.2), ("b", 2, 0.1), ("b", 3, 0.3)], "part string, k int, silhouette double")
    assert {r["part"]: r["k"] for r in scoring.choose_k(scores).collect()} == {"a": 2, "b": 3}
    assert pick_k({2: 0.5, 3: 0.52, 4: 0.534}) == 3 and pick_k({2: None, 3: None}) == 2


def test_silhouette_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(scoring, "within", lambda df: False)
    test_silhouette_and_choice_of_k(spark)


def test_scores_of_known_predictions(spark):
    pairs = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("b", "needs_review")]
    df = spark.createDataFrame(pairs, "truth string, guess string")
    scores = {r["class"]: r for r in scoring.class_scores(df, "truth", "guess").collect()}
    assert scores["a"]["recall"] == pytest.approx(5 / 7) and scores["b"]["precision"] == pytest.approx(3 / 5)
    assert scores["needs_review"]["recall"] == 0 and scores["needs_review"]["f1"] == 0
    cells = {(r["label"], r["predicted"]): r["n"] for r in scoring.confusion_matrix(df, "truth", "guess", ["a", "b", "c"]).collect()}
    assert len(cells) == 9 and cells["a", "b"] == 2 and cells["c", "c"] == 0
    assert scoring.holdout_summary(df, "truth", "guess").first()["accuracy"] == round(8 / 11, 4)


def test_labels_keep_their_apostrophes(spark):
    docs = spark.createDataFrame([(k, "red green" if k % 2 else "blue black", "it's" if k % 2 else "a\\b") for k in range(20)], "id int, text string, label string")
    model = fit_classifier(docs, "id", "text", "label")
    assert {r["id"]: r["theme"] for r in classify(docs, "id", "text", model, floor=0.0).collect()} == {r["id"]: r["label"] for r in docs.collect()}


def test_run_scores_against_all_pairs(spark):
    """Silhouettes and costs of the set-based fit, from the same assignment, by brute force."""
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice([f"{side}{j}" for j in range(6)], 4)) for side in ("a", "b", "c") for _ in range(12)]
    claims = spark.createDataFrame([("t", text) for text in texts], "theme string, adjuster_note string")
    notes = clusters.distinct_notes(claims, "theme", "adjuster_note").persist()
    vectors, runs = clusters.weigh(notes, 1, ()).persist(), kmeans.Runs.of((2, 3), 2)
    found = kmeans.fit(vectors, runs).persist()
    assigned = [dict(r.asDict(), labels=[]) for r in found.filter("run = 0").orderBy("note_id").collect()]
    for run in range(4):
        for row, r in zip(assigned, found.filter(f"run = {run}").orderBy("note_id").collect()):
            row["labels"].append(r["label"])
    assert found.agg({"rounds": "max"}).first()[0] < 50
    terms = {term: i for i, term in enumerate(sorted({t for r in vectors.collect() for t in r["terms"]}))}
    x = {r["note_id"]: np.zeros(len(terms)) for r in assigned}
    for r in vectors.collect():
        for term, weight in zip(r["terms"], r["ws"]):
            x[r["note_id"]][terms[term]] = weight
    scores = {r["run"]: r for r in kmeans.run_scores(found).collect()}
    copies = [r["claims"] for r in assigned]
    points = np.repeat(np.stack([x[r["note_id"]] for r in assigned]), copies, axis=0)
    for run in range(4):
        label = np.repeat([r["labels"][run] for r in assigned], copies)
        if len(set(label)) > 1:
            means = np.stack([points[label == c].mean(axis=0) for c in label])
            assert scores[run]["cost"] == pytest.approx(((points - means) ** 2).sum(), abs=1e-2)
            assert scores[run]["silhouette"] == pytest.approx(silhouette_by_hand(points, label), abs=1e-2)
