"""Winnowing against a plain calculation, the next document, and the guarantee."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from pendscope.llm import fingerprints as fp

from llm_cases import STORY, awkward, nothing, wide  # noqa: F401


def ordered(rows):
    return sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""))


def test_winnowing(spark):
    """Rightmost minimum of every window, from the same hashes."""
    words = [f"w{k * k % 23}" for k in range(120)]
    df = spark.createDataFrame([(words,)], "w array<string>")
    got = df.select(F.expr(fp.marks("w", 3, 7)).alias("m")).first()["m"]
    grams = df.select(F.expr("transform(sequence(0, size(w) - 3), i -> xxhash64(xxhash64(w[i]), xxhash64(w[i + 1]), xxhash64(w[i + 2])) & 4294967295)").alias("g")).first()["g"]
    want = set()
    for start in range(len(grams) - 6):
        least = min(grams[start:start + 7])
        want.add((least, max(k for k in range(start, start + 7) if grams[k] == least)))
    assert {(m >> 31, fp.PLACE - (m & fp.PLACE)) for m in got} == want


def test_next_and_edited(awkward):
    docs = ordered(awkward.collect())
    want = []
    for k, row in enumerate(docs):
        text, following = row["text"] or "", docs[(k + 1) % len(docs)]["text"] or ""
        quarter = len(text) // 4
        want.append((row["doc_id"], len(text), hashlib.sha256((text[:len(text) - quarter] + following[:quarter]).encode()).hexdigest()))
    rows = fp.document_fingerprints(awkward).collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in rows), key=str) == sorted(want, key=str)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    prints = {}
    for row in awkward.select("doc_id", "text").join(fp.document_fingerprints(awkward), "doc_id").collect():
        prints.setdefault(row["text"], set()).add(row["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_many_buckets(spark):
    """Uneven, repeated and far keys; the next row is found across buckets."""
    docs = spark.range(900).select(F.expr("if(id < 300, id * 1000000007, if(id < 600, 5, -id))").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    rows = ordered(docs.collect())
    want = sorted((r["text"], rows[(k + 1) % len(rows)]["text"]) for k, r in enumerate(rows))
    short, fp.ROWS_PER_BUCKET = fp.ROWS_PER_BUCKET, 2
    try:
        got = fp.with_next(docs, "doc_id", ["text"]).select("text", "next_text").collect()
    finally:
        fp.ROWS_PER_BUCKET = short
    assert sorted(map(tuple, got)) == want


def test_likeness_and_guarantee(spark):
    passage = " ".join(f"shared{k}" for k in range(fp.WINDOW + fp.GRAM - 1))
    texts = [" ".join(f"{side}{k}" for k in range(300)) + " " + passage + " " + " ".join(f"{side}z{k}" for k in range(300)) for side in ("left", "right")]
    rows = fp.fingerprints(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")).collect()
    hashes = [{m >> 31 for m in r["marks"]} for r in rows]
    assert hashes[0] & hashes[1]
    row = fp.document_fingerprints(spark.createDataFrame([(1, STORY * 4), (2, "entirely other things are said here " * 60)], "doc_id bigint, text string")).orderBy("doc_id").first()
    assert row["near_edited"] > 0.3 > row["near_next"]


def test_shape(wide, nothing):
    assert fp.document_fingerprints(wide).count() == wide.count()
    assert fp.document_fingerprints(nothing).count() == 0


def likeness_by_hand(spark, a: str, b: str) -> float:
    """From the units up, in plain Python; only the hash function is Spark's."""
    def kept(text: str) -> set[int]:
        units = re.findall(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,16}(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D]", text)
        grams = [units[k:k + fp.GRAM] for k in range(len(units) - fp.GRAM + 1)]
        if not units:
            return set()
        if not grams:
            return {("whole", tuple(units))}
        frame = spark.createDataFrame([(k, g) for k, g in enumerate(grams)], "k int, g array<string>")
        call = ", ".join(f"xxhash64(g[{j}])" for j in range(fp.GRAM))
        codes = [r["h"] for r in frame.selectExpr("k", f"xxhash64({call}) & 4294967295 AS h").orderBy("k").collect()]
        return {min(codes[k:k + fp.WINDOW]) for k in range(max(1, len(codes) - fp.WINDOW + 1))}

    x, y = kept(a), kept(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_near_columns_by_hand(spark, awkward):
    docs = ordered(awkward.filter("length(coalesce(text, '')) < 20000").collect())
    rows = ordered(awkward.join(fp.document_fingerprints(awkward.filter("length(coalesce(text, '')) < 20000")).drop("n_chars"), "doc_id").collect())
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["near_edited"], r["near_next"]))
    for k, doc in enumerate(docs):
        if doc["doc_id"] is None:
            continue
        text, following = doc["text"] or "", docs[(k + 1) % len(docs)]["text"] or ""
        quarter = len(text) // 4
        edited = text[:len(text) - quarter] + following[:quarter]
        want = (likeness_by_hand(spark, text, edited), likeness_by_hand(spark, text, following))
        assert any(abs(want[0] - a) < 1e-12 and abs(want[1] - b) < 1e-12 for a, b in got[doc["doc_id"]]), (doc["doc_id"], want, got[doc["doc_id"]])


def test_length_changes_nothing(spark):
    """One pair on both sides of any length is compared alike."""
    found = []
    for size in (150, 998, 999, 1000, 1001, 3000):
        words = " ".join(f"word{k}" for k in range(size))[:size]
        rows = fp.document_fingerprints(spark.createDataFrame([(1, words), (2, "zz " + words)], "doc_id bigint, text string")).orderBy("doc_id").collect()
        assert set(rows[0].asDict()) == {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"}
        found.append(rows[0]["near_next"])
    assert max(found[1:5]) - min(found[1:5]) < 0.02 and min(found) > 0.7
