"""Document fingerprints by winnowing.

A text's units are hashed, runs of ``GRAM`` units give gram hashes, and of every window of ``WINDOW`` neighbouring
grams the smallest is kept, the rightmost one where several are equal, with its place. Two texts that share a passage
of ``WINDOW + GRAM - 1`` units share a kept hash; nothing shorter than a gram is ever matched.

Units are words of up to sixteen characters and the single characters of longer runs without white space, so the units
of a passage do not depend on what stands before it. All texts, short or long, have the same kind of marks, dense enough
(two in ``WINDOW + 1`` grams) that a few sentences have several. Everything is SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pendscope.llm.common import SPACE, broadcast_if_small

GRAM = 4
WINDOW = 5
PLACE = 2147483647  # a mark is 32 bits of hash, then PLACE - place: the least mark is the rightmost least hash
SEGMENTS = 64
ROWS_PER_BUCKET = 256
_UNIT = f"(?<![^{SPACE}])[^{SPACE}]{{1,16}}(?![^{SPACE}])|[^{SPACE}]".replace("\\", "\\\\")


def bound(value: str, name: str, body: str) -> str:
    """SQL that works ``value`` out once and uses it as ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def marks(units: str, gram: int, window: int) -> str:
    """SQL for the winnowed marks (array of bigint) of an array of strings. Fewer units than a gram make one gram; fewer
    grams than a window make one window; no units make no marks."""
    mark = "shiftleft({0} & 4294967295, 31) | (" + str(PLACE) + " - {1})"
    grams = f"transform(sequence(0, size(h) - {gram}), i -> {mark.format('xxhash64(' + ', '.join(f'h[i + {j}]' for j in range(gram)) + ')', 'i')})"
    keys = f"if(size(h) < {gram}, array({mark.format('xxhash64(h)', '0')}), {grams})"
    kept = f"if(size(g) <= {window}, array(array_min(g)), array_distinct(transform(sequence(1, size(g) - {window - 1}), i -> array_min(slice(g, i, {window})))))"
    hashed = f"transform({units}, u -> xxhash64(u))"
    return bound(hashed, "h", f"if(size(h) = 0, cast(array() AS array<bigint>), {bound(keys, 'g', kept)})")


def fingerprint_sql(text: str) -> str:
    """SQL for the marks of a text."""
    return marks(f"regexp_extract_all({text}, '{_UNIT}', 0)", GRAM, WINDOW)


def likeness(marks_a: str, marks_b: str) -> str:
    """SQL for the Jaccard likeness of two fingerprints by hash; two texts without units are alike."""
    hashes = "array_distinct(transform({0}, m -> shiftright(m, 31)))"
    return bound(hashes.format(marks_a), "a", bound(
        hashes.format(marks_b), "b", "if(size(a) + size(b) = 0, 1D, size(array_intersect(a, b)) / double(size(array_union(a, b))))"))


def shown(marks_of: str) -> str:
    """SQL for a fingerprint as text: hash@place of the marks."""
    return f"array_join(transform({marks_of}, m -> concat(hex(shiftright(m, 31)), '@', {PLACE} - (m & {PLACE}))), ' ')"


def with_next(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``docs`` with ``next_<column>`` of the row that follows by key (null keys first, equal keys by the columns); the
    last row is followed by the first.

    Rows go to buckets of key ranges: segments between approximate quantiles, each cut into equal widths, as many as the
    table needs for some ``ROWS_PER_BUCKET`` rows each. The first rows of a bucket are also put at the end of the bucket
    before, so one shuffle of the rows does, and no task sees more than a bucket. Rows of one key are in one bucket."""
    order = "at_key"
    rows = docs.withColumn(order, F.coalesce(F.col(key).cast("long"), F.lit(-2 ** 63)))
    edges = sorted(set(docs.stat.approxQuantile(key, [i / SEGMENTS for i in range(SEGMENTS + 1)], 0.002))) if docs.columns else []
    if len(edges) < 2:
        edges = [edges[0], edges[0] + 1] if edges else [0.0, 1.0]
    width = max(1, -(-docs.count() // (SEGMENTS * ROWS_PER_BUCKET)))
    limits = "array(" + ", ".join(f"{edge!r}D" for edge in edges) + ")"
    segment = f"least({len(edges) - 1}, greatest(1, size(filter({limits}, e -> e <= double({order})))))"
    part = bound(segment, "s", f"s * {width} + greatest(0, least({width - 1}, int((double({order}) - {limits}[s - 1]) / ({limits}[s] - {limits}[s - 1]) * {width})))")
    rows = rows.withColumn("bucket", F.expr(f"if({order} = {-2 ** 63 + 1} - 1, -1, {part})").cast("long"))
    firsts = rows.groupBy("bucket").agg(F.min(order).alias(order))
    by_bucket = Window.orderBy("bucket")  # one narrow row per bucket
    firsts = firsts.select(order, F.coalesce(F.lag("bucket").over(by_bucket), F.max("bucket").over(Window.partitionBy())).alias("earlier"),
                           F.lag("bucket").over(by_bucket).isNull().alias("around"))
    rows = rows.join(broadcast_if_small(firsts), order, "left")  # one row per bucket
    rows = rows.withColumn("place", F.explode(F.expr(
        "if(earlier IS NULL, array(named_struct('bucket', bucket, 'copy', false)), "
        "array(named_struct('bucket', bucket, 'copy', false), named_struct('bucket', earlier, 'copy', true)))")))
    rows = rows.withColumn("bucket", F.col("place.bucket")).withColumn("copy", F.col("place.copy"))
    following = Window.partitionBy("bucket").orderBy("copy", order, *columns)
    rows = rows.select("*", *(F.lead(c).over(following).alias(f"next_{c}") for c in columns))
    return rows.filter("NOT copy").drop(order, "bucket", "earlier", "around", "place", "copy")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, body, marks (of the text), edited (the text whose last quarter is replaced by the
    start of the next document), edited_marks, next_marks.

    Null texts count as empty; repeated rows follow one another; equal texts have equal marks. An empty table gives no rows."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = rows.select("key", "body", F.expr(fingerprint_sql("body")).alias("marks"))
    rows = with_next(rows, "key", ["body", "marks"]).withColumn("edited", F.expr(
        "concat(left(body, length(body) - length(body) div 4), left(next_body, length(body) div 4))"))
    return rows.select(F.col("key").alias(key), "body", "marks", "edited", F.expr(fingerprint_sql("edited")).alias("edited_marks"), "next_marks")


def document_fingerprints(docs: DataFrame) -> DataFrame:
    return fingerprints(docs).select(
        "doc_id", F.length("body").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        F.expr(shown("marks")).alias("fingerprint"), F.expr(shown("edited_marks")).alias("edited_fingerprint"),
        F.expr(likeness("marks", "edited_marks")).alias("near_edited"), F.expr(likeness("marks", "next_marks")).alias("near_next"))
