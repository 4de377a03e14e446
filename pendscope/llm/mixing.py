"""Mixing sources to target weights with hash-threshold histograms.

Each row has a hash, uniform and fixed by its key. A source's budget becomes a threshold on
that hash: words are summed by source and the hash's first twelve bits, the bucket in which
the running sum passes the budget is found, only that bucket is split again by the next twelve
bits, and only the last bucket (one row in sixteen million) is put in order. All other rows are
taken or left by comparing their hash with the threshold, without a sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pendscope.llm.common import SMALL_ROWS, SPACE, broadcast_if_small, meet, stored, text_key

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
FINE = 256  # hashes in a bucket of the second level
COARSE = FINE * 4096


def words_in(text: str) -> str:
    return f"regexp_count(coalesce({text}, ''), '[^{SPACE}]+')".replace("\\", "\\\\")


def _ranges(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` stored in ranges of ``order``, with ``part``, the number of the range; a range is what one task holds."""
    return stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)


def _before(ranges: DataFrame, by: list[str], order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``ranges`` with the sums of ``sums`` (name: expression) over all earlier rows of the same ``by``: those of the same range by
    a window inside it, those of earlier ranges by their totals, of which a task sees one row per range."""
    within = Window.partitionBy("part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranges.groupBy("part", *by).agg(*(F.expr(f"sum({e})").alias(n) for n, e in sums.items()))
    totals = totals.select("part", F.struct(*(F.sum(n).over(earlier).alias(n) for n in sums)).alias("earlier"), *by)
    summed = ranges.select("*", *(F.sum(F.expr(e)).over(within).alias(n) for n, e in sums.items()))
    summed = summed.join(broadcast_if_small(totals), ["part", *by])
    return summed.withColumns({n: F.expr(f"coalesce({n}, 0) + coalesce(earlier.{n}, 0)") for n in sums}).drop("part", "earlier")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source_key, source, source_size and others) with ``target``, without ``source``.

    Weights repeat over the sources in code point order, null last. A source whose share is above
    ``MOST`` times its size stops there and the excess goes to the others by weight. With sources
    ordered by limit over weight the stopped ones come first, so one running sum finds them. Sources can be
    as many as hosts: they are put in order by ranges, and only three numbers meet the driver."""
    by_name = [F.col("source").isNull(), F.col("source")]
    named = _before(_ranges(sizes, by_name, "mix-names"), [], by_name, {"place": "1"})
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    weighted = named.withColumn("weight", weight.cast("long")).withColumn("most", F.col("source_size") * MOST).drop("place")
    by_ratio = [F.col("most") / F.col("weight"), *by_name]
    ranges = _ranges(weighted, by_ratio, "mix-ratios")
    words, weights = (n or 0 for n in ranges.agg(F.sum("source_size"), F.sum("weight")).first())
    judged = _before(ranges, [], by_ratio, {"most_before": "most", "weight_before": "weight"})
    judged = (
        judged.withColumn("left", F.lit(float(words)) * SHARE - F.col("most_before")).withColumn("weight_left", F.lit(weights) - F.col("weight_before"))
        .withColumn("stopped", F.col("most") * F.col("weight_left") <= F.col("weight") * F.col("left"))
    )
    level = judged.filter("NOT stopped").agg(F.min_by(F.col("left") / F.col("weight_left"), F.struct(*by_ratio))).first()[0]  # of ties the first in order
    target = F.when(F.col("stopped"), F.col("most").cast("double")).otherwise(F.col("weight") * F.lit(level).cast("double"))
    return judged.withColumn("target", target).drop("source", "weight", "most", "most_before", "weight_before", "left", "weight_left", "stopped")


def _at_source(rows: DataFrame, levels: DataFrame) -> DataFrame:
    """``rows`` with the columns that ``levels`` has for their source. Beyond ``SMALL_ROWS`` sources those of most rows are broadcast,
    so that no source is dealt to one task."""
    if levels.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return rows.join(F.broadcast(levels.drop("n_rows")), "source_key")
    return meet(rows, levels, "source_key", "n_rows", levels.agg(F.sum("n_rows")).first()[0])


def _passing(sums: DataFrame, bucket: str, budget: str) -> DataFrame:
    """Per source the bucket in which the running sum passes ``budget`` and what is left there."""
    running = Window.partitionBy("source_key").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sums.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
        .filter(f"before <= {budget} AND {budget} < before + words")
        .selectExpr("source_key", bucket, f"{budget} - before AS left_{bucket}")
    )


def _hash(key: str, seed: str) -> Column:
    """32 bits, uniform and the same in every run."""
    text = F.concat_ws(":", F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _levels(docs: DataFrame, key: str, text: str, source: str, seed: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sizes and hashes of all rows; per source the whole copies and the bucket of the threshold; and the rows in that
    bucket with the words they add (``more``)."""
    rows = stored(docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), F.expr(words_in(f"`{text}`")).cast("long").alias("size"),
        _hash(key, seed).alias("hash"), F.monotonically_increasing_id().alias("tie")).withColumn("source_key", text_key("source")), "mix-sizes")

    sums = stored(rows.withColumn("coarse", F.expr(f"hash div {COARSE}")).groupBy("source_key", "coarse").agg(
        F.first("source").alias("source"), F.sum("size").alias("words"), F.count("*").alias("n_rows")), "mix-sums")
    sizes = sums.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size"), F.sum("n_rows").alias("n_rows"))
    targets = source_targets(sizes).withColumn("whole", F.when(F.col("source_size") > 0, F.expr(
        f"least({MOST}, cast(floor(target) as bigint) div source_size)")).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("budget", F.expr(f"if(whole = {MOST}, 0, cast(floor(target) as bigint) - whole * source_size)"))

    coarse = _passing(sums.join(targets.select("source_key", "budget"), "source_key"), "coarse", "budget")
    levels = stored(targets.join(coarse, "source_key", "left"), "mix-levels")

    near = levels.filter("coarse IS NOT NULL").select("source_key", "coarse", "left_coarse", "n_rows")
    inside = _at_source(rows, near).filter(f"hash div {COARSE} = coarse").withColumn("fine", F.expr(f"hash div {FINE}"))
    fine = _passing(inside.groupBy("source_key", "fine").agg(F.sum("size").alias("words"), F.first("left_coarse").alias("left_coarse")),
                    "fine", "left_coarse")
    levels = stored(levels.join(fine, "source_key", "left"), "mix-levels").select(
        "source_key", "source_size", "target", "whole", "fine", F.col("left_fine").alias("room"), "n_rows")

    at_threshold = _at_source(rows.withColumn("at", F.expr(f"hash div {FINE}")), levels.filter("fine IS NOT NULL")).filter("at = fine")
    order = [F.col(c) for c in ("source_key", "hash", "key", "size", "tie")]  # rows of null or repeated keys share a hash, and any number of tasks
    last = _before(_ranges(at_threshold, order, "mix-threshold"), ["source_key"], order, {"sizes_before": "size"})
    last = last.withColumn("more", F.expr("greatest(0, least(size, room - sizes_before))"))
    return rows, levels, last.drop("sizes_before")


_ADDED = "int(more > 0 AND 2 * more >= size)"  # the row at the threshold counts as a copy where half of it or more is taken


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = "mix") -> DataFrame:
    """One row per row of ``docs``: key, size, source, source_size, target, copies, taken.

    ``copies`` is the number of whole texts the mix holds, ``taken`` the number of words. The one row at
    a source's threshold gives as many words as are left of the target (``taken``); it counts as a whole
    copy where that is half of it or more. Rows without text have size 0 and are never at a threshold. Equal
    rows share a hash; among them the order is by size, and equal rows in all are taken in any order, which
    gives the same rows. Null sources are a source of their own. An empty table gives no rows."""
    rows, levels, last = _levels(docs, key, text, source, seed)
    placed = _at_source(rows.withColumn("at", F.expr(f"hash div {FINE}")), levels)
    rest = placed.filter("fine IS NULL OR at <> fine").withColumn("more", F.expr("if(at < fine, size, 0)"))
    return rest.unionByName(last).selectExpr(
        f"key AS `{key}`", "size", "source AS `source`", "source_size", "target",
        f"whole + coalesce(if(at = fine, {_ADDED}, int(at < fine)), 0) AS copies", "whole * size + coalesce(more, 0) AS taken")


def source_mix(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: every document as often as its ``copies`` say, with the columns of ``docs``. Texts are not shuffled: a
    row's hash is compared with the level of its source, and only rows at a threshold are looked up by id."""
    _, levels, last = _levels(docs, "doc_id", "text", "source", seed)
    last = stored(last.groupBy("key").agg(F.max(F.expr(_ADDED)).alias("added")).withColumnRenamed("key", "last_key"), "mix-last")
    placed = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("key"), _hash("doc_id", seed).alias("hash"), text_key("source").alias("source_key"))
    placed = _at_source(placed, levels.select("source_key", "whole", "fine", "n_rows")).join(
        broadcast_if_small(last), F.expr(f"hash div {FINE} = fine") & F.col("key").eqNullSafe(F.col("last_key")), "left")
    copies = f"int(whole + coalesce(if(hash div {FINE} = fine, added, int(hash div {FINE} < fine)), 0))"
    return placed.select("doc", F.explode(F.expr(f"array_repeat(0, {copies})"))).select("doc.*")
