"""Jaccard self-join of documents on word n-grams, by MinHash banding.

Equal n-gram sets become one node first, so exact copies are never paired. A node's MinHash signature is cut into bands;
the number of bands and rows follows from the wanted recall at the threshold. Nodes are shuffled on band hashes, and
nodes that share one are verified on their full n-gram sets:

* a bucket of up to ``DENSE`` nodes gives pairs, which are made distinct before the sets are joined to them;
* a larger bucket is cut into blocks by hash, and every pair of blocks is verified in one task with matrix products. A
  task returns one row per node (its number of links and the least node it is connected to there), not the pairs. Blocks are
  bounded in nodes and in n-grams, so no task grows with the bucket.

A pair that shares several dense buckets counts in the least of them, one that shares any never in the others."""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pendscope.llm.common import BROADCAST_IDS, broadcast_if_small, meet, stored
from pendscope.llm.components import components, with_least

GRAM = 5
SIMILAR = 0.8
RECALL = 0.999
HASHES = 128  # most hashes of a signature
DENSE = 16
BLOCK_NODES = 256
BLOCK_GRAMS = 1_000_000
KEPT_WORDS = 50_000  # bound on the word hashes a task remembers
_WORD = re.compile(r"[^\W_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def banding(similar: float = SIMILAR, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): enough bands for ``recall`` at ``similar``; among these the fewest false candidates at half of it."""
    best = None
    for rows in range(1, hashes + 1):
        hit = similar ** rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands * rows <= hashes:
            false = 1 - (1 - (similar / 2) ** rows) ** bands
            best = min(best or (2, 0, 0), (false, bands, rows))
    if best is None:
        raise ValueError("more hashes are needed for this recall")
    return best[1:]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word.encode())
        return value


_KNOWN = _Hashes()


def gram_set(text: str | None, n: int = GRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of a text's words (letters and digits, lower case). Fewer words than
    ``n`` are one gram; a text without words is one gram of its characters; a blank or null text has none."""
    if len(_KNOWN) > KEPT_WORDS:
        _KNOWN.clear()
    words = _WORD.findall((text or "").lower())
    if not words:
        blank = (text or "").strip()
        return np.array([xxhash.xxh3_64_intdigest(blank.encode())] if blank else [], np.uint64)
    each = np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))
    width = min(n, len(each))
    grams = np.full(len(each) - width + 1, width, np.uint64)
    for k in range(width):
        grams = grams * _ODD + each[k:k + len(grams)]
    return np.unique(_mix(grams))


def band_hashes(grams: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One bucket number per band."""
    seeds = _mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) * _ODD)
    factors, shifts = seeds[::2] | np.uint64(1), seeds[1::2]
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(grams), 2048):
        least = np.minimum(least, (grams[start:start + 2048, None] * factors + shifts).min(axis=0))
    least = least.reshape(bands, rows)
    bucket = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        bucket = _mix(bucket * _ODD + least[:, k])
    return bucket.view(np.int64)


def _signatures(bands: int, rows: int, n: int):
    kind = T.StructType([T.StructField("set_key", T.BinaryType()), T.StructField("n_grams", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    @F.pandas_udf(kind)
    def signature(texts: pd.Series) -> pd.DataFrame:
        found = []
        for text in texts:
            grams = gram_set(text, n)
            found.append((xxhash.xxh3_128_digest(grams.tobytes()), len(grams), band_hashes(grams, bands, rows)) if len(grams) else (None, 0, None))
        return pd.DataFrame(found, columns=kind.names)

    return signature


def _gram_sets(n: int):
    kind = T.StructType([T.StructField("set_key", T.BinaryType()), T.StructField("grams", T.ArrayType(T.LongType()))])

    @F.pandas_udf(kind)
    def sets(texts: pd.Series) -> pd.DataFrame:
        found = [gram_set(text, n) for text in texts]
        return pd.DataFrame({"set_key": [xxhash.xxh3_128_digest(g.tobytes()) for g in found], "grams": [g.view(np.int64) for g in found]})

    return sets.asNondeterministic()  # else a filter on its result runs it before the rows are chosen


def _shared_columns(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each set of ``left`` shares with each of ``right``, by products of 0/1 matrices of bounded width."""
    shared = np.zeros((len(left), len(right)), np.float32)
    values = np.intersect1d(np.concatenate(left), np.concatenate(right))

    def places(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        column = np.searchsorted(values, flat := np.concatenate(sets))
        known = column < len(values)
        known[known] = values[column[known]] == flat[known]
        row, column = row[known], column[known]
        order = np.argsort(column, kind="stable")
        return row[order], column[order]

    (row_a, col_a), (row_b, col_b) = places(left), places(right)
    for start in range(0, len(values), 2048):
        parts = []
        for row, column, size in ((row_a, col_a, len(left)), (row_b, col_b, len(right))):
            lo, hi = np.searchsorted(column, (start, start + 2048))
            part = np.zeros((size, 2048), np.float32)
            part[row[lo:hi], column[lo:hi] - start] = 1
            parts.append(part)
        shared += parts[0] @ parts[1].T
    return shared


def verified_block(group: pd.DataFrame, similar: float) -> pd.DataFrame:
    """Links between two blocks of a dense bucket (or within one). ``group``: bucket, i, j, block, node, copies, dense, grams."""
    bucket, i, j = int(group["bucket"].iloc[0]), int(group["i"].iloc[0]), int(group["j"].iloc[0])
    group = group.sort_values("node")
    sides = [group[group["block"] == i], group[group["block"] == j]]
    if not len(sides[0]) or not len(sides[1]):
        return pd.DataFrame({"node": [], "links": [], "hub": []}, dtype="int64")
    grams = [[np.asarray(g) for g in side["grams"]] for side in sides]
    earlier = [[d[d < bucket] for d in map(np.asarray, side["dense"])] for side in sides]
    size = [np.array([len(g) for g in side], np.float32) for side in grams]
    shared = _shared_columns(*grams)
    linked = shared >= similar * (size[0][:, None] + size[1][None, :] - shared) - 1e-6
    if any(map(len, earlier[0])) and any(map(len, earlier[1])):
        linked &= _shared_columns(*earlier) == 0
    node = [side["node"].to_numpy() for side in sides]
    if i == j:
        np.fill_diagonal(linked, False)
    copies = [side["copies"].to_numpy() for side in sides]
    links = [linked @ copies[1], linked.T @ copies[0]]
    hub = [node[0].copy(), node[1].copy()]
    most = np.iinfo(np.int64).max
    while True:
        left = np.minimum(hub[0], np.where(linked, hub[1][None, :], most).min(axis=1))
        right = np.minimum(hub[1], np.where(linked, left[:, None], most).min(axis=0))
        if i == j:
            left = right = np.minimum(left, right)
        if (left == hub[0]).all() and (right == hub[1]).all():
            break
        hub = [left, right]
    out = pd.DataFrame({"node": node[0], "links": links[0], "hub": hub[0]})
    if i != j:
        out = pd.concat([out, pd.DataFrame({"node": node[1], "links": links[1], "hub": hub[1]})])
    return out[out["links"] > 0]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR, n: int = GRAM,
                    recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: key, class_id (least key of all it is linked to, over any number of links), n_links (other
    rows whose set is as similar as ``similar``), n_grams.

    Null and blank texts link to nothing and are classes of their own; equal sets always link, repeated rows too. Keys that
    are repeated with other texts are told apart by their sets. An empty table gives no rows."""
    bands, rows = banding(similar, recall)
    signed = stored(docs.select(F.col(key).alias("key"), _signatures(bands, rows, n)(F.col(text)).alias("s")).select("key", "s.*"), "join-signed")
    nodes = stored(
        signed.filter("set_key IS NOT NULL").groupBy("set_key").agg(
            F.min("key").alias("least"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()), "join-nodes")

    buckets = nodes.select("node", "n_grams", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("nodes"), F.sum("n_grams").alias("grams")).filter("nodes > 1")
    members = stored(buckets.drop("n_grams").join(shared, "bucket"), "join-members")
    small, dense = members.filter(f"nodes <= {DENSE}"), members.filter(f"nodes > {DENSE}")

    lists = small.groupBy("bucket").agg(F.array_sort(F.collect_list("node")).alias("all")).select("all").distinct()
    pairs = lists.select(F.explode(F.expr(
        "flatten(transform(all, (a, i) -> transform(slice(all, i + 2, size(all)), b -> named_struct('a', a, 'b', b))))")).alias("p")).select("p.*").distinct()
    pairs = stored(pairs, "join-pairs")

    wanted = pairs.selectExpr("a AS node").unionByName(pairs.selectExpr("b AS node")).unionByName(dense.select("node")).distinct()
    wanted = stored(nodes.join(wanted, "node").select("node", "set_key", "least", "copies"), "join-wanted")
    ids = wanted.select(F.col("least").alias("wanted")).distinct()
    texts = docs.select(F.col(key).alias("id"), F.col(text).alias("body")).join(
        broadcast_if_small(ids, BROADCAST_IDS), F.col("id").eqNullSafe(F.col("wanted")), "left_semi")
    sets = texts.select(_gram_sets(n)(F.col("body")).alias("s")).select("s.*").join(wanted.drop("least"), "set_key").drop("set_key").dropDuplicates(["node"])
    in_dense = dense.groupBy("node").agg(F.array_sort(F.collect_list("bucket")).alias("dense"))  # one bucket per band at most
    sets = stored(sets.join(in_dense, "node", "left").withColumn("dense", F.coalesce("dense", F.array().cast("array<bigint>"))), "join-sets")

    one = sets.selectExpr("node AS a", "grams AS grams_a", "dense AS dense_a", "copies AS copies_a")
    two = sets.selectExpr("node AS b", "grams AS grams_b", "dense AS dense_b", "copies AS copies_b")
    linked = pairs.join(one, "a").join(two, "b").filter("NOT arrays_overlap(dense_a, dense_b)").withColumn(
        "shared", F.expr("size(array_intersect(grams_a, grams_b))"))
    linked = stored(linked.filter(f"shared >= {similar}D * (size(grams_a) + size(grams_b) - shared) - 1e-6D")
                    .select("a", "b", "copies_a", "copies_b"), "join-linked")

    blocks = f"int(greatest(ceil(nodes / {BLOCK_NODES}D), ceil(grams / {BLOCK_GRAMS}D)))"
    tasks = (
        dense.selectExpr("bucket", "node", f"{blocks} AS blocks").withColumn("block", F.expr("int(pmod(xxhash64(node, bucket), blocks))"))
        .withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
        .selectExpr("bucket", "node", "block", "least(block, other) AS i", "greatest(block, other) AS j")
    )
    in_blocks = stored(tasks.join(sets, "node").groupBy("bucket", "i", "j").applyInPandas(
        lambda group: verified_block(group, similar), "node long, links long, hub long"), "join-blocks")

    links = (
        linked.selectExpr("a AS node", "copies_b AS links").unionByName(linked.selectExpr("b AS node", "copies_a AS links"))
        .unionByName(in_blocks.select("node", "links")).groupBy("node").agg(F.sum("links").alias("links"))
    )
    roots = components(linked.selectExpr("a AS u", "b AS v").unionByName(in_blocks.selectExpr("node AS u", "hub AS v")))
    roots = stored(roots, "join-roots")
    joined = nodes.select("node", "set_key", "least", "copies").join(links, "node", "left").join(roots, "node", "left")
    joined = stored(joined.selectExpr("set_key", "copies", "copies - 1 + coalesce(links, 0) AS n_links", "root AS u", "least AS v"), "join-linked-nodes")
    in_class = with_least(joined.filter("u IS NOT NULL"), roots.count()).selectExpr("set_key", "copies", "n_links", "m AS class_id")
    classed = in_class.unionByName(joined.filter("u IS NULL").selectExpr("set_key", "copies", "n_links", "v AS class_id"))
    alone = signed.filter("set_key IS NULL").selectExpr(f"key AS `{key}`", "key AS class_id", "0L AS n_links", "n_grams")
    classed = stored(classed, "join-classed")
    found = meet(signed.filter("set_key IS NOT NULL").drop("bands"), classed, "set_key", "copies", signed.count()).selectExpr(f"key AS `{key}`", "class_id", "n_links", "n_grams")
    return found.unionByName(alone)


def ngram_jaccard(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document of least id of every class, with the columns of ``docs``; of repeated rows one stays."""
    classes = stored(near_duplicates(docs), "join-classes")
    judged = classes.groupBy("doc_id").agg(F.max(F.expr("doc_id <=> class_id")).alias("kept"))
    gone = stored(judged.filter("NOT kept").select("doc_id"), "join-gone")
    chosen = docs.join(broadcast_if_small(gone, BROADCAST_IDS), docs["doc_id"].eqNullSafe(gone["doc_id"]), "left_anti")
    counted = classes.agg(F.count("*").alias("n"), F.countDistinct(F.coalesce("doc_id", F.lit(-1))).alias("d")).first()
    return chosen if counted["n"] == counted["d"] else chosen.dropDuplicates(["doc_id", "text"])
