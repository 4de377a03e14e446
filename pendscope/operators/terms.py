"""Terms of documents and their weights."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pendscope.functions.text import doc_text_sql, pairs_sql, words_sql
from pendscope.session import cut_lineage, spread, stored, within

BLOCK_WORDS = 1_000_000  # a block of documents ends with the batch that reaches so many
BATCH_ROWS = 500  # documents in an Arrow batch: texts can be long
BUCKET_BYTES = 8 << 20  # of text for each bucket of terms: some 1,600,000 terms of blocks


def doc_text(claims: DataFrame) -> DataFrame:
    """One document per pended claim: note and code."""
    return claims.filter("pended").selectExpr("claim_id", f"{doc_text_sql()} AS text")


def tokenise(docs: DataFrame, text: str = "text", stop_words: Sequence[str] = ()) -> DataFrame:
    """Adds ``words`` and ``pairs`` (neighbouring words)."""
    with_words = docs.withColumn("words", F.expr(words_sql(text, stop_words)))
    return with_words.withColumn("pairs", F.expr(pairs_sql("words")))


def runs_sql(sorted_terms: str) -> str:
    """SQL for the (term, tf) structs of a sorted array: runs of equal entries and their lengths."""
    pairs = "transform(s, (i, j) -> named_struct('term', t[i], 'tf', bigint(if(j + 1 < size(s), s[j + 1], size(t)) - i)))"
    starts = "filter(sequence(0, size(t) - 1), i -> i = 0 OR t[i] <> t[i - 1])"
    body = f"if(size(t) = 0, cast(array() AS array<struct<term:string,tf:bigint>>), transform(array({starts}), s -> {pairs})[0])"
    return f"transform(array({sorted_terms}), t -> {body})[0]"


def counted_terms(docs: DataFrame, key: Sequence[str], text: str = "text", stop_words: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """(key, extra, counts): the words and word pairs of each document as one array of (term, tf), by term.

    A document is one row and its terms are sorted and counted inside it, so no text is shuffled and a sum per
    document that follows sends one row per document."""
    terms = tokenise(spread(docs.select(*key, *extra, text)), text, stop_words).selectExpr(*key, *extra, "sort_array(concat(words, pairs)) AS terms")
    return terms.selectExpr(*key, *extra, f"{runs_sql('terms')} AS counts")


def term_counts(docs: DataFrame, key: Sequence[str], text: str = "text", stop_words: Sequence[str] = (), extra: Sequence[str] = ()) -> DataFrame:
    """(key, extra, term, tf) for the words and word pairs of each document.

    The outer form of ``inline`` keeps Spark from filtering on the size of the array first: that filter would work out
    the whole expression a second time, below every projection and with its words once per place."""
    return counted_terms(docs, key, text, stop_words, extra).selectExpr(*key, *extra, "inline_outer(counts)").filter("term IS NOT NULL")


def vocabulary(counts: DataFrame, min_df: int, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Terms found in at least ``min_df`` documents; ``weight`` counts a document
    more than once. The counts are summed in every task before the shuffle."""
    documents = F.count("*") if weight is None else F.sum(weight)
    return counts.groupBy(*by, "term").agg(documents.alias("df")).filter(F.col("df") >= min_df)


RARITY = "ln((1 + n_docs) / (1 + df)) + 1"
TERM_WEIGHT = f"(1 + ln(tf)) * ({RARITY})"


def tfidf(docs: DataFrame, key: str, text: str = "text", min_df: int = 2, stop_words: Sequence[str] = ()) -> DataFrame:
    """(key, term, weight): damped counts, smoothed rarity, unit length per key. The texts are cut into terms once."""
    found = weighted_terms(docs.select(F.col(key), F.col(text)), [key], min_df, text, stop_words, flat=True)
    repeated = docs.groupBy(key).count().filter("count > 1").select(key)
    if not repeated.limit(1).count():
        return found.select(key, "term", "weight")
    # the documents of a key that repeats have one length together; null is a key
    again = F.broadcast(repeated.withColumnRenamed(key, "again")) if within(repeated) else repeated.withColumnRenamed(key, "again")
    same = F.col(key).eqNullSafe(F.col("again"))
    whole = found.join(again, same, "left_semi").selectExpr(key, "term", f"raw / sqrt(sum(raw * raw) OVER (PARTITION BY `{key}`)) AS weight")
    return found.join(again, same, "left_anti").select(key, "term", "weight").unionByName(whole)


# ---- blocks of documents, packed -----------------------------------------------


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers below 2 ** 31: their bytes by place, compressed, so that they take as little on the way as on disk."""
    return pa.compress(np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True) if len(values) else b""


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int32)
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _packed_texts(texts: pa.Array) -> dict:
    """Their lengths and their letters, one after another."""
    letters = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts.cast(pa.binary())), b"")[0].as_buffer() if len(texts) else b""
    return {"lengths": _packed(pc.binary_length(texts).to_numpy(zero_copy_only=False)), "n_letters": len(letters),
            "letters": pa.compress(letters, codec="zstd", asbytes=True) if len(letters) else b""}


def _unpacked_texts(rows: list[dict]) -> pa.Array:
    lengths = np.concatenate([np.zeros(1, np.int32), *(_unpacked(r["lengths"], r["n"]) for r in rows)])
    letters = b"".join(pa.decompress(r["letters"], decompressed_size=r["n_letters"], codec="zstd", asbytes=True) for r in rows if r["n_letters"])
    return pa.Array.from_buffers(pa.string(), len(lengths) - 1, [None, pa.py_buffer(np.cumsum(lengths, dtype=np.int32)), pa.py_buffer(letters)])


def _steps(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rising numbers as their differences, anew from each of ``starts``."""
    out = np.diff(values, prepend=0)
    begins = starts[starts < len(values)]
    out[begins] = values[begins]
    return out


def _risen(steps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    total = np.cumsum(steps, dtype=np.int64)
    return total - np.repeat(np.append(0, total)[starts], sizes)


BLOCK_KINDS = {"block": "bigint", "copies": "array<bigint>", "sizes": "array<int>", "codes": "binary", "tfs": "binary", "bucket": "int", "part": "string",
               "first": "int", "n": "int", "lengths": "binary", "n_letters": "int", "letters": "binary", "dfs": "binary"}
ARROW_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _counted_block(docs: pa.Table, block: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """The documents of a block with the codes and counts of their terms, some in a row, then the terms of every part of the
    block with the number of their documents: a row for each bucket that a hash of the words deals them to."""
    words = docs.column("words").combine_chunks()
    coded = pc.dictionary_encode(words.flatten())
    names, many = coded.dictionary, max(1, len(coded.dictionary))
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.repeat(np.arange(len(docs)), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    inside = at[1:] == at[:-1]
    pairs, paired = np.unique(ids[:-1][inside] * many + ids[1:][inside], return_inverse=True)
    total = many + len(pairs)
    spots, tfs = np.unique(np.concatenate((at, at[1:][inside])) * total + np.concatenate((ids, many + paired)), return_counts=True)
    at, codes = spots // total, spots % total
    parts = pc.dictionary_encode(docs.column("part").combine_chunks())
    if len(parts.dictionary) < 2:  # every code is in the one part
        found, local = np.arange(total if len(codes) else 0), codes
    else:
        found, local = np.unique(parts.indices.to_numpy(zero_copy_only=False).astype(np.int64)[at] * total + codes, return_inverse=True)
    df = np.bincount(local, weights=docs.column("copies").to_numpy()[at], minlength=len(found)).astype(np.int64)
    # of two words, the hashes of both; a term falls into the same bucket whatever its block
    hashes = np.fromiter((crc32(name.encode()) for name in names.to_pylist()), np.int64, len(names))
    hashes = np.concatenate((hashes, hashes[pairs // many] * 31 + hashes[pairs % many]))[found % total] % buckets
    joined = pc.binary_join_element_wise(names.take(pa.array(pairs // many)), names.take(pa.array(pairs % many)), " ")
    parted = found // total
    order = np.lexsort((parted, hashes))
    # the codes follow this order and rise in a document, so that their steps are small
    place = np.empty(len(found), np.int64)
    place[order] = np.arange(len(found))
    codes = place[local]
    rising = np.argsort(at * max(1, len(found)) + codes)
    codes, tfs = codes[rising], tfs[rising]
    starts = np.searchsorted(at, np.arange(len(docs) + 1))
    held, copies = docs.column("id").combine_chunks(), docs.column("copies").combine_chunks()
    rows = []
    for begin in range(0, len(docs), BATCH_ROWS):
        end = min(len(docs), begin + BATCH_ROWS)
        span = slice(starts[begin], starts[end])
        rows.append({"block": block, "copies": copies[begin:end].to_pylist(), "sizes": np.diff(starts[begin:end + 1]).tolist(),
                     "codes": _packed(_steps(codes[span], starts[begin:end] - starts[begin])), "tfs": _packed(tfs[span])})
    spans = pa.array(np.append(np.arange(0, len(docs), BATCH_ROWS), len(docs)).astype(np.int32))
    yield _block_rows(rows, pa.ListArray.from_arrays(spans, held))
    group = hashes[order] * max(1, len(parts.dictionary)) + parted[order]
    first = np.flatnonzero(np.diff(group, prepend=-1))
    terms, rows = pa.concat_arrays([names, joined]), []
    for begin, end in zip(first.tolist(), [*first[1:].tolist(), len(found)]):
        mine = order[begin:end]
        rows.append({"block": block, "bucket": int(hashes[mine[0]]), "part": parts.dictionary[int(parted[mine[0]])].as_py(), "first": begin, "n": end - begin,
                     "dfs": _packed_counts(df[mine]), **_packed_texts(terms.take(pa.array(found[mine] % total)))})
    yield from pa.Table.from_batches([_block_rows(rows, pa.nulls(len(rows), pa.list_(held.type)))]).to_batches(max_chunksize=BATCH_ROWS)


def _packed_counts(counts: np.ndarray) -> bytes:
    """Counts of documents, the upper halves apart: nearly all are 0."""
    lower, upper = _packed(counts & 0x7FFFFFFF), _packed(counts >> 31)
    return len(lower).to_bytes(4, "little") + lower + upper


def _unpacked_counts(packed: bytes, n: int) -> np.ndarray:
    at = 4 + int.from_bytes(packed[:4], "little")
    return _unpacked(packed[4:at], n).astype(np.int64) | _unpacked(packed[at:], n).astype(np.int64) << 31


def _block_rows(rows: list[dict], ids: pa.Array) -> pa.RecordBatch:
    columns = {name: pa.array([r.get(name) for r in rows], ARROW_KINDS[kind]) for name, kind in BLOCK_KINDS.items()}
    return pa.RecordBatch.from_arrays([ids, *columns.values()], names=["ids", *columns])


KNOWN_KINDS = {"of_block": "bigint", "part": "string", "bucket": "int", "n": "int", "codes": "binary", "ids": "binary", "lengths": "binary",
               "n_letters": "int", "letters": "binary", "dfs": "binary"}


def _common_terms(rows: pa.Table, min_df: int, named: bool) -> pa.Table:
    """Of the terms of a bucket those found in ``min_df`` documents, back by block and part. A number with the bucket tells them apart."""
    parts = pc.dictionary_encode(rows.column("part").combine_chunks()).indices.to_numpy(zero_copy_only=False).astype(np.int64)
    rows = rows.to_pylist()
    sizes = np.array([r["n"] for r in rows], np.int64)
    texts = _unpacked_texts(rows)
    term = pc.dictionary_encode(texts)
    many = max(1, len(term.dictionary))
    _, local = np.unique(np.repeat(parts, sizes) * many + term.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    del term
    # whole numbers: they add up exactly in any order below 2 ** 53
    counts = np.concatenate([np.zeros(0, np.int64), *(_unpacked_counts(r["dfs"], r["n"]) for r in rows)])
    df = np.bincount(local, weights=counts).astype(np.int64)[local]
    begin, out = 0, []
    for row in rows:
        held = begin + np.flatnonzero(df[begin:begin + row["n"]] >= min_df)
        if len(held):
            out.append({"of_block": row["block"], "part": row["part"], "bucket": row["bucket"], "n": len(held),
                        "codes": _packed(_steps(row["first"] + held - begin, np.zeros(1, np.int64))), "ids": None if named else _packed(local[held]),
                        "dfs": _packed_counts(df[held]), **_packed_texts(texts.take(pa.array(held)))})
        begin += row["n"]
    return pa.table({name: pa.array([r[name] for r in out], ARROW_KINDS[kind]) for name, kind in KNOWN_KINDS.items()})


def _numbers(row: dict) -> np.ndarray:
    return (row["bucket"] << 32) + _unpacked(row["ids"], row["n"]).astype(np.int64)


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]] * row["n"], pa.string()), "id": pa.array(_numbers(row)), "term": _unpacked_texts([row])})


def _weighted_block(docs: pa.Table, known: pa.Table, named: bool, flat: bool) -> pa.Table:
    """Weights of unit length for the documents of a block, from the common terms of the block."""
    ids, copies = docs.column("ids").combine_chunks().flatten(), docs.column("copies").combine_chunks().flatten()
    n, all_sizes, all_codes, all_tfs = len(ids), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for row in docs.select(["sizes", "codes", "tfs"]).to_pylist():
        sizes = np.array(row["sizes"], np.int64)
        all_codes.append(_risen(_unpacked(row["codes"], sizes.sum()), np.cumsum(sizes) - sizes, sizes))
        all_tfs.append(_unpacked(row["tfs"], sizes.sum()))
        all_sizes.append(sizes)
    codes, tfs, at = np.concatenate(all_codes), np.concatenate(all_tfs), np.repeat(np.arange(n), np.concatenate(all_sizes))
    rows = known.to_pylist()
    listed = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(_unpacked(r["codes"], r["n"]), dtype=np.int64) for r in rows)])
    of = np.repeat([r["n_docs"] for r in rows], [r["n"] for r in rows]) if rows else np.zeros(0)
    idf = np.log((1 + of) / (1 + np.concatenate([np.zeros(0, np.int64), *(_unpacked_counts(r["dfs"], r["n"]) for r in rows)]))) + 1
    place = np.full(1 + max(codes.max(initial=0), listed.max(initial=0)), -1)
    place[listed] = np.arange(len(listed))
    place = place[codes]
    held = place >= 0
    at, place = at[held], place[held]
    raw = (1 + np.log(tfs[held])) * idf[place]
    ws = raw / np.sqrt(np.bincount(at, weights=raw * raw, minlength=n))[at]
    names = _unpacked_texts(rows) if named else pa.array(np.concatenate([np.zeros(0, np.int64), *map(_numbers, rows)]))
    terms = names.take(pa.array(place))
    if flat:
        return pa.table({"id": ids.take(pa.array(at)), "term": terms, "weight": ws, "raw": raw})
    starts = pa.array(np.searchsorted(at, np.arange(n + 1)).astype(np.int32))
    return pa.table({"id": ids, "copies": copies, "square": np.bincount(at, weights=ws * ws, minlength=n),
                     "terms": pa.ListArray.from_arrays(starts, terms), "ws": pa.ListArray.from_arrays(starts, pa.array(ws))})


def numbered_terms(docs: DataFrame, key: Sequence[str], min_df: int, text: str = "text", stop_words: Sequence[str] = (),
                   part: str | None = None, copies: str | None = None, flat: bool = False, named: bool = True) -> tuple[DataFrame, DataFrame]:
    """(key, copies, square, terms, ws) of every document: the weights of its words and word pairs that occur in ``min_df``
    documents of its ``part``, of unit length, and the sum of their squares; with ``flat`` rows (key, term, weight, raw).
    A document counts ``copies`` times. Unless ``named``, terms are numbers. Second, their names: (part, id, term), where a
    term has as many rows as there are blocks, at most.

    Documents stay in blocks of bounded size and name their terms by the block's codes. What is shuffled are the distinct
    terms of the blocks, not the documents' entries, dealt to buckets as one row for each block; those that are common
    enough come back to their block. All of it is packed, on disk and on the way."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    rows = docs.select(F.struct(*key).alias("id"), (F.lit("") if part is None else F.col(part)).alias("part"),
                       (F.lit(1) if copies is None else F.col(copies)).cast("bigint").alias("copies"), F.col(text).alias("text"))
    sizes = cut_lineage(rows.groupBy("part").agg(F.sum("copies").alias("n_docs"), F.sum(F.octet_length("text")).alias("bytes")))
    buckets = max(1, -(-(sizes.agg(F.sum("bytes")).first()[0] or 0) // BUCKET_BYTES))
    rows = spread(rows).selectExpr("id", "part", "copies", f"{words_sql('text', stop_words)} AS words")
    id_type, most = rows.schema["id"].dataType.simpleString(), BLOCK_WORDS

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, block = [], 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            held.append(batch)
            n += len(batch.column("words").flatten())
            if n >= most:
                yield from _counted_block(pa.Table.from_batches(held), block, buckets)
                held, n, block = [], 0, block + 1
        if held:
            yield from _counted_block(pa.Table.from_batches(held), block, buckets)

    def of_kinds(kinds: dict) -> str:
        return ", ".join(f"{name} {kind}" for name, kind in kinds.items())

    blocks = stored(rows.mapInArrow(coded, f"ids array<{id_type}>, {of_kinds(BLOCK_KINDS)}"), "terms")

    def common(found: pa.Table) -> pa.Table:
        return _common_terms(found, min_df, named)

    known = stored(blocks.filter("bucket IS NOT NULL").select("bucket", "block", "part", "first", "n", "lengths", "n_letters", "letters", "dfs").groupBy(
        "bucket").applyInArrow(common, of_kinds(KNOWN_KINDS)), "known")
    listed = known.join(sizes, "part").select("of_block", "n", "codes", "dfs", "n_docs", *(("lengths", "n_letters", "letters") if named else ("bucket", "ids")))
    kind = "string" if named else "bigint"
    out = f"term {kind}, weight double, raw double" if flat else f"copies bigint, square double, terms array<{kind}>, ws array<double>"

    def weighted(texts: pa.Table, terms: pa.Table) -> pa.Table:
        return _weighted_block(texts, terms, named, flat)

    found = blocks.filter("bucket IS NULL").select("ids", "copies", "block", "sizes", "codes", "tfs").groupBy("block").cogroup(listed.groupBy("of_block")).applyInArrow(
        weighted, f"id {id_type}, {out}")
    names = known.select("part", "bucket", "n", "ids", "lengths", "n_letters", "letters").filter("ids IS NOT NULL").mapInArrow(_named, "part string, id bigint, term string")
    return found.select("id.*", *(name for name in found.columns if name != "id")), names


def weighted_terms(docs: DataFrame, key: Sequence[str], min_df: int, text: str = "text", stop_words: Sequence[str] = (),
                   part: str | None = None, copies: str | None = None, flat: bool = False) -> DataFrame:
    """The weights of :func:`numbered_terms` with the terms themselves."""
    return numbered_terms(docs, key, min_df, text, stop_words, part, copies, flat)[0]


def unit_vectors(weighted: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, terms, ws) from (key, term, raw): a document's weights by term, of unit length. A document is one row, and its
    length is worked out inside it."""
    rows = weighted.select(*key, F.struct("term", "raw").alias("entry")).groupBy(*key).agg(F.sort_array(F.collect_list("entry")).alias("e"))
    # a variable of a lambda is worked out once, a column inside one once per element
    with_norm = "array(struct(e, sqrt(aggregate(e, 0D, (t, x) -> t + x.raw * x.raw)) AS norm))"
    return rows.selectExpr(*key, "e.term AS terms", f"transform({with_norm}, p -> transform(p.e, x -> x.raw / p.norm))[0] AS ws")


def vector_entries(vectors: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, term, weight); the outer form for the reason given in :func:`term_counts`."""
    return vectors.selectExpr(*key, "inline_outer(arrays_zip(terms, ws)) AS (term, weight)").filter("term IS NOT NULL")
