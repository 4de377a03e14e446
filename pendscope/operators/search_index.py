"""Literal search that reads only the files which can hold the text.

An index keeps, for every Parquet file of a stored claims table, which hashed three-character pieces occur in the searched
columns: a bitmap of ``BITS`` bits, cut into rows of 32,768. A text can only be in a file that has all pieces of the text,
so all other files are left out by their names while Spark plans the scan; what remains is searched as before. Files never change
once written, so the index grows by the new files and an out-of-date index costs time, never rows: a file it does not
know is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pendscope.operators.browse import WHITESPACE, find_claims

SEARCHED = ("claim_id", "adjuster_note", "provider_id")
PIECE = 3
BITS = 4 * 32_768
SHORT = 64  # characters
FILE_ROWS = 200_000
INDEX_SCHEMA = "file string, part bigint, bits binary"


def _pieces(text: str) -> str:
    """SQL: the distinct places in the bitmap, from 1, of the pieces of a lower-cased text; none for fewer characters."""
    piece = "concat(" + ", ".join(f"c[i + {k}]" for k in range(PIECE)) + ")"
    places = f"transform(sequence(0, size(c) - {PIECE}), i -> 1 + pmod(xxhash64({piece}), {BITS}))"
    return (f"array_distinct(flatten(transform(array(split(lower(coalesce({text}, '')), '')), "
            f"c -> if(size(c) < {PIECE}, cast(array() AS array<bigint>), {places}))))")


def write_searchable(claims: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """``claims`` as files of alike rows (theme, then provider), so that a rare text meets few of them."""
    claims.repartitionByRange("theme", "provider_id", "claim_id").write.option("maxRecordsPerFile", file_rows).parquet(path)


def index_files(stored: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The index (``INDEX_SCHEMA``) of the files of a stored claims table that ``known``, an earlier index, lacks. Pieces
    are made distinct inside each task, so at most ``BITS`` rows per file are shuffled, whatever the texts. A file
    without any piece has no rows and is always read."""
    rows = stored.select(F.col("_metadata.file_path").alias("file"), *SEARCHED)
    if known is not None:
        rows = rows.join(known.select("file").distinct(), "file", "left_anti")
    texts = rows.select("file", F.explode(F.array(*(F.lower(name) for name in SEARCHED))).alias("text")).filter(f"length(text) >= {PIECE}")
    # most texts are keys: their pieces are cut by position in compiled code, which a long text would pay for by its square
    short = texts.filter(f"length(text) <= {SHORT}").withColumn("at", F.explode(F.expr(f"sequence(1, length(text) - {PIECE - 1})")))
    short = short.selectExpr("file", f"1 + pmod(xxhash64(substring(text, at, {PIECE})), {BITS}) AS place")
    long = texts.filter(f"length(text) > {SHORT}").select("file", F.explode(F.expr(_pieces("text"))).alias("place"))
    places = short.unionByName(long).distinct()
    return places.groupBy("file", F.expr("bitmap_bucket_number(place)").alias("part")).agg(
        F.expr("bitmap_construct_agg(bitmap_bit_position(place))").alias("bits"))


def files_without(index: DataFrame, text: str) -> DataFrame:
    """(file): files of the index that cannot hold ``text``, whatever its case. None for texts shorter than a piece."""
    text = text.strip(WHITESPACE).lower()
    wanted = index.sparkSession.range(1).select(F.lit(text).alias("text")).select(F.explode(F.expr(_pieces("text"))).alias("place"))
    wanted = wanted.selectExpr("bitmap_bucket_number(place) AS part", "bitmap_bit_position(place) AS bit")
    wanted = wanted.groupBy("part").agg(F.collect_list("bit").alias("wanted"))  # as many as the text has characters
    held = "forall(wanted, bit -> getbit(cast(conv(hex(substring(bits, int(bit div 8) + 1, 1)), 16, 10) AS int), int(bit % 8)) = 1)"
    files = index.select("file").distinct().crossJoin(F.broadcast(wanted))  # at most BITS / 32,768 rows
    return files.join(index, ["file", "part"], "left").groupBy("file").agg(
        F.bool_and(F.expr(f"bits IS NOT NULL AND {held}")).alias("all")).filter("NOT all").select("file")


def find_indexed(stored: DataFrame, index: DataFrame, query: str, **conditions) -> DataFrame:
    """:func:`find_claims` on the files that may hold ``query``. The names left out come to the driver, which lists the files
    of the table anyway."""
    out = [row["file"] for row in files_without(index, query).collect()] if query.strip(WHITESPACE) else []
    kept = stored.filter(~F.col("_metadata.file_path").isin(out)) if out else stored
    return find_claims(kept, query=query, **conditions)


def search_report(stored: DataFrame, index: DataFrame, query: str) -> DataFrame:
    """One row: files of the table, files that a search for ``query`` reads, their share (null for a table without rows)."""
    files = stored.select(F.col("_metadata.file_path").alias("file")).distinct()
    judged = files.join(files_without(index, query).withColumn("out", F.lit(True)), "file", "left")
    return judged.agg(F.count("*").alias("files"), F.count_if(F.col("out").isNull()).alias("files_read")).withColumn(
        "share_read", F.expr("files_read / nullif(files, 0)"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX_SCHEMA).parquet(path)
