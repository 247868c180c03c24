"""Line dedup across documents: all lines of a repeated key go, except in the first document that holds it.

The lines' 128-bit hashes are range-partitioned together with a salt of the document, so that one
line that a third of all documents hold is spread over many partitions; inside a partition they
are sorted by hash, document and position, and first occurrences are streamed. What is first in its
salted part meets the other parts' firsts, a row for each salt at most, and the smallest document
keeps its lines. The result is a run-length compressed bitmap of kept lines for each document that
loses any; texts are read again only to apply it.

Defined results: a null or empty text is one empty line. Rows with a null doc_id keep all lines and
don't count as holders. Rows that share a doc_id are one holder: they never drop each other's
lines. Lines whose stripped key has less than ``min_chars`` code points always stay. Other columns
pass through ``dedup_lines`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

MIN_CHARS = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key(line: Column) -> Column:
    """The line with [\\x20\\x09-\\x0D] stripped at both ends and A-Z in lower case."""
    white = " \t\n\x0b\x0c\r"
    return F.translate(F.call_function("btrim", line, F.lit(white)), _UPPER, _LOWER)


def held_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """A row for each document and key: doc_id, row (a hash of the text), hash, positions."""
    one = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.transform(lines(F.col("text")), key)).alias("pos", "key"))
    long = one.where(F.char_length("key") >= min_chars)
    return long.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.reverse("key")).alias("h2"))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, row, n_dropped and keep of the documents that lose a line.

    keep is the document's bitmap of kept lines, run-length compressed: (first, n) of each run, the
    last one open to the end. The hashes are written first: a range partitioning reads its input twice."""
    scratch = scratch or Scratch(docs.sparkSession, "lines")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = scratch.save(held_lines(docs, min_chars), "hashes").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    ranged = salted.repartitionByRange(parts, "h1", "salt")
    stream = Window.partitionBy("h1", "salt", "h2").orderBy("doc_id", "pos")
    first = ranged.withColumn("first", F.first("doc_id").over(stream))
    later = first.where("doc_id > first").select("doc_id", "row", "pos")
    # The first document of each salt, against those of the other salts.
    among = Window.partitionBy("h1", "h2")
    heads = first.where("doc_id = first").select("h1", "h2", "doc_id", "row", "pos")
    beaten = heads.withColumn("first", F.min("doc_id").over(among)).where("doc_id > first").select("doc_id", "row", "pos")
    lost = later.unionByName(beaten).groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("lost"))
    runs = """filter(concat(
        transform(lost, (p, i) -> struct(if(i = 0, 0, element_at(lost, greatest(i, 1)) + 1) AS first, p - if(i = 0, 0, element_at(lost, greatest(i, 1)) + 1) AS n)),
        array(struct(element_at(lost, -1) + 1 AS first, 1000000000 AS n))), r -> r.n > 0)"""
    return lost.select("doc_id", "row", F.size("lost").alias("n_dropped"), F.expr(runs).alias("keep"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The rows of docs with the kept lines as text (null texts stay null), and n_lines and n_dropped.

    Columns of these two names in docs are replaced; columns named _id, _row, _n or _keep are dropped."""
    docs = docs.drop("_id", "_row", "_n", "_keep")
    keep = keep_bitmaps(docs, min_chars).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("n_dropped").alias("_n"), F.col("keep").alias("_keep"))
    joined = docs.join(keep.hint("shuffle_hash"), (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_row")), "left")
    split = lines(F.col("text"))
    kept = F.array_join(F.flatten(F.transform(F.col("_keep"), lambda r: F.slice(split, r["first"] + 1, r["n"]))), "\n")
    return joined.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), 1).otherwise(F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long"),
            "n_dropped": F.coalesce("_n", F.lit(0)).cast("long"),
            "text": F.when(F.col("_keep").isNull(), F.col("text")).otherwise(kept),
        }
    ).drop("_id", "_row", "_n", "_keep")
