"""Sinks. Overwrites and appends go through Spark's commit protocol; no flush or lock is needed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.hygiene import routed
from ..operators.joins import keep_last, remaining
from ..workspace import Scratch


#: Bytes of lines that one file of a compacted output holds, about.
FILE_BYTES = 128 << 20


def write_json_lines(df: DataFrame, path: str, append: bool = False, partitions: int | None = None, file_bytes: int = FILE_BYTES) -> None:
    """partitions: compacts the output to so many files, or to more, where those would be larger than file_bytes.

    The rows are written beside first, by all tasks, so that their size is known and none reads more than a file's."""
    mode = "append" if append else "overwrite"
    if not partitions:
        df.write.mode(mode).json(path)
        return
    scratch = Scratch(df.sparkSession, "lines")
    try:
        rows = scratch.save(df, "rows")
        size = rows.select(F.octet_length(F.to_json(F.struct("*"))).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        files = max(partitions, -(-(size[0] + size[1]) // file_bytes))
        rows.repartition(files).write.mode(mode).json(path)
    finally:
        scratch.drop()


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both, the new one where a key is in both."""
    both = old.withColumn("_at", F.lit(0)).unionByName(new.withColumn("_at", F.lit(1)))
    return keep_last(both, key, F.col("_at")).drop("_at")


def write_routed(df: DataFrame, path: str, category: Column, routes: dict[str, tuple[str, ...]]) -> None:
    """Rows in a folder for each route; rows of no route aren't written."""
    df.withColumn("bucket", routed(category, routes)).where("bucket IS NOT NULL").write.mode("overwrite").partitionBy("bucket").json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_missing(df: DataFrame, done: DataFrame, key: list[str], path: str) -> None:
    """Appends the rows whose key isn't done yet."""
    remaining(df, done, key).write.mode("append").json(path)


def write_once(df: DataFrame, path: str) -> None:
    """Writes a range's results unless they are there."""
    df.write.mode("ignore").json(path)
