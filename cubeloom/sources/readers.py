"""Scans of annotation files. Schemas are given, never inferred, so that polymorphic fields stay as they are."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bigjson

SAMPLE = """uid string, source string, data_type string, modality string, video string, images array<string>, caption string, captions array<string>,
    conversations array<struct<`from`: string, value: string>>, timestamps array<double>, start_sec double, end_sec double, video_len int, category string, metadata map<string,string>"""


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that are one JSON array of objects each, cut in ranges."""
    return bigjson.array_rows(spark, path, schema)


def json_object(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key and value of files that are one JSON object keyed by id, cut in ranges; value is the values' type."""
    return bigjson.object_rows(spark, path, value)


def json_folder(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One-record files of a folder, with the file's stem as key; unreadable ones are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return rows.select("*", F.regexp_replace(name, r"\.[^.]*$", "").alias("key")).where("_corrupt IS NULL").drop("_corrupt")


def parquet_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """Parquet files, corrupt ones left out."""
    return spark.read.option("ignoreCorruptFiles", "true").parquet(path)


def csv_header(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def media_listing(spark: SparkSession, path: str, glob: str = "*", suffixes: Sequence[str] = ()) -> DataFrame:
    """path, name, stem (before the first dot) and length of files under a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("name"), F.substring_index(name, ".", 1).alias("stem"), "length")
    return out.where(F.lower("name").rlike(rf"\.({'|'.join(suffixes)})$")) if suffixes else out


def sidecar_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """id and file of sidecar JSON files; those without an id are left out."""
    rows = spark.read.schema("yt_meta_dict struct<info: struct<id: string>>").option("multiLine", True).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    found = F.nullif(F.col("yt_meta_dict.info.id"), F.lit(""))
    return rows.select(found.alias("id"), F.col("_metadata.file_path").alias("file")).where("id IS NOT NULL")


def union_tasks(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """A bag union of benchmark files, each with its task's name and place."""
    named = [df.withColumns({"task": F.lit(name), "task_order": F.lit(i)}) for i, (name, df) in enumerate(parts)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def result_shards(spark: SparkSession, pattern: str, schema: str, lines: bool = False) -> DataFrame:
    """Result shards by a glob; each is a JSON array, or JSON lines."""
    return spark.read.schema(schema).option("multiLine", not lines).json(pattern)


def string_or_array(field: Column) -> Column:
    """A field read as string that holds either a string or a JSON array of strings, as an array."""
    return F.when(F.substring(F.ltrim(field), 1, 1) == "[", F.from_json(field, "array<string>")).when(field.isNotNull(), F.array(field))


def checked_type(df: DataFrame, types: tuple[str, ...] = ("conversations", "caption", "interleave")) -> DataFrame:
    """df; a row of another data_type ends the query with an error."""
    bad = F.raise_error(F.concat(F.lit("unknown data_type "), F.coalesce("data_type", F.lit("null"))))
    return df.withColumn("data_type", F.when(F.col("data_type").isin(*types), F.col("data_type")).otherwise(bad.cast("string")))


def in_batches(df: DataFrame, function, schema: str, rows: int = 32) -> DataFrame:
    """function applied to Arrow batches of at most ``rows`` rows, so that a task holds few large payloads at once."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                yield function(batch.slice(lo, rows))

    return df.mapInArrow(run, schema)
