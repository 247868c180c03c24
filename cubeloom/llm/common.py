"""What the operators share: tables in the shared folder, and a reader of the input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..workspace import Scratch, importable, scope, shared_dir

__all__ = ["Scratch", "importable", "scope", "shared_dir", "spread", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan, dealt out anew if it has fewer partitions than there are cores: a single small file otherwise keeps one core busy.

    Larger inputs have more splits than cores and stay as they are."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
