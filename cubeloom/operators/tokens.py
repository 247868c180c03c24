"""Token sequences as rows: placeholders of frames merged by cube."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_placeholders(df: DataFrame, key: str, order: list[str], is_image: Column, per_cube: int, bounds: DataFrame | None = None) -> DataFrame:
    """The tokens that stay when each cube's frames share one placeholder, with new positions from 0.

    Cubes are runs of ``per_cube`` frames, or the ranges [low, high) of ``bounds`` (key, low, high). A cube keeps its
    first placeholder; tokens between the frames of one cube go, those between cubes stay."""
    w = Window.partitionBy(key).orderBy(*order)
    seen = df.withColumn("_img", is_image).withColumn("_g", F.count_if("_img").over(w) - 1)
    if bounds is None:
        first, last = F.col("_g") % per_cube == 0, F.col("_g") % per_cube == per_cube - 1
    else:
        seen = seen.join(bounds.select(key, F.col("low").alias("_low"), F.col("high").alias("_high")), key, "left").where("_low IS NULL OR (_g >= _low AND _g < _high) OR (_g < 0 AND _low = 0)")
        first, last = F.col("_low").isNull() | (F.col("_g") == F.col("_low")), F.col("_low").isNull() | (F.col("_g") == F.col("_high") - 1)
    kept = seen.where((F.col("_img") & first) | (~F.col("_img") & ((F.col("_g") < 0) | last)))
    return kept.withColumn("position", (F.row_number().over(w) - 1).cast("long")).select(*df.columns, "position")
