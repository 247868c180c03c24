"""Benchmark metrics from predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accuracy_by(df: DataFrame, group: str, correct: Column, scored: Column | None = None) -> DataFrame:
    """Rows, right ones and accuracy of each group and of all (group 'overall'): the micro average.

    One pass: the groups' counts are summed by a rollup. scored: rows that count."""
    rows = df if scored is None else df.where(scored)
    out = rows.rollup(group).agg(F.count("*").alias("n"), F.sum(F.coalesce(correct, F.lit(False)).cast("long")).alias("n_right"), F.grouping(group).alias("_g"))
    return out.select(F.when(F.col("_g") == 1, "overall").otherwise(F.col(group)).alias(group), "n", F.coalesce("n_right", F.lit(0)).alias("n_right"), F.try_divide("n_right", "n").alias("accuracy"))


def same_letter(pred: Column, answer: Column) -> Column:
    return F.upper(pred) == F.upper(answer)


def bare_answer(answer: Column) -> Column:
    """The letter of '(B) text', or the answer itself."""
    return F.coalesce(F.nullif(F.regexp_extract(answer, r"^\(([A-Z])\)", 1), F.lit("")), answer)


def judge_summary(df: DataFrame, pred: str, score: str, *by: str) -> DataFrame:
    """Mean of the truncated scores, and yes / (yes + no); 'yes' is looked for first."""
    verdict = F.when(F.lower(pred).contains("yes"), "yes").when(F.lower(pred).contains("no"), "no")
    out = df.groupBy(*by).agg(
        F.avg(F.col(score).cast("long").cast("double")).alias("mean_score"), F.count_if(verdict == "yes").alias("n_yes"), F.count_if(verdict == "no").alias("n_no"))
    return out.withColumn("accuracy", F.try_divide("n_yes", F.col("n_yes") + F.col("n_no")))


def active_share(df: DataFrame, group: str, active: str, world: int) -> DataFrame:
    """Each group's active labels over all groups' labels, times their number."""
    sums = df.groupBy(group).agg(F.sum(active).alias("n_active"))
    every = F.sum("n_active").over(Window.partitionBy())  # over the groups, a row each
    return sums.withColumn("share", F.try_divide(F.col("n_active") * world, every))


def frames_per_video(df: DataFrame, name: str, frames: str, order: str) -> DataFrame:
    """name and n_frames, the size of its frames; of rows with the same name the last one in order counts."""
    return df.groupBy(name).agg(F.max_by(F.size(frames), order).cast("long").alias("n_frames"))
