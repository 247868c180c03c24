"""From annotations to samples: question-answer expansion, merging, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Scratch

#: Partitions up to which the table of their offsets is broadcast.
BROADCAST_PARTS = 500_000


def turn(role: str, value: Column) -> Column:
    return F.struct(F.lit(role).alias("from"), value.alias("value"))


def prompt(form: str, qa: Column) -> Column:
    """Form i: the instruction; q: the question; iq: both."""
    return {"i": qa["i"], "q": qa["q"], "iq": F.concat_ws(" ", qa["i"], qa["q"])}[form]


def qa_to_dialogues(df: DataFrame, qa: str, form: str = "q", tag: str = "<video>\n") -> DataFrame:
    """A row with a two-turn dialogue for each question and answer."""
    each = df.withColumn("_qa", F.explode(qa))
    return each.withColumn("conversations", F.array(turn("human", F.concat(F.lit(tag), prompt(form, F.col("_qa")))), turn("gpt", F.col("_qa.a")))).drop("_qa", qa)


def qa_to_one_dialogue(qa: Column, tag: str = "<video>\n") -> Column:
    """All questions and answers as turns of one dialogue; the tag before the first."""
    return F.flatten(F.transform(qa, lambda x, i: F.array(turn("human", F.concat(F.when(i == 0, F.lit(tag)).otherwise(F.lit("")), x["i"])), turn("gpt", x["a"]))))


def caption_and_qa(caption: Column, qa: Column, caption_prompt: str) -> Column:
    """Prompt and answer of the caption, then of each question."""
    pair = lambda q, a: F.struct(q.alias("q"), a.alias("a"))
    return F.concat(F.array(pair(F.lit(caption_prompt), caption)), F.transform(qa, lambda x: pair(x["question"], x["answer"])))


def numbered(df: DataFrame, name: str, *order: str, by: tuple[str, ...] = (), large: bool = False) -> DataFrame:
    """df with a running number from 0 in the given order, inside each key where keys are given.

    Without keys the number is global. It is then made of a range sort and counts before each
    partition, so that no task holds the table. large: keys may hold a large part of the table, so that
    the number comes from a global one less the key's first."""
    if by and large:
        every = numbered(df, "_all", *by, *order)
        first = every.groupBy(*by).agg(F.min("_all").alias("_first"))
        return every.join(first, list(by)).withColumn(name, F.col("_all") - F.col("_first")).drop("_all", "_first")
    if by:
        return df.withColumn(name, (F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1).cast("long"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    # Written, since it is read twice: a second range partitioning would sample anew and cut elsewhere.
    placed = Scratch(df.sparkSession, "numbered").save(placed, "rows").withColumn("_part", F.shiftright("_id", 33))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_low"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n") - F.col("_low")).alias("_shift"))
    before = F.broadcast(before) if parts <= BROADCAST_PARTS else before  # a row of 16 bytes for each partition
    return placed.join(before, "_part").withColumn(name, F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift")


def uid(prefix: str, category: Column, number: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), category, number.cast("string"))


def relative_times(times: Column, start: Column) -> Column:
    """Seconds since the clip's start, two decimals, not below 0."""
    return F.transform(times, lambda t: F.greatest(F.lit(0.0), F.bround(t - start, 2)))


def modality(image: Column, video: Column, frames: Column | None = None) -> Column:
    """image, video or text; a video of one frame or none counts as an image where frames are given."""
    kind = F.when(image.isNotNull(), "image").when(video.isNotNull(), "video").otherwise("text")
    return kind if frames is None else F.when((kind == "video") & (frames <= 1), "image").otherwise(kind)


def slice_rows(df: DataFrame, number: str, first: int, last: int = -1) -> DataFrame:
    """Rows first to last (exclusive; -1: the end) of a running number."""
    return df.where((F.col(number) >= first) & (F.lit(True) if last == -1 else F.col(number) < last))


def hash_choice(options: list[str], key: Column, seed: int = 0) -> Column:
    """One of the options by 32 bits of an MD5 of seed and key: a choice that is the same in every run and engine."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long")
    return F.element_at(F.array(*[F.lit(o) for o in options]), (bits % len(options) + 1).cast("int"))
