"""Perspective rotation: each dialogue once for every participant, with that speaker as assistant.

The others are users with their names; system turns stay system turns. The mask gives the spans of
characters to train on: what the assistant says, with its end marker.

Turns are ranked by a range partitioning of the whole table (conversation, turn, speaker, text) and
prefix sums over each conversation's partitions, so that no task holds a whole conversation. A
dialogue is rendered in segments of at most SEGMENT turns; its text is theirs in a row, and
``text_start`` and ``mask`` count from the dialogue's beginning. Where a segment begins follows from
the lengths that each speaker adds to each segment, without the texts; a segment's texts meet its own
row of each perspective, so that a long conversation is spread over as many keys as it has segments. A
conversation of one segment needs none of this: its participants are those of its row.

Defined results: turns with the same number are ordered by speaker, then text; a null turn comes
last. A null text is empty. A null speaker is shown as ``unknown`` and is no participant. Rows with a
null conv_id form one conversation. A conversation without participants (system turns only) has no
rendering. Repeated rows are turns of their own. Other columns are ignored. What would read as a
marker inside a text or a name is broken by a backslash: <| is written <\\|, and |> is written |\\>; a
line break in a name is a space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

#: Turns in a segment, and segments of a conversation that one row of a participant meets.
SEGMENT, SEGMENTS = 512, 64
SYSTEM, ASSISTANT, END = "system", "<|assistant|>\n", "<|end|>\n"


def ranked(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """conv_id, role, text, rank (the turn's place in its conversation, from 0) and total (the conversation's turns)."""
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text")]
    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    placed = base.repartitionByRange(parts, *by).sortWithinPartitions(*by).select("conv_id", "role", "text", F.monotonically_increasing_id().alias("id"), F.spark_partition_id().alias("part"))
    placed = scratch.save(placed, "placed")
    counts = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    base = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n") - F.col("low")
    total = F.sum("n").over(Window.partitionBy("conv_id"))
    shift = counts.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), base.alias("shift"), total.alias("total"))
    return placed.join(shift, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part"))).select("conv_id", "role", "text", (F.col("id") + F.col("shift")).alias("rank"), "total")


def escaped(text: Column) -> Column:
    """text without anything that reads as a marker."""
    return F.replace(F.replace(text, F.lit("<|"), F.lit("<\\|")), F.lit("|>"), F.lit("|\\>"))


def _head(role: Column, perspective: Column | None = None) -> Column:
    name = F.coalesce(F.translate(escaped(role), "\r\n", "  "), F.lit("unknown"))
    other = F.when(role == SYSTEM, "<|system|>\n").otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    return other if perspective is None else F.when(role == perspective, ASSISTANT).otherwise(other)


def beginnings(turns: DataFrame) -> DataFrame:
    """_conv, _segment, perspective and text_start, for each participant in each segment of its conversation."""
    held = turns.groupBy("conv_id", "segment", "role").agg(F.count("*").alias("n"), F.sum(F.length("said") + F.lit(len(END))).alias("chars"))
    held = held.withColumn("as_user", F.length(_head(F.col("role"))))
    segments = held.groupBy("conv_id", "segment").agg(F.sum(F.col("chars") + F.col("n") * F.col("as_user")).alias("chars")).withColumn("copy", F.floor(F.col("segment") / SEGMENTS))
    last = segments.groupBy(F.col("conv_id").alias("_conv")).agg(F.max("copy").alias("last"))
    cast = turns.where((F.col("role") != SYSTEM)).select("conv_id", F.col("role").alias("perspective")).distinct()
    cast = cast.join(last, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("_conv", "perspective", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("_copy"))
    each = segments.join(cast, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("copy") == F.col("_copy"))).select("_conv", F.col("segment").alias("_segment"), "perspective", "chars")
    own = held.where(F.col("role").isNotNull()).select("conv_id", "segment", "role", (F.col("n") * (F.lit(len(ASSISTANT)) - F.col("as_user"))).alias("less"))
    each = each.join(own, F.col("_conv").eqNullSafe(F.col("conv_id")) & (F.col("_segment") == F.col("segment")) & (F.col("perspective") == F.col("role")), "left")
    size = F.col("chars") + F.coalesce("less", F.lit(0))
    before = F.sum(size).over(Window.partitionBy("_conv", "perspective").orderBy("_segment")) - size
    return each.select("_conv", "_segment", "perspective", before.alias("text_start"))


def rotate(turns: DataFrame, segment: int = SEGMENT, scratch: Scratch | None = None) -> DataFrame:
    """conv_id, perspective, segment, n_turns, text_start, text and mask (an array of start and end in the dialogue) for every participant."""
    scratch = scratch or Scratch(turns.sparkSession, "chat")
    turns = ranked(turns, scratch).select("conv_id", "role", "rank", "total", F.floor(F.col("rank") / segment).cast("long").alias("segment"), escaped(F.col("text")).alias("said"))
    grouped = lambda some: some.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(F.struct("rank", "role", "said"))).alias("turns"))
    columns = ["conv_id", "segment", "turns", "perspective", "text_start"]
    cast = F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), lambda r: r.isNotNull() & (r != SYSTEM)))
    each = grouped(turns.where(F.col("total") <= segment)).withColumns({"perspective": F.explode(cast), "text_start": F.lit(0).cast("long")}).select(*columns)
    long = turns.where(F.col("total") > segment)
    if long.select(F.lit(1)).limit(1).count():
        more = grouped(long).join(beginnings(long), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("segment") == F.col("_segment")))
        each = each.unionByName(more.select(*columns))
    piece = lambda t: F.struct(_head(t["role"], F.col("perspective")).alias("head"), F.concat(t["said"], F.lit(END)).alias("body"), t["role"].eqNullSafe(F.col("perspective")).alias("own"))
    spans = """aggregate(pieces, struct(text_start AS at, cast(array() AS array<struct<start: bigint, end: bigint>>) AS spans), (acc, p) -> struct(
        acc.at + length(p.head) + length(p.body) AS at,
        if(p.own, concat(acc.spans, array(struct(acc.at + length(p.head) AS start, acc.at + length(p.head) + length(p.body) AS end))), acc.spans) AS spans), acc -> acc.spans)"""
    each = each.withColumn("pieces", F.transform("turns", piece))
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"])), "")
    return each.select("conv_id", "perspective", "segment", F.size("turns").cast("long").alias("n_turns"), "text_start", text.alias("text"), F.expr(spans).alias("mask"))
