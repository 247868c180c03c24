"""Concatenate and cut: token sequences of one length from documents of any length.

First pass: every partition is tokenised and written with its documents' token offsets inside the
partition. The totals of the partitions (a row each) give every partition's global offset as a
prefix sum. Second pass: each document knows its place in the one long stream of ids, and the fixed
windows that it crosses; one record per document and window says where the piece lies.

Defined results: a null or empty text is the end id alone. Documents keep the order in which they
are read; equal or null doc_ids are documents of their own. The literal text of a special token is
that token, unless ``literals`` is false. Other columns of the input are ignored,
whatever their names. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import wordbpe
from .common import Scratch

END_ID = 1
LENGTH = 2048
#: Partitions up to which the table of their offsets (16 bytes a row) is broadcast; beyond, it is shuffled.
BROADCAST_PARTS = 500_000


def tokenized(docs: DataFrame, vocabulary: str, end_id: int = END_ID, literals: bool = True) -> DataFrame:
    """doc_id, ids (with the end id), part (the partition) and at (ids before it in the partition)."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                known = wordbpe.load(vocabulary, literals)
                ids = [known.encode(t or "") + end for t in some.column(1).to_pylist()]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                before = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(ids, pa.binary()), pa.array(n), pa.array(np.full(len(n), part, np.int64)), pa.array(before)], ["doc_id", "ids", "n", "part", "at"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, n long, part long, at long")


def pack(docs: DataFrame, vocabulary: str, length: int = LENGTH, end_id: int = END_ID, literals: bool = True, scratch: Scratch | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids (binary, 4 bytes each), doc_tokens, sequence_id, offset.

    Every sequence but the last is full, so that only the last is padded."""
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    ids = scratch.save(tokenized(docs, vocabulary, end_id, literals), "ids")
    totals = ids.groupBy("part").agg(F.sum("n").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    before = scratch.save(before, "before")
    before = F.broadcast(before) if before.count() <= BROADCAST_PARTS else before
    placed = ids.join(before, "part").withColumn("at", F.col("at") + F.col("base"))
    return placed.select(
        "doc_id",
        F.expr(
            f"""inline(transform(sequence(at div {length}, (at + n - 1) div {length}), s -> struct(
                greatest(s * {length} - at, 0L) AS start,
                least((s + 1) * {length} - at, n) - greatest(s * {length} - at, 0L) AS length,
                substring(ids, cast(4 * greatest(s * {length} - at, 0L) + 1 AS int), cast(4 * (least((s + 1) * {length} - at, n) - greatest(s * {length} - at, 0L)) AS int)) AS ids,
                n AS doc_tokens,
                s AS sequence_id,
                greatest(at - s * {length}, 0L) AS offset)))"""
        ),
    )
