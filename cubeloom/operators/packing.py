"""Packing of variable-length samples in bins of a bounded length.

A bin is a run of a group's samples in their order, so packing finds where runs begin; places inside
a bin are differences of prefix sums. The runs of a group (a batch) follow from each other, and groups
go in parallel; a batch is bounded by its size, never the whole table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 16_384
DUMMY = 64


def packing_length(tokens: Column, images: Column, per_image: int = 64) -> Column:
    """Tokens once each image id stands for per_image places."""
    return tokens + images * (per_image - 1)


def runs_that_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Where runs begin that are as long as the capacity lets them be: a search of the prefix sums for each run. No size is over the capacity."""
    ends, begins, at = np.cumsum(sizes), [], 0
    while at < len(sizes):
        begins.append(at)
        before = ends[at - 1] if at else 0
        at = max(at + 1, int(np.searchsorted(ends, before + capacity, "right")))
    return np.array(begins, np.int64)


def next_fit(df: DataFrame, group: str, length: str, key: str, capacity: int = CAPACITY, dummy: int = DUMMY) -> DataFrame:
    """Next-fit decreasing: samples from the longest on; a bin closes when the next one doesn't fit.

    A sample over the capacity is replaced by a dummy of a fixed length. Adds bin and start (its place in the bin)."""

    def run(rows: pa.Table) -> pa.Table:
        size, keys = rows.column("size").to_numpy(), rows.column(key).to_numpy()
        order = np.lexsort((keys, -size))
        put = np.where(size[order] > capacity, dummy, size[order])
        begins = runs_that_fit(put, capacity)
        bins = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(put))))
        before = np.cumsum(put) - put
        return pa.table({group: rows.column(group).take(order), key: keys[order], "bin": bins, "start": before - before[begins][bins], "length": put})

    rows = df.select(group, F.col(key).cast("long").alias(key), F.col(length).cast("long").alias("size"))
    return rows.groupBy(group).applyInArrow(run, f"{group} {rows.schema[group].dataType.simpleString()}, {key} long, bin long, start long, length long")


@dataclass(frozen=True)
class ParallelBins:
    """Bins for a group of ``degree`` workers that each need an image.

    A sample joins the open bin if it fits, if the bin doesn't then hold images of two videos, and if the bin is
    poor (fewer images than degree) or stays within the longest bin and the most images seen. A closed bin gets as many
    dummies, of an image each, as it is poor by, each put while the bin isn't full; a bin that stays poor is dropped."""

    degree: int
    capacity: int
    most_images: int
    dummy: int = DUMMY

    def joins(self, images: int, used: int, video: bool, longest: int, sample: tuple[int, int, bool]) -> bool:
        size, n, is_video = sample
        small = images + n <= self.most_images and used + size <= longest
        return used + size <= self.capacity and not (video and is_video) and (images < self.degree or small)

    def dummies(self, images: int, used: int) -> int | None:
        """How many a bin gets; None if it is dropped."""
        missing, room = max(0, self.degree - images), max(0, -(-(self.capacity - used) // self.dummy))
        return missing if missing <= room else None


def pack_parallel(samples: list[tuple], degree: int, capacity: int, per_image: int = 64, dummy: int = DUMMY, ring: str | None = None) -> list[tuple]:
    """(sample, bin, start, length) for samples (key, tokens, images, is_video) of one batch, as ParallelBins has it; a dummy's key is None.

    Samples go from the longest on, padded to a multiple of degree (ring) or twice that (zigzag); those over the
    capacity are left out. A video without images doesn't keep the next one out."""
    multiple = {None: 1, "ring": degree, "zigzag": 2 * degree}[ring]
    rows = sorted((-(tokens + images * (per_image - 1)), key, images, bool(video)) for key, tokens, images, video in samples)
    longest = next((-size for size, *_ in rows if -size <= capacity), 0)
    rule = ParallelBins(degree, capacity, max((n for *_, n, _ in rows), default=0), dummy)
    rows = [(key, -(size // multiple) * multiple, n, video) for size, key, n, video in rows]
    rows = [r for r in rows if r[1] <= capacity]
    out, number, first = [], 0, 0
    images, used, video = 0, 0, False
    for i, (_, size, n, is_video) in enumerate([*rows, (None, capacity + 1, 0, False)]):  # the last one closes the last bin
        if i > first and not rule.joins(images, used, video, longest, (size, n, is_video)):
            extra = rule.dummies(images, used)
            if extra is not None:
                held = [(k, s) for k, s, *_ in rows[first:i]] + [(None, dummy)] * extra
                starts = np.cumsum([0, *(s for _, s in held)]).tolist()
                out += [(k, number, at, s) for (k, s), at in zip(held, starts)]
                number, longest = number + 1, max(longest, starts[-1])
            first, images, used, video = i, 0, 0, False
        images, used, video = images + n, used + size, video or (is_video and n > 0)
    return out


def pack_for_parallel(df: DataFrame, group: str, key: str, degree: int, capacity: int = CAPACITY, ring: str | None = None) -> DataFrame:
    """pack_parallel for each group; df has tokens, images and is_video."""

    def run(rows: pa.Table) -> pa.Table:
        found = pack_parallel(list(zip(*(rows.column(c).to_pylist() for c in (key, "tokens", "images", "is_video")))), degree, capacity, ring=ring)
        columns = list(zip(*found)) or [(), (), (), ()]
        return pa.table({group: pa.array([rows.column(group)[0].as_py()] * len(found), pa.int64())} | {n: pa.array(c, pa.int64()) for n, c in zip((key, "bin", "start", "length"), columns)})

    rows = df.select(F.col(group).cast("long").alias(group), F.col(key).cast("long").alias(key), "tokens", "images", "is_video")
    return rows.groupBy(group).applyInArrow(run, f"{group} long, {key} long, bin long, start long, length long")


def balanced_batches(df: DataFrame, group: str, key: str, length: str, size: int, allowance: int = 1000) -> DataFrame:
    """A batch number for each row: batches of ``size`` rows in key order, of which the heavy ones are divided.

    A batch is heavy if its total reaches the group's mean total of a batch plus an allowance. It is divided where its
    running total passes multiples of that limit, so that no part is over the limit by more than one row."""
    order = Window.partitionBy(group).orderBy(key)
    placed = df.select(group, key, F.col(length).cast("long").alias("_n")).withColumn("_at", F.floor((F.row_number().over(order) - 1) / size))
    whole, batch = Window.partitionBy(group), Window.partitionBy(group, "_at")
    limit = F.sum("_n").over(whole) / (F.max("_at").over(whole) + 1) + allowance
    placed = placed.withColumns({"_limit": limit, "_total": F.sum("_n").over(batch), "_before": F.sum("_n").over(batch.orderBy(key)) - F.col("_n")})
    placed = placed.withColumn("_part", F.when(F.col("_total") >= F.col("_limit"), F.floor(F.col("_before") / F.col("_limit"))).otherwise(0))
    return placed.select(group, key, (F.dense_rank().over(Window.partitionBy(group).orderBy("_at", "_part")) - 1).cast("long").alias("batch"))
