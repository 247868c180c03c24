"""Ordered scans of keys that may be larger than a task.

Rows are sorted by range partitions of (key, order), and each run of a key in a batch of rows becomes
one row of arrays, so that a run is never longer than a batch. What a run does to what follows is a
small summary (a sum, an affine map); summaries of a key are put in order, and each run gets what
comes before it. A key of any size is spread over as many tasks as its rows are; summaries are one row
for a batch of rows. Only runs that continue a key need anything from outside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from ..workspace import Scratch

AT = "_run"


def packed(df: DataFrame, key: str, order: list[str], scratch: Scratch) -> DataFrame:
    """key, AT (a number that grows in the order of key and order), and arrays of the other columns, for each run of a key in a batch."""
    others = [c for c in df.columns if c != key]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(key), *map(F.col, order)]
    rows = df.repartitionByRange(parts, *by).sortWithinPartitions(*by).select(key, F.monotonically_increasing_id().alias(AT), *others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            offsets = pa.array(np.append(starts, batch.num_rows).astype(np.int32))
            first = pa.array(starts)
            lists = [pa.ListArray.from_arrays(offsets, batch.column(i)) for i in range(2, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(first), batch.column(1).take(first), *lists], batch.schema.names)

    schema = StructType([df.schema[key], StructField(AT, LongType()), *[StructField(c, ArrayType(df.schema[c].dataType)) for c in others]])
    return scratch.save(rows.mapInArrow(run, schema), "runs")


def unpacked(runs: DataFrame, key: str, like: DataFrame, added: dict[str, str], function: Callable[[dict[str, list | np.ndarray], dict[str, np.ndarray], np.ndarray], dict[str, pa.Array]], carry: list[str]) -> DataFrame:
    """The rows of runs, with what function makes of a batch of runs: from flat columns, what each run carries, and the runs' bounds."""
    others = [c for c in like.columns if c != key]
    names = [key, *others, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            lists = {c: column[c] for c in others}
            bounds = np.asarray(next(iter(lists.values())).offsets).astype(np.int64)
            flat = {c: x.values.slice(x.offsets[0].as_py(), len(x.flatten())) for c, x in lists.items()}
            bounds -= bounds[0]
            made = function(flat, {c: column[c].to_numpy(zero_copy_only=False) for c in carry}, bounds)
            keys = column[key].take(pa.array(np.repeat(np.arange(batch.num_rows), np.diff(bounds))))
            yield pa.RecordBatch.from_arrays([keys, *flat.values(), *(made[c] for c in added)], names)

    schema = StructType([like.schema[key], *[like.schema[c] for c in others], *StructType.fromDDL(", ".join(f"{c} {t}" for c, t in added.items())).fields])
    return runs.select(key, *others, *carry).mapInArrow(run, schema).select(*like.columns, *added)


def carried(runs: DataFrame, key: str, before: DataFrame, names: list[str]) -> DataFrame:
    """runs with what comes before each; before has a row for each run that continues a key, fewer than one for a batch, and zeros stand for the others."""
    return runs.join(before, AT, "left").withColumns({n: F.coalesce(n, F.lit(0)) for n in names})


def running(df: DataFrame, key: str, order: list[str], scratch: Scratch | None = None, **sums: Column) -> DataFrame:
    """df with inclusive running sums (longs) over each key's rows in order. sums: a column of whole numbers for each name; null counts as 0."""
    scratch = scratch or Scratch(df.sparkSession, "running")
    given = {f"_in_{n}": F.coalesce(c.cast("long"), F.lit(0)) for n, c in sums.items()}
    like = df.withColumns(given)
    runs = packed(like, key, order, scratch)
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x)
    totals = runs.select(key, AT, *[total(f"_in_{n}").alias(n) for n in sums])
    w = Window.partitionBy(key).orderBy(AT)
    before = totals.select(AT, F.row_number().over(w).alias("_k"), *[(F.sum(n).over(w) - F.col(n)).alias(n) for n in sums]).where("_k > 1").drop("_k")
    names = list(sums)

    def add(flat, carry, bounds):
        out = {}
        for n in names:
            values = flat[f"_in_{n}"].to_numpy(zero_copy_only=False)
            every = np.concatenate([[0], np.cumsum(values)])
            out[n] = pa.array(every[1:] + np.repeat(carry[n] - every[bounds[:-1]], np.diff(bounds)))
        return out

    return unpacked(carried(runs, key, before, names), key, like, {n: "long" for n in names}, add, names).drop(*given)


def momentum(df: DataFrame, key: str, order: list[str], value: str, out: str = "m", rate: float = 0.8, scratch: Scratch | None = None) -> DataFrame:
    """m_1 = x_1 - x_0, then m_t = rate * (x_t - x_(t-1)) + (1 - rate) * m_(t-1); null for each key's first frame.

    A run is an affine map of the momentum before it, which doesn't depend on it but for its first
    frames; the maps of a key's runs are applied in order, one number at a time, and then every run by itself."""
    scratch = scratch or Scratch(df.sparkSession, "momentum")
    keep = 1 - rate
    like = df.withColumn("_x", F.col(value).cast("double"))
    runs = packed(like, key, order, scratch)
    # The momentum after a run that begins with none, if all its steps but the first are weighed by rate.
    start = F.struct(F.lit(0.0).alias("m"), F.get("_x", F.lit(0)).alias("x"))
    inner = F.aggregate("_x", start, lambda acc, x: F.struct((acc["m"] * keep + (x - acc["x"]) * rate).alias("m"), x.alias("x")), lambda acc: acc["m"])
    summary = runs.select(key, AT, F.size("_x").cast("long").alias("n"), F.get("_x", F.lit(0)).alias("first"), F.get("_x", F.lit(1)).alias("second"), F.element_at("_x", -1).alias("last"), inner.alias("inner"))
    several = summary.withColumn("_runs", F.count("*").over(Window.partitionBy(key))).where("_runs > 1").drop("_runs")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = seen = None
        m = x = 0.0
        for batch in batches:
            made = []
            for k, at, n, first, second, last, inside in zip(*(c.to_pylist() for c in batch.columns)):
                if seen is None or k != now:
                    now, seen, m = k, 0, 0.0
                else:
                    made.append((at, seen, x, m))
                for i in range(min(2, n)):  # a key's second frame has the whole difference, others their share
                    if seen + i > 0:
                        step = (first - x) if i == 0 else (second - first)
                        weight = (1.0 if seen + i == 1 else rate) - (rate if i else 0.0)
                        inside = inside + keep ** (n - 1 - i) * step * weight
                m = keep**n * m + inside if n else m
                seen, x = seen + n, last
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * 4, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], [AT, "_seen", "_last", "_m"])

    before = several.repartition(key).sortWithinPartitions(key, AT).mapInArrow(fold, f"{AT} long, _seen long, _last double, _m double")
    names = ["_seen", "_last", "_m"]

    def steps(flat, carry, bounds):
        x = flat["_x"].to_numpy(zero_copy_only=False).astype(np.float64)
        first = bounds[:-1]
        delta = np.diff(x, prepend=0.0)
        delta[first] = x[first] - carry["_last"]
        weight = np.full(len(x), rate)
        at = first[carry["_seen"] == 0]
        weight[at] = 0.0
        weight[at[at + 1 < np.repeat(bounds[1:], 1)[carry["_seen"] == 0]] + 1] = 1.0
        weight[first[carry["_seen"] == 1]] = 1.0
        delta *= weight
        folded = np.empty(len(x))
        for lo, hi, m in zip(first.tolist(), bounds[1:].tolist(), carry["_m"].tolist()):
            folded[lo:hi] = np.fromiter(accumulate(delta[lo:hi].tolist(), lambda acc, d: keep * acc + d, initial=m), np.float64, hi - lo + 1)[1:]
        none = np.zeros(len(x), bool)
        none[at] = True
        return {out: pa.array(folded, mask=none)}

    return unpacked(carried(runs, key, before, names), key, like, {out: "double"}, steps, names).drop("_x")
