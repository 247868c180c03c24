"""Nearest neighbours by vantage-point trees, one for each shard of the vectors.

A tree splits its rows in halves by their distance from a vantage row, and keeps the least and the
largest distance of each half. By the triangle inequality a half holds nothing nearer to a query
than the gap between the query's distance and that range. A search goes to the half with the
smaller gap first, and enters a half if gap <= factor * (distance of the k-th found so far): factor
1, the default, is exact search; less prunes more and loses neighbours.

Shards come from a tree of the same kind over SAMPLE rows at most (the documented sample), whose
leaves, LEAVES at most, divide space; every row is routed to its leaf, and a leaf of more than
``shard_rows`` rows is dealt out over several shards, each with a tree of its own. Trees are built
once and written to the shared folder. A query searches its own leaf first; the distance that it
finds there rules out other leaves and bounds the search in the rest. Queries meet a shard in blocks
of ``block`` at most, so that a task holds a bounded number of either. Distances are Euclidean
in double precision; matrix products only find out which are worth computing.

Defined results: vectors that are null or zero, or hold null or non-finite components, take no
part, and neither do null ids. Vectors of another length are never neighbours. Equal distances go to
the smaller id. Candidates that share an id are rows of their own, but a query never meets its own
id. Equal queries (id and vector) are one; queries of one id with different vectors each have a
list. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SHARD_ROWS, BLOCK, LEAF = 16_384, 16_384, 128
#: Rows from which space is divided, its parts, and components in a shard (128 MB).
SAMPLE, LEAVES, SHARD_CELLS = 4_096, 256, 1 << 24
FACTOR = 1.0
#: Rounding never prunes what lies on the bound.
SLACK = 1 - 1e-12
_KEY = ("dim", "leaf", "part")


class Tree:
    """rows in tree order; inner nodes are numbered level by level, each with a vantage row and its halves' ranges of distance."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF, built: tuple[np.ndarray, np.ndarray] | None = None):
        self.rows, self.ids = np.array(rows, np.float64), np.array(ids)
        self.depth = max(0, int(np.ceil(np.log2(max(len(ids), 1) / leaf))))
        self.vantages, self.ranges = built or (np.zeros(2**self.depth - 1, np.int64), np.zeros((2**self.depth - 1, 4)))
        if built is None:
            self._build(np.random.default_rng(len(ids)))
        with np.errstate(over="ignore", under="ignore"):
            self.norms = (self.rows**2).sum(1)

    def _build(self, random) -> None:
        order = np.argsort(self.ids, kind="stable")
        points = np.empty((len(self.vantages), self.rows.shape[1] if self.rows.ndim == 2 else 0))
        for level in range(self.depth):
            for node, low, high in self.level(level):
                points[node] = self.rows[order[low + int(random.integers(high - low))]]
                d = distances(self.rows[order[low:high]], points[node][None])[:, 0]
                by = np.argsort(d, kind="stable")
                order[low:high], d, middle = order[low:high][by], d[by], (high - low) // 2
                self.ranges[node] = d[0], d[middle - 1], d[middle], d[-1]
        self.rows, self.ids = self.rows[order], self.ids[order]
        for level in range(self.depth):  # a vantage row stays inside its node's range
            for node, low, high in self.level(level):
                self.vantages[node] = low + np.flatnonzero((self.rows[low:high] == points[node]).all(1))[0]

    def level(self, level: int) -> Iterator[tuple[int, int, int]]:
        """Node, low and high of a level's nodes."""
        spans = [(0, len(self.ids))]
        for _ in range(level):
            spans = [s for low, high in spans for s in ((low, low + (high - low) // 2), (low + (high - low) // 2, high))]
        return ((2**level - 1 + i, low, high) for i, (low, high) in enumerate(spans))

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float, reach: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Distances and ids of each query's k nearest, nearest first; missing ones are inf and -1. Rows farther than reach aren't needed."""
        queries = np.asarray(queries, np.float64)
        reach = np.full(len(ids), np.inf) if reach is None else reach
        with np.errstate(over="ignore", under="ignore"):
            norms = (queries**2).sum(1)
        best, found = np.full((len(ids), k), np.inf), np.full((len(ids), k), -1, np.int64)
        todo = [(0, 0, len(self.ids), 0, np.arange(len(ids)), np.zeros(len(ids)))] if len(self.ids) else []
        while todo:
            node, low, high, level, at, gap = todo.pop()
            enter = gap * SLACK <= factor * np.minimum(best[at, k - 1], reach[at])
            at, gap = at[enter], gap[enter]
            if not len(at):
                continue
            if level == self.depth:
                self._leaf(low, high, at, ids, queries, norms, best, found, reach)
                continue
            d = distances(queries[at], self.rows[self.vantages[node]][None])[:, 0]
            a, b, c, e = self.ranges[node]
            left, right = np.maximum(gap, np.maximum(a - d, d - b)), np.maximum(gap, np.maximum(c - d, d - e))
            middle, first = low + (high - low) // 2, left <= right
            halves = (2 * node + 1, low, middle, level + 1), (2 * node + 2, middle, high, level + 1)
            for (one, one_gap), who in (((halves[1], right), first), ((halves[0], left), ~first), ((halves[0], left), first), ((halves[1], right), ~first)):
                todo.append((*one, at[who], one_gap[who]))
        found[~np.isfinite(best)] = -1
        return best, found

    def _leaf(self, low, high, every, ids, queries, norms, best, found, reach) -> None:
        k, rows, row_ids = best.shape[1], self.rows[low:high], self.ids[low:high]
        step = max(1, 4_000_000 // max(1, high - low))
        for lo in range(0, len(every), step):
            at = every[lo : lo + step]
            with np.errstate(over="ignore", under="ignore", invalid="ignore"):
                near = norms[at][:, None] + self.norms[None, low:high] - 2 * (queries[at] @ rows.T)
                error = 8 * (rows.shape[1] + 8) * np.finfo(float).eps * (norms[at] + self.norms[low:high].max()) + np.finfo(float).tiny
            own = ids[at][:, None] == row_ids[None]
            near[own] = np.inf
            with np.errstate(over="ignore", under="ignore"):
                limit = np.minimum(best[at, k - 1], reach[at]) ** 2 * (1 + 1e-12) + error
            if high - low > k:
                limit = np.minimum(limit, np.partition(near, k - 1, axis=1)[:, k - 1] + 2 * error)
            q, r = np.nonzero(~(near > limit[:, None]) & ~own)  # what overflows is computed, too
            if not len(q):
                continue
            exact = np.full(near.shape, np.inf)
            some = max(1, 2_000_000 // max(1, rows.shape[1]))
            for i in range(0, len(q), some):
                exact[q[i : i + some], r[i : i + some]] = lengths(queries[at[q[i : i + some]]], rows[r[i : i + some]])
            better = np.unique(q)
            exact, at = exact[better], at[better]
            all_d = np.concatenate([best[at], exact], 1)
            all_i = np.concatenate([found[at], np.broadcast_to(row_ids, exact.shape)], 1)
            by = np.lexsort((all_i, all_d), axis=1)[:, :k]
            best[at], found[at] = np.take_along_axis(all_d, by, 1), np.take_along_axis(all_i, by, 1)


class Space:
    """A tree over a sample, whose leaves divide space: each split is halfway between the sample's halves."""

    def __init__(self, rows: np.ndarray, leaves: int):
        tree = Tree(np.arange(len(rows)), rows, max(1, -(-len(rows) // leaves)))
        self.depth, self.points = tree.depth, tree.rows[tree.vantages]
        self.splits = tree.ranges[:, 1] / 2 + tree.ranges[:, 2] / 2

    def route(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each row, and the least distance that a row of each leaf can have from it."""
        home, gaps = np.zeros(len(rows), np.int64), np.zeros((len(rows), 1))
        for level in range(self.depth):
            first, d = 2**level - 1, np.empty((len(rows), 2**level))
            for i in range(2**level):
                d[:, i] = distances(rows, self.points[first + i][None])[:, 0] - self.splits[first + i]
            home = 2 * home + (d[np.arange(len(rows)), home] > 0)
            gaps = np.stack([np.maximum(gaps, d), np.maximum(gaps, -d)], 2).reshape(len(rows), -1)
        return home, gaps


def lengths(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances along the last axis. Where squares over- or underflow, both are scaled by a power of two first, which changes no digit."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        out = np.sqrt(((a - b) ** 2).sum(-1))
        odd = ~(np.isfinite(out) & (out > 1e-140))
        if odd.any():
            x, y = (np.broadcast_to(v, np.broadcast_shapes(a.shape, b.shape))[odd] for v in (a, b))
            high = np.maximum(np.abs(x).max(-1, initial=0), np.abs(y).max(-1, initial=0))
            power = np.where(high > 0, -np.frexp(high)[1], 0)[:, None]
            # Twice, since a power of two may be too large for one factor.
            x, y = (np.ldexp(np.ldexp(v, power // 2), power - power // 2) for v in (x, y))
            own = x - y
            most = np.abs(own).max(-1, initial=0)
            again = np.where(most > 0, -np.frexp(most)[1], 0)[:, None]
            scaled = np.sqrt((np.ldexp(own, again) ** 2).sum(-1))
            out[odd] = np.ldexp(scaled, -(power + again)[:, 0])
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)))
    step = max(1, 1_000_000 // max(1, b.size))
    for lo in range(0, len(a), step):
        out[lo : lo + step] = lengths(a[lo : lo + step, None, :], b[None])
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) and dim of the rows that take part."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists(e, lambda x: x != 0)
    return vectors.where(F.col("vec_id").isNotNull() & F.coalesce(finite & some, F.lit(False))).select(F.col("vec_id").cast("long"), e.alias("embedding"), F.size("embedding").alias("dim"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length, from a column of binaries."""
    parts = [np.frombuffer(x.as_buffer(), np.float64) for x in column]
    return np.stack(parts) if parts else np.zeros((0, 0))


def spaces(rows: DataFrame, leaves: int) -> dict[int, Space]:
    """A division of space for each length of vector that the sample holds."""
    sample = rows.orderBy(F.xxhash64("vec_id", "embedding")).limit(SAMPLE).select("embedding").toArrow().column("embedding")
    found: dict[int, list] = {}
    for x in sample:
        found.setdefault(len(x.values), []).append(np.asarray(x.values))
    return {dim: Space(np.stack(some), leaves) for dim, some in found.items()}


def routed(rows: DataFrame, parts_of: dict[int, Space], twin: str) -> DataFrame:
    """vec_id, twin, dim, vector (binary), leaf, gaps (to each leaf, for queries) and spot (a number that deals a leaf's rows out, whatever they hold)."""
    asked = twin != "0L"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == dim))
                for lo in range(0, len(some), 1024):
                    each = some.slice(lo, 1024)
                    rows = np.asarray(each.column(3).flatten()).reshape(-1, dim)
                    home, gaps = parts_of[dim].route(rows) if dim in parts_of else (np.zeros(len(rows), np.int64), np.zeros((len(rows), 1)))
                    spot = np.arange(n, n + len(rows), dtype=np.int64) + part * 7919
                    n += len(rows)
                    gaps = pa.array(list(gaps) if asked else [None] * len(rows), pa.list_(pa.float64()))
                    vectors = pa.array([x.tobytes() for x in rows], pa.binary())
                    yield pa.RecordBatch.from_arrays([each.column(0), each.column(1), each.column(2), vectors, pa.array(home), gaps, pa.array(spot)], ["vec_id", "twin", "dim", "vector", "leaf", "gaps", "spot"])

    columns = rows.select("vec_id", F.expr(twin).alias("twin"), "dim", "embedding")
    return columns.mapInArrow(run, "vec_id long, twin long, dim int, vector binary, leaf long, gaps array<double>, spot long")


def built(rows: DataFrame, shard_rows: int) -> DataFrame:
    """Trees: their rows with dim, leaf, part, place (in tree order), and, at the first place, vantages and ranges."""
    most = F.least(F.lit(shard_rows), F.greatest(F.lit(1), F.floor(F.lit(SHARD_CELLS) / F.col("dim"))))
    parts = rows.groupBy("dim", "leaf").agg(F.count("*").alias("n")).select("dim", "leaf", F.ceil(F.col("n") / most).cast("long").alias("parts"))
    dealt = rows.join(parts, ["dim", "leaf"]).withColumn("part", F.pmod("spot", "parts"))

    def run(table: pa.Table) -> pa.Table:
        tree, n = Tree(table.column("vec_id").to_numpy(), _matrix(table.column("vector"))), len(table)
        same = {c: table.column(c) for c in (*_KEY, "parts")}
        first = lambda x: pa.array([x.tobytes()] + [None] * (n - 1), pa.binary())
        own = {"place": pa.array(np.arange(n)), "vec_id": pa.array(tree.ids), "vector": pa.array([x.tobytes() for x in tree.rows], pa.binary()), "vantages": first(tree.vantages), "ranges": first(tree.ranges)}
        return pa.table(same | own)

    return dealt.select(*_KEY, "parts", "vec_id", "vector").groupBy(*_KEY).applyInArrow(run, "dim int, leaf long, part long, parts long, place long, vec_id long, vector binary, vantages binary, ranges binary")


def searched(asked: DataFrame, trees: DataFrame, k: int, factor: float, block: int) -> DataFrame:
    """query_id, twin, vec_id and score of the k nearest that each query (vec_id, twin, vector, reach) finds in the leaf that it names."""
    shards = trees.where("place = 0").select("dim", "leaf", "parts").distinct()
    load = asked.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / F.lit(block)).cast("long").alias("blocks"))
    left = trees.join(load, ["dim", "leaf"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    right = asked.join(load, ["dim", "leaf"]).join(shards, ["dim", "leaf"]).withColumn("block", F.pmod(F.xxhash64("vec_id", "twin"), "blocks"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out = {"query_id": [], "twin": [], "vec_id": [], "score": []}
        if len(rows) and len(asked):
            place = rows.column("place").to_numpy()
            order, top = np.argsort(place), int(np.flatnonzero(place == 0)[0])
            vantages = np.frombuffer(rows.column("vantages")[top].as_buffer(), np.int64)
            ranges = np.frombuffer(rows.column("ranges")[top].as_buffer(), np.float64).reshape(-1, 4)
            tree = Tree(rows.column("vec_id").to_numpy()[order], _matrix(rows.column("vector"))[order], built=(vantages, ranges))
            ids, twins = asked.column("vec_id").to_numpy(), asked.column("twin").to_numpy()
            score, found = tree.search(ids, _matrix(asked.column("vector")), k, factor, asked.column("reach").to_numpy())
            full = np.isfinite(score)
            out = {"query_id": np.repeat(ids, k)[full.ravel()], "twin": np.repeat(twins, k)[full.ravel()], "vec_id": found[full], "score": score[full]}
        return pa.table({n: pa.array(v, pa.float64() if n == "score" else pa.int64()) for n, v in out.items()})

    left = left.select(*_KEY, "block", "place", "vec_id", "vector", "vantages", "ranges")
    right = right.select(*_KEY, "block", "vec_id", "twin", "vector", "reach")
    key = (*_KEY, "block")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, "query_id long, twin long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id", "twin").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest found. queries: vec_id and embedding."""
    scratch = scratch or Scratch(vectors.sparkSession, "vptree")
    rows, asked = usable(vectors), usable(queries).withColumn("twin", F.xxhash64("embedding")).dropDuplicates(["vec_id", "twin"])
    leaves = min(LEAVES, -(-rows.count() // shard_rows))
    parts_of = spaces(rows, leaves) if leaves > 1 else {}
    rows, asked = routed(rows, parts_of, "0L"), routed(asked, parts_of, "twin").withColumn("reach", F.lit(float("inf")))
    if leaves <= 1:  # one shard for each length of vector; written, since the search reads it twice
        trees = scratch.save(built(rows, shard_rows), "trees")
        return _ranked(searched(asked, trees, k, factor, block), k).select("query_id", "rank", "vec_id", "score")
    trees = scratch.save(built(scratch.save(rows, "rows"), shard_rows), "trees")
    scratch.drop("rows")
    asked = scratch.save(asked, "asked")
    home = scratch.save(_ranked(searched(asked, trees, k, factor, block), k).drop("rank"), "home")
    reach = home.groupBy(F.col("query_id").alias("vec_id"), "twin").agg(F.when(F.count("*") == k, F.max("score")).otherwise(float("inf")).alias("reach"))
    wider = asked.drop("reach").join(reach, ["vec_id", "twin"], "left").withColumn("reach", F.coalesce("reach", F.lit(float("inf"))))
    near = F.transform("gaps", lambda gap, i: F.when((i != F.col("leaf")) & (gap * SLACK <= factor * F.col("reach")), i.cast("long")))
    wider = wider.select("vec_id", "twin", "dim", "vector", "reach", F.explode(F.filter(near, lambda i: i.isNotNull())).alias("leaf"))
    away = scratch.save(searched(wider, trees, k, factor, block), "away")
    for name in ("trees", "asked"):
        scratch.drop(name)
    return _ranked(home.unionByName(away), k).select("query_id", "rank", "vec_id", "score")
