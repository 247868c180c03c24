"""Near-duplicate documents: one-permutation MinHash with optimal densification, exact confirmation.

1. Every text becomes the set of its word shingles. Sets that are equal form a class, found by a
   128-bit hash of the set; each class is one node, whose set is made from one of its texts.
2. One permutation: each shingle falls in one of bands * rows bins, which keeps its smallest value.
   An empty bin takes the value of a full one, tried in an order that depends on the bin alone
   (optimal densification). Bins are hashed by bands; nodes with an equal band share a bucket.
3. Star-shaped candidate edges: in each bucket every member is paired with the first one only, so
   that pairs grow with the members. Pairs of too different sizes go at once; the others send the
   member's set to the star's, which is copied for so many members each. Components are found.
4. Where a bucket still holds members of different components, pairs that aren't of the star are
   tested on the full sets, each pair in its first shared bucket only: strays (members outside of
   the bucket's largest component) against those of other components. Members go in blocks to each
   block of strays, so that rows grow with strays times members, and with members alone where a
   bucket's strays fit in a block. In a block only sets that share one of their rarest elements are
   compared (as many of these as two similar sets can't both do without), and enough is left from it on. Only links that join two
   components leave the task.

With 32 bands of 5 rows, a pair at similarity 0.8 misses all buckets with a chance of 3e-6.

Defined results: null texts, and texts without words, have an empty set and are linked with
nothing. Rows with a null doc_id are linked with nothing, have a null component and are kept. Equal
rows are judged alike, and rows that share a doc_id each by their own text. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import Scratch
from .components import components

BANDS, ROWS, PERCENT = 32, 5, 80
#: Shingles and members in a block of a bucket, and members that one copy of a star's set meets.
BLOCK_SHINGLES, BLOCK_MEMBERS, STAR_MEMBERS = 500_000, 4_000, 500
_C = [np.uint64(c) for c in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_EMPTY = np.uint64(2**64 - 1)


def shingle_sets(data: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and where each text's begin."""
    data = tv.lower_ascii(data)
    first, last, of = tv.words(data, starts)
    found, of = tv.shingles(tv.span_hashes(data, first, last), of, k)
    for i, j in zip(of[:-1].tolist(), of[1:].tolist()):
        found[i:j].sort()
    new = np.ones(len(found), bool)
    new[1:] = found[1:] != found[:-1]
    new[of[:-1][of[:-1] < of[1:]]] = True
    return found[new], np.concatenate([[0], np.cumsum(new)])[of]


def signatures(sets: np.ndarray, of: np.ndarray, bins: int) -> np.ndarray:
    """A row of bins for each set that isn't empty; rows of empty sets are of no use."""
    n = len(of) - 1
    owner = np.repeat(np.arange(n), np.diff(of))
    at = ((tv.mix(sets ^ _C[0]) >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    out = np.full(n * bins, _EMPTY)
    np.minimum.at(out, owner * bins + at.astype(np.int64), tv.mix(sets ^ _C[1]))
    out = out.reshape(n, bins)
    full = out != _EMPTY
    row, bin_ = np.nonzero(~full & full.any(1)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        other = (tv.mix(bin_.astype(np.uint64) + np.uint64(attempt * int(_C[2]) % 2**64)) % np.uint64(bins)).astype(np.int64)
        found = full[row, other]
        out[row[found], bin_[found]] = out[row[found], other[found]]
        row, bin_ = row[~found], bin_[~found]
    return out


def band_hashes(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.broadcast_to(tv.mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(signature), bands)).copy()
    for r in range(rows):
        out = tv.mix(out * _C[3] + signature[:, r * bands : (r + 1) * bands])
    return out


def set_hashes(sets: np.ndarray, of: np.ndarray) -> np.ndarray:
    """128 bits for each set, as two columns."""
    columns = []
    for c in _C[:2]:
        total = np.zeros(len(sets) + 1, np.uint64)
        np.cumsum(tv.mix(sets * _C[3] ^ c), out=total[1:])
        columns.append(tv.mix(total[of[1:]] - total[of[:-1]] + np.diff(of).astype(np.uint64)))
    return np.stack(columns, 1)


def _binary(column: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in column]


def sketches(docs: DataFrame, k: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, n (set size), set_id (16 bytes), bands (longs) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = tv.text_bytes(batch.column(2))
            for i, j in tv.slices(starts):
                sets, of = shingle_sets(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], k)
                hashes = band_hashes(signatures(sets, of, bands * rows), bands, rows).view(np.int64)
                offsets = pa.array(np.arange(len(hashes) + 1, dtype=np.int32) * bands)
                listed = pa.ListArray.from_arrays(offsets, pa.array(hashes.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(of)), pa.array(_binary(set_hashes(sets, of)), pa.binary()), listed], ["doc_id", "text_hash", "n", "set_id", "bands"])

    return docs.select(F.col("doc_id").cast("long"), text_hash().alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n long, set_id binary, bands array<long>")


def text_hash() -> Column:
    return F.xxhash64("text")


def full_sets(texts: DataFrame, k: int) -> DataFrame:
    """node, n and set (sorted 64-bit hashes in binary) of every row of texts (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = tv.text_bytes(batch.column(1))
            for i, j in tv.slices(starts):
                sets, of = shingle_sets(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i], k)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(of)), pa.array([sets[a:b].tobytes() for a, b in zip(of[:-1], of[1:])], pa.binary())], ["node", "n", "set"])

    return texts.select("node", "text").mapInArrow(run, "node long, n long, set binary")


def _once(sets: DataFrame) -> DataFrame:
    """One row for each node; repeated rows of a document have given several. The join that follows is dealt by the same key."""
    return sets.groupBy("node").agg(F.first("set").alias("set"))


def _similar(common, n_a, n_b, percent: int):
    return 100 * common >= percent * (n_a + n_b - common)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b, n_a, n_b), those whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                keep.append(bool(_similar(int((both[1:] == both[:-1]).sum()), len(x), len(y), percent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    close = pairs.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b").distinct()
    load = close.groupBy("b").agg(F.ceil(F.count("*") / F.lit(STAR_MEMBERS)).cast("int").alias("copies"))
    stars = _once(sets.join(load.select(F.col("b").alias("node")), "node", "left_semi")).select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    stars = stars.join(load, "b").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
    sent = close.join(load, "b").withColumn("copy", F.pmod(F.xxhash64("a"), "copies").cast("int")).drop("copies")
    sent = sent.join(_once(sets).select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a")
    return sent.join(stars, ["b", "copy"]).select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def prefixes(where: np.ndarray, counts: np.ndarray, owner: np.ndarray, n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of each set's rarest elements, as many as two similar sets must have one of in common (all but percent of its elements, and one), and each one's rank in its set.

    Elements are ranked by how many of the block's sets hold them, then by their number, alike in all sets."""
    order = np.lexsort((where, counts[where], owner))
    first = np.concatenate([[0], np.cumsum(n)])[:-1]
    place = np.arange(len(order)) - first[owner[order]]
    taken = place < (n + (-percent * n // 100) + 1)[owner[order]]
    return order[taken], place[taken]


def block_links(table: pa.Table, percent: int) -> pa.Table:
    """Links that join components among a block's rows: node, component, n, set, bands, bucket, stray, and asks (a stray's row for its side of the block).

    Only rows that share an element of their prefixes are compared, so that what all of a bucket's sets have in common costs nothing."""
    node, comp, n, stray, asks = (table.column(c).to_numpy() for c in ("node", "component", "n", "stray", "asks"))
    bands = np.stack([np.asarray(x.values) for x in table.column("bands")])
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
    values, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    sizes = np.array([len(s) for s in sets], np.int64)
    of = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    band = int(np.flatnonzero((bands == bands[0]).all(0) & (bands[0] == table.column("bucket")[0].as_py()))[0])
    names, comp_ids = np.unique(comp, return_inverse=True)
    group = np.arange(len(names))  # components joined in this task
    # Answering rows by the elements of their prefixes, and each asking row's own prefix.
    held, rank = prefixes(where, counts, owner, sizes, percent)
    ask = asks[owner[held]]
    mine, my_rank = held[ask], rank[ask]
    by = np.argsort(where[held[~ask]], kind="stable")
    theirs, their_rank = held[~ask][by], rank[~ask][by]
    keys, rows = where[theirs], owner[theirs]
    #: What is left of an answering set from an element on.
    rest = sizes[rows] - their_rank
    own_of = np.searchsorted(owner[mine], np.arange(len(sets) + 1))
    links = []
    mark = np.zeros(len(values), np.int32)
    for x in np.flatnonzero(asks).tolist():
        own = slice(own_of[x], own_of[x + 1])
        wanted = where[mine[own]]
        low, high = np.searchsorted(keys, wanted), np.searchsorted(keys, wanted, "right")
        met = np.repeat(high - np.cumsum(high - low), high - low) + np.arange((high - low).sum())
        # Sets whose first common element this is have no more in common than what is left of either from it on.
        most = np.minimum(rest[met], np.repeat(sizes[x] - my_rank[own], high - low))
        at = np.unique(rows[met[(100 + percent) * most >= percent * (sizes[x] + sizes[rows[met]])]])
        other = (group[comp_ids[at]] != group[comp_ids[x]]) & (100 * np.minimum(n[at], n[x]) >= percent * np.maximum(n[at], n[x]))
        other &= ~stray[at] | (node[at] > node[x])  # two strays meet twice
        at = at[other]
        at = at[~(bands[at, :band] == bands[x, :band]).any(1)] if len(at) else at
        if not len(at):
            continue
        mark[where[of[x] : of[x + 1]]] = 1
        ends = np.cumsum(sizes[at])
        places = np.repeat(of[at] - ends + sizes[at], sizes[at]) + np.arange(ends[-1])
        common = np.add.reduceat(mark[where[places]], ends - sizes[at])
        mark[where[of[x] : of[x + 1]]] = 0
        for y in at[_similar(common, n[x], n[at], percent)].tolist():
            if group[comp_ids[y]] != group[comp_ids[x]]:
                links.append((int(node[x]), int(node[y])))
                group[group == group[comp_ids[y]]] = group[comp_ids[x]]
    return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})


def strays_and_members(members: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the blocks of each bucket that holds several components: bucket, i, j, node, component, stray, asks. The star has been tested."""
    labelled = members.where("node <> center").join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).select("bucket", "node", "n", "component")
    held = labelled.groupBy("bucket", "component").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    largest = F.max(F.struct("m", "n", "component"))
    open_ = held.groupBy("bucket").agg(largest.alias("top"), F.sum("m").alias("m"), F.sum("n").alias("n"), F.count("*").alias("components")).where("components > 1")
    blocks = lambda m, n: F.ceil(F.greatest(n / F.lit(BLOCK_SHINGLES), m / F.lit(BLOCK_MEMBERS))).cast("int")
    open_ = open_.select("bucket", F.col("top.component").alias("top"), blocks(F.col("m"), F.col("n")).alias("js"), blocks(F.col("m") - F.col("top.m"), F.col("n") - F.col("top.n")).alias("is"))
    rest = labelled.join(open_, "bucket").withColumn("stray", F.col("component") != F.col("top"))
    own = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    answer = rest.select("bucket", "node", "component", "stray", F.lit(False).alias("asks"), own("js").alias("j"), every("is").alias("i"))
    ask = rest.where("stray").select("bucket", "node", "component", "stray", F.lit(True).alias("asks"), own("is").alias("i"), every("js").alias("j"))
    return answer.unionByName(ask)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, set_id and text_hash of every row of docs."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "neardup")
    every = scratch.save(sketches(docs, k, bands, rows), "sketches")
    whole = every.where("doc_id IS NOT NULL AND n > 0")
    nodes = whole.groupBy("set_id").agg(F.min(F.struct("doc_id", "text_hash", "n", "bands")).alias("r"))
    nodes = scratch.save(nodes.select(F.monotonically_increasing_id().alias("node"), "set_id", "r.*"), "nodes")
    at = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = at.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("c"), F.count("*").alias("members")).where("members > 1")
    members = scratch.save(at.join(shared.select("bucket", F.col("c.node").alias("center"), F.col("c.n").alias("n_center")), "bucket"), "members")
    involved = nodes.join(members.select("node").distinct(), "node").select("node", "doc_id", "text_hash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_hash", text_hash()).join(involved, ["doc_id", "text_hash"])
    sets = scratch.save(full_sets(texts, k), "sets")
    star = members.where("node <> center").select(F.col("node").alias("a"), F.col("center").alias("b"), F.col("n").alias("n_a"), F.col("n_center").alias("n_b"))
    links = scratch.save(confirmed(star, sets, percent), "links")
    found = components(links, scratch, "first")
    rest = strays_and_members(members, found).join(_once(sets), "node").join(nodes.select("node", "n", "bands"), "node")
    more = rest.groupBy("bucket", "i", "j").applyInArrow(lambda t: block_links(t, percent), "a long, b long")
    more = scratch.save(more.distinct(), "more")
    final = nodes.select("set_id", "doc_id", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if more.limit(1).count():  # the components that the second step joins
        label = final.select("node", "component")
        across = more.join(label.toDF("a", "x"), "a").join(label.toDF("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        joined = components(across, scratch, "second").toDF("component", "lowest")
        final = final.join(joined, "component", "left").withColumn("component", F.coalesce("lowest", "component"))
    final = scratch.save(final.select("set_id", "doc_id", "component"), "final")
    first = final.groupBy("component").agg(F.min("doc_id").alias("first"), F.count("*").alias("m")).where("m > 1").drop("m")
    named = scratch.save(final.join(first, "component", "left").select("set_id", F.coalesce("first", "doc_id").alias("component_id")), "named")
    for name in ("nodes", "members", "sets", "links", "more", "final"):
        scratch.drop(name)
    linked = every.join(named, "set_id", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), "doc_id")))
    return linked.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "set_id", "text_hash")
