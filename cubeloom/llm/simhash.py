"""Near-duplicate documents by SimHash: fingerprints that differ in few bits are linked.

A fingerprint bit is set if it is set in over half of the XXH64 of a text's word shingles, repeats
included. Equal fingerprints are one node, however many documents have them.

Candidates: 64 bits are four quarters, and two fingerprints within RADIUS = 2 bits agree in two whole
quarters, so that each node goes to the six buckets of its pairs of quarters and no link is missed.
A bucket's nodes are dealt to blocks of about BLOCK by their hash; each pair of blocks is one task's row.

Comparison is bit-sliced. A block stores bit planes: word j of plane p holds bit p of fingerprints
64 j to 64 j + 63. A query's bit turns a plane into the places that differ from it, and carry-save
counters (ones, twos, and a mark for more) add that plane to 64 distances at a time. After every few
planes the queries whose whole block is beyond the radius are abandoned. Of a block's links only those
that join nodes which weren't yet joined in that task leave it; components are then found by star
contractions.

Defined results: a null or empty text, and one without words, has the fingerprint zero and is linked
like any other. Rows with a null doc_id have a fingerprint, are linked with nothing and have a null
component. Repeated rows are alike; rows that share a doc_id each go by their own text, and a text's
smallest doc_id names its component. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

RADIUS, SHINGLE, SEED = 2, 3, 42
#: Fingerprints in a block, queries compared at a time, planes between two looks at what is left, and hashes counted at a time.
BLOCK, QUERIES, PLANES, COUNTED = 8_192, 512, 8, 1 << 16
QUARTERS = [(a, b) for a in range(4) for b in range(a + 1, 4)]
_ALL = np.uint64(2**64 - 1)


def shingle_hashes(text: bytes, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """XXH64 of each shingle of k words, in pieces."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    n = max(len(words) - k + 1, min(len(words), 1))
    for lo in range(0, n, COUNTED):
        here = range(lo, min(lo + COUNTED, n))
        yield np.fromiter((xxh64_intdigest(b" ".join(words[i : i + k]), SEED) for i in here), np.uint64, len(here))


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    ones, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, k):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.int64)
        n += len(hashes)
    return int((np.uint64(1) << np.flatnonzero(2 * ones > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (64 bits as a long) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", k) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, "doc_id long, fingerprint long")


def planes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of fingerprints, 64 by words, and the places of the last word that hold one."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    shift = np.arange(64, dtype=np.uint64)
    bits = (padded.reshape(-1, 1, 64) >> shift[:, None]) & np.uint64(1)  # word, plane, place
    held = np.full(len(padded) // 64, _ALL)
    if len(values) % 64:
        held[-1] = (np.uint64(1) << np.uint64(len(values) % 64)) - np.uint64(1)
    return np.ascontiguousarray((bits << shift).sum(2, dtype=np.uint64).T), held


def within(queries: np.ndarray, sliced: tuple[np.ndarray, np.ndarray], radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Places of queries and of the block's fingerprints that differ in at most ``radius`` bits (0 to 3)."""
    plane, held = sliced
    left = np.arange(len(queries))
    ones = np.zeros((len(queries), plane.shape[1]), np.uint64)
    twos, far = np.zeros_like(ones), np.broadcast_to(~held, ones.shape).copy()
    for p in range(64):
        differ = plane[p] ^ np.where(queries[left] >> np.uint64(p) & np.uint64(1), _ALL, np.uint64(0))[:, None]
        carry = ones & differ
        ones ^= differ
        far |= twos & carry
        twos ^= carry
        if p % PLANES == PLANES - 1:
            beyond = far | {0: ones | twos, 1: twos, 2: ones & twos, 3: np.uint64(0)}[radius]
            live = (beyond != _ALL).any(1)
            if not live.all():
                left, ones, twos, far = left[live], ones[live], twos[live], far[live]
            if not len(left):
                return left, left
    near = ~(far | {0: ones | twos, 1: twos, 2: ones & twos, 3: np.uint64(0)}[radius])
    row, word = np.nonzero(near)
    bit = np.unpackbits(near[row, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    of, place = np.nonzero(bit)
    return left[row[of]], word[of] * 64 + place


def block_links(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (places in a and b joined) of a block with itself, or with another, that join what wasn't joined."""
    every = a if b is None else np.concatenate([a, b])
    sliced, shift = planes(a if b is None else b), 0 if b is None else len(a)
    group, links = np.arange(len(every)), []
    for lo in range(0, len(a), QUERIES):
        x, y = within(a[lo : lo + QUERIES], sliced, radius)
        x, y = x + lo, y + shift
        while len(x):
            apart = group[x] != group[y]
            x, y = x[apart], y[apart]
            if not len(x):
                break
            # For each group the first of its links to a smaller group; each step at least halves the groups that have one.
            high, low = np.maximum(group[x], group[y]), np.minimum(group[x], group[y])
            names, first = np.unique(high, return_index=True)
            links += zip(x[first].tolist(), y[first].tolist())
            to = np.arange(len(every))
            to[names] = low[first]
            while (to != to[to]).any():
                to = to[to]
            group = to[group]
    return links


def near_pairs(nodes: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Links a, b between nodes (fingerprint) that suffice for the components."""
    quarter = lambda q: F.shiftrightunsigned("fingerprint", 16 * q).bitwiseAND(F.lit(0xFFFF).cast("long"))
    keys = [F.lit(i << 32).cast("long") + quarter(a) * 65536 + quarter(b) for i, (a, b) in enumerate(QUARTERS)]
    at = nodes.select("fingerprint", F.explode(F.array(*keys)).alias("bucket"))
    count = at.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    blocks = count.select("bucket", F.ceil(F.col("members") / F.lit(block)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fingerprint"), "blocks").cast("int")
    dealt = at.join(blocks, "bucket").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("asks"), "fingerprint")
    rows = dealt.groupBy("bucket", "i", "j").agg(F.collect_list(F.when(F.col("asks"), F.col("fingerprint"))).alias("a"), F.collect_list(F.when(~F.col("asks"), F.col("fingerprint"))).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for a, b, same in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
                a, b = (np.asarray(x.values, np.int64).view(np.uint64) for x in (a, b))
                if not len(a) or not (same or len(b)):
                    continue
                if same and len(a) == 2:  # most buckets
                    links = [(0, 1)] if int(a[0] ^ a[1]).bit_count() <= radius else []
                else:
                    links = block_links(a, None if same else b, radius)
                every = (a if same else np.concatenate([a, b])).view(np.int64)
                left += [int(every[x]) for x, _ in links]
                right += [int(every[y]) for _, y in links]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return rows.select("a", "b", (F.col("i") == F.col("j")).alias("same")).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of docs. radius is 0, 1 or 2, which the buckets are made for."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"buckets of two quarters hold links of at most {RADIUS} bits")
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    every = scratch.save(fingerprints(docs, k), "fingerprints")
    nodes = scratch.save(every.where("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "nodes")
    links = scratch.save(near_pairs(nodes, radius, block), "links")
    found = components(links, scratch).toDF("fingerprint", "component")
    named = nodes.join(found, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    named = scratch.save(named, "named")
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = scratch.save(named.join(lowest, "component").select("fingerprint", "component_id"), "lowest")
    for name in ("nodes", "links", "named"):
        scratch.drop(name)
    out = every.join(named, "fingerprint", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
