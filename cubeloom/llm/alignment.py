"""Alignment of two tokenizers: byte-level BPE (A) and a piece model (B) over the same text.

Both read a space and the text. Byte offsets where an A token and a B token end cut the text into
groups; in a group every A token is linked with every B token. An id pair's count is the number of
documents that hold it linked.

Slices of documents are encoded and aligned together, as arrays: token ends are running sums of
token sizes, groups end where both have one, and links are index arithmetic on groups. Long texts are
cut before a space that follows a character other than white space; no match of A's pattern and no
piece of B spans such a place (the vocabulary is searched for one that would).

Method: postings, cogrouped. Each document's distinct pairs and how often it has them become postings
by A id: one row for an A id and a slice of documents. Counts of pairs are added up before they are
shuffled; an A id's counts are at most B's vocabulary. Counts and postings are then dealt by A id to
GROUPS groups, and by slices of documents to as many shares that a group's share has about SPLIT
postings, each with the group's counts, and sorted, counts first: one pass over a sorted stream, which
Spark spills, holds the counts of one A id and adds to the sums of the share's documents. A document
so has a partial sum from each group, however many tasks there are; these are summed.

Defined results: a null or empty text, and one whose tokens don't give a space and the text again
(such as one with U+2581), has no tokens, zeros and an empty digest. Each row is a document of its
own, so that repeated rows and equal or null doc_ids each count. Strings of special tokens are plain
text. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .wordbpe import byte_letters

#: Documents in a slice, and their characters; characters of a part of a long text; links that are expanded at once.
SLICE, SLICE_CHARS, PART, EXPANDED = 1_024, 3_000_000, 200_000, 4_000_000
#: Groups of A ids, and postings in a group's share.
GROUPS, SPLIT = 16, 16_000_000
#: A place before a space where a long text may be cut.
_CUT = re.compile(r"[^\s▁](?= [^ ])")
#: Characters that all versions of Unicode's tables see alike; texts with others are encoded by the tokenizer's own library.
_KNOWN = re.compile(r"[\x00-\u052f\u2000-\u2064\u3000-\u30ff\u4e00-\u9fa5\uac00-\ud7a3]*")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[tuple[str, str], "Tokenizers"] = {}


class Side:
    """What a tokenizer's ids stand for: their bytes, sizes, and their numbers followed by a comma or by the side's own end."""

    def __init__(self, known: dict[int, bytes], end: str):
        n = max(known) + 1
        self.bytes = np.array([known.get(i, b"") for i in range(n)], object)
        self.sizes = np.array([len(x) for x in self.bytes], np.int64)
        self.inner, self.last = (np.array([f"{i}{c}" for i in range(n)], object) for c in (",", end))


class Tokenizers:
    """Both tokenizers. A's merges are done by tiktoken's core where its vocabulary's ids are in the order of the merges, which comes to the same."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path_a)
        self.whole.encode_special_tokens = True
        with open(path_a, encoding="utf-8") as f:
            file = json.load(f)
        vocabulary, special = file["model"]["vocab"], {t["content"] for t in file["added_tokens"]}
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        made = [vocabulary[x + y] for x, y in (m if isinstance(m, list) else m.split(" ") for m in file["model"]["merges"])]
        own = file["pre_tokenizer"]
        ordered = made == sorted(set(made)) and len(made) + 256 == len(ranks) and own["type"] == "ByteLevel" and own["use_regex"] and not own["add_prefix_space"] and not file["normalizer"]
        self.fast = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={}) if ordered else None
        self.a = Side({i: token for token, i in ranks.items()}, "|")
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=path_b)
        listed = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.b = Side({i: bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) and self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(listed)}, ";")
        #: Whether no piece goes on over a space, so that parts of a text are independent.
        self.apart = not any("▁" in p.lstrip("▁") for p in listed)

    def parts(self, text: str, size: int = PART) -> list[str]:
        """A space and the text, cut in parts that begin with a space."""
        text, out, lo = " " + text, [], 0
        while self.apart and len(text) - lo > size and (cut := _CUT.search(text, lo + size)):
            out.append(text[lo : cut.end()])
            lo = cut.end()
        return [*out, text[lo:]]

    def ids_a(self, part: str) -> list[int]:
        if self.fast is not None and _KNOWN.fullmatch(part):
            return self.fast.encode_ordinary(part)
        return self.whole.encode(part, add_special_tokens=False).ids


def load(path_a: str, path_b: str) -> Tokenizers:
    """Both tokenizers, once in each Python worker."""
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Tokenizers(path_a, path_b)
    return _loaded[path_a, path_b]


def _encoded_texts(texts: list[str], own: Tokenizers) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Ids of each text by both, none where they don't give the text again."""
    parts = [own.parts(t) if t else [] for t in texts]
    ids_b = iter(own.pieces.encode([p[1:] for listed in parts for p in listed], num_threads=1))
    a, b = [], []
    for text, listed in zip(texts, parts):
        x = np.array([i for p in listed for i in own.ids_a(p)], np.int64)
        y = np.array([i for _ in listed for i in next(ids_b)], np.int64)
        whole = (" " + text).encode()
        if own.a.sizes[x].sum() != len(whole) or b"".join(own.b.bytes[y]) != whole:
            x = y = x[:0]
        a.append(x)
        b.append(y)
    return a, b


def _distinct(doc: np.ndarray, a: np.ndarray, b: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Distinct (document, A id, B id) in order of A id, B id and document, and how often."""
    order = np.lexsort((doc, b, a))
    doc, a, b = doc[order], a[order], b[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(doc) else np.zeros(0, np.int64)
    sums = np.diff(np.append(new, len(doc))) if times is None else np.add.reduceat(times[order], new) if len(new) else new
    return doc[new], a[new], b[new], sums


def aligned(texts: list[str], own: Tokenizers) -> tuple[list[list], tuple[np.ndarray, ...]]:
    """n_a, n_b, n_groups, n_links and groups_sha256 of each text; and all distinct pairs: text's place, A id, B id, times."""
    lists_a, lists_b = _encoded_texts(texts, own)
    a, b = np.concatenate(lists_a), np.concatenate(lists_b)
    first_a, first_b = (np.concatenate([[0], np.cumsum([len(x) for x in lists])]) for lists in (lists_a, lists_b))
    ends_a, ends_b = np.cumsum(own.a.sizes[a]), np.cumsum(own.b.sizes[b])
    cuts = ends_a[np.isin(ends_a, ends_b, assume_unique=True)]
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    p, q = np.bincount(group_a, minlength=len(cuts)), np.bincount(group_b, minlength=len(cuts))
    start_b = np.concatenate([[0], np.cumsum(q)])[:-1]
    # Groups as text: numbers in order, each with what follows it.
    last_a = np.append(group_a[1:] != group_a[:-1], True)[: len(a)]
    last_b = np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
    listed = np.empty(len(a) + len(b), object)
    listed[np.arange(len(a)) + start_b[group_a]] = np.where(last_a, own.a.last[a], own.a.inner[a])
    listed[np.arange(len(b)) + np.cumsum(p)[group_b]] = np.where(last_b, own.b.last[b], own.b.inner[b])
    bounds = np.searchsorted(group_a, np.arange(len(cuts)))
    links = np.concatenate([[0], np.cumsum(p * q)])
    counts, found = [], []
    for k in range(len(texts)):
        lo, hi, lo_b, hi_b = first_a[k], first_a[k + 1], first_b[k], first_b[k + 1]
        if lo == hi:
            counts.append([0, 0, 0, 0, ""])
            continue
        groups = (int(group_a[lo]), int(group_a[hi - 1]) + 1)
        text = "".join(listed[lo + lo_b : hi + hi_b])[:-1]
        counts.append([int(hi - lo), int(hi_b - lo_b), groups[1] - groups[0], int(links[groups[1]] - links[groups[0]]), hashlib.sha256(text.encode()).hexdigest()])
    of = np.repeat(np.arange(len(texts)), np.diff(first_a))
    # Groups whose tokens are expanded to links, and large ones, whose distinct ids are paired instead.
    large = p * q > EXPANDED // 64
    for lo, hi in _spans(np.where(large, 0, p * q)):
        some = slice(int(bounds[lo]), int(bounds[hi]) if hi < len(cuts) else len(a))
        g = group_a[some]
        n = np.where(large[g], 0, q[g])
        ends = np.cumsum(n)
        at = np.repeat(start_b[g] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        found.append(_distinct(np.repeat(of[some], n), np.repeat(a[some], n), b[at]))
    for g in np.flatnonzero(large).tolist():
        lo = int(bounds[g])
        (x, m), (y, n) = (np.unique(v, return_counts=True) for v in (a[lo : lo + p[g]], b[start_b[g] : start_b[g] + q[g]]))
        found.append((np.full(len(x) * len(y), of[lo]), np.repeat(x, len(y)), np.tile(y, len(x)), np.outer(m, n).ravel()))
    if not found:
        return counts, _distinct(*[np.zeros(0, np.int64)] * 3)
    return counts, found[0] if len(found) == 1 else _distinct(*map(np.concatenate, zip(*found)))


def _spans(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of groups with about EXPANDED links each."""
    ends, lo = np.cumsum(sizes), 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + EXPANDED, "right")))
        yield lo, hi
        lo = hi


_ENCODED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a int, offsets array<int>, b array<int>, times array<long>"


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each document (a is null), and rows of postings: an A id and, for documents row + offset in order of b, the pair's B id and times."""
    kinds = [pa.int64()] * 6 + [pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
    names = [c.split()[0] for c in _ENCODED.split(", ")]

    def flushed(held: list[tuple], own: Tokenizers) -> Iterator[pa.RecordBatch]:
        n = len(held)
        ids, texts = [(row, doc) for row, doc, _ in held], [t for _, _, t in held]
        counts, (doc, a, b, times) = aligned(texts, own)
        columns = [pa.array(c, t) for c, t in zip(zip(*[(*x, *y) for x, y in zip(ids, counts)]), kinds)]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.nulls(n, t) for t in kinds[7:])], names)
        if not len(a):
            return
        starts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        offsets = pa.array(np.append(starts, len(a)).astype(np.int32))
        rows = np.array([row for row, _ in ids], np.int64)
        base = int(rows.min())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in ((rows[doc] - base).astype(np.int32), b.astype(np.int32), times.astype(np.int64))]
        k = len(starts)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, base)), *(pa.nulls(k, t) for t in kinds[1:7]), pa.array(a[starts].astype(np.int32)), *lists], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(path_a, path_b)
        held, size = [], 0
        for batch in batches:
            for row, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                held.append((row, doc, text.as_py() or ""))
                size += len(held[-1][2])
                if len(held) >= SLICE or size >= SLICE_CHARS:
                    yield from flushed(held, own)
                    held, size = [], 0
        if held:
            yield from flushed(held, own)

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(run, _ENCODED)


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What sorted postings add to each document of a share: grp, share, a, row, offsets, b, times; counts of an A id come first, with a null row and counts as times."""
    share = now = ids = counts = None
    best: dict[int, np.ndarray] = {}
    total: dict[int, np.ndarray] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for base in list(total):
            x, y = best.pop(base), total.pop(base)
            at = np.flatnonzero(y)
            yield pa.RecordBatch.from_arrays([pa.array(at + base), pa.array(x[at]), pa.array(y[at])], ["row", "n_best", "count_sum"])

    for batch in batches:
        shares = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        heads = batch.column(2).to_pylist()
        base = batch.column(3)
        is_count = np.asarray(base.is_null())
        base = np.asarray(base.fill_null(0))
        edge, flat = ({n: np.asarray(f(batch.column(i))) for i, n in ((4, "offsets"), (5, "b"), (6, "times"))} for f in (lambda c: c.offsets, lambda c: c.values))
        i = 0
        while i < len(heads):
            if shares[i] != share:
                yield from flushed()
                share = shares[i]
            if is_count[i]:
                now = (share, heads[i])
                ids, counts = (flat[c][edge[c][i] : edge[c][i + 1]] for c in ("b", "times"))
                order = np.argsort(ids)
                ids, counts = ids[order], counts[order]
                i += 1
                continue
            if (share, heads[i]) != now:
                raise ValueError("postings without their counts")
            j = i + 1
            while j < len(heads) and shares[j] == share and heads[j] == heads[i] and not is_count[j]:
                j += 1
            lo, hi = edge["b"][i], edge["b"][j]
            count, times, offsets = counts[np.searchsorted(ids, flat["b"][lo:hi])], flat["times"][edge["times"][i] : edge["times"][j]], flat["offsets"][edge["offsets"][i] : edge["offsets"][j]]
            top = np.where(count == counts.max(), times, 0)
            sums = times * count
            for k in range(i, j):
                own = slice(edge["b"][k] - lo, edge["b"][k + 1] - lo)
                key, size = int(base[k]), int(offsets[own].max()) + 1
                if key not in total or len(total[key]) < size:
                    for held in (best, total):
                        held[key] = np.concatenate([held.get(key, np.zeros(0, np.int64)), np.zeros(max(SLICE, size) - len(held.get(key, ())), np.int64)])
                np.add.at(best[key], offsets[own], top[own])
                np.add.at(total[key], offsets[own], sums[own])
            i = j
    yield from flushed()


def align(docs: DataFrame, path_a: str, path_b: str, split: int = SPLIT, groups: int = GROUPS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row of docs."""
    scratch = scratch or Scratch(docs.sparkSession, "align")
    every = scratch.save(encoded(docs, path_a, path_b), "encoded")
    postings = every.where("a IS NOT NULL").select("a", "row", "offsets", "b", "times")
    counts = postings.select("a", F.explode("b").alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    listed = counts.groupBy("a").agg(F.sum("n").alias("postings"), F.collect_list("b").alias("b"), F.collect_list("n").alias("times"))
    group = F.pmod(F.xxhash64("a"), F.lit(groups)).cast("int").alias("grp")
    listed = scratch.save(listed.withColumn("grp", group), "counts")
    most = listed.groupBy("grp").agg(F.sum("postings").alias("n")).agg(F.max("n")).first()[0] or 0
    shares = -(-most // split) or 1
    each = listed.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    first = each.select("grp", "share", "a", F.lit(None).cast("long").alias("row"), F.expr("transform(b, x -> 0)").alias("offsets"), "b", "times")
    dealt = postings.select(group, F.pmod(F.xxhash64("row"), F.lit(shares)).cast("int").alias("share"), "a", "row", "offsets", "b", "times")
    stream = first.unionByName(dealt).repartition(4 * groups * shares, "grp", "share")
    stream = stream.sortWithinPartitions("grp", "share", "a", F.col("row").asc_nulls_first())
    sums = stream.mapInArrow(_contributions, "row long, n_best long, count_sum long").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = every.where("a IS NULL").join(sums, "row", "left")
    none = F.lit(0).cast("long")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
