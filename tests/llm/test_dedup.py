"""Line dedup and near duplicates."""

import hashlib
import itertools
import random
from collections import defaultdict

import pytest
from compare import assert_same
from helpers import DOCS, edge_docs, edge_rows, edited, lower, prose, words_of
from pyspark.sql import functions as F

from cubeloom.llm import linededup, neardup, queries
from cubeloom.llm.common import Scratch
from cubeloom.llm.components import components


def brute_lines(rows):
    """(n_lines, n_dropped, text) of each row."""
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for i, text in rows:
        if i is not None:
            for line in (text or "").split("\n"):
                held[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if i is None or len(key(x)) < 10 or min(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def test_lines_on_edges(spark):
    rows = [(r[0], r[1]) for r in edge_rows()] + [(500, "shared line of words"), (501, "shared line of words\nShared Line of words\n\nshort\nshort"), (502, "\tshared line of words\x0b\nown line of this one")]
    rows += [(i, "a line that all hold\n" * (i % 3) + f"line number {i} here") for i in range(600, 700)] + [(700, "first text of an id\nshared line of words"), (700, "second text of an id\nfirst text of an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash")).withColumn("hash", F.lit(1))
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in linededup.dedup_lines(df).collect()), key=str)
    assert got == brute_lines(rows)
    assert linededup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def test_lines_query(spark, sf_dir, duck):
    assert_same(queries.op8_line_dedup(spark, sf_dir), duck, queries.ORACLE["op8_line_dedup"])


def brute_near(rows, k, percent=80):
    def shingles(text):
        w = words_of(lower(text or ""))
        return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()

    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def check_near(spark, rows, k=2):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bands", F.lit("clash")).repartition(3)
    got = neardup.near_duplicates(df, k).collect()
    assert len(got) == len(rows)
    want = brute_near(rows, k)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
            assert r.kept == (r.doc_id == r.component_id)


def test_near_on_edges(spark):
    check_near(spark, [(r[0], r[1]) for r in edge_rows()])
    check_near(spark, [(r[0], r[1]) for r in edge_rows()], k=5)


def test_near_small_sets_and_chains(spark):
    r, rows = random.Random(3), []
    for g in range(12):  # chains: each text a little further from the first
        text = prose(60, 100 + g)
        for step in range(6):
            rows.append((len(rows), text))
            text = edited(text, 2, 1000 + 10 * g + step)
    for g in range(40):  # sets of a few shingles
        w = prose(7, 300 + g).split()
        rows += [(len(rows) + i, " ".join(w[: 7 - i])) for i in range(3)]
    r.shuffle(rows)
    check_near(spark, [(i, t) for i, (_, t) in enumerate(rows)])


def test_near_large_group_with_strays(spark):
    """A group of copies where many are too far from the bucket's star, so that the second step has to find their links."""
    base = prose(100, 55)
    rows = [(i, edited(base, i % 14, 7000 + i)) for i in range(150)]
    check_near(spark, rows)


def test_near_repeated_rows(spark):
    """Two similar documents, each many times, are two sets; rows of one id are judged each by their own text."""
    a = prose(100, 70)
    texts = [a, edited(a, 3, 71), a.upper()]
    rows = [(i, texts[i]) for i in range(2) for _ in range(2000)] + [(2, texts[2])]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert len(got) == 4001 and all(r.component_id == 0 and r.kept == (r.doc_id == 0) for r in got)
    b, c = prose(100, 72), prose(100, 73)
    rows = [(5, a), (3, texts[1]), (5, b), (5, c), (9, edited(c, 2, 74)), (9, b), (None, a)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    by_set = {(r.doc_id, r.text_hash): (r.component_id, r.kept) for r in got}
    assert len(by_set) == 7 and sorted(by_set.values(), key=str) == sorted([(3, False), (3, True), (5, True), (5, True), (5, False), (5, False), (None, True)], key=str)


def test_near_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_MEMBERS", 20)
    monkeypatch.setattr(neardup, "STAR_MEMBERS", 7)
    base = prose(100, 56)
    check_near(spark, [(i, edited(base, i % 14, 8000 + i)) for i in range(120)])


def test_near_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = brute_near(rows, 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op4_minhash(spark, sf_dir).collect()} == want
    assert neardup.near_duplicates(spark.createDataFrame([], DOCS), 2).count() == 0


def test_components(spark):
    r = random.Random(9)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def root(i):
        parent.setdefault(i, i)
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert got == {i: root(i) for i in parent if root(i) != i}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("n", [10, 12])
def test_words_that_hashes_confuse_are_told_apart(spark, n):
    """Thue-Morse words and their complements, whose sums of powers of any odd number are equal modulo 2**64."""
    bits = [i.bit_count() % 2 for i in range(2**n)]
    a, b = ("".join("ab"[x ^ flip] for x in bits) for flip in (0, 1))
    docs = spark.createDataFrame([(1, f"{a} {a}", "", "", 0), (2, f"{b} {b}", "", "", 0), (3, f"{b}  {b}\n", "", "", 0)], DOCS)
    got = {r.doc_id: (r.component_id, r.kept) for r in neardup.near_duplicates(docs, k=2).collect()}
    assert got == {1: (1, True), 2: (2, True), 3: (2, False)}
