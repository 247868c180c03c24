"""Keyed shuffles: permutations, their evenness, and what is built on them."""

import random

import pytest
from pyspark.sql import functions as F

from cubeloom.operators import mixture as M


def places(spark, n, seed):
    return [r.p for r in spark.range(n).select("id", M.permuted(F.col("id"), n, seed).alias("p")).orderBy("id").collect()]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 7, 9, 10, 16, 17, 99, 1000, 44_490])
def test_every_place_once(spark, n):
    for seed in (0, 7):
        assert sorted(places(spark, n, seed)) == list(range(n))


def correlation(a, b):
    n = len(a)
    mean = (n - 1) / 2
    return sum((x - mean) * (y - mean) for x, y in zip(a, b)) / sum((x - mean) ** 2 for x in a)


def test_seeds_are_unrelated(spark):
    n = 4000
    found = [places(spark, n, seed) for seed in (7, 8, 99)]
    for i, a in enumerate(found):
        assert abs(correlation(a, list(range(n)))) < 0.06
        for b in found[:i]:
            assert abs(correlation(a, b)) < 0.06
            assert sum((x - y) % n == (a[0] - b[0]) % n for x, y in zip(a, b)) < 20  # no rotation


def test_even(spark):
    """Where rows end up by tenths, and how neighbours part, by chi squared."""
    n, cells = 20_000, 10
    p = places(spark, n, 3)
    for values in ([(i * cells // n, x * cells // n) for i, x in enumerate(p)], [(x * cells // n, y * cells // n) for x, y in zip(p, p[1:])]):
        counts = [[0] * cells for _ in range(cells)]
        for a, b in values:
            counts[a][b] += 1
        expected = len(values) / cells**2
        chi = sum((c - expected) ** 2 / expected for row in counts for c in row)
        assert 40 < chi < 180, chi  # 81 degrees of freedom, or 99


def test_large_numbers(spark):
    total = 10**12
    rows = [random.Random(1).randrange(total) for _ in range(2000)]
    got = [r.p for r in spark.createDataFrame([(x,) for x in rows], "x long").select(M.permuted(F.col("x"), total, 5).alias("p")).collect()]
    assert all(0 <= x < total for x in got) and len(set(got)) == len(set(rows))


def test_shuffle_by_a_key_of_letters_in_groups(spark):
    df = spark.createDataFrame([(g, f"k{i}") for g, n in (("a", 50), ("b", 1), (None, 3)) for i in range(n)], "g string, key string")
    rows = M.shuffled(df.where("g IS NOT NULL"), "key", 4, by=("g",)).collect()
    assert sorted((r.g, r.position) for r in rows) == [("a", i) for i in range(50)] + [("b", 0)]
    assert sorted(r.position for r in M.shuffled(df, "key", 4).collect()) == list(range(54))


@pytest.mark.parametrize("n, m", [(10, 3), (3, 10), (5, 5), (0, 4), (4, 0), (1, 7)])
def test_interleave_of_shuffles(spark, n, m):
    a, b = (spark.createDataFrame([(f"{k}{i:02d}",) for i in range(c)], "key string") for k, c in (("a", n), ("b", m)))
    rows = sorted(M.shuffled_interleave(a, b, "key", 3).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(n + m)) and len({r.key for r in rows}) == n + m
    # Each bucket has an even part of either side, the first side's before the second's.
    k = max(1, min(n, m))
    sides = [r.key[0] for r in rows]
    want = [s for i in range(k) for s in "a" * (n // k + (i < n % k)) + "b" * (m // k + (i < m % k))]
    assert sides == want


def test_routes(spark):
    paths = ["x/ego4d_1fps512frames_a/f/rows.jsonl", "video_data/a.jsonl", "b/tsv_data.json", "Video_data/x", "image/llava.json"]
    df = spark.createDataFrame([(p, "v.mp4") for p in paths], "p string, v string")
    got = df.select(M.route(F.col("p")), M.routed_video(F.col("v"), F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("video", "f/v.mp4"), ("video", "v.mp4"), ("video", "v.mp4"), ("image", "v.mp4"), ("image", "v.mp4")]
