"""Scans, selection and merged states with one key that holds most rows, cut in many runs."""

import math
import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from cubeloom.operators import scan, segments


@pytest.fixture
def short_runs(spark):
    """Runs of at most 7 rows, so that keys go on over many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")
    yield
    spark.conf.set(name, before)


def skewed(seed=1, n=400, hot=0.9):
    r = random.Random(seed)
    sizes = {"hot": int(n * hot), "a": 1, "b": 2, "c": 3, None: 5, "d": n - int(n * hot)}
    return [(k, i, r.choice([r.uniform(-5, 5), 1.5])) for k, size in sizes.items() for i in range(size)]


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, i long, x double").repartition(5)


def by_key(rows):
    out = {}
    for k, i, x in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        out.setdefault(k, []).append((i, x))
    return out


@pytest.mark.parametrize("rate", [0.8, 0.1, 1.0])
def test_momentum_over_many_runs(spark, short_runs, rate):
    rows = skewed()
    want = {}
    for k, listed in by_key(rows).items():
        m = None
        for t, (i, x) in enumerate(listed):
            d = x - listed[t - 1][1] if t else None
            m = None if t == 0 else d if t == 1 else rate * d + (1 - rate) * m
            want[k, i] = m
    got = {(r.k, r.i): (r.x, r.m) for r in scan.momentum(table(spark, rows), "k", ["i"], "x", rate=rate).collect()}
    assert got.keys() == want.keys()
    assert all((got[p][1] is None) == (want[p] is None) and (want[p] is None or got[p][1] == pytest.approx(want[p], abs=1e-9)) for p in want)
    assert {p: v[0] for p, v in got.items()} == {(k, i): x for k, i, x in rows}


def test_running_sums_over_many_runs(spark, short_runs):
    rows = skewed(2)
    got = {(r.k, r.i): (r.n, r.s) for r in scan.running(table(spark, rows), "k", ["i"], n=F.lit(1), s=F.floor("x")).collect()}
    want = {}
    for k, listed in by_key(rows).items():
        for (i, _), n, s in zip(listed, accumulate(1 for _ in listed), accumulate(math.floor(x) for _, x in listed)):
            want[k, i] = (n, s)
    assert got == want
    assert scan.running(table(spark, []), "k", ["i"], n=F.lit(1)).count() == 0 and scan.momentum(table(spark, []), "k", ["i"], "x").count() == 0


def test_segments_and_runs_over_many_runs(spark, short_runs):
    rows = [r for r in skewed(3) if r[0] is not None]
    df = table(spark, rows).withColumn("f", (F.col("x") > 2).cast("int"))
    segs, hits = set(), set()
    for k, listed in by_key(rows).items():
        cuts = [t for t, (_, x) in enumerate(listed) if t == 0 or x > 2] + [len(listed)]
        segs |= {(k, a, b) for a, b in zip(cuts, cuts[1:])}
        start = None
        for t, x in enumerate([x for _, x in listed] + [0]):
            if x > 1 and start is None:
                start = t
            elif not x > 1 and start is not None:
                hits.add((k, start, t))
                start = None
    assert {(r.k, r.start, r.stop) for r in segments.flags_to_segments(df, "k", ["i"], "f").collect()} == segs
    assert {(r.k, r.start, r.stop) for r in segments.label_runs(df, "k", ["i"], F.col("x") > 1).collect()} == hits


@pytest.mark.parametrize("first", [True, False])
@pytest.mark.parametrize("kind", ["spread", "ties", "equal", "nulls", "wild"])
def test_selection_gives_the_ranking(spark, short_runs, kind, first):
    r = random.Random(kind)
    value = {"spread": lambda: r.gauss(0, 1), "ties": lambda: float(r.randrange(4)), "equal": lambda: 2.5, "nulls": lambda: r.choice([None, None, None, r.random()]), "wild": lambda: r.choice([1e308, -1e308, 1e-300, r.random(), r.random() * 1e-9])}[kind]
    rows = [(k, i, value()) for k, n in (("hot", 700), ("b", 3), ("c", 40)) for i in range(n)]
    df = table(spark, rows)
    want = segments.top_boundaries(df, "k", ["i"], "x", first=first)
    got = segments.top_boundaries(df, "k", ["i"], "x", ranked=5, first=first)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    n = {k: len(v) for k, v in by_key([(k, i, 0) for k, i, _ in rows]).items()}
    for k, listed in by_key([(a, i, -math.inf if x is None else x) for a, i, x in rows]).items():
        top = max(round(n[k] / 5) - 1, 1)
        taken = {i for i, x in sorted(listed, key=lambda p: (-p[1], p[0]))[:top] if x != -math.inf} | ({0} if first else set())
        assert {x.i for x in want.where(F.col("k") == k).where("flag = 1").collect()} == taken


def states(values):
    m = max(x for x, _ in values)
    return (m, sum(math.exp(x - m) for x, _ in values), sum(math.exp(x - m) * y for x, y in values))


def test_softmax_states_merge_in_any_order(spark):
    r = random.Random(4)
    parts = [[(r.uniform(-700, 700), r.random()) for _ in range(4)] for _ in range(3)]
    kind = "struct<m: double, e: double, v: double>"
    df = spark.createDataFrame([tuple(map(states, parts))], f"a {kind}, b {kind}, c {kind}")
    merge = segments.merged_softmax
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    row = df.select(merge(merge(a, b), c).alias("l"), merge(a, merge(b, c)).alias("r"), merge(c, merge(b, a)).alias("s")).first()
    want = states([x for p in parts for x in p])
    for got in row:
        assert tuple(got) == pytest.approx(want, rel=1e-12)


def test_softmax_of_a_hot_key_in_one_scan(spark, short_runs):
    rows = skewed(5)
    df = table(spark, rows)
    out = segments.online_softmax(df, ["k"], "x", "i")
    for r in out.collect():
        m, e, v = states([(x, i) for k, i, x in rows if k == r.k])
        assert r.out == pytest.approx(v / e) and r.lse == pytest.approx(m + math.log(e))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    assert segments.online_softmax(table(spark, []), ["k"], "x", "i").count() == 0


def test_uniform_noise(spark):
    rows = [r.u for r in spark.range(4000).select(segments.uniform(3, F.col("id"), F.lit(1)).alias("u")).collect()]
    assert all(0 < u < 1 for u in rows) and abs(sum(rows) / 4000 - 0.5) < 0.02
    noise = [r.g for r in spark.range(4000).select(segments.gumbel(3, F.col("id")).alias("g")).collect()]
    assert abs(sum(noise) / 4000 - 0.5772) < 0.08
