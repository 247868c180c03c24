"""Order-dependent operators against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cubeloom.operators import convert, joins, segments
from cubeloom.operators.tokens import merge_placeholders


def frame_table(spark, sequences, name="x", kind="double"):
    return spark.createDataFrame([(k, i, v) for k, s in enumerate(sequences) for i, v in enumerate(s)], f"k int, i int, {name} {kind}")


def test_flag_segments_edges(spark):
    flags = [[1], [1, 1, 1], [1, 0, 0], [0, 0, 1, 0]]
    got = {(r.k, r.start, r.stop) for r in segments.flags_to_segments(frame_table(spark, flags, "f", "int"), "k", ["i"], "f").collect()}
    assert got == {(0, 0, 1), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 3), (3, 0, 2), (3, 2, 4)}


def runs(values):
    out, start = [], None
    for i, v in enumerate([*values, 0]):
        if v and start is None:
            start = i
        elif not v and start is not None:
            out.append((start, i))
            start = None
    return out


def test_label_runs(spark):
    random.seed(2)
    seqs = [[random.randint(0, 1) for _ in range(random.randint(1, 15))] for _ in range(30)] + [[0, 0], [1, 1]]
    got = {(r.k, r.start, r.stop) for r in segments.label_runs(frame_table(spark, seqs, "v", "int"), "k", ["i"], F.col("v") == 1).collect()}
    assert got == {(k, a, b) for k, s in enumerate(seqs) for a, b in runs(s)}


@pytest.mark.parametrize("form", [segments.momentum, segments.momentum_closed])
def test_momentum(spark, form):
    random.seed(3)
    seqs = [[random.uniform(-5, 5) for _ in range(n)] for n in (1, 2, 3, 90)]
    want = {}
    for k, s in enumerate(seqs):
        m = None
        for t in range(len(s)):
            m = None if t == 0 else s[1] - s[0] if t == 1 else 0.8 * (s[t] - s[t - 1]) + 0.2 * m
            want[k, t] = m
    for r in form(frame_table(spark, seqs), "k", ["i"], "x").collect():
        assert (r.m is None) if want[r.k, r.i] is None else r.m == pytest.approx(want[r.k, r.i], abs=1e-9)


def test_sample_lengths(spark):
    seqs = [[0, 1, 2, 0, 1, 0, -1, -1], [0]]
    got = {(r.k, r.sample): r.length for r in segments.sample_lengths(frame_table(spark, seqs, "p", "int"), "k", ["i"], "p").collect()}
    assert got == {(0, 0): 3, (0, 1): 2, (0, 2): 1, (1, 0): 1}


def test_numbered_is_global(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(8)
    assert convert.numbered(df, "n", "v").where("n <> v").count() == 0


def test_contained_name_last_wins(spark):
    clips = spark.createDataFrame([("abcdefgh1",), ("ab",), ("zz",)], "clip string")
    files = spark.createDataFrame([("x_abcdefgh1_a",), ("x_abcdefgh1_b",), ("ab",)], "file string")
    got = {r.clip: r.file for r in joins.contained_name(clips, files, "clip", "file").collect()}
    assert got == {"abcdefgh1": "x_abcdefgh1_b", "ab": "x_abcdefgh1_b"}


def test_lookup_abort(spark):
    rows, cat = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "a")], "k int, p string")
    assert joins.lookup(rows, cat, ["k"]).count() == 1
    with pytest.raises(Exception, match="no entry"):
        joins.lookup(rows, cat, ["k"], "abort").collect()


def test_merge_placeholders(spark):
    # text, cube of 3 frames with a separator between, text, cube of 3 frames
    kinds = [0, 1, 0, 1, 0, 1, 0, 1, 1, 1, 0]
    df = frame_table(spark, [kinds], "v", "int")
    got = [r.i for r in merge_placeholders(df, "k", ["i"], F.col("v") == 1, 3).orderBy("position").collect()]
    assert got == [0, 1, 6, 7, 10]
    bounds = spark.createDataFrame([(0, 0, 2), (0, 2, 6)], "k int, low long, high long")
    got = [r.i for r in merge_placeholders(df, "k", ["i"], F.col("v") == 1, 3, bounds).orderBy("position").collect()]
    assert got == [0, 1, 4, 5, 10]


def test_numbered_beyond_the_sample(spark):
    """More rows than a range partitioning samples, and a column that only one of the two readings needs."""
    df = spark.range(300_000).select((F.col("id") * 7919 % 300_007).alias("v"), F.md5(F.col("id").cast("string")).alias("text")).repartition(6)
    rows = convert.numbered(df, "n", "v").select("v", "n", "text")
    assert rows.select("n").distinct().count() == 300_000
    assert rows.agg(F.max("n")).first()[0] == 299_999
    from pyspark.sql import Window

    w = Window.orderBy("v")
    assert rows.withColumn("r", F.row_number().over(w) - 1).where("r <> n").count() == 0


def test_numbered_in_large_keys(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), (F.col("id") * 7919 % 1000).alias("v"))
    a = convert.numbered(df, "n", "v", by=("k",), large=True)
    b = convert.numbered(df, "n", "v", by=("k",))
    assert a.count() == 1000 and a.select("k", "v", "n").exceptAll(b.select("k", "v", "n")).count() == 0


def test_megabatches_are_dealt_evenly(spark):
    from cubeloom.operators import mixture

    df = spark.range(200).select(F.col("id").alias("doc_id"), (F.col("id") * 37 % 101 + 1).alias("n"))
    rows = mixture.megabatches(df, "n", "doc_id", 32, 4, 1).collect()
    assert sorted(r.doc_id for r in rows) == list(range(200))
    length = {r.doc_id: r.n for r in df.collect()}
    groups = {}
    for r in rows:
        groups.setdefault(r.megabatch, []).append(r)
    for g in groups.values():
        by_place = sorted(g, key=lambda r: r.place)
        assert [length[r.doc_id] for r in by_place] == sorted((length[r.doc_id] for r in g), reverse=True)
        if len(g) % 4 == 0:  # greedy: the least loaded chunk that isn't full
            loads, counts = [0.0] * 4, [0] * 4
            for r in by_place:
                pick = loads.index(min(loads))
                assert r.chunk == pick
                loads[pick] += length[r.doc_id]
                counts[pick] += 1
                if counts[pick] == len(g) // 4:
                    loads[pick] = float("inf")


@pytest.mark.parametrize("rate", [0.05, 0.8, 1.0])
def test_momentum_of_long_keys_at_any_rate(spark, rate):
    rows = [(k, i, math.sin(i * (k + 1)) * 10) for k, n in enumerate((0, 1, 2, 64, 65, 66, 700)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, x double")
    want = {}
    for k, i, x in rows:
        before = want.get((k, i - 1))
        d = x - rows_at(rows, k, i - 1) if i else None
        want[k, i] = None if i == 0 else d if i == 1 else rate * d + (1 - rate) * before
    for f in (segments.momentum, segments.momentum_closed):
        got = {(r.k, r.i): r.m for r in f(df, "k", ["i"], "x", rate=rate).collect()}
        assert got.keys() == want.keys()
        assert all(got[x] is None if want[x] is None else got[x] == pytest.approx(want[x], abs=1e-9) for x in want)


def rows_at(rows, k, i):
    return next(x for key, at, x in rows if (key, at) == (k, i))


def test_contained_name_with_a_beginning_that_all_share(spark):
    clips = spark.createDataFrame([(i, f"video_000{i:03d}") for i in range(200)] + [(900, "zz"), (901, "video_999999"), (902, "0001")], "id long, clip string")
    files = spark.createDataFrame([(f"video_000{i:03d}{c}.mp4",) for i in range(0, 200, 2) for c in "ab"], "file string")
    got = {(r.id, r.file) for r in joins.contained_name(clips, files, "clip", "file").collect()}
    names = [r.file for r in files.collect()]
    want = {(r.id, max(f for f in names if r.clip in f)) for r in clips.collect() if any(r.clip in f for f in names)}
    assert got == want and len(got) == 101


def test_parts_of_names_are_never_broadcast(spark, tmp_path):
    """A scan of names is small by its file, their parts aren't: only the short names' join, on an aggregate that is measured, may broadcast a side."""
    spark.range(1000).select(F.concat(F.lit("folder_clip_"), "id").alias("file")).write.parquet(str(tmp_path / "f"))
    files = spark.read.parquet(str(tmp_path / "f"))
    clips = files.select(F.col("file").alias("clip"))
    out = joins.contained_name(clips, files, "clip", "file")
    assert out._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin [_part") <= 1
    assert {(r.clip, r.file) for r in out.collect()} >= {("folder_clip_1", "folder_clip_199"), ("folder_clip_998", "folder_clip_998")}


def shuffled(spark):
    """Rows written to shuffles by the stages that the session still knows, by stage."""
    jvm = spark._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    known = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(known.apply(i).stageId(), known.apply(i).attemptId()): known.apply(i).shuffleWriteRecords() for i in range(known.size())}


def test_only_pieces_that_may_be_a_clips_name_leave_a_task(spark):
    """Names of three to seven characters in files of up to thirteen: all their pieces of those lengths are over 40 for each file."""
    clips = spark.range(5000).select(F.concat(F.lit("n"), "id", F.lit("z")).alias("clip"))
    files = spark.range(20000).select(F.explode(F.array(F.concat(F.lit("n"), "id", F.lit("zx.mkv")), F.concat(F.lit("n"), "id", F.lit("z.avi")))).alias("file"))
    before = shuffled(spark)
    got = {(r.clip, r.file) for r in joins.contained_name(clips, files, "clip", "file").collect()}
    assert got == {(f"n{i}z", f"n{i}zx.mkv") for i in range(5000)}
    assert sum(n for k, n in shuffled(spark).items() if k not in before) < 1.5 * (5000 + 40000)


@pytest.mark.parametrize(("lengths", "letters", "whole"), [(7, "ab\u00e9\U0001f600", "all"), (30, "ab", "some"), (60, "ab\u00e9\U0001f600", "short")])
def test_contained_name_of_many_lengths(spark, monkeypatch, lengths, letters, whole):
    """Random names, few of whose pieces are ruled out by their ends: up to 32 lengths some are tried whole, and the others are found by parts."""
    rng, by_parts = random.Random(lengths), []
    name = lambda n: "".join(rng.choice(letters) for _ in range(n))
    monkeypatch.setattr(joins, "_by_parts", lambda c, *a, f=joins._by_parts: by_parts.append({r[0] for r in c.select(F.length("clip")).distinct().collect()}) or f(c, *a))
    files = [("pq"[i % 2], name(rng.randint(0, 2 * lengths))) for i in range(150)]
    cut = [(w, f[i : i + rng.randint(1, lengths)]) for w, f in files for i in (0, len(f) // 2) if f]
    clips = cut + [("qp"[w == "q"], c) for w, c in cut[:50]] + [("p", name(n)) for n in range(lengths)] + [("p", "")]
    want = {(w, c, max(f for v, f in files if v == w and c in f)) for w, c in clips if any(v == w and c in f for v, f in files)}
    clips, files = spark.createDataFrame(clips, "folder string, clip string"), spark.createDataFrame(files, "folder string, file string")
    got = [tuple(r) for r in joins.contained_name(clips, files, "clip", "file", within=("folder",)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    used = {len(c) for c in {r.clip for r in clips.collect()}}
    left = by_parts[0] if by_parts else set()
    assert {"all": not left, "some": set() < left < {n for n in used if n >= 8}, "short": left == {n for n in used if n >= 8}}[whole]


def test_contained_name_without_clips_or_files(spark):
    none, some = spark.createDataFrame([(None,)], "clip string"), spark.createDataFrame([("clip_0123",)], "clip string")
    files = some.select(F.concat("clip", F.lit(".mp4")).alias("file"))
    for c, f in ((none, files), (none.where("false"), files), (some, files.where("false"))):
        assert joins.contained_name(c, f, "clip", "file").collect() == []


def test_contained_name_within_a_folder(spark):
    """Names of each length, the empty one too, repeated rows, nulls and a column that isn't used; files of another folder don't count."""
    clips = spark.createDataFrame([(f, c) for f in ("p", "q", None) for c in ("", "a", "lip_01", "clip_0123", "clip_0124", "clip_9999", None)] * 2, "folder string, clip string")
    files = spark.createDataFrame([("p", "clip_0123.avi", 1), ("p", "clip_0123.mkv", 2), ("p", "x", 3), ("q", "a_clip_0124", 4), ("q", None, 5), (None, "clip_9999", 6)] * 2, "folder string, file string, size int")
    got = sorted(tuple(r) for r in joins.contained_name(clips, files, "clip", "file", within=("folder",)).collect())
    held = {(f, n) for f, n, _ in map(tuple, files.collect()) if f and n}
    pairs = {(f, c) for f, c in map(tuple, clips.collect()) if f and c is not None}
    want = sorted((f, c, max(n for g, n in held if f == g and c in n)) for f, c in pairs if any(f == g and c in n for g, n in held))
    assert got == want and len(got) == 8
