"""Streams over files, one micro-batch a file, against the batch operators."""

import pytest
from pyspark.sql import functions as F

from cubeloom.operators import segments
from cubeloom.streaming import frames as st


@pytest.fixture
def source(spark, tmp_path):
    rows = [(v, i, float((i * 7 + v * 3) % 11), int(i % (3 + v) == 0)) for v in range(3) for i in range(20)]
    for part in range(4):
        spark.createDataFrame([r for r in rows if r[1] // 5 == part], "video long, frame long, x double, flag int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    return batch, stream, tmp_path


def run(stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_momentum(source):
    batch, stream, tmp = source
    want = {(r.video, r.frame): r.m for r in segments.momentum(batch.select("video", "frame", "x"), "video", ["frame"], "x").collect()}
    got = {(r.video, r.frame): r.m for r in run(st.momentum_stream(stream), "momentum", tmp)}
    assert set(got) == set(want)
    assert all(got[k] is None if want[k] is None else got[k] == pytest.approx(want[k]) for k in want)


def test_segments(source):
    batch, stream, tmp = source
    want = {(r.video, r.start, r.stop) for r in segments.flags_to_segments(batch, "video", ["frame"], "flag").collect()}
    got = {(r.video, r.start, r.stop) for r in run(st.segment_stream(stream), "segments", tmp)}
    assert got == {w for w in want if w[2] < 20}  # the last of each video is still open


def test_append_missing(source):
    batch, stream, tmp = source
    schema = "video long, frame long, x double, flag int"
    for n in range(2):
        st.append_missing(stream, str(tmp / "out"), ["video", "frame"], schema, str(tmp / f"c{n}")).start().awaitTermination(120)
    assert batch.sparkSession.read.schema(schema).json(str(tmp / "out")).count() == 60


def test_event_rates_is_a_batch_query_too(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert st.event_rates(events).agg(F.sum("n")).first()[0] == events.count()


def test_momentum_of_many_frames_in_any_order(spark, tmp_path):
    """More frames of a key in a micro-batch than an Arrow chunk holds, the last first."""
    rows = spark.range(25_000).select(F.lit(0).cast("long").alias("video"), (F.lit(24_999) - F.col("id")).alias("frame"), (F.col("id") * 7919 % 101).cast("double").alias("x")).coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("video long, frame long, x double").parquet(str(tmp_path / "in"))
    got = {r.frame: r.m for r in run(st.momentum_stream(stream), "many", tmp_path)}
    want = {r.frame: r.m for r in segments.momentum(rows, "video", ["frame"], "x").collect()}
    assert got.keys() == want.keys() and all(want[k] is None or got[k] == pytest.approx(want[k]) for k in want)
