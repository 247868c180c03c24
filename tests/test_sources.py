"""Round trips of readers and writers."""

import json

import pytest
from pyspark.sql import functions as F

from cubeloom.operators import mixture
from cubeloom.sources import blobs, catalogue, external, readers, writers


def test_json_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"video": "v1", "n": 1}, {"video": "v2", "n": 2}]')
    assert readers.json_array(spark, str(tmp_path / "a.json"), "video string, n int").count() == 2
    (tmp_path / "o.json").write_text('{"k1": {"sentences": ["a", "b"]}, "k2": {"sentences": []}}')
    rows = readers.json_object(spark, str(tmp_path / "o.json"), "struct<sentences: array<string>>").collect()
    assert {r.key: r.value.sentences for r in rows} == {"k1": ["a", "b"], "k2": []}


def test_json_folder_skips_corrupt(spark, tmp_path):
    (tmp_path / "m1.json").write_text('{"caption": "c"}')
    (tmp_path / "m2.json").write_text("{broken")
    rows = readers.json_folder(spark, str(tmp_path), "caption string").select("key", "caption").collect()
    assert [(r.key, r.caption) for r in rows] == [("m1", "c")]


def test_csv_and_polymorphic(spark, tmp_path):
    (tmp_path / "q.csv").write_text('video,qid,question\nv1,1,"what, now"\n')
    assert readers.csv_header(spark, str(tmp_path / "q.csv"), "video string, qid int, question string").first().question == "what, now"
    df = spark.createDataFrame([('["a", "b"]',), ("c",), (None,)], "f string")
    assert [r.v for r in df.select(readers.string_or_array(F.col("f")).alias("v")).collect()] == [["a", "b"], ["c"], None]


def test_media_listing_and_sidecar(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "v_1.x.mp4").write_bytes(b"12345")
    (tmp_path / "d" / "n.txt").write_bytes(b"1")
    rows = readers.media_listing(spark, str(tmp_path), suffixes=("mp4",)).collect()
    assert [(r.name, r.stem, r.length) for r in rows] == [("v_1.x.mp4", "v_1", 5)]
    (tmp_path / "s").mkdir()
    for i, v in enumerate(("id1", "")):
        (tmp_path / "s" / f"{i}.json").write_text(json.dumps({"yt_meta_dict": {"info": {"id": v}}}))
    assert [r.id for r in readers.sidecar_catalogue(spark, str(tmp_path / "s")).collect()] == ["id1"]


def test_corrupt_parquet_skipped(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "p"))
    (tmp_path / "p" / "part-bad.parquet").write_bytes(b"not parquet")
    assert spark.read.schema("id long").option("ignoreCorruptFiles", "true").parquet(str(tmp_path / "p")).count() == 3


def test_sinks(spark, tmp_path):
    df = spark.range(10).select("id", F.when(F.col("id") < 5, "Caption").otherwise("QA").alias("category"))
    writers.write_json_lines(df, str(tmp_path / "j"), partitions=1)
    writers.write_json_lines(df, str(tmp_path / "j"), append=True)
    assert spark.read.json(str(tmp_path / "j")).count() == 20
    writers.write_routed(df, str(tmp_path / "r"), F.col("category"), {"cap": ("Caption",)})
    assert spark.read.json(str(tmp_path / "r")).select("bucket").distinct().count() == 1
    writers.write_once(df, str(tmp_path / "o"))
    writers.write_once(df.limit(1), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).count() == 10
    writers.write_missing(df, df.where("id < 8").select("id"), ["id"], str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    writers.write_metrics(df.agg(F.count("*").alias("n")), str(tmp_path / "k"))
    assert spark.read.json(str(tmp_path / "k")).first().n == 10


def test_mixture_load(spark, tmp_path):
    for n in ("a", "b"):
        (tmp_path / f"{n}.jsonl").write_text("".join(json.dumps({"uid": f"{n}{i}"}) + "\n" for i in range(4)))
    spec = f"{tmp_path}/{{a,b}}.jsonl#1_6*2"
    rows = mixture.load_mixture(spark, spec, "uid string").orderBy("source_path", "position").collect()
    assert [r.uid for r in rows] == ["a1", "a2", "a3", "a0", "a1", "b1", "b2", "b3", "b0", "b1"]


QA = "i long, video string, QA array<struct<i: string, q: string, a: string>>"


def test_source_misses(spark):
    ann = spark.createDataFrame([(0, "k400/a/v1.mp4", [("look", "what?", "x")]), (1, "k400/b/v2.mp4", [("look", "why?", "y"), ("see", "who?", "z")])], QA)
    cat = spark.createDataFrame([("b/v2.mp4", "/d/v2.mp4")], "key string, path string").withColumn("key", F.lit("a/v2.mp4"))
    spec = catalogue.QA_SOURCES["kinetics710"]
    assert catalogue.qa_source(spec, ann, cat).count() == 0
    out = catalogue.qa_source(spec, ann, cat.withColumn("key", F.lit("b/v2.mp4"))).collect()
    assert sorted(r.conversations[0].value for r in out) == ["look why?", "see who?"] and {r.uid for r in out} == {"VideoChat2IT_Kinetics710_b_1"}
    assert {r.video for r in out} == {"/d/v2.mp4"}
    with pytest.raises(Exception, match="no entry"):
        catalogue.qa_source(catalogue.QA_SOURCES["clevrer_qa"], ann, cat).collect()


def test_calls_are_repeated_and_reported(spark, tmp_path):
    def call(name, n):
        seen = tmp_path / f"{name}{n}"
        tries = int(seen.read_text()) + 1 if seen.exists() else 1
        seen.write_text(str(tries))
        if tries < n:
            raise OSError("busy")
        return name * 2, tries

    df = spark.createDataFrame([("a", 1), ("b", 3), ("c", 9), (None, 0)], "name string, n int").withColumn("tries", F.lit("clash")).coalesce(1)
    out = {r.name: (r.twice, r.tries, r.error) for r in external.called(df, call, [F.col("name"), F.col("n")], "twice string, tries int", attempts=4).collect()}
    assert out["a"] == ("aa", 1, None) and out["b"] == ("bb", 3, None) and out["c"] == (None, None, "OSError: busy")
    assert out[None][2].startswith("TypeError")
    assert external.called(df.limit(0), call, [F.col("name"), F.col("n")], "twice string, tries int").count() == 0


def test_longvila_removes_the_first_tag_of_each_human_turn(spark):
    rows = [(0, "y", [("human", "a \n <video> b <video>"), ("gpt", "c <video>"), ("human", "no tag "), ("human", "<video>")])]
    ann = spark.createDataFrame(rows, "i long, id string, conversations array<struct<from: string, value: string>>")
    files = spark.createDataFrame([("y", "/y.mp4", 2)], "id string, path string, frames int")
    (out,) = catalogue.longvila(ann, files).collect()
    assert [t.value for t in out.conversations] == ["a b <video>", "c <video>", "no tag ", ""]
    assert catalogue.longvila(ann, files, low=3).count() == 0


def test_write_media_once(spark, tmp_path):
    df = spark.createDataFrame([("a.bin", bytearray(b"1")), ("b.bin", bytearray(b"22"))], "name string, data binary")
    assert {r.written for r in blobs.write_media(df, f"file://{tmp_path}/m", "name", "data").collect()} == {True}
    assert {r.written for r in blobs.write_media(df, f"file://{tmp_path}/m", "name", "data").collect()} == {False}
    assert (tmp_path / "m" / "b.bin").read_bytes() == b"22"


def test_frames_of_a_listing_are_never_broadcast(spark, tmp_path):
    """A small file's rows can be many frames."""
    spark.range(100).write.parquet(str(tmp_path / "p"))
    clips = spark.read.parquet(str(tmp_path / "p")).select("id", F.array(F.lit(1), F.lit(7), F.lit(90)).alias("wanted"))
    listing = spark.read.parquet(str(tmp_path / "p")).select("id", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("frame")).where("frame % 4 <> 0")
    out = blobs.existing_frames(clips, listing, "id")
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, tuple(r.frames)) for r in out.collect()} == {(i, (1, 7)) for i in range(100)}


def test_compacted_lines_are_cut_by_size(spark, tmp_path):
    """So many files as are asked for, or more where one would be larger than a file should be."""
    df = spark.range(4000, numPartitions=8).select("id", F.repeat(F.lit("é"), 100).alias("text"))
    files = lambda name: [f.stat().st_size for f in (tmp_path / name).glob("part-*")]
    writers.write_json_lines(df, str(tmp_path / "a"), partitions=1)
    assert len(files("a")) == 1
    writers.write_json_lines(df, str(tmp_path / "a"), append=True, partitions=1, file_bytes=100_000)
    assert len(files("a")) == 10 and sorted(files("a"))[-2] < 110_000
    assert sorted(r.id for r in spark.read.json(str(tmp_path / "a")).collect()) == sorted([*range(4000)] * 2)
    writers.write_json_lines(df.limit(0), str(tmp_path / "e"), partitions=1)
    assert sum(files("e")) == 0
