"""The store of frames: writes, appends, lookups that read their own bytes only, failed writes."""

import json
import os

import pytest
from pyspark.sql import functions as F

from cubeloom.sources import tsvstore


def rows(spark, ids, parts=3):
    df = spark.createDataFrame([(i, f"sharegpt4video/é{i}", [bytes([i % 256]) * (i % 5), b"x\x00\n\t"]) for i in ids], "id long, name string, frames array<binary>")
    return df.repartitionByRange(parts, "id").sortWithinPartitions("id")


def test_write_append_read(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    tsvstore.write_store(rows(spark, range(50)), path)
    tsvstore.write_store(rows(spark, range(100, 130)), path, append=True)
    got = {r.line: (r.name, [bytes(f) for f in r.frames]) for r in tsvstore.read_store(spark, path).collect()}
    ids = [*range(50), *range(100, 130)]
    assert got == {n: (f"sharegpt4video/é{i}", [bytes([i % 256]) * (i % 5), b"x\x00\n\t"]) for n, i in enumerate(ids)}
    # Offsets go on over segments and writes, in bytes.
    whole = b"".join(open(f"{tmp_path}/s/{s.name}.tsv", "rb").read() for s in tsvstore.segments(path))
    for r in tsvstore.names(spark, path).collect():
        assert whole[r.byte_offset :].decode().startswith(r.name + "\t") and whole[: r.byte_offset].count(b"\n") == r.line
    tsvstore.write_store(rows(spark, [7]), path)
    assert [r.name for r in tsvstore.read_store(spark, path).collect()] == ["sharegpt4video/é7"]
    assert len([f for f in os.listdir(f"{tmp_path}/s") if f.endswith(".tsv")]) == 1


def spoiled(path, tmp, keep):
    """Overwrites every line but those of ``keep`` (places in the whole) with other bytes of the same length."""
    for s in tsvstore.segments(path):
        file = f"{tmp}/{s.name}.tsv"
        lines = open(file, "rb").read().splitlines(keepends=True)
        with open(file, "wb") as f:
            f.writelines(line if s.first_line + i in keep else b"\xff" * len(line) for i, line in enumerate(lines))


def test_lookups_read_their_own_bytes(spark, tmp_path):
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    tsvstore.write_store(rows(spark, range(200)), a)
    tsvstore.write_store(rows(spark, range(200, 300)), a, append=True)
    tsvstore.write_store(rows(spark, range(20)).withColumn("name", F.regexp_replace("name", "sharegpt4video", "YouCook2")), b)
    spoiled(a, f"{tmp_path}/a", {5, 250})
    asked = spark.createDataFrame([("sharegpt4video/é5",), ("sharegpt4video/é250",), ("sharegpt4video/é250",), ("YouCook2/é3",), ("YouCook2/none",), ("other/é5",), (None,)], "asked string")
    got = sorted((str(r.asked), r.store, r.line, r.frames and [bytes(f) for f in r.frames]) for r in tsvstore.looked_up(asked, {"sharegpt4video": a, "YouCook2": b}, "asked").collect())
    frames = lambda i: [bytes([i % 256]) * (i % 5), b"x\x00\n\t"]
    assert got == [("None", None, None, None), ("YouCook2/none", None, None, None), ("YouCook2/é3", "YouCook2", 3, frames(3)), ("other/é5", None, None, None)] + [("sharegpt4video/é250", "sharegpt4video", 250, frames(250))] * 2 + [("sharegpt4video/é5", "sharegpt4video", 5, frames(5))]
    read = lambda **given: [(r.line, r.name) for r in tsvstore.read_store(spark, a, **given).collect()]
    assert read(lines=[250]) == [(250, "sharegpt4video/é250")] and read(names=["sharegpt4video/é5", "none"]) == [(5, "sharegpt4video/é5")]
    assert read(lines=[5, 5]) == [(5, "sharegpt4video/é5")] and read(lines=[5], names=["none"]) == read(lines=[9999]) == read(lines=[]) == []
    with pytest.raises(Exception, match="codec|Expecting|utf"):
        read()  # the others are spoiled


def test_repeated_names_and_empty_rows(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    df = spark.createDataFrame([("a", [b"1"]), ("b", []), ("a", [b"2", b"3"]), ("c", None)], "name string, frames array<binary>").coalesce(1)
    tsvstore.write_store(df, path)
    assert {(r.name, r.line, r.n_frames) for r in tsvstore.names(spark, path).collect()} == {("a", 1, 2)}
    assert tsvstore.read_store(spark, path).count() == 2
    tsvstore.write_store(df.where("name = 'x'"), path)
    assert tsvstore.read_store(spark, path).count() == 0 and tsvstore.names(spark, path).count() == 0


def test_a_failed_write_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    tsvstore.write_store(rows(spark, range(10)), path)
    bad = spark.createDataFrame([("tab\tin name", [b"1"])], "name string, frames array<binary>")
    for append in (True, False):
        with pytest.raises(Exception, match="tab"):
            tsvstore.write_store(rows(spark, range(5)).drop("id").unionByName(bad), path, append=append)
    assert tsvstore.read_store(spark, path).count() == 10


def test_dataset(spark, tmp_path):
    df = spark.createDataFrame([("v1", None, "f1", [b"a"]), (None, "i2", "f2", [b"b", b"c"]), (None, None, "f3", [b"d"]), ("v4", None, "f4", [])], "video string, image string, filename string, images array<binary>").coalesce(1)
    tsvstore.write_dataset(df, f"file://{tmp_path}/d")
    assert {(r.name, r.n_frames) for r in tsvstore.names(spark, f"file://{tmp_path}/d/imgs").collect()} == {("v1", 1), ("i2", 2), ("f3", 1)}
    chat = [json.loads(line) for f in os.listdir(tmp_path / "d" / "chat") if f.endswith(".json") for line in open(tmp_path / "d" / "chat" / f)]
    assert sorted(c["filename"] for c in chat) == ["f1", "f2", "f3"] and all("images" not in c for c in chat)
