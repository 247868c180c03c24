"""A store of frames by name: tab-separated lines, where each begins, and which line a name has.

A store is a folder. Each task of a write adds a segment of three files: ``.tsv`` (name, tab, a JSON
array of base64 payloads), ``.lineidx`` (the offset of each line, eight bytes) and a Parquet file of
names (line, offset and length in the segment, number of frames). A write is committed by a manifest
that lists all segments with their lines and bytes; lines and offsets go on from segment to segment,
so that an append continues where the last write ended. What a failed task or write leaves isn't listed.

It is a data source: ``spark.read.format("tsvstore").load(path)`` reads every line, a range of lines a
task; with the options ``lines`` or ``names`` (JSON lists) only the lines that they name are read. These are
options, not pushed filters: Spark 4.1 keeps a reader's pushed filters for later queries on the same DataFrame.
``looked_up`` joins any number of names with the stores' names and reads their lines' bytes, sorted by
place, in parallel.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..workspace import importable

FORMAT, SCHEMA = "tsvstore", "line long, name string, frames array<binary>"
#: Bytes that a task reads of a whole scan, lines picked in a task, and lines whose names are written at a time.
RANGE, PICKED, NAMES = 64_000_000, 1_000, 50_000
_NAMES = pa.schema([("name", pa.string()), ("line", pa.int64()), ("at", pa.int64()), ("length", pa.int64()), ("n_frames", pa.int32())])


def encoded(name: str, frames: list[bytes]) -> bytes:
    """A line, with its line break."""
    if "\t" in name or "\n" in name or "\r" in name:
        raise ValueError(f"a name holds a tab or a line break: {name!r}")
    return f"{name}\t{json.dumps([base64.b64encode(f).decode() for f in frames])}\n".encode()


def decoded(line: bytes) -> tuple[str, list[bytes]]:
    name, _, payload = line.decode().rstrip("\n").partition("\t")
    return name, [base64.b64decode(x) for x in json.loads(payload)]


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    path = path.removeprefix("file:") if path.startswith("file:/") and "://" not in path else path
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Segment(WriterCommitMessage):
    """A segment's name, its size, the partition that wrote it, and lines and bytes before it."""

    name: str
    lines: int
    bytes: int
    order: int = 0
    first_line: int = 0
    first_byte: int = 0


def segments(path: str) -> list[Segment]:
    """The segments of a store's last commit."""
    fs, base = _opened(path)
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.base_name.startswith("manifest-")]
    if not found:
        return []
    with fs.open_input_file(max(found)) as f:
        return [Segment(**s) for s in json.loads(f.read())["segments"]]


def _commit(path: str, listed: list[Segment]) -> None:
    fs, base = _opened(path)
    fs.create_dir(base, recursive=True)
    found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(base)) if f.base_name.startswith("manifest-"))
    number = int(found[-1].rsplit("-", 1)[1].split(".")[0]) + 1 if found else 0
    lines = size = 0
    for s in listed:
        s.first_line, s.first_byte = lines, size
        lines, size = lines + s.lines, size + s.bytes
    part = f"{base}/.manifest-{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(json.dumps({"segments": [vars(s) for s in listed]}).encode())
    fs.move(part, f"{base}/manifest-{number:010d}.json")


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> Segment:
        from pyspark import TaskContext

        fs, base = _opened(self.path)
        fs.create_dir(f"{base}/names", recursive=True)
        context = TaskContext.get()
        out = Segment(uuid.uuid4().hex, 0, 0, context.partitionId() if context else 0)
        held: list[tuple] = []
        with (
            fs.open_output_stream(f"{base}/{out.name}.tsv") as tsv,
            fs.open_output_stream(f"{base}/{out.name}.lineidx") as index,
            fs.open_output_stream(f"{base}/names/{out.name}.parquet") as sink,
            pq.ParquetWriter(sink, _NAMES) as names,
        ):
            for row in rows:
                frames = [bytes(f) for f in row["frames"]]
                line = encoded(row["name"], frames)
                index.write(out.bytes.to_bytes(8, "little"))
                held.append((row["name"], out.lines, out.bytes, len(line), len(frames)))
                tsv.write(line)
                out.lines, out.bytes = out.lines + 1, out.bytes + len(line)
                if len(held) >= NAMES:
                    names.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _NAMES)], schema=_NAMES))
                    held.clear()
            if held:
                names.write_table(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), _NAMES)], schema=_NAMES))
        return out

    def commit(self, messages: list[Segment | None]) -> None:
        old = segments(self.path)
        new = sorted((m for m in messages if m and m.lines), key=lambda m: m.order)
        _commit(self.path, new if self.overwrite else old + new)
        self._remove(m.name for m in [*(old if self.overwrite else []), *(m for m in messages if m and not m.lines)])

    def abort(self, messages: list[Segment | None]) -> None:
        self._remove(m.name for m in messages if m)

    def _remove(self, names) -> None:
        fs, base = _opened(self.path)
        for name in names:
            for f in (f"{base}/{name}.tsv", f"{base}/{name}.lineidx", f"{base}/names/{name}.parquet"):
                if fs.get_file_info(f).type == pafs.FileType.File:
                    fs.delete_file(f)


@dataclass
class Lines(InputPartition):
    """Lines of a segment: a range, or those picked."""

    segment: Segment
    first: int
    last: int
    picked: list[int] | None = None


class Reader(DataSourceReader):
    def __init__(self, path: str, lines: list[int] | None = None, names: list[str] | None = None):
        self.path, self.lines, self.names = path, lines, names

    def partitions(self) -> list[Lines]:
        import pyarrow.compute as pc

        listed = segments(self.path)
        if self.lines is None and self.names is None:
            out = []
            for s in listed:
                step = max(1, s.lines * RANGE // max(s.bytes, 1))
                out += [Lines(s, lo, min(lo + step, s.lines)) for lo in range(0, s.lines, step)]
            return out
        fs, base = _opened(self.path)
        out = []
        for s in listed:
            picked = None if self.lines is None else {i - s.first_line for i in set(self.lines) if s.first_line <= i < s.first_line + s.lines}
            if self.names is not None and picked != set():
                found = pq.read_table(f"{base}/names/{s.name}.parquet", filesystem=fs, columns=["line"], filters=pc.field("name").isin(list(self.names)))
                named = set(found.column("line").to_pylist())
                picked = named if picked is None else picked & named
            listed_ = sorted(picked)
            out += [Lines(s, 0, s.lines, listed_[lo : lo + PICKED]) for lo in range(0, len(listed_), PICKED)]
        return out

    def read(self, part: Lines) -> Iterator[tuple]:
        if part is None:
            return
        fs, base = _opened(self.path)
        s = part.segment
        with fs.open_input_file(f"{base}/{s.name}.lineidx") as index, fs.open_input_file(f"{base}/{s.name}.tsv") as tsv:

            def offset(line: int) -> int:
                return int.from_bytes(index.read_at(8, 8 * line), "little") if line < s.lines else s.bytes

            if part.picked is not None:
                for line in part.picked:
                    at = offset(line)
                    yield (s.first_line + line, *decoded(tsv.read_at(offset(line + 1) - at, at)))
                return
            at, end = offset(part.first), offset(part.last)
            tsv.seek(at)
            rest, line = b"", s.first_line + part.first
            while at < end or rest:
                block = tsv.read(min(1 << 22, end - at))
                at += len(block)
                *whole, rest = (rest + block).split(b"\n")
                for one in whole:
                    yield (line, *decoded(one))
                    line += 1
                if not block:
                    break


class TsvStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], *(json.loads(self.options[o]) if o in self.options else None for o in ("lines", "names")))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known to a session."""
    importable(spark).dataSource.register(TsvStore)
    return spark


def write_store(df: DataFrame, path: str, name: str = "name", frames: str = "frames", append: bool = False) -> None:
    """Adds a line for each row; rows without frames are left out."""
    register(df.sparkSession)
    rows = df.where(F.size(frames) > 0).select(F.col(name).cast("string").alias("name"), F.col(frames).alias("frames"))
    rows.write.format(FORMAT).mode("append" if append else "overwrite").save(path)


def read_store(spark: SparkSession, path: str, lines: list[int] | None = None, names: list[str] | None = None) -> DataFrame:
    """All lines, or those with one of the given numbers and names; ``looked_up`` is for many."""
    read = register(spark).read.format(FORMAT)
    for option, values in (("lines", lines), ("names", names)):
        read = read if values is None else read.option(option, json.dumps(values))
    return read.load(path)


def write_dataset(df: DataFrame, path: str, images: str = "images", append: bool = False) -> None:
    """A store of rows' images by name (the video, or else the image, or else the file's name) beside the rows without them, as JSON lines."""
    key = F.coalesce("video", "image", "filename").alias("name")
    rows = df.where(F.size(images) > 0)
    write_store(rows.select(key, F.col(images).alias("frames")), f"{path}/imgs", append=append)
    rows.drop(images).write.mode("append" if append else "overwrite").json(f"{path}/chat")


def names(spark: SparkSession, path: str) -> DataFrame:
    """name, line, byte_offset, n_frames, and segment, at and length (where its bytes are); of lines with the same name the last one."""
    listed = segments(path)
    if not listed:
        return spark.createDataFrame([], "name string, line long, byte_offset long, n_frames int, segment string, at long, length long")
    placed = spark.createDataFrame([(s.name, s.first_line, s.first_byte) for s in listed], "segment string, first_line long, first_byte long")  # a row for each task of a write
    rows = spark.read.schema("name string, line long, at long, length long, n_frames int").parquet(*[f"{path}/names/{s.name}.parquet" for s in listed])
    rows = rows.withColumn("segment", F.regexp_extract(F.col("_metadata.file_path"), r"([0-9a-f]+)\.parquet$", 1)).join(F.broadcast(placed), "segment")
    last = F.max_by(F.struct("line", "byte_offset", "n_frames", "segment", "at", "length"), "line").alias("r")
    rows = rows.withColumns({"line": F.col("line") + F.col("first_line"), "byte_offset": F.col("at") + F.col("first_byte")})
    return rows.groupBy("name").agg(last).select("name", "r.*")


def fetched(places: DataFrame, keep: list[str]) -> DataFrame:
    """places (path, segment, at, length) with frames: each line's own bytes are read, in order of place in each task."""
    kinds = ", ".join(f"`{c}` {places.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, opened = None, None
        for batch in batches:
            frames = []
            for path, segment, at, length in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held != (path, segment):
                    if opened is not None:
                        opened.close()
                    fs, base = _opened(path)
                    held, opened = (path, segment), fs.open_input_file(f"{base}/{segment}.tsv")
                frames.append(decoded(opened.read_at(length, at))[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4, batch.num_columns)), pa.array(frames, pa.list_(pa.binary()))], [*keep, "frames"])
        if opened is not None:
            opened.close()

    rows = places.select("path", "segment", "at", "length", *keep).repartition("path", "segment", F.floor(F.col("at") / RANGE)).sortWithinPartitions("path", "segment", "at")
    return rows.mapInArrow(run, f"{kinds}, frames array<binary>")


def looked_up(df: DataFrame, stores: dict[str, str], name: str) -> DataFrame:
    """df with store, line and frames of each row's name: from the first store whose word the name holds, else null.

    stores: a word and a folder each, in the order in which they are tried."""
    spark = df.sparkSession
    store: Column = reduce(lambda other, word: F.when(F.contains(F.col(name), F.lit(word)), word).otherwise(other), reversed(stores), F.lit(None).cast("string"))
    asked = df.select(F.col(name).alias("name"), store.alias("store")).where("store IS NOT NULL").distinct()
    every = reduce(DataFrame.unionByName, [names(spark, path).withColumns({"store": F.lit(word), "path": F.lit(path)}) for word, path in stores.items()])
    found = fetched(asked.join(every, ["store", "name"]), ["name", "store", "line"]).withColumnRenamed("name", "_name")
    return df.withColumn("_store", store).join(found, (F.col(name) == F.col("_name")) & (F.col("_store") == F.col("store")), "left").drop("_name", "_store")
