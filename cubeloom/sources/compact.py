"""Small files of lines put together to files of a size.

Files are listed, put in order of their paths, and a prefix sum over their sizes gives each one's bin: a
bin ends with the file that reaches the target. Bins are copied in parallel, byte by byte, into a new
folder beside the old one. Only when all are written and their bytes add up do the folders change places,
and only then does the old one go. What a failed run leaves is cleared or finished by the next."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scan import running
from .tsvstore import _opened

BLOCK = 1 << 22


def bins(files: DataFrame, target: int) -> DataFrame:
    """files (path, length) with bin, from 0."""
    placed = running(files.withColumn("_all", F.lit(0)), "_all", ["path"], _to=F.col("length"))
    return placed.select("path", "length", F.floor((F.col("_to") - F.col("length")) / target).cast("long").alias("bin"))


def _copied(folder: str, suffix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for number, paths in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, base = _opened(folder)
                size = added = 0
                with fs.open_output_stream(f"{base}/part-{number:08d}{suffix}", compression=None) as out:
                    for path in paths:
                        own, place = _opened(path)
                        last = b"\n"
                        with own.open_input_stream(place, compression=None) as f:
                            while block := f.read(BLOCK):
                                out.write(block)
                                size, last = size + len(block), block[-1:]
                        if last != b"\n":  # a file without a line break at its end
                            out.write(b"\n")
                            added += 1
                made.append((number, len(paths), size, added))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*made)] if made else [pa.array([], pa.int64())] * 4, ["bin", "n_files", "bytes", "added"])

    return run


def recover(folder: str) -> None:
    """Finishes or clears what a run that was cut off left: the new folder takes the old one's place only if that had been moved away."""
    fs, base = _opened(folder)
    there = lambda path: fs.get_file_info(path).type == pafs.FileType.Directory
    old, new = f"{base}.old", f"{base}.new"
    if not there(base) and there(new):
        fs.move(new, base)
    if there(base):
        for path in (old, new):
            if there(path):
                fs.delete_dir(path)


def compact(spark: SparkSession, folder: str, target: int, suffix: str = ".txt") -> DataFrame:
    """bin, n_files and bytes of each new file. folder holds files of lines, which end in a line break or get one."""
    folder = folder.rstrip("/")
    recover(folder)
    fs, base = _opened(folder)
    files = spark.read.format("binaryFile").load(folder).select("path", "length")
    grouped = bins(files, target).groupBy("bin").agg(F.array_sort(F.collect_list("path")).alias("paths"), F.sum("length").alias("size"))
    if fs.get_file_info(f"{base}.new").type == pafs.FileType.NotFound:
        fs.create_dir(f"{base}.new", recursive=True)
    tasks = spark.sparkContext.defaultParallelism * 4
    done = grouped.select("bin", "paths").repartition(tasks, "bin").mapInArrow(_copied(f"{folder}.new", suffix), "bin long, n_files long, bytes long, added long")
    rows = done.collect()  # a row of four numbers for each new file
    read, = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()
    written = sum(f.size for f in fs.get_file_info(pafs.FileSelector(f"{base}.new")))
    if read != sum(r.bytes for r in rows) or written != read + sum(r.added for r in rows):
        fs.delete_dir(f"{base}.new")
        raise OSError(f"files changed while they were compacted: {folder}")
    fs.move(base, f"{base}.old")
    fs.move(f"{base}.new", base)
    fs.delete_dir(f"{base}.old")
    return spark.createDataFrame([(r.bin, r.n_files, r.bytes) for r in rows], "bin long, n_files long, bytes long")
