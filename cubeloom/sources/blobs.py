"""Frames and media of stores and folders, and the offset index of a line-based file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import multiplied
from ..workspace import Scratch


def line_index(df: DataFrame, line: str, order: str) -> DataFrame:
    """df with byte_offset and line: where each line would begin in one file, a newline after each.

    Offsets inside a sorted partition, then the partitions' totals before it: no task holds the table."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("_id", F.monotonically_increasing_id())
    # Written, since it is read twice: a second range partitioning would sample anew and cut elsewhere.
    placed = Scratch(df.sparkSession, "lines").save(placed, "rows").withColumn("_part", F.shiftright("_id", 33))
    size = (F.octet_length(line) + 1).cast("long")
    inside = Window.partitionBy("_part").orderBy("_id")
    here = placed.withColumns({"_size": size, "_at": F.sum(size).over(inside) - size, "_n": F.row_number().over(inside) - 1})
    totals = placed.groupBy("_part").agg(F.sum(size).alias("_total"), F.count("*").alias("_rows"))
    w = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_part", F.coalesce(F.sum("_total").over(w), F.lit(0)).alias("_base"), F.coalesce(F.sum("_rows").over(w), F.lit(0)).alias("_first"))
    out = here.join(before, "_part").withColumns({"byte_offset": F.col("_at") + F.col("_base"), "line": F.col("_n") + F.col("_first")})
    return out.select(*df.columns, "byte_offset", "line")


def stored_or(df: DataFrame, decoded: str, frames: str = "frames") -> DataFrame:
    """df with frames from a store (tsvstore.looked_up), or else its own decoded ones."""
    return df.withColumn(frames, F.coalesce(frames, decoded))


def existing_frames(clips: DataFrame, listing: DataFrame, key: str) -> DataFrame:
    """Each clip's wanted frame numbers that have a file, ascending, in frames; clips without any are left out.

    clips: key and wanted (an array). listing: key and frame."""
    each = clips.select(key, F.explode("wanted").alias("frame")).join(multiplied(listing), [key, "frame"], "left_semi")
    return each.groupBy(key).agg(F.sort_array(F.collect_list("frame")).alias("frames"))


def write_media(df: DataFrame, folder: str, name: str, payload: str) -> DataFrame:
    """Writes each payload to folder/name unless it is there, when run; name and whether it was written.

    The folder is any that pyarrow's file systems reach. A file appears under its name only when whole."""

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for batch in batches:
            new = []
            for n, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                there = fs.get_file_info(f"{base}/{n}").type != pafs.FileType.NotFound
                if not there:
                    with fs.open_output_stream(f"{base}/.{n}.part", compression=None) as f:
                        f.write(data)
                    fs.move(f"{base}/.{n}.part", f"{base}/{n}")
                new.append(not there)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new)], ["name", "written"])

    return df.select(F.col(name).cast("string").alias("name"), F.col(payload).cast("binary").alias("payload")).mapInArrow(run, "name string, written boolean")
