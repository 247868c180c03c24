"""Frames as a stream: momentum and flag segments with state for each video, and results as they come.

The batch operators see a whole video; these see its frames in order of arrival and keep what the
next frame needs (the last value, the last momentum, the open segment). A video's segment is given out
when the next one begins. Frames of one video that arrive
in one micro-batch are gathered and sorted; later batches must not bring earlier frames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.joins import remaining


def _in_order(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's frames of this micro-batch, which come in several chunks, in their order."""
    return pd.concat(list(batches)).sort_values("frame", kind="stable", ignore_index=True)


def momentum_stream(frames: DataFrame, rate: float = 0.8) -> DataFrame:
    """video, frame and m for a stream of video, frame (its order) and x."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last, m = state.get if state.exists else (0, 0.0, 0.0)
        rows, out = _in_order(batches), []
        for x in rows["x"]:
            out.append(None if seen == 0 else x - last if seen == 1 else rate * (x - last) + (1 - rate) * m)
            m = out[-1] or 0.0
            seen, last = seen + 1, x
        state.update((seen, float(last), float(m)))
        yield pd.DataFrame({"video": key[0], "frame": rows["frame"], "m": pd.array(out, "Float64")})

    return frames.select("video", "frame", "x").groupBy("video").applyInPandasWithState(run, "video long, frame long, m double", "seen long, last double, m double", "append", GroupStateTimeout.NoTimeout)


def segment_stream(frames: DataFrame) -> DataFrame:
    """video, segment, start and stop of each closed segment for a stream of video, frame and flag.

    A source that knows a video's end sends one more frame with a flag, which closes the last segment."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        segment, start, at = state.get if state.exists else (0, 0, 0)
        closed = []
        for flag in _in_order(batches)["flag"]:
            if flag and at > start:
                closed.append((key[0], segment, start, at))
                segment, start = segment + 1, at
            at += 1
        state.update((segment, start, at))
        yield pd.DataFrame(closed, columns=["video", "segment", "start", "stop"])

    return frames.select("video", "frame", "flag").groupBy("video").applyInPandasWithState(run, "video long, segment long, start long, stop long", "segment long, start long, at long", "append", GroupStateTimeout.NoTimeout)


def event_rates(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and mean values by type in tumbling windows; rows later than ``late`` are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("window.start").alias("start"), "event_type", "n", "mean_value")


def append_missing(stream: DataFrame, path: str, key: list[str], schema: str, checkpoint: str):
    """A writer that appends the rows of each micro-batch whose key isn't in path yet: a run can be repeated."""

    def put(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            done = spark.read.schema(schema).json(path).select(*key).distinct()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = spark.createDataFrame([], batch.select(*key).schema)
        remaining(batch.dropDuplicates(key), done, key).write.mode("append").json(path)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)
