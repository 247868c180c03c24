"""Frame indices and times of clips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform_indices(length: Column, n: Column | int) -> Column:
    """Centres of n even parts of ``length`` places, without repeats, ascending."""
    n = n if isinstance(n, Column) else F.lit(n)
    gap = length / n
    return F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.floor(i * gap + gap / 2).cast("long"))))


def frame_grid(frame_rate: Column, frames: Column, fps: Column | float = 1.0, start: Column | None = None, end: Column | None = None) -> Column:
    """Frame numbers picked at ``fps`` a second; a start or end of null or zero is absent."""
    rate = F.least(fps if isinstance(fps, Column) else F.lit(float(fps)), frame_rate)
    first = F.coalesce(F.bround(frame_rate * F.nullif(start, F.lit(0.0))).cast("long"), F.lit(0).cast("long")) if start is not None else F.lit(0).cast("long")
    last = F.coalesce(F.bround(frame_rate * F.nullif(end, F.lit(0.0))).cast("long"), (frames - 1).cast("long")) if end is not None else (frames - 1).cast("long")
    seconds = F.sequence(first, last, F.bround(frame_rate).cast("long"))
    centres = lambda i: F.transform(F.sequence(F.lit(0), F.bround(rate).cast("int") - 1), lambda k: F.floor(i + k * frame_rate / rate + frame_rate / rate / 2).cast("long"))
    return F.when(last >= first, F.flatten(F.transform(seconds, centres))).otherwise(F.array().cast("array<long>"))


def timestamps(indices: Column, frame_rate: Column) -> Column:
    """Seconds with one decimal, half-even."""
    return F.transform(indices, lambda i: F.bround(i / frame_rate, 1))


def pick(values: Column, indices: Column) -> Column:
    """The values at the given places."""
    return F.filter(values, lambda v, i: F.array_contains(indices, i.cast("long")))


def bounded_indices(frames: Column, segments: int, frame_rate: Column, start: Column, end: Column, first: int = 1) -> Column:
    """Frame numbers for ``segments`` even parts of a clip in a folder of ``frames`` numbered files."""
    low = F.greatest(F.lit(first), F.bround(start * frame_rate).cast("int"))
    high = F.least(F.bround(end * frame_rate).cast("int"), frames.cast("int"))
    size = (high - low).cast("double") / segments
    return F.transform(F.sequence(F.lit(0), F.lit(segments - 1)), lambda i: F.floor(low + size / 2 + F.bround(size * i)).cast("long"))


def timecode_seconds(code: Column) -> Column:
    """H:M:S.f as seconds."""
    part = F.split(code, ":")
    return part[0].cast("double") * 3600 + part[1].cast("double") * 60 + part[2].cast("double")


def default_timestamps(start: Column, end: Column, n: Column) -> Column:
    """One a second over the clip, n of them at most, evenly."""
    length = F.greatest(F.bround(end - start).cast("int"), F.lit(1))
    return uniform_indices(length, n)


def resample_rate(frames: Column, fps: Column) -> Column:
    """A clip with under two frames is sampled again at one frame a second more."""
    return F.when(frames < 2, fps + 1).otherwise(fps)
