"""Shards of sequences: closed forms in a row's place, so that no window is needed beyond its place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .mixture import even_part


def even_shard(number: Column, total: Column, parts: int) -> Column:
    """Contiguous even shards, the first ones longer by one."""
    return even_part(number, total, F.lit(parts))


def ceil_shard(number: Column, total: Column, parts: int) -> Column:
    """Contiguous shards of ceil(total / parts), the last ones shorter or empty."""
    return F.floor(number / F.ceil(total / parts)).cast("long")


def zigzag_shard(number: Column, total: Column, parts: int, even: bool = True) -> Column:
    """Shard r has chunks r and 2 * parts - 1 - r of 2 * parts; chunks are even, or of ceil size."""
    chunk = (even_shard if even else ceil_shard)(number, total, 2 * parts)
    return F.least(chunk, 2 * parts - 1 - chunk)


def video_shard(number: Column, low: Column, high: Column, parts: int) -> Column:
    """Even shards of the video's range [low, high); what comes before goes to the first, what follows to the last."""
    inside = even_part(number - low, high - low, F.lit(parts))
    return F.when(number < low, 0).when(number >= high, parts - 1).otherwise(inside).cast("long")


def token_shard(images_before: Column, is_image: Column, images: Column, parts: int) -> Column:
    """Shard of a token: that of the last image at or before it; the head goes to the first."""
    ordinal = F.greatest(images_before + is_image.cast("int") - 1, F.lit(0))
    return even_part(ordinal, images, F.lit(parts))


def half(place: Column, start: Column, end: Column) -> Column:
    """front or back half of a packed sample [start, end)."""
    return F.when(place < F.floor((start + end) / 2), "front").otherwise("back")
