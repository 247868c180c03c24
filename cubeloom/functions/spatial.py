"""Geometry of images: patches, resizing, padding, position codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_long = lambda c: c.cast("long")


def patch_grid(width: Column, height: Column, patch: int) -> Column:
    return F.struct(_long(F.ceil(width / patch)).alias("columns"), _long(F.ceil(height / patch)).alias("rows"))


def _boxes(xs: Column, ys: Column, patch: int) -> Column:
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.struct(_long(x).alias("left"), _long(y).alias("top"), _long(x + patch).alias("right"), _long(y + patch).alias("bottom")))))


def sliding_patches(width: Column, height: Column, patch: int, overlap: float = 0.0) -> Column:
    """Boxes of patches at a stride of patch * (1 - overlap), centred; none if the image is smaller."""
    stride = int(patch * (1 - overlap))

    def starts(size: Column) -> Column:
        n = F.floor((size - patch) / stride) + 1
        first = F.floor((size - (n - 1) * stride - patch) / 2)
        return F.when(n >= 1, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: first + i * stride)).otherwise(F.array().cast("array<long>"))

    return _boxes(starts(width), starts(height), patch)


def tiled_patches(width: Column, height: Column, patch: int) -> Column:
    """Boxes that tile the image from the top left; the last ones reach over the edge."""
    starts = lambda size: F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(size / patch).cast("long") - 1), lambda i: i * patch)
    return _boxes(starts(width), starts(height), patch)


def letterbox(width: Column, height: Column, target_w: Column, target_h: Column) -> Column:
    """Size after resizing into the target, and where it is pasted."""
    sw, sh = target_w / width, target_h / height
    w = F.when(sw < sh, target_w).otherwise(F.least(F.ceil(width * sh), target_w))
    h = F.when(sw < sh, F.least(F.ceil(height * sw), target_h)).otherwise(target_h)
    return F.struct(_long(w).alias("new_width"), _long(h).alias("new_height"), _long(F.floor((target_w - w) / 2)).alias("paste_x"), _long(F.floor((target_h - h) / 2)).alias("paste_y"))


def centre_crop(width: Column, height: Column, edge: int) -> Column:
    """Size with the shortest edge at ``edge``, and the centred square's corner."""
    ratio = width / height
    w = F.when(ratio > 1, F.floor(edge * ratio)).otherwise(edge)
    h = F.when(ratio > 1, edge).otherwise(F.floor(edge / ratio))
    return F.struct(_long(w).alias("new_width"), _long(h).alias("new_height"), ((w - edge) / 2).cast("double").alias("left"), ((h - edge) / 2).cast("double").alias("top"))


def square(width: Column, height: Column) -> Column:
    """The side of the square that holds the image, and where it is pasted."""
    side = F.greatest(width, height)
    return F.struct(_long(side).alias("side"), _long(F.floor((side - width) / 2)).alias("paste_x"), _long(F.floor((side - height) / 2)).alias("paste_y"))


def unpad(current_w: Column, current_h: Column, width: Column, height: Column) -> Column:
    """Rows and columns to cut at either side so that the padding of a letterbox goes."""
    tall = width / height > current_w / current_h
    rows = F.when(tall, F.floor((current_h - F.floor(height * (current_w / width))) / 2)).otherwise(0)
    columns = F.when(tall, 0).otherwise(F.floor((current_w - F.floor(width * (current_h / height))) / 2))
    return F.struct(_long(rows).alias("cut_rows"), _long(columns).alias("cut_columns"))


def display_size(width: Column, height: Column, longest: int = 800, shortest: int = 400) -> Column:
    """Size for display: the short edge is the least of longest / aspect, shortest, and itself."""
    high, low = F.greatest(width, height), F.least(width, height)
    short = F.floor(F.least(longest / (high / low), F.lit(float(shortest)), low.cast("double")))
    long = F.floor(short * (high / low))
    return F.struct(_long(F.when(width > height, long).otherwise(short)).alias("new_width"), _long(F.when(width > height, short).otherwise(long)).alias("new_height"))


def grid_side(sides: Column, compat: bool = True, longest: Column | None = None) -> Column:
    """The side for a high-resolution image: always the largest (compat), or the smallest that holds it."""
    largest = F.array_max(sides)
    return largest if compat or longest is None else F.coalesce(F.array_min(F.filter(sides, lambda s: s >= longest)), largest)


def effective_area(width: Column, height: Column, target_w: Column, target_h: Column) -> Column:
    """Pixels of the image that are left after resizing into the target."""
    scale = F.least(target_w / width, target_h / height)
    return F.least(_long(F.floor(width * scale)) * _long(F.floor(height * scale)), _long(width * height))


def sincos(position: Column, dims: int) -> Column:
    """Sines, then cosines, of a position at dims / 2 frequencies."""
    half = dims // 2
    angles = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda i: position * F.pow(F.lit(10000.0), -(i / F.lit(half))))
    return F.concat(F.transform(angles, F.sin), F.transform(angles, F.cos))


def position_code(t: Column, y: Column, x: Column, dims: int) -> Column:
    """A position in time and space: 2/8 of the dimensions for time, 3/8 for each axis."""
    return F.concat(sincos(t, dims // 8 * 2), sincos(y, dims // 8 * 3), sincos(x, dims // 8 * 3))


def normalise(pixels: Column, mean: float, std: float) -> Column:
    return F.transform(pixels, lambda p: (p - mean) / std)


def three_channels(pixels: Column) -> Column:
    """A grey image's values once for each channel."""
    return F.concat(pixels, pixels, pixels)
