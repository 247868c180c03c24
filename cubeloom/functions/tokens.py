"""Token sequences: image placeholders, expansion, padding, label masks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IMAGE_ID, IGNORE = -200, -100


#: Pieces that cover a text whole: a marker, a line break, a word with the space before it, a space, any other character.
PIECES = r"<\|[a-z_]+\|>|\n| ?[A-Za-z0-9]+| |[^A-Za-z0-9 \n]"


def piece_ids(text: Column, vocabulary: int = 30_000) -> Column:
    """A small tokenizer inside the engine: an id from 1 for each of a text's PIECES, by 28 bits of its MD5."""
    bits = lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 7), 16, 10).cast("long")
    return F.transform(F.regexp_extract_all(text, F.lit(PIECES), F.lit(0)), lambda w: (bits(w) % vocabulary + 1).cast("int"))


def piece_count(text: Column) -> Column:
    """How many ids piece_ids gives a text, without their hashes."""
    return F.regexp_count(text, F.lit(PIECES))


def with_image_ids(text: Column, tokenizer: Callable[[Column], Column] = piece_ids, tag: str = "<image>", bos: int | None = None) -> Column:
    """Ids of the text between the tags, an image id for each tag; bos once, at the start."""
    chunks = F.transform(F.split(text, tag, -1), lambda c: tokenizer(c))
    joined = F.flatten(F.transform(chunks, lambda c, i: F.when(i > 0, F.concat(F.array(F.lit(IMAGE_ID)), c)).otherwise(c)))
    return joined if bos is None else F.concat(F.array(F.lit(bos)), joined)


def expand_images(text: Column, patches: Column, before: Column | None = None, tag: str = "<image>", start: str = "", end: str = "") -> Column:
    """Each tag becomes start, as many tags as its image has patches, end; a tag beyond the images stays.

    before: images that earlier turns have used. A text with a tag is stripped."""
    before = F.lit(0) if before is None else before
    chunks = F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), tag, -1)
    known = lambda i: F.get(patches, (before + i - 1).cast("int"))
    fill = lambda i: F.when(known(i).isNull(), F.lit(tag)).otherwise(F.concat(F.lit(start), F.repeat(F.lit(tag), known(i).cast("int")), F.lit(end)))
    joined = F.array_join(F.transform(chunks, lambda c, i: F.when(i > 0, F.concat(fill(i), c)).otherwise(c)), "")
    return F.when(text.contains(tag), joined).otherwise(text)


def expand_dialogue(turns: Column, patches: Column, tag: str = "<image>", start: str = "", end: str = "") -> Column:
    """expand_images over the turns (struct from, value) of a dialogue; images go on from turn to turn."""
    used = lambda i: F.aggregate(F.slice(turns, F.lit(1), i), F.lit(0), lambda n, t: n + F.regexp_count(t["value"], F.lit(tag)))
    return F.transform(turns, lambda t, i: F.struct(t["from"].alias("from"), expand_images(t["value"], patches, used(i), tag, start, end).alias("value")))


def expand_video(text: Column, labels: Column, tag: str = "<image>", thumbnail: bool = False, start: str = "", end: str = "", thumbnail_start: str = "", thumbnail_end: str = "") -> Column:
    """The tag becomes a label (its time as text) and a tag for each frame, after the thumbnail's tag if there is one."""
    frames = F.array_join(F.transform(labels, lambda t: F.concat(t.cast("string"), F.lit(tag))), "")
    small = thumbnail_start + tag + thumbnail_end if thumbnail else ""
    stripped = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(text.contains(tag), F.replace(stripped, F.lit(tag), F.concat(F.lit(start + small), frames, F.lit(end)))).otherwise(text)


def expand_slots(ids: Column, slots: int, fill: int) -> Column:
    """Each image id becomes ``slots`` places for features."""
    return F.flatten(F.transform(ids, lambda x: F.when(x == IMAGE_ID, F.array_repeat(F.lit(fill), slots)).otherwise(F.array(x))))


def padded(ids: Column, length: Column | int, pad: int, left: bool = False) -> Column:
    length = length if isinstance(length, Column) else F.lit(length)
    filler = F.array_repeat(F.lit(pad), F.greatest(length - F.size(ids), F.lit(0)).cast("int"))
    return F.concat(filler, ids) if left else F.concat(ids, filler)


def attention(ids: Column, pad: int) -> Column:
    return F.transform(ids, lambda x: x != pad)


def truncated(ids: Column, length: int) -> Column:
    return F.slice(ids, 1, length)


def restarting_positions(lengths: Column) -> Column:
    """0 .. n-1 for each sample of a pack."""
    return F.flatten(F.transform(F.filter(lengths, lambda n: n > 0), lambda n: F.sequence(F.lit(0), n.cast("int") - 1)))


def divisible_padding(length: Column, parts: int, zigzag: bool = False) -> Column:
    """Pads to a multiple of parts, or of twice the parts for the zigzag order."""
    return F.pmod(-length, F.lit(2 * parts if zigzag else parts))


def with_enough_tags(text: Column, images: Column, tag: str = "<image>") -> Column:
    """A text whose tags are as many as its images; else one tag for each image and a line break come first."""
    own = F.regexp_count(text, F.lit(tag))
    return F.when(own == images, text).otherwise(F.concat(F.repeat(F.lit(tag), images.cast("int")), F.lit("\n"), text))


def video_tag_as_image(text: Column) -> Column:
    """<video> becomes <image>; one is put in front if there is none."""
    changed = F.replace(text, F.lit("<video>"), F.lit("<image>"))
    return F.when(changed.contains("<image>"), changed).otherwise(F.concat(F.lit("<image>\n"), changed))


def with_dummy_image(ids: Column) -> Column:
    """A row without an image gets one at the end."""
    return F.when(F.array_contains(ids, IMAGE_ID), ids).otherwise(F.concat(ids, F.array(F.lit(IMAGE_ID))))
