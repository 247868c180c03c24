"""Is it an image? Headers and pixel data of PNG and BMP files, headers of JPEG and GIF files, looked at in Arrow batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How files of each kind begin, samples for each PNG colour type, and the bit depths that it allows.
SIGNATURES = {"png": b"\x89PNG\r\n\x1a\n", "jpeg": b"\xff\xd8\xff", "gif": b"GIF8", "bmp": b"BM"}
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: Bytes of pixels of a larger image than this aren't unpacked: its size is an error.
LARGEST = 1 << 28
SCHEMA = "format string, width int, height int, depth int, error string"


class Broken(ValueError):
    """What is wrong with a file."""


def _png(data: bytes) -> tuple[int, int, int]:
    at, header, packed, ended = 8, None, [], False
    while at < len(data) and not ended:
        if at + 12 > len(data):
            raise Broken("truncated")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if at + 12 + size > len(data):
            raise Broken("truncated")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise Broken("checksum")
        if header is None:
            if kind != b"IHDR" or size != 13:
                raise Broken("header")
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        ended = kind == b"IEND"
        at += 12 + size
    if header is None or not ended:
        raise Broken("truncated")
    width, height, depth, colour, *_, interlaced = header
    if not width or not height or colour not in DEPTHS or depth not in DEPTHS[colour]:
        raise Broken("header")
    row = (width * SAMPLES[colour] * depth + 7) // 8 + 1
    if row * height > LARGEST:
        raise Broken("size")
    try:
        pixels = zlib.decompressobj()
        rows = pixels.decompress(b"".join(packed), row * height + 1)
    except zlib.error:
        raise Broken("pixels") from None
    if not interlaced and (len(rows) != row * height or any(rows[i] > 4 for i in range(0, len(rows), row))):
        raise Broken("pixels")
    return width, height, depth


def _bmp(data: bytes) -> tuple[int, int, int]:
    if len(data) < 54:
        raise Broken("truncated")
    start, size, width, height, planes, bits = struct.unpack_from("<IIiiHH", data, 10)
    if size < 40 or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height:
        raise Broken("header")
    if (width * bits + 31) // 32 * 4 * abs(height) + start > len(data):
        raise Broken("truncated")
    return width, abs(height), bits if bits <= 8 else 8


def _gif(data: bytes) -> tuple[int, int, int]:
    if len(data) < 14 or data[:6] not in (b"GIF87a", b"GIF89a"):
        raise Broken("header")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    if not data.endswith(b"\x3b"):
        raise Broken("truncated")
    if not width or not height:
        raise Broken("header")
    return width, height, (flags >> 4 & 7) + 1


def _jpeg(data: bytes) -> tuple[int, int, int]:
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise Broken("header")
        kind, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            if at + 9 > len(data):
                break
            depth, height, width = struct.unpack_from(">BHH", data, at + 4)
            if not width or not height:
                raise Broken("header")
            if not data.rstrip(b"\0").endswith(b"\xff\xd9"):
                raise Broken("truncated")
            return width, height, depth
        at += 2 + size
    raise Broken("truncated")


def examined(data: bytes | None) -> tuple[str | None, int | None, int | None, int | None, str | None]:
    """Format, width, height, bits of a sample, and what is wrong: empty, signature, header, truncated, checksum, pixels or size; null if nothing is."""
    if not data:
        return None, None, None, None, "empty"
    kind = next((k for k, s in SIGNATURES.items() if data.startswith(s)), None)
    if kind is None:
        return None, None, None, None, "signature"
    try:
        return kind, *{"png": _png, "bmp": _bmp, "gif": _gif, "jpeg": _jpeg}[kind](data), None
    except Broken as e:
        return kind, None, None, None, str(e)


def with_image_facts(df: DataFrame, payload: str) -> DataFrame:
    """df with the columns of SCHEMA for each payload."""
    names, last = df.columns, len(df.columns)
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [examined(x.as_buffer().to_pybytes() if x.is_valid else None) for x in batch.column(last)]
            columns = zip(*found) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(last)), *(pa.array(c, k) for c, k in zip(columns, kinds))], [*names, *(c.split()[0] for c in SCHEMA.split(", "))])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.select(*names, F.col(payload).alias("_payload")).mapInArrow(run, f"{schema}, {SCHEMA}")


def valid_images(df: DataFrame, path: str, payload: str, suffixes: tuple[str, ...] = ("png", "bmp", "gif", "jpg", "jpeg")) -> DataFrame:
    """Rows whose name has an image's suffix and whose payload decodes to samples of eight bits."""
    known = F.lower(path).rlike(rf"\.({'|'.join(suffixes)})$")
    facts = with_image_facts(df.where(known), payload)
    return facts.where("error IS NULL AND depth = 8").select(*df.columns)


def png(width: int, height: int, grey: bytes) -> bytes:
    """A PNG file of grey samples of eight bits."""
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + grey[i * width : (i + 1) * width] for i in range(height))
    return SIGNATURES["png"] + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def bmp(width: int, height: int, grey: bytes) -> bytes:
    """A BMP file of grey samples of eight bits."""
    row = (width + 3) // 4 * 4
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256))
    start = 54 + len(palette)
    pixels = b"".join(grey[i * width : (i + 1) * width].ljust(row, b"\0") for i in reversed(range(height)))
    return b"BM" + struct.pack("<IHHI", start + len(pixels), 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, len(pixels), 0, 0, 256, 0) + palette + pixels
