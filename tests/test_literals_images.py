"""Python literals of judges, images, and compaction."""

import ast
import os
import struct
import zlib

import pytest

from cubeloom.functions import text as T
from cubeloom.sources import compact, images

ANSWERS = {
    """{"pred": "it's no", "score": 4}""": ("it's no", 4.0),
    "{'pred': 'yes', 'score': -1}": ("yes", -1.0),
    "{'note': \"'pred': 'no'\", 'pred': 'yes'}": ("yes", None),
    "{'pred': 'a\\'b\\n', 'score': '4.5'}": ("a'b\n", 4.5),
    "{'pred': 'x', 'score': +3e0, 'deep': [{'pred': 1}, (2, None)]}": ("x", 3.0),
    "{'a': {'pred': 'inner'}, 'score': True}": (None, None),
    "{'pred': 'first', 'pred': 'last', 'score': .5}": ("last", 0.5),
    "{'pred': 5, 'score': 'five'}": (None, None),
    "{'pred': 'yes', 'score': 1": (None, None),
    "{'pred': 'yes'}}": (None, None),
    "{'pred': 'yes', ]}": (None, None),
    "no {'pred': 'yes'}": (None, None),
    "['pred']": (None, None),
    "{'pred': open('x'), 'score': 1}": (None, None),
    "{'pred': __import__('os')}": (None, None),
    "{'pred': 'nul\\x00', 'score': 1e999}": ("nul\x00", None),
    "": (None, None),
    "{}": (None, None),
    "{" * 400: (None, None),
    "{'pred': 'unended": (None, None),
    "{'pred': u'é', 'score': 1_0}": ("é", 10.0),
}


def test_literals(spark):
    rows = [(i, a) for i, a in enumerate([*ANSWERS, None])]
    got = {r.i: (r.pred, r.score) for r in T.judged(spark.createDataFrame(rows, "i int, answer string"), "answer").collect()}
    assert got == {i: ANSWERS.get(a, (None, None)) for i, a in rows}


def test_literals_agree_with_the_language():
    for a in ANSWERS:
        try:
            value = ast.literal_eval(a.strip())
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            value = {}
        assert T.literal_fields(a) == (value if isinstance(value, dict) else {})


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def header(*fields):
    return images.SIGNATURES["png"] + chunk(b"IHDR", struct.pack(">IIBBBBB", *fields))


GREY = bytes(range(12))
PNG, BMP = images.png(4, 3, GREY), images.bmp(4, 3, GREY)
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x03\x00\x04\x01\x01\x11\x00\xff\xda\x00\x04ab123\xff\xd9"
GIF = b"GIF89a" + struct.pack("<HHBBB", 4, 3, 0xF0, 0, 0) + b"x" * 8 + b"\x3b"
END = chunk(b"IEND", b"")
FILES = [
    (PNG, ("png", 4, 3, 8, None)), (BMP, ("bmp", 4, 3, 8, None)), (JPEG, ("jpeg", 4, 3, 8, None)), (GIF, ("gif", 4, 3, 8, None)),
    (None, (None, None, None, None, "empty")), (b"", (None, None, None, None, "empty")), (b"text", (None, None, None, None, "signature")),
    (PNG[:-1], ("png", None, None, None, "truncated")), (PNG[:20], ("png", None, None, None, "truncated")), (PNG[:40] + b"?" + PNG[41:], ("png", None, None, None, "checksum")),
    (header(0, 3, 8, 0, 0, 0, 0) + END, ("png", None, None, None, "header")), (header(4, 3, 4, 2, 0, 0, 0) + END, ("png", None, None, None, "header")),
    (header(4, 3, 8, 0, 0, 0, 0) + END, ("png", None, None, None, "pixels")), (header(4, 3, 8, 0, 0, 0, 0) + chunk(b"IDAT", b"notz") + END, ("png", None, None, None, "pixels")),
    (header(4, 3, 8, 0, 0, 0, 0) + chunk(b"IDAT", zlib.compress(b"\7" + bytes(14))) + END, ("png", None, None, None, "pixels")),
    (header(4, 3, 8, 0, 0, 0, 0) + chunk(b"IDAT", zlib.compress(bytes(999))) + END, ("png", None, None, None, "pixels")),
    (header(1 << 30, 1 << 20, 8, 2, 0, 0, 0) + END, ("png", None, None, None, "size")), (header(4, 3, 16, 2, 0, 0, 0) + chunk(b"IDAT", zlib.compress(bytes(75))) + END, ("png", 4, 3, 16, None)),
    (BMP[:60], ("bmp", None, None, None, "truncated")), (BMP[:18] + b"\0\0\0\0" + BMP[22:], ("bmp", None, None, None, "header")), (JPEG[:-2], ("jpeg", None, None, None, "truncated")), (JPEG[:8], ("jpeg", None, None, None, "truncated")), (GIF[:-1], ("gif", None, None, None, "truncated")),
]


def test_images(spark):
    df = spark.createDataFrame([(i, data) for i, (data, _) in enumerate(FILES)], "i int, data binary")
    got = {r.i: (r.format, r.width, r.height, r.depth, r.error) for r in images.with_image_facts(df, "data").collect()}
    assert got == {i: want for i, (_, want) in enumerate(FILES)}


def test_valid_images(spark):
    df = spark.createDataFrame([("a.PNG", PNG), ("b.txt", PNG), ("c.jpg", PNG[:-3]), ("d.bmp", BMP), ("e.png", FILES[17][0]), (None, PNG)], "path string, data binary")
    assert sorted(r.path for r in images.valid_images(df, "path", "data").collect()) == ["a.PNG", "d.bmp"]


def files(folder, sizes):
    os.makedirs(folder)
    for i, n in enumerate(sizes):
        with open(f"{folder}/{i:04d}.txt", "w") as f:
            f.write("\n".join([f"{i}"] * n) + ("\n" if i % 2 else ""))


def lines(folder):
    return sorted(x for f in os.listdir(folder) if not f.startswith(".") for x in open(f"{folder}/{f}").read().splitlines())


def test_compaction(spark, tmp_path):
    folder = f"{tmp_path}/in"
    files(folder, [1, 3, 2, 50, 1, 1, 1, 0, 4])
    before, sizes = lines(folder), [os.path.getsize(f"{folder}/{f}") for f in sorted(os.listdir(folder))]
    want, total = {}, 0
    for n in sizes:
        want.setdefault(total // 20, []).append(n)
        total += n
    rows = {r.bin: (r.n_files, r.bytes) for r in compact.compact(spark, f"file://{folder}", 20).collect()}
    assert rows == {k: (len(v), sum(v)) for k, v in want.items()}
    assert lines(folder) == before and len(os.listdir(folder)) == len(want)
    assert sorted(os.listdir(tmp_path)) == ["in"]


def test_compaction_that_was_cut_off(spark, tmp_path):
    folder = f"{tmp_path}/in"
    files(folder, [2, 2])
    before = lines(folder)
    os.makedirs(f"{folder}.new")  # cut off while copying
    compact.recover(f"file://{folder}")
    assert lines(folder) == before and os.listdir(tmp_path) == ["in"]
    os.rename(folder, f"{folder}.old")  # cut off between the two moves
    files(f"{folder}.new", [2, 2])
    compact.recover(f"file://{folder}")
    assert lines(folder) == before and os.listdir(tmp_path) == ["in"]


def test_compaction_of_a_file_that_cannot_be_read(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/in"
    files(folder, [2, 2, 2])
    before = lines(folder)
    monkeypatch.setattr(compact, "_copied", lambda *_: lambda batches: (_ for _ in ()).throw(OSError("no")))
    with pytest.raises(Exception, match="no"):
        compact.compact(spark, f"file://{folder}", 4)
    assert lines(folder) == before
