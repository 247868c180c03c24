"""Byte-level BPE by the tiktoken library: encoding of whole texts, and decoding to bytes.

Long texts are cut before a white-space character that follows a solid one: no match of the pattern
spans such a place, so the parts' ids are the text's ids. A run of white space that would overflow
the library's regular expression is one match but for its last character (or whole, at the end of
the text), and is given to the library as that one match.

Defined results: a null text is the empty text, with no ids. Rows are independent: repeated rows and
equal or null doc_ids each give a row. Other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters in a part, and in a run of white space that the library isn't given.
PART, RUN = 200_000, 100_000
#: White space as the library's expressions know it.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(rf"[^{WHITE}](?=[\t-\r ])")
_RUN = re.compile(rf"[{WHITE}]{{{RUN},}}")
_encodings: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """tiktoken's Encoding, once in each Python worker."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encodings[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def parts(text: str, size: int = PART) -> Iterator[str]:
    """Parts of ``size`` characters or more, cut at safe places; the text is all of them in a row."""
    lo = 0
    while len(text) - lo > size and (cut := _SAFE.search(text, lo + size - 1)):
        yield text[lo : cut.end()]
        lo = cut.end()
    yield text[lo:]


def encode(text: str, path: str, pattern: str, size: int = PART) -> list[int]:
    own = encoding(path, pattern)
    if len(text) <= size:
        return own.encode_ordinary(text)
    out: list[int] = []
    for part in parts(text, size):
        at = 0
        for run in _RUN.finditer(part):
            out += own.encode_ordinary(part[at : run.start()])
            at = run.end() - (run.end() < len(part))
            out += own._encode_single_piece(part[run.start() : at])
        out += own.encode_ordinary(part[at:])
    return out


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (binary: 4 bytes each, little-endian) and decoded (binary) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(path, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                ids = [encode(t or "", path, pattern) for t in some.column(1).to_pylist()]
                decoded = [own.decode_bytes(x) for x in ids]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([np.array(x, "<u4").tobytes() for x in ids], pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, decoded binary")
