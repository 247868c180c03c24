"""JSON files that are one array or one object, read by many tasks.

A file is read as pieces that end at a mark, a closing brace or a comma, which Spark's text reader cuts
and deals out by byte ranges. Whether a piece begins inside a string, and how deep it stands, follows
from all pieces before it: each range is summed up first (does it turn strings inside out, and how far
does it go down, beginning outside or inside a string), a fold over the ranges gives each one's
beginning, and a second reading cuts an element wherever a piece ends at the top. What lies over the
edges of ranges is one beginning, one end or one middle for each range, and these are joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..workspace import Scratch

#: Marks at which pieces end: BRACE for elements that are objects, COMMA for any.
BRACE, COMMA = "}", ","
_OPENING = re.compile(rb"(?:\s|\xef\xbb\xbf)*[\[{]")
#: How far each byte goes down.
_DOWN = np.zeros(256, np.int8)
_DOWN[list(b"{[")], _DOWN[list(b"}]")] = 1, -1
#: What may stand around an element.
_BLANK = " \t\n\x0b\f\r,"
_RANGE = "file string, start long"
#: What a cut piece of text is: a whole element, the end of one from an earlier range, the beginning of one, or a range's whole text.
WHOLE, END, BEGINNING, MIDDLE = range(4)


def brackets(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text's bytes: the places of the quotes that open or close a string, of the brackets, and whether each bracket has an odd number of those quotes before it."""
    quotes, back = np.flatnonzero(text == ord('"')), np.flatnonzero(text == ord("\\"))
    if len(back):
        first = np.flatnonzero(np.diff(back, prepend=-2) != 1)  # of each run of backslashes; an odd run escapes what follows it
        length = np.diff(first, append=len(back))
        quotes = np.setdiff1d(quotes, (back[first] + length)[length % 2 == 1], assume_unique=True)
    places = np.flatnonzero(_DOWN[text])
    return quotes, places, np.searchsorted(quotes, places) % 2 == 1


def pieces(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """file, start (of the byte range) and piece, without the mark that ends it; a range's pieces are in order in one task."""
    rows = spark.read.option("lineSep", mark).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("piece"))


def _texts(batch: pa.RecordBatch, mark: str) -> Iterator[tuple[tuple[str, int], bytes]]:
    """Each range that a batch has pieces of, and these as one text with their marks: a piece is small, and work is done by batch."""
    file, start, piece = batch.columns
    if not len(piece):
        return
    changes = (np.diff(start.to_numpy()) != 0) | (np.diff(file.dictionary_encode().indices.to_numpy()) != 0)
    edges = [0, *(np.flatnonzero(changes) + 1).tolist(), len(piece)]
    for low, high in zip(edges, edges[1:]):
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, high - low], pa.int32()), piece.slice(low, high - low)), mark)
        yield (file[low].as_py(), start[low].as_py()), (joined[0].as_py() + mark).encode()


def _summed(mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[str, int], list] = {}
        for batch in batches:
            for at, data in _texts(batch, mark):
                text = np.frombuffer(data, np.uint8)
                quotes, places, odd = brackets(text)
                down = _DOWN[text[places]].astype(np.int64)
                ways = state.setdefault(at, [0, False, 0, True])
                ways[0] += int(down[odd == ways[1]].sum())
                ways[2] += int(down[odd == ways[3]].sum())
                if len(quotes) % 2:
                    ways[1], ways[3] = ways[3], ways[1]
        rows = [(*at, *ways) for at, ways in state.items()]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], ["file", "start", "down", "ends", "down_inside", "ends_inside"])

    return run


def beginnings(ranges: DataFrame) -> dict[tuple[str, int], tuple[bool, int]]:
    """Whether each range begins inside a string, and how deep: a fold over one row for each split of the input."""
    out, file, inside, depth = {}, None, False, 0
    for r in ranges.orderBy("file", "start").toLocalIterator():
        if r.file != file:
            file, inside, depth = r.file, False, 0
        out[r.file, r.start] = (inside, depth)
        depth, inside = (depth + r.down_inside, r.ends_inside) if inside else (depth + r.down, r.ends)
    return out


def _cut(first: dict[tuple[str, int], tuple[bool, int]], mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, inside, depth, held, ended = None, False, 0, [], False

        def made(parts: list[int], texts: pa.Array) -> pa.RecordBatch:
            n = len(texts)
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(now[0], pa.string()), n), pa.repeat(pa.scalar(now[1], pa.int64()), n), pa.array(parts, pa.int32()), texts], ["file", "start", "part", "text"])

        def rest() -> Iterator[pa.RecordBatch]:
            if held:
                yield made([BEGINNING if ended else MIDDLE], pa.array([b"".join(held).decode()]))

        for batch in batches:
            for at, data in _texts(batch, mark):
                if at != now:
                    yield from rest()
                    now, held, ended = at, [], False
                    inside, depth = first[now]
                own = _OPENING.match(data) if depth == 0 and not inside else None
                text = np.frombuffer(data, np.uint8)
                quotes, places, odd = brackets(text)
                places = places[odd == inside]
                depths = depth + np.cumsum(_DOWN[text[places]], dtype=np.int64)
                if mark == BRACE:
                    cuts = places[(text[places] == ord(BRACE)) & (depths == 1)] + 1
                else:
                    commas = np.flatnonzero(text == ord(COMMA))
                    commas = commas[(np.searchsorted(quotes, commas) % 2 == 1) == inside]
                    cuts = commas[np.isin(np.append(depth, depths)[np.searchsorted(places, commas)], (0, 1))] + 1
                begin = own.end() if own else 0
                if len(cuts):
                    held.append(data[begin : cuts[0]])
                    others = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data))
                    yield made([WHOLE if ended else END, *[WHOLE] * len(others)], pa.concat_arrays([pa.array([b"".join(held).decode()]), others]))
                    begin, held, ended = int(cuts[-1]), [], True
                if begin < len(data):
                    held.append(data[begin:])
                depth = int(depths[-1]) if len(depths) else depth
                inside ^= len(quotes) % 2 == 1
        yield from rest()

    return run


def elements(spark: SparkSession, path: str, mark: str = BRACE) -> DataFrame:
    """file and text of each element directly inside a file's outer array or object; in an object the text begins with the key.

    A file that ends inside an element is an error, as soon as its rows are read."""
    scratch = Scratch(spark, "json")
    # Written, since a sort samples its rows first, which would sum all ranges up twice.
    first = beginnings(scratch.save(pieces(spark, path, mark).mapInArrow(_summed(mark), f"{_RANGE}, down long, ends boolean, down_inside long, ends_inside boolean"), "ranges"))
    cut = scratch.save(pieces(spark, path, mark).mapInArrow(_cut(first, mark), f"{_RANGE}, part int, text string"), "elements")
    # At most two rows for each range: its first element's end, and its last one's beginning.
    w = Window.partitionBy("file").orderBy("start", F.col("part") == BEGINNING).rowsBetween(Window.unboundedPreceding, -1)
    edges = cut.where(F.col("part") != WHOLE).withColumn("element", F.count_if(F.col("part") == END).over(w))  # an element lasts up to its end
    parts = F.array_sort(F.collect_list(F.struct("start", "part", "text")))
    joined = edges.groupBy("file", "element").agg(parts.alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["text"]), "")
    open_ = ~F.element_at("p", -1)["part"].eqNullSafe(END) & text.rlike(r"[^\s,\]}]")
    joined = joined.select("file", F.when(open_, F.raise_error(F.concat(F.lit("a JSON file ends inside an element: "), "file")).cast("string")).otherwise(text).alias("text"))
    every = cut.where(F.col("part") == WHOLE).select("file", "text").unionByName(joined)
    return every.where(F.ltrim("text", F.lit(_BLANK + "]}")) != "").select("file", F.btrim("text", F.lit(_BLANK)).alias("text"))


def array_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of files that are one array."""
    return elements(spark, path).select(F.from_json("text", schema).alias("r")).select("r.*")


def object_rows(spark: SparkSession, path: str, value: str) -> DataFrame:
    """key and value of files that are one object; value is the values' type. Of a repeated key each value is a row."""
    nested = value.strip().lower().startswith(("struct", "map"))
    found = elements(spark, path, BRACE if nested else COMMA)
    # By commas, the last element still has the file's own brace.
    text = F.col("text") if nested else F.when(F.from_json(F.concat(F.lit("{"), "text", F.lit("}")), f"map<string,{value}>").isNotNull(), F.col("text")).otherwise(F.regexp_replace("text", r"\}$", ""))
    return found.select(F.explode(F.from_json(F.concat(F.lit("{"), text, F.lit("}")), f"map<string,{value}>")).alias("key", "value"))
