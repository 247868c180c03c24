"""Calls from rows to what lives outside: codecs, fetches, judges. The callable is given; the operator repeats and reports."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def called(df: DataFrame, call: Callable, inputs: list[Column], schema: str, attempts: int = 10) -> DataFrame:
    """df with the fields of schema, which ``call(*inputs)`` returns as a tuple, and error.

    A call that raises is repeated up to ``attempts`` times; then the fields are null and error says why, and the row
    stays. It serves image and video decoders, loaders of URLs, encoders that write a clip and return its
    path, and judge models. Columns of df named like a field are replaced. A task holds one Arrow batch of results."""
    fields = [f.name for f in StructType.fromDDL(schema)] + ["error"]
    rows = df.drop(*fields)
    body = rows.select(F.struct("*").alias("row"), F.struct(*[c.alias(f"_{i}") for i, c in enumerate(inputs)]).alias("given"))
    types = to_arrow_schema(StructType.fromDDL(f"{schema}, error string"))

    def one(given: tuple) -> tuple:
        for _ in range(attempts):
            try:
                return (*call(*given), None)
            except Exception as e:  # whatever a codec raises
                said = f"{type(e).__name__}: {e}"
        return (*[None] * (len(fields) - 1), said)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(tuple(g.values())) for g in batch.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in found], f.type) for i, f in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["row", *fields])

    return body.mapInArrow(run, f"row {body.schema['row'].dataType.simpleString()}, {schema}, error string").select("row.*", *fields)


FRAMES = "images array<string>, timestamps array<double>"


def with_frames(df: DataFrame, decode: Callable, inputs: list[Column], attempts: int = 10, least: int = 0) -> DataFrame:
    """Rows whose video ``decode`` gives (images, timestamps) of, ``least`` frames or more; those it fails for are left out."""
    return called(df, decode, inputs, FRAMES, attempts).where(F.col("error").isNull() & (F.size("images") >= least)).drop("error")


def judged(df: DataFrame, prompt: Column, judge: Callable[[str], str], score: Callable[[Column], Column], attempts: int = 10) -> DataFrame:
    """df with response (the judge's), error, and score, a column of the response; null where every attempt failed."""
    out = called(df, lambda text: (judge(text),), [prompt], "response string", attempts)
    return out.withColumn("score", F.when(F.col("error").isNull(), score(F.col("response"))))


def table_function(generate: Callable[..., Iterable[tuple]], schema: str):
    """A generator of rows as a table function, to be registered or joined laterally."""

    class Generated:
        def eval(self, *args):
            yield from generate(*args)

    return F.udtf(Generated, returnType=schema)
