"""Labels of a dialogue's tokens: the ids where an answer is learned, IGNORE elsewhere.

The labels of three chat styles follow from token counts of parts of the prompt, each part tokenized
by itself. If the parts' tokens don't add up to the prompt's, the whole row is ignored: a token that
reaches over a boundary, a dialogue that ends with a question, a separator inside a text.

A tokenizer is a function from a text column to a column of ids. One that gives offsets is taken by
``offset_labels``, which merges the turns' spans of characters with the tokens' spans in one pass.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chat import Template, render
from .tokens import IGNORE, piece_count, piece_ids

Tokenizer = Callable[[Column], Column]
#: Tokens at the start of a question that stay learned in the role style: the sign and the name (a fixed value).
ROLE_SIGN, ROLE_KEPT = "### ", 2


def answerable(turns: Column) -> Column:
    """turns (array of struct from, value) without a first one that isn't human's."""
    return F.when(F.get(turns, F.lit(0))["from"] != "human", F.slice(turns, F.lit(2), F.greatest(F.size(turns) - 1, F.lit(0)))).otherwise(turns)


def alternating(turns: Column) -> Column:
    """Whether human and gpt take turns, human first."""
    return F.forall(F.transform(turns, lambda t, i: t["from"] == F.when(i % 2 == 0, "human").otherwise("gpt")), lambda x: x)


def _labelled(ids: Column, learned: Column, fits: Column) -> Column:
    """Labels of ids; learned is cut or filled up with False."""
    n = F.size(ids)
    flags = F.slice(F.concat(learned, F.array_repeat(F.lit(False), n)), F.lit(1), n)
    return F.zip_with(ids, flags, lambda i, x: F.when(fits & x, i).otherwise(F.lit(IGNORE)))


def _with_bos(ids: Column, bos: int | None) -> Column:
    return ids if bos is None else F.concat(F.array(F.lit(bos)), ids)


def _repeat(flag: bool, n: Column) -> Column:
    return F.array_repeat(F.lit(flag), F.greatest(n, F.lit(0)).cast("int"))


def _count(tokenizer: Tokenizer, text: Column) -> Column:
    """How many tokens a text has."""
    return piece_count(text) if tokenizer is piece_ids else F.size(tokenizer(text))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _by_rounds(turns: Column, template: Template, tokenizer: Tokenizer, limit: int | None, bos: int | None, after: Callable[[Column], Column | int]) -> Column:
    """Questions and headers of each round are ignored. after: tokens between rounds, by the number of rounds.

    Catalyst puts an expression in every place that names its column, so that a round's work would be that of the whole text: values are bound."""
    mark = template.sep + template.roles[1]
    cut = lambda text: F.split(text, re.escape(template.sep), -1)
    second = lambda parts, i: F.coalesce(F.concat(F.lit(template.sep), F.get(parts, i + 1)), F.lit(""))
    paired = lambda parts: F.transform(F.sequence(F.lit(0), F.size(parts) - 1, F.lit(2)), lambda i: F.concat(F.get(parts, i), second(parts, i)))
    start = lambda i: F.when(i == 0, F.lit(0 if bos is None else 1)).otherwise(F.lit(0))

    def flags(one: Column, i: Column, between: Column) -> Column:
        """Null for a round that isn't one question and one answer."""
        asked = lambda sides: _count(tokenizer, F.concat(F.get(sides, F.lit(0)), F.lit(mark))) + start(i)
        whole = _count(tokenizer, one) + start(i) + between
        sized = lambda sides: _bound(F.struct(asked(sides).alias("asked"), whole.alias("whole")), lambda n: F.concat(_repeat(False, n["asked"]), _repeat(True, n["whole"] - n["asked"])))
        return _bound(F.split(one, re.escape(mark), -1), lambda sides: F.when((one != "") & (F.size(sides) == 2), sized(sides)))

    def learned_of(rounds: Column) -> Column:
        each = _bound(F.size(rounds), lambda n: _bound(F.lit(0) + after(n), lambda between: F.transform(rounds, lambda one, i: flags(one, i, between))))
        # Rounds behind the first bad one don't count.
        until = lambda all_: F.array_position(F.transform(all_, lambda x: x.isNull()), F.lit(True)).cast("int")
        return _bound(each, lambda all_: F.flatten(_bound(until(all_), lambda bad: F.when(bad > 0, F.slice(all_, F.lit(1), bad - 1)).otherwise(all_))))

    def labelled(ids: Column, learned: Column) -> Column:
        fits = F.size(learned) == F.size(ids)
        fits = fits if limit is None else fits | (F.size(learned) >= limit)
        return F.struct(ids.alias("ids"), _bound(fits, lambda f: _labelled(ids, learned, f)).alias("labels"))

    def made(text: Column) -> Column:
        ids = _with_bos(tokenizer(text), bos)
        ids = ids if limit is None else F.slice(ids, 1, limit)
        return _bound(ids, lambda own: _bound(_bound(cut(text), lambda parts: _bound(paired(parts), learned_of)), lambda learned: labelled(own, learned)))

    return _bound(render(template, turns, system=""), made)


def round_labels(turns: Column, template: Template, tokenizer: Tokenizer = piece_ids, limit: int | None = None) -> Column:
    """ids and labels of a prompt whose rounds end with the separator, which is learned with the answer."""
    return _by_rounds(turns, template, tokenizer, limit, None, lambda _: _count(tokenizer, F.lit(template.sep)))


def header_labels(turns: Column, template: Template, tokenizer: Tokenizer = piece_ids, bos: int = 1, limit: int | None = None) -> Column:
    """ids and labels of a prompt with header tokens: a beginning token that only the first round has, and one token between rounds."""
    return _by_rounds(turns, template, tokenizer, limit, bos, lambda n: F.when(n > 1, 1).otherwise(0))


def role_labels(turns: Column, system: str, names: tuple[str, str], tokenizer: Tokenizer = piece_ids, bos: int | None = None) -> Column:
    """ids and labels of a prompt of '### Name: text' lines: the system text and questions are ignored, but for the first tokens of a question.

    Every part counts a beginning token if there is one, so that later parts are out of step by as many, as published."""
    name = lambda t: F.when(F.lower(t["from"]) == "human", names[0]).when(F.lower(t["from"]) == "gpt", names[1]).otherwise(F.lit("unknown"))
    said = F.transform(turns, lambda t: F.struct(F.concat(F.lit(ROLE_SIGN), name(t), F.lit(": "), t["value"], F.lit("\n")).alias("text"), (t["from"] == "human").alias("asks")))
    head = F.lit(f"{system}\n\n")
    ids = _with_bos(tokenizer(F.concat(head, F.array_join(F.transform(said, lambda s: s["text"]), ""), F.lit(ROLE_SIGN))), bos)
    size = lambda text: _count(tokenizer, text) + (0 if bos is None else 1)
    piece = lambda s: F.when(s["asks"], F.concat(_repeat(True, F.least(size(s["text"]), F.lit(ROLE_KEPT))), _repeat(False, size(s["text"]) - ROLE_KEPT))).otherwise(_repeat(True, size(s["text"])))
    learned = F.concat(_repeat(False, size(head)), F.flatten(F.transform(said, piece)), _repeat(True, F.size(ids)))
    return F.struct(ids.alias("ids"), _labelled(ids, learned, F.lit(True)).alias("labels"))


def answer_spans(turns: Column, template: Template) -> Column:
    """Spans of characters (start, end, learned) that cover a prompt: heads and questions, then answers with their separator."""
    name = lambda t: F.when(t["from"] == "human", F.lit(template.roles[0])).otherwise(F.lit(template.roles[1]))
    piece = lambda n, learned: F.struct(n.alias("n"), learned.alias("learned"))
    sizes = F.flatten(F.transform(turns, lambda t: F.array(piece(F.length(name(t)), F.lit(False)), piece(F.length(t["value"]) + len(template.sep), t["from"] != "human"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,learned:boolean>>").alias("spans"))
    add = lambda acc, s: F.struct((acc["at"] + s["n"]).alias("at"), F.concat(acc["spans"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + s["n"]).alias("end"), s["learned"].alias("learned")))).alias("spans"))
    return F.aggregate(sizes, zero, add, lambda acc: acc["spans"])


def merged(starts: np.ndarray, ends: np.ndarray, span_ends: np.ndarray, learned: np.ndarray) -> np.ndarray | None:
    """Whether each token lies in a learned span, both in order of place; None if a token reaches over the end of a span."""
    of = np.searchsorted(span_ends, starts, "right")
    if len(starts) and (of[-1] >= len(span_ends) or (ends > span_ends[np.minimum(of, len(span_ends) - 1)]).any()):
        return None
    return learned[of]


def offset_labels(df: DataFrame, key: str, text: str, spans: str, tokenizer: Callable[[str], tuple[list[int], list[int], list[int]]]) -> DataFrame:
    """key, ids and labels of every row, by a tokenizer that gives ids and where each begins and ends in the text. A token over a boundary ignores the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = [], []
            for said, covered in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own, starts, ends = tokenizer(said)
                own = np.array(own, np.int32)
                flags = merged(np.array(starts, np.int64), np.array(ends, np.int64), np.array([s["end"] for s in covered], np.int64), np.array([s["learned"] for s in covered], bool))
                ids.append(own)
                labels.append(np.where(flags, own, IGNORE) if flags is not None else np.full(len(own), IGNORE, np.int32))
            lists = [pa.array(x, pa.list_(pa.int32())) for x in (ids, labels)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], [key, "ids", "labels"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text, spans).mapInArrow(run, f"{key} {kind}, ids array<int>, labels array<int>")
