"""Answers, prompts and other text."""

from __future__ import annotations

import ast
import math
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

#: The prefixes that answer extraction strips, in this order. Two of them are two phrases
#: run together, so that neither phrase is stripped on its own; extraction depends on it.
ANSWER_PREFIXES = (
    "The best answer is",
    "The correct answer is",
    "The answer is",
    "The answer",
    "The best option isThe correct option is",
    "Best answer:Best option:",
    "Answer:",
)
#: The same with the phrases apart.
SEPARATE_PREFIXES = (
    "The best answer is",
    "The correct answer is",
    "The answer is",
    "The answer",
    "The best option is",
    "The correct option is",
    "Best answer:",
    "Best option:",
    "Answer:",
)


def words(text: Column) -> Column:
    """Words between Unicode white space, empty ones left out."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(words(text)), F.lit(0)).cast("long")


def _stripped(text: Column, compat: bool) -> Column:
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return reduce(lambda s, p: F.replace(s, F.lit(p), F.lit("")), ANSWER_PREFIXES if compat else SEPARATE_PREFIXES, trimmed)


def option_letter(text: Column, maximum: int = 10, compat: bool = True) -> Column:
    """The first capital letter among the first ``maximum`` of the alphabet, answer prefixes stripped; '' if none.

    compat: strips the prefixes as ANSWER_PREFIXES has them, so that 'Best answer: C' gives B."""
    return F.regexp_extract(_stripped(text, compat), f"[A-{chr(64 + maximum)}]", 0)


def first_integer(text: Column, compat: bool = True) -> Column:
    """The first integer after the answer prefixes; null if none."""
    return F.regexp_extract(_stripped(text, compat), r"\d+", 0).try_cast("long")


def option_letters(options: Column) -> Column:
    """'(A) first', '(B) second' ... as an array."""
    return F.transform(options, lambda c, i: F.concat(F.lit("("), F.chr(i + 65), F.lit(") "), c))


def question_prompt(question: Column, options: Column, instruction: str = "") -> Column:
    """The question, its lettered options, and an instruction if given; no white space at the end."""
    whole = F.concat(F.lit("Question: "), question, F.lit("\nOptions:\n"), F.array_join(option_letters(options), "\n"), F.lit("\n" + instruction))
    return F.regexp_replace(whole, r"(?U)\s+$", "")


def answer_choice(answer: Column, options: Column, bare: bool = False) -> Column:
    """'(B)', or 'B', of the answer among the options; the sign before A if it isn't one of them. Of equal options, the last."""
    last = F.when(F.array_contains(options, answer), F.size(options) + 1 - F.array_position(F.reverse(options), answer)).otherwise(0)
    letter = F.chr((last + 64).cast("int"))
    return letter if bare else F.concat(F.lit("("), letter, F.lit(")"))


def option_list(options: Column, lettered: bool = False) -> Column:
    """Each option on a line of its own after 'Options:', as it is or as 'A. first'."""
    each = F.transform(options, lambda c, i: F.concat(F.lit(" "), F.chr(i + 65), F.lit(". "), c)) if lettered else options
    return F.concat(F.lit("Options:\n"), F.array_join(each, "\n"))


#: How options are numbered. Every mark is followed by '. '.
OPTION_STYLES = ("1", "(1)", "(a)", "(A)", "Option 1:")


def styled_options(options: Column, style: Column) -> Column:
    """'Options:' and a numbered line for each option, in one of OPTION_STYLES."""
    digit = lambda i: (i + 1).cast("string")
    mark = lambda i: (
        F.when(style == "1", digit(i)).when(style == "(1)", F.concat(F.lit("("), digit(i), F.lit(")"))).when(style == "(a)", F.concat(F.lit("("), F.chr(i + 97), F.lit(")")))
        .when(style == "(A)", F.concat(F.lit("("), F.chr(i + 65), F.lit(")"))).otherwise(F.concat(F.lit("Option "), digit(i), F.lit(":")))
    )
    return F.concat(F.lit("Options:\n"), F.array_join(F.transform(options, lambda c, i: F.concat(mark(i), F.lit(". "), c)), "\n"))


def name_from_path(path: Column) -> Column:
    """The last part of a path; of a checkpoint folder, its parent's name before it."""
    parts = F.split(F.regexp_replace(path, "^/+|/+$", ""), "/")
    last = F.element_at(parts, -1)
    return F.when(last.startswith("checkpoint-") & (F.size(parts) > 1), F.concat_ws("_", F.try_element_at(parts, F.lit(-2)), last)).otherwise(last)


#: Kinds of text in a Python literal: white space, a string with its escapes, a number, a word, or one sign.
_LITERAL = re.compile(r"""\s+|[rRuUbB]{0,2}(?:'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*")|[+-]?\s*(?:\d[\d_]*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|[A-Za-z_]\w*|[{}\[\](),:]""", re.S)
#: Opening and closing signs, and how deep a literal may go.
_CLOSES, DEPTH = {"{": "}", "[": "]", "(": ")"}, 50


def literal_fields(text: str | None) -> dict[str, object]:
    """The entries of a text that is one Python dictionary of literals, by key; empty if it isn't one. Of a repeated key the last one counts.

    The signs are followed first, so that nothing but brackets in pairs, strings, numbers and words is given to the evaluation."""
    at, stack, text = 0, [], (text or "").strip()
    while at < len(text):
        found = _LITERAL.match(text, at)
        if not found or not text.startswith("{"):
            return {}
        sign, at = found[0], found.end()
        if sign in _CLOSES:
            stack.append(_CLOSES[sign])
            if len(stack) > DEPTH:
                return {}
        elif sign in _CLOSES.values() and (not stack or stack.pop() != sign):
            return {}
    try:
        value = ast.literal_eval(text)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return {}
    return {k: v for k, v in value.items() if isinstance(k, str)} if isinstance(value, dict) else {}


def _number(value: object) -> float | None:
    try:
        out = float(value) if isinstance(value, (int, float, str)) and not isinstance(value, bool) else None
    except (ValueError, OverflowError):
        return None
    return out if out is not None and math.isfinite(out) else None


def judged(df: DataFrame, text: str, pred: str = "pred", score: str = "score") -> DataFrame:
    """df with pred and score of a judge's answer such as {'pred': 'yes', 'score': 4}: a Python literal with quotes, escapes, signs and nesting of any kind.

    An answer that is no dictionary, or lacks an entry, has nulls; so has a pred that isn't a string and a score that is neither a number nor a string of one."""
    names, last = df.columns, len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [literal_fields(t) for t in batch.column(last).to_pylist()]
            preds = pa.array([p if isinstance(p := f.get("pred"), str) else None for f in found], pa.string())
            scores = pa.array([_number(f.get("score")) for f in found], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(last)), preds, scores], [*names, pred, score])

    schema = StructType([*df.schema.fields, StructField(pred, StringType()), StructField(score, DoubleType())])
    return df.select(*names, F.col(text).alias("_text")).mapInArrow(run, schema)


def has_suffix(name: Column, suffixes: tuple[str, ...]) -> Column:
    return F.lower(name).rlike(rf"\.({'|'.join(suffixes)})$")


#: The suffixes of videos and images.
VIDEO_SUFFIXES = ("mp4", "mkv", "avi", "mov", "flv", "wmv", "webm", "m4v")
IMAGE_SUFFIXES = ("jpg", "png", "jpeg", "bmp", "tiff", "webp")


def is_video(name: Column) -> Column:
    return has_suffix(name, VIDEO_SUFFIXES)


def is_image(name: Column) -> Column:
    return has_suffix(name, IMAGE_SUFFIXES)


def is_multimodal(name: Column) -> Column:
    return is_video(name) | is_image(name)


def listed_video(name: Column, suffixes: tuple[str, ...] = ("mp4", "mkv", "avi", "mov", "wmv", "flv", "mjpeg")) -> Column:
    """The suffix after the last dot is one of the list's."""
    return F.lower(F.substring_index(name, ".", -1)).isin(*suffixes)


def without_first_tag(text: Column, tag: str = "<video>") -> Column:
    """The text without the first tag and the white space before it."""
    return F.regexp_replace(text, rf"(?s)^(.*?)\s*{tag}", "$1")


def path_stem(path: Column) -> Column:
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^(.+?)(\.[^.]*)?$", 1)


def path_suffix(path: Column) -> Column:
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+(\.[^.]+)$", 1)


def ends_or_contains(text: Column, keyword: str) -> Column:
    """A stop keyword has been reached."""
    return text.endswith(keyword) | text.contains(keyword)
