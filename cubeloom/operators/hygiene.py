"""Validity of samples and rewriting of their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count

ROLES = ("human", "gpt")


def valid_roles(conversation: Column) -> Column:
    """Every turn has a known role and a value; a missing dialogue is valid, a malformed turn isn't."""
    return F.coalesce(F.forall(conversation, lambda t: F.coalesce(t["from"].isin(*ROLES) & (t["value"] != ""), F.lit(False))), F.lit(True))


def valid_length(captions: Column, images: Column, low: int = 1, high: int = 16_384, per_word: float = 1.5, per_image: int = 5 * 64) -> Column:
    """At least ``low`` caption tokens, and ``low`` to ``high`` together with the images'."""
    text = F.aggregate(captions, F.lit(0.0), lambda acc, c: acc + word_count(F.coalesce(c, F.lit(""))) * per_word)
    return (text >= low) & (text + images * per_image).between(low, high)


def has_modality(*fields: Column) -> Column:
    return F.coalesce(*fields).isNotNull()


def has_placeholder(conversation: Column, tag: str = "<image>") -> Column:
    return F.exists(conversation, lambda t: F.coalesce(t["value"].contains(tag), F.lit(False)))


def valid_frames(frames: Column, low: int, high: int = -1) -> Column:
    return (frames >= low) & (F.lit(True) if high <= 0 else frames <= high)


def admitted(slots_text: Column, slots_image: Column) -> Column:
    """An interleaved document is taken if its sides are as long, two slots or more, the first an image."""
    return (F.size(slots_text) == F.size(slots_image)) & (F.size(slots_image) >= 2) & F.get(slots_image, F.lit(0)).isNotNull()


def without_last_image(slots: Column, slots_image: Column) -> Column:
    """The slots, but the last one if it is an image."""
    return F.when(F.element_at(slots_image, -1).isNotNull(), F.slice(slots, F.lit(1), F.size(slots) - 1)).otherwise(slots)


def first_whole_caption(captions: Column) -> Column:
    """Content of the first entry whose idx is '-1'; null if none."""
    return F.get(F.filter(captions, lambda c: c["idx"] == "-1"), F.lit(0))["content"]


def filter_samples(df: DataFrame, *checks: Column) -> DataFrame:
    """Rows that pass every check (all count, not only the last)."""
    for c in checks:
        df = df.where(c)
    return df


def rewrite_paths(df: DataFrame, field: str, pattern: str, to: str) -> DataFrame:
    """A regular expression's replacement in a string field, or in every entry of an array field."""
    one = lambda c: F.regexp_replace(c, pattern, to)
    return df.withColumn(field, F.transform(field, one) if df.schema[field].dataType.typeName() == "array" else one(F.col(field)))


def all_valid(df: DataFrame, key: str, valid: Column) -> DataFrame:
    """Keys all of whose rows are valid."""
    return df.groupBy(key).agg(F.bool_and(F.coalesce(valid, F.lit(False))).alias("_all")).where("_all").drop("_all")


def routed(category: Column, routes: dict[str, tuple[str, ...]], other: str | None = None) -> Column:
    """The route whose list has the category, for a write partitioned by it."""
    out = F.lit(other)
    for name, members in reversed(routes.items()):
        out = F.when(category.isin(*members), F.lit(name)).otherwise(out)
    return out


def fan_out(df: DataFrame, slots: Column, thresholds: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """A row for each n of which the document has 2n slots or more, in gt."""
    return df.withColumn("gt", F.explode(F.filter(F.array(*[F.lit(n) for n in thresholds]), lambda n: slots >= 2 * n)))
