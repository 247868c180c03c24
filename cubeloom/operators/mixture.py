"""Training mixtures: the specification, repeats, slices, balanced interleaving, shuffles, lengths."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from hashlib import md5
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import word_count


@dataclass(frozen=True)
class Source:
    """A part of a mixture: rows first to last (-1: the end) of path's rows, repeated."""

    path: str
    first: int = 0
    last: int = -1
    repeat: int = 1


def braces(path: str) -> list[str]:
    """a{b,c}d as abd and acd; every combination where there are several groups."""
    parts = re.split(r"\{([^{}]*)\}", path)
    return ["".join(x) for x in product(*[p.split(",") if i % 2 else [p] for i, p in enumerate(parts)])]


def parse_mixture(spec: str) -> list[Source]:
    """Sources of 'path{a,b}.jsonl#first_last*n;...'. The repeat comes last; rows are repeated, then sliced."""
    out = []
    for item in filter(None, (x.strip() for x in spec.split(";"))):
        path, _, repeat = item.partition("*")
        path, _, span = path.partition("#")
        first, last = (int(x) for x in span.split("_")) if span else (0, -1)
        out += [Source(p, first, last, int(repeat or 1)) for p in braces(path)]
    return out


#: Parts of a source's path that make it a video source (fixed values), and the first of them, whose rows' paths get the source's folder.
EGO4D = "ego4d_1fps512frames_"
VIDEO_PARTS = (EGO4D, "video_data", "tsv_data")


def route(path: Column, video_parts: tuple[str, ...] = VIDEO_PARTS) -> Column:
    """The side of a mixture that a source's path belongs to: video if it holds one of the parts (letters as they are), else image."""
    hit = reduce(lambda a, p: a | path.contains(p), video_parts, F.lit(False))
    return F.when(hit, "video").otherwise("image")


def routed_video(video: Column, path: Column) -> Column:
    """A row's video; of ego4d sources behind the name of the folder that the source's file is in."""
    return F.when(path.contains(EGO4D) & video.isNotNull(), F.concat(F.element_at(F.split(path, "/"), -2), F.lit("/"), video)).otherwise(video)


def repeated_slice(df: DataFrame, number: str, total: int, source: Source) -> DataFrame:
    """The rows of df (numbered from 0 to total - 1) repeated, then sliced by position in the repeated list."""
    each = df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(source.repeat - 1)))).withColumn("position", F.col("rep") * F.lit(total) + F.col(number))
    return each.where((F.col("position") >= source.first) & (F.lit(True) if source.last == -1 else F.col("position") < source.last))


def load_mixture(spark: SparkSession, spec: str, schema) -> DataFrame:
    """The bag union of a specification's sources, read as JSON lines, with source and position."""
    from .convert import numbered

    parts = []
    for s in parse_mixture(spec):
        # Rows in the order of files, of their byte ranges, and of lines: a range's lines are in order in one task.
        place = {"_file": F.col("_metadata.file_path"), "_start": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()}
        placed = numbered(spark.read.schema(schema).json(s.path).withColumns(place), "number", *place).drop(*place)
        parts.append(repeated_slice(placed, "number", placed.count(), s).withColumn("source_path", F.lit(s.path)).drop("number"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def even_part(number: Column, total: Column, parts: Column) -> Column:
    """Which of ``parts`` even parts a row lies in, the first ones larger by one; numbers from 0. The same as ntile, without a global window."""
    size, extra = F.floor(total / parts), total % parts
    cut = extra * (size + 1)
    return F.when(number < cut, F.floor(number / (size + 1))).otherwise(extra + F.floor((number - cut) / F.greatest(size, F.lit(1)))).cast("long")


def part_start(part: Column, total: int, parts: int) -> Column:
    """The first number of an even part, or the rows before it."""
    return part * (total // parts) + F.least(part, F.lit(total % parts))


def interleave(first: DataFrame, second: DataFrame, number: str, n_first: int, n_second: int) -> DataFrame:
    """Two numbered lists in step: each of min(n_first, n_second) buckets has an even part of either, the first's before the second's.

    Adds bucket, side and position, the row's place in the order of (bucket, side, number)."""
    buckets = max(1, min(n_first, n_second))

    def side(df: DataFrame, n: int, k: int) -> DataFrame:
        bucket = F.col("bucket")
        before = part_start(bucket + 1 if k else bucket, n_first, buckets) + part_start(bucket, n_second, buckets)
        out = df.withColumn("side", F.lit(k)).withColumn("bucket", even_part(F.col(number), F.lit(n), F.lit(buckets)))
        return out.withColumn("position", (before + F.col(number) - part_start(bucket, n, buckets)).cast("long"))

    return side(first, n_first, 0).unionByName(side(second, n_second, 1), allowMissingColumns=True)


def shuffled_interleave(first: DataFrame, second: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Both lists shuffled, then interleaved in step. A list whose partner is empty stays as it is, without a shuffle."""
    from .convert import numbered

    lists = [numbered(df, "_i", key) for df in (first, second)]
    n, m = (df.count() for df in lists)
    mix = (lambda df, total, k: df.withColumn("_i", permuted(F.col("_i"), total, seed + k))) if n and m else (lambda df, total, k: df)
    return interleave(mix(lists[0], n, 0), mix(lists[1], m, 1), "_i", n, m).drop("_i")


#: Rounds of the permutation, its multipliers and shifts, and steps after which a walk is given up (which never happens, see below).
ROUNDS, MULTIPLIERS, SHIFTS, WALK = 6, (930_721_853, 742_938_285), (17, 21), 64
_LOW = (1 << 31) - 1


def round_keys(seed: int) -> list[int]:
    """31 bits for each round."""
    return [int.from_bytes(md5(f"{seed}-{r}".encode()).digest()[:4], "big") & _LOW for r in range(ROUNDS)]


def _once_permuted(number: Column, side: Column, seed: int) -> Column:
    """A permutation of 0 to side * side - 1: a number is two digits, and each round adds a hash of one to the other."""
    start = F.struct((number % side).alias("l"), ((number - number % side) / side).cast("long").alias("r"))

    def step(acc, key):
        mixed = acc["r"] + key
        for multiplier, shift in zip(MULTIPLIERS, SHIFTS):
            mixed = F.shiftright(mixed * multiplier, shift).bitwiseAND(F.lit(_LOW).cast("long"))
        return F.struct(acc["r"].alias("l"), ((acc["l"] + mixed) % side).alias("r"))

    return F.aggregate(F.array(*[F.lit(k).cast("long") for k in round_keys(seed)]), start, step, lambda acc: acc["r"] * side + acc["l"])


def permuted(number: Column, total: Column | int, seed: int = 0) -> Column:
    """Where row ``number`` (from 0) of ``total`` rows stands after a shuffle: a permutation that depends on total and seed alone, found for each row by itself.

    A Feistel network over the smallest square that holds all numbers; a number that it leads beyond the
    total is led on (cycle walking). Fewer than 2 * sqrt(total) + 1 places lie beyond, so that a walk of
    WALK steps in a row is impossible for small totals and less likely than 1e-70 for others; it is an error.
    total is at most 2**50."""
    total = (F.lit(total) if isinstance(total, int) else total).cast("long")
    side = F.ceil(F.sqrt(total.cast("double"))).cast("long")
    first = _once_permuted(number.cast("long"), side, seed)
    held = F.struct(first.alias("at"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), held, lambda acc, _: F.struct(F.when(acc["at"] < total, acc["at"]).otherwise(_once_permuted(acc["at"], side, seed)).alias("at")), lambda acc: acc["at"])
    # The walk is only made where the first step leads beyond the total; the array holds that step's result for both branches.
    return F.transform(F.array(first), lambda at: F.when(at < total, at).otherwise(walked))[0]


def shuffled(df: DataFrame, key: str, seed: int = 0, name: str = "position", by: tuple[str, ...] = ()) -> DataFrame:
    """df with each row's place in a shuffle of the rows (of each group). Rows are numbered in the order of key, of any type, and the numbers permuted."""
    from .convert import numbered

    placed = numbered(df, "_i", key, by=by, large=True)
    if not by:
        return placed.withColumn(name, permuted(F.col("_i"), placed.count(), seed)).drop("_i")
    totals = placed.groupBy(*by).agg(F.count("*").alias("_total"))
    return placed.join(totals, list(by)).withColumn(name, permuted(F.col("_i"), F.col("_total"), seed)).drop("_i", "_total")


def rough_length(data_type: Column, text: Column, has_image: Column, has_video: Column, frames: Column, per_word: float = 1.5, per_frame: int = 64, video_factor: float = 0.5) -> Column:
    """Tokens of a sample, roughly: its words and media, and 42."""
    media = F.when(has_video, per_frame + frames * video_factor * per_frame).when(has_image, 256).otherwise(0)
    known = F.when(data_type.isin("conversations", "interleave", "caption"), word_count(text) * per_word).otherwise(F.raise_error(F.concat(F.lit("unknown data_type "), data_type)).cast("double"))
    return known + media + 42


def frame_count(source: Column, given: Column, cap: int = 420) -> Column:
    """The given number of frames, or else a default by source, at most cap."""
    default = F.when(source.contains("finevideo"), 420).when(source.contains("activitynet"), 180).when(source.contains("sharegpt4video"), 60).otherwise(30)
    return F.least(F.coalesce(F.nullif(given, F.lit(0)), default), F.lit(cap))


def signed_length(words: Column, has_media: Column) -> Column:
    """Words, negative for a text-only sample."""
    return F.when(has_media, words).otherwise(-words)


def megabatches(df: DataFrame, length: str, key: str, size: int, chunks: int, seed: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Length-grouped order: shuffle, cut in megabatches of ``size``, sort each by length (longest first), deal it in even chunks.

    Adds megabatch, place (in the sorted megabatch), chunk and at (place in the chunk)."""
    placed = shuffled(df, key, seed, "_n", by)
    placed = placed.withColumn("megabatch", F.floor(F.col("_n") / size).cast("long")).drop("_n")
    rows = F.sort_array(F.collect_list(F.struct((-F.col(length)).alias("_l"), F.col(key).alias("_k"))))
    grouped = placed.groupBy(*by, "megabatch").agg(rows.alias("_rows"))  # a megabatch is size rows at most
    dealt = grouped.select(*by, "megabatch", F.posexplode(_even_chunks(F.col("_rows"), chunks)).alias("place", "_c"))
    return dealt.select(*by, "megabatch", F.col("_c._k").alias(key), F.col("place").cast("long"), F.col("_c.chunk").cast("long").alias("chunk"))


def _even_chunks(rows: Column, chunks: int) -> Column:
    """Greedy: each row goes to the least loaded chunk that isn't full, the first of equals. A count not divisible by chunks is dealt by stride."""
    full = F.size(rows) / chunks
    zero = F.struct(F.array_repeat(F.lit(0.0), chunks).alias("loads"), F.array_repeat(F.lit(0), chunks).alias("counts"), F.array().cast("array<int>").alias("to"))

    def put(acc, row):
        pick = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        count = F.get(acc["counts"], pick) + 1
        load = F.when(count >= full, F.lit(float("inf"))).otherwise(F.get(acc["loads"], pick) - row["_l"])
        return F.struct(
            F.transform(acc["loads"], lambda x, i: F.when(i == pick, load).otherwise(x)).alias("loads"),
            F.transform(acc["counts"], lambda x, i: F.when(i == pick, count).otherwise(x)).alias("counts"),
            F.concat(acc["to"], F.array(pick)).alias("to"),
        )

    greedy = F.aggregate(F.transform(rows, lambda r: F.struct(r["_l"].cast("double").alias("_l"))), zero, put)["to"]
    stride = F.transform(rows, lambda r, i: (i % chunks).cast("int"))
    to = F.when(F.size(rows) % chunks == 0, greedy).otherwise(stride)
    return F.zip_with(rows, to, lambda r, c: F.struct(r["_l"].alias("_l"), r["_k"].alias("_k"), c.alias("chunk")))


def modality_megabatches(df: DataFrame, signed: str, key: str, size: int, chunks: int, seed: int = 0) -> DataFrame:
    """megabatches of the media samples and of the text-only ones apart (modality 1 and -1), by a signed length.

    Adds slot, the megabatch's place in a shuffle of the full ones; each side's last one is a tail and comes at the end."""
    signs = df.withColumn("modality", F.signum(F.col(signed).cast("double")).cast("int")).withColumn("_abs", F.abs(signed))
    out = megabatches(signs, "_abs", key, size, chunks, seed, by=("modality",))
    last = out.groupBy("modality").agg(F.max("megabatch").alias("_last"))  # a row for each sign
    last = last.withColumns({"_before": F.coalesce(F.sum("_last").over(Window.orderBy("modality").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_full": F.sum("_last").over(Window.partitionBy())})
    out = out.join(F.broadcast(last), "modality").withColumn("tail", F.col("megabatch") == F.col("_last"))
    out = out.withColumn("slot", F.when(~F.col("tail"), permuted(F.col("_before") + F.col("megabatch"), F.col("_full"), seed)))
    return out.drop("_last", "_before", "_full")
