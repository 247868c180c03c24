"""Joins of annotations with catalogues of media."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, catalogue: DataFrame, on: list[str], miss: str = "skip") -> DataFrame:
    """Rows with the catalogue's columns. miss: skip drops a row without an entry, abort ends the query with an error, keep leaves nulls.

    Catalyst broadcasts the catalogue where its measured size allows."""
    if miss == "skip":
        return rows.join(catalogue, on)
    found = rows.join(catalogue.withColumn("_hit", F.lit(1)), on, "left")
    if miss == "abort":
        checked = F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit("no entry for "), F.to_json(F.struct(*on))))).otherwise(F.col("_hit"))
        found = found.withColumn("_hit", checked).where("_hit = 1")
    return found.drop("_hit")


def multiplied(df: DataFrame) -> DataFrame:
    """df, whose rows an explode has multiplied, as a side of a join that is never broadcast: Catalyst estimates it by the scan below."""
    return df.hint("merge")


def existing(rows: DataFrame, catalogue: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(catalogue, on, "left_semi")


def remaining(rows: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    return rows.join(done, on, "left_anti")


def keep_last(df: DataFrame, key: list[str], *order: Column) -> DataFrame:
    """The last row of each key in the given order.

    The latest row is a maximum (pre-aggregated before the shuffle), not a ranking of all rows."""
    others = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_r")).select(*key, *[F.col("_r")[c].alias(c) for c in others])


#: Bits of the bitmaps by which places and pieces of names are ruled out, and different lengths up to which names are tried whole.
_BITS, _LENGTHS = 1 << 16, 32


def _is_set(bits: list[int], at: Column) -> Column:
    """Whether the bit is one of the given ones. The bitmap is a literal of _BITS bits, so that no join is needed."""
    words = [0] * (_BITS // 64)
    for n in bits:
        words[n // 64] |= 1 << n % 64
    held = F.split(F.lit(",".join(str(w - (1 << 64) if w >> 63 else w) for w in words)), ",").cast("array<bigint>")
    return F.getbit(F.get(held, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1


def _start(c: Column) -> Column:
    return F.pmod(F.xxhash64(c.substr(1, 1)), F.lit(_BITS))


def _frame(c: Column, n: Column) -> Column:
    """A bit for n and the first two and last two of c's first n characters."""
    two = F.least(n, F.lit(2))
    return F.pmod(F.xxhash64(n, c.substr(F.lit(1), two), c.substr(n - two + 1, two)), F.lit(_BITS))


def contained_name(clips: DataFrame, files: DataFrame, clip: str, file: str, size: int = 8, within: tuple[str, ...] = ()) -> DataFrame:
    """Each different clip with the last file (in name order) whose name contains the clip's; of the same ``within`` columns (a folder, say) if given."""
    found = last_files(clips, files, clip, file, size, within)
    return clips.distinct().join(found, [*within, clip]).select(*clips.columns, file)


def last_files(clips: DataFrame, files: DataFrame, clip: str, file: str, size: int = 8, within: tuple[str, ...] = ()) -> DataFrame:
    """``within``, clip and file: for each clip's name the last file (in name order) whose name contains it, and some names that no clip has.

    It is for a join with clips. A clip's name is a piece of the file's, and the last file of each piece is found before the join. Pieces are cut in the
    lengths that clips have, and only those leave a task that begin, end and are as long as some clip's name. Names shorter than
    ``size`` are found so, and of other lengths those whose pieces, which are counted first, are together no more than the files' parts of ``size``
    characters; the names left are found by one such part (see _by_parts). Nothing is broadcast, and no pair is made without a shared part."""
    files = files.select(*within, file).where(F.col(file).isNotNull())
    found = clips.agg(F.collect_set(F.length(clip)).alias("lengths"), F.collect_set(_start(F.col(clip))).alias("starts"), F.collect_set(_frame(F.col(clip), F.length(clip))).alias("frames")).first()
    lengths = sorted(found.lengths)
    # Of the rest of a name and a length, not of the piece: conditions on a join's key would be tried on the other side's rows too.
    begins, fits = _is_set(found.starts, _start(F.col("_rest"))), _is_set(found.frames, _frame(F.col("_rest"), F.col("_n")))

    def pieces(of: list[int]) -> DataFrame:
        # Exploded places and substrings stay in generated code, unlike arrays of pieces.
        places = files.where(F.length(file) > 0).withColumn("_i", F.explode(F.sequence(F.lit(1), F.length(file))))
        rests = places.withColumn("_rest", F.col(file).substr(F.col("_i"), F.lit(max(of, default=0)))).where(begins)
        cut = rests.withColumn("_n", F.explode(F.array(*[F.lit(n) for n in of if n]).cast("array<int>"))).where((F.col("_n") <= F.length("_rest")) & fits)
        cut = cut.select(*within, file, "_n", F.col("_rest").substr(F.lit(1), F.col("_n")).alias("_piece"))
        return cut.unionByName(files.withColumns({"_n": F.lit(0), "_piece": F.lit("")})) if 0 in of else cut  # the empty name is in every file's

    whole, longer = [n for n in lengths if n < size], [n for n in lengths if n >= size]
    if longer and len(lengths) <= _LENGTHS:
        left = files.agg(F.sum(F.greatest(F.length(file) - size + 1, F.lit(0)).cast("long")).alias("n")).first().n or 0
        counted = {r["_n"]: r["count"] for r in pieces(longer).groupBy("_n").count().collect()}
        for n in sorted(longer, key=lambda n: counted.get(n, 0)):
            if (left := left - counted.get(n, 0)) < 0:
                break
            whole.append(n)
    rest = [n for n in longer if n not in whole]
    last = pieces(whole).groupBy(*within, F.col("_piece").alias(clip)).agg(F.max(file).alias(file))
    if rest:
        last = last.unionByName(_by_parts(clips.select(*within, clip).where(F.length(clip).isin(rest)).distinct(), files, clip, file, size, within))
    return multiplied(last)


def _by_parts(clips: DataFrame, files: DataFrame, clip: str, file: str, size: int, within: tuple[str, ...]) -> DataFrame:
    """last_files for different names of ``size`` characters or more.

    Every part of ``size`` characters of a clip's name must be a part of the file's, so the join is on
    equal parts: for each clip on the one that the fewest files have, so that a beginning that
    all names share is no key."""
    on = [*within, "_part"]
    files, width = files.distinct(), F.lit(size)  # dealt out anew: a small file's names are many parts
    # By 64 bits of a part, which are counted and joined sooner; whether a file holds the name is seen from both.
    hashed = lambda df, c: df.withColumn("_i", F.explode(F.sequence(F.lit(1), F.greatest(F.length(c) - width + 1, F.lit(1))))).withColumn("_part", F.col(c).substr(F.col("_i"), width)).drop("_i").withColumn("_part", F.xxhash64(*on))
    cut = hashed(files, file).select("_part", F.struct(*within, file).alias("_f"))
    held = cut.groupBy("_part").agg(F.count("*").alias("_files"))
    each = multiplied(hashed(clips, clip)).join(held, "_part")
    rarest = each.groupBy(*within, clip).agg(F.min_by("_part", F.struct("_files", "_part")).alias("_part"))
    holds = reduce(lambda a, c: a & (F.col("_f")[c] == F.col(c)), within, F.col("_f")[file].contains(F.col(clip)))
    return clips.join(rarest, [*within, clip]).join(multiplied(cut), "_part").where(holds).groupBy(*clips.columns).agg(F.max(F.col("_f")[file]).alias(file))


def by_priority(rows: DataFrame, candidates: DataFrame, key: str, suffix: str, order: list[str]) -> DataFrame:
    """Each row with its candidate of the suffix that comes first in order; rows without one are left out."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(suffix))
    best = candidates.where(rank > 0).groupBy(key).agg(F.min_by(F.struct(*[c for c in candidates.columns if c != key]), rank).alias("_c"))
    return rows.join(best.select(key, "_c.*"), key)


def in_ranges(points: DataFrame, ranges: DataFrame, key: str, point: str, low: str, high: str, cell: int | None = None) -> DataFrame:
    """Points with the range [low, high) that holds them; an equal key comes first, so that only a key's own pairs are tested.

    cell: the usual width of a range, for integers. Only pairs in an equal cell are tested then, not all of a key."""
    on = [key]
    if cell:
        on.append("_cell")
        points = points.withColumn("_cell", F.floor(F.col(point) / cell))
        ranges = multiplied(ranges.where(F.col(low) < F.col(high)).withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / cell), F.floor((F.col(high) - 1) / cell)))))
    return points.join(ranges, on).drop("_cell").where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high)))


def best_of(rows: DataFrame, options: list[tuple], names: list[str], worth: Callable[[Column], Column]) -> DataFrame:
    """Each row with the option of greatest worth, the first of equals.

    options is a fixed list, so it is an array literal and the best is found inside each row: no join, no shuffle.
    worth: a comparable column of an option (a struct with the given names)."""
    fields = [F.struct(F.lit(-i).alias("_order"), *[F.lit(v).alias(n) for n, v in zip(names, o)]) for i, o in enumerate(options)]
    ranked = F.transform(F.array(*fields), lambda o: F.struct(worth(o).alias("_worth"), o["_order"].alias("_order"), *[o[n].alias(n) for n in names]))
    return rows.withColumn("_best", F.array_max(ranked)).select(*rows.columns, *[F.col("_best")[n].alias(n) for n in names])
