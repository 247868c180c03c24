"""Order-dependent operators over frames, tokens and turns, as windows and folds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import Scratch
from .scan import momentum, running

__all__ = ["momentum"]


def momentum_closed(df: DataFrame, key: str, order: list[str], value: str, out: str = "m", rate: float = 0.8) -> DataFrame:
    """scan.momentum by a window over the frames whose weight, (1 - rate) to the power of their age, a double can still show beside the newest (2**-60).

    The window grows as the rate falls; at a small rate, or for keys larger than a task, ``momentum`` is the better form."""
    w = Window.partitionBy(key).orderBy(*order)
    keep = 1 - rate
    if not 0 < rate <= 1:
        raise ValueError("a window needs a rate over 0 and up to 1")
    frames = math.ceil(60 * math.log(2) / -math.log(keep)) if keep else 0
    deltas = df.withColumn("_t", F.row_number().over(w) - 1).withColumn("_d", F.col(value) - F.lag(value).over(w))
    deltas = deltas.withColumn("_d", F.when(F.col("_t") == 1, F.col("_d")).otherwise(F.col("_d") * rate))
    near = w.rowsBetween(-frames, 0)
    terms = F.collect_list(F.struct("_t", "_d")).over(near)
    total = F.aggregate(terms, F.lit(0.0), lambda acc, x: acc * keep + F.coalesce(x["_d"], F.lit(0.0)))
    return deltas.withColumn(out, F.when(F.col("_t") > 0, total)).drop("_t", "_d")


#: Rows of a key that one task ranks, and cells of a histogram.
RANKED, CELLS = 100_000, 4096


def top_boundaries(df: DataFrame, key: str, order: list[str], score: str, per_cube: int = 5, out: str = "flag", ranked: int = RANKED, first: bool = True) -> DataFrame:
    """1 for each key's first frame and its k frames of highest score; k = max(round(frames / per_cube) - 1, 1). Equal scores go by order.

    Keys of at most ``ranked`` rows are ranked by a window. In larger ones the k-th score is selected:
    histograms of the scores between two bounds, refined until the cell that holds it has few rows or one
    value; then only those rows are ranked, or counted in order if they are many equal ones."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    sized = df.join(counts, key)
    k = F.greatest(F.bround(F.col("_n") / per_cube) - 1, F.lit(1))
    small = sized.where(F.col("_n") <= ranked)
    w = Window.partitionBy(key)
    small = small.withColumns({"_at": F.row_number().over(w.orderBy(*order)), "_r": F.row_number().over(w.orderBy(F.col(score).desc_nulls_last(), *order))})
    flag = ((F.lit(first) & (F.col("_at") == 1)) | ((F.col("_r") <= k) & F.col(score).isNotNull())).cast("int")
    done = small.withColumn(out, flag).drop("_n", "_at", "_r")
    large = counts.where(F.col("_n") > ranked)
    if large.limit(1).count() == 0:
        return done
    scratch = Scratch(df.sparkSession, "top")
    rows = scratch.save(sized.where(F.col("_n") > ranked).drop("_n"), "large")
    bounds = _kth(rows, scratch.save(large.withColumn("_k", k.cast("long")).drop("_n"), "keys"), key, score, ranked, scratch)
    above = F.col(score) > F.col("_high")
    tied = (F.col(score) >= F.col("_low")) & (F.col(score) <= F.col("_high"))
    held = rows.join(bounds, key).withColumns({"_above": F.coalesce(above, F.lit(False)), "_tied": F.coalesce(tied, F.lit(False))})
    # Rows of the last cell: few, which a window ranks, or all equal, whose order is a running count.
    few = held.where("_tied AND _low < _high")
    few = few.withColumn("_r", F.row_number().over(w.orderBy(F.col(score).desc(), *order))).select(key, *order, (F.col("_r") <= F.col("_left")).alias("_taken"))
    placed = running(held.drop("_high"), key, order, scratch=Scratch(df.sparkSession, "ties"), _at=F.lit(1), _r=(F.col("_tied") & (F.col("_low") == F.col("_same"))).cast("int"))
    placed = placed.join(few.where("_taken").select(key, *order).distinct().withColumn("_few", F.lit(True)), [key, *order], "left")
    flag = (F.lit(first) & (F.col("_at") == 1)) | F.col("_above") | (F.col("_tied") & (F.col("_low") == F.col("_same")) & (F.col("_r") <= F.col("_left"))) | F.coalesce("_few", F.lit(False))
    return done.unionByName(placed.withColumn(out, flag.cast("int")).select(*df.columns, out))


def _kth(rows: DataFrame, keys: DataFrame, key: str, score: str, few: int, scratch: Scratch) -> DataFrame:
    """For each key of keys (key, _k): _low and _high around its k-th highest score, _left, how many of the scores between them are among the k, and _same (_high).

    Bounds are values that occur; between them there are at most ``few`` rows, or they are equal."""
    spans = rows.where(F.col(score).isNotNull()).groupBy(key).agg(F.min(score).alias("_low"), F.max(score).alias("_high"), F.count("*").alias("_m"))
    now = scratch.save(keys.join(spans, key, "left").withColumn("_left", F.least("_k", F.coalesce("_m", F.lit(0)))).drop("_k"), "kth-0")
    step = 0
    while True:
        open_ = now.where(F.col("_low").isNotNull() & (F.col("_low") < F.col("_high")) & (F.col("_m") > few))
        if open_.limit(1).count() == 0:
            return now.select(key, "_low", "_high", "_left", F.col("_high").alias("_same"))
        inside = rows.join(open_, key).where(F.col(score).between(F.col("_low"), F.col("_high")))
        # Halves, so that a span near the largest double has a width.
        share = (F.col(score) / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
        cell = F.least(F.floor(share * CELLS), F.lit(CELLS - 1))
        cells = inside.groupBy(key, cell.alias("_cell")).agg(F.count("*").alias("_c"), F.min(score).alias("_lo"), F.max(score).alias("_hi"))
        w = Window.partitionBy(key).orderBy(F.col("_cell").desc())  # at most CELLS rows
        ranked = cells.withColumn("_before", F.sum("_c").over(w) - F.col("_c")).join(open_.select(key, "_left"), key)
        chosen = ranked.where((F.col("_before") < F.col("_left")) & (F.col("_before") + F.col("_c") >= F.col("_left")))
        chosen = chosen.select(key, F.col("_lo").alias("_low"), F.col("_hi").alias("_high"), F.col("_c").alias("_m"), (F.col("_left") - F.col("_before")).alias("_left"))
        step += 1
        now = scratch.save(now.join(open_.select(key), key, "left_anti").unionByName(chosen), f"kth-{step}")


def flags_to_segments(df: DataFrame, key: str, order: list[str], flag: str, *aggregates: Column) -> DataFrame:
    """A row [start, stop) for each run that begins at a flag; the first frame begins one."""
    placed = running(df, key, order, _i=F.lit(1), _s=F.col(flag)).withColumn("_i", F.col("_i") - 1)
    first = df.groupBy(key).agg(F.min_by(F.coalesce(F.col(flag), F.lit(0)), F.struct(*order)).alias("_f"))
    segment = F.when(F.col("_i") == 0, 0).otherwise(F.col("_s") - F.col("_f"))
    placed = placed.join(first, key).withColumn("segment", segment.cast("long"))
    return placed.groupBy(key, "segment").agg(F.min("_i").alias("start"), (F.max("_i") + 1).alias("stop"), *aggregates)


def label_runs(df: DataFrame, key: str, order: list[str], label: Column) -> DataFrame:
    """Maximal runs [start, stop) of rows where label holds."""
    hit = F.coalesce(label, F.lit(False))
    placed = running(df.withColumn("_hit", hit), key, order, _i=F.lit(1), _h=F.col("_hit").cast("int"))
    return placed.where("_hit").groupBy(key, (F.col("_i") - F.col("_h")).alias("_g")).agg((F.min("_i") - 1).alias("start"), F.max("_i").alias("stop")).drop("_g")


def change_groups(df: DataFrame, key: str, order: list[str], kind: Column, out: str = "grp") -> DataFrame:
    """A running number for consecutive rows of one kind."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_k", kind).withColumn("_c", F.coalesce((F.col("_k") != F.lag("_k").over(w)).cast("int"), F.lit(0))).withColumn(out, F.sum("_c").over(w)).drop("_k", "_c")


def context_turns(df: DataFrame, key: str, order: list[str], is_media: Column, out: str = "turn") -> DataFrame:
    """Turns of a flat context: one ends where text is followed by media."""
    w = Window.partitionBy(key).orderBy(*order)
    opens = (~F.coalesce(F.lag("_m").over(w), F.lit(True))) & F.col("_m")
    return df.withColumn("_m", is_media).withColumn("_o", opens.cast("int")).withColumn(out, F.sum("_o").over(w)).drop("_m", "_o")


def interleaved_turns(df: DataFrame, key: str, order: str, text: str, image: str, tag: str = "<image>") -> DataFrame:
    """Slots (text or image, one of them null) as turns: a run of images is a human turn of tags, a run of texts a gpt turn.

    A dialogue begins with images and ends with text: of more than two turns, a first text and last images
    are dropped; of two turns in the wrong order, the order is turned. Slots with neither end a run. Adds turn (from 0)."""
    kind = F.when(F.col(image).isNotNull(), "human").when(F.col(text).isNotNull(), "gpt").otherwise("none")
    runs = change_groups(df.withColumn("_kind", kind), key, [order], F.col("_kind"), "_g").where("_kind <> 'none'")
    rows = runs.groupBy(key, "_g", "_kind").agg(F.array_sort(F.collect_list(F.struct(order, F.coalesce(text, F.lit(tag)).alias("v")))).alias("_v"))
    value = F.when(F.col("_kind") == "gpt", F.array_join(F.transform("_v", lambda x: x["v"]), " ")).otherwise(F.repeat(F.lit(tag), F.size("_v")))
    turns = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_g", F.col("_kind").alias("from"), value.alias("value")))).alias("_t"))
    t = F.col("_t")
    starts = F.when(t[0]["from"] != "gpt", t).when(F.size(t) > 2, F.slice(t, F.lit(2), F.size(t) - 1)).otherwise(F.reverse(t))
    turns = turns.withColumn("_t", starts)
    turns = turns.withColumn("_t", F.when((F.element_at(t, -1)["from"] == "human") & (F.size(t) > 2), F.slice(t, F.lit(1), F.size(t) - 1)).otherwise(t))
    return turns.select(key, F.posexplode("_t").alias("turn", "_x")).select(key, F.col("turn").cast("long").alias("turn"), "_x.from", "_x.value")


def dialogue_rounds(df: DataFrame, key: str, order: list[str], is_media: Column, value: str) -> DataFrame:
    """Messages of a flat context: each round's media and first text are one human message, the texts after it alternate from gpt on.

    Adds turn (the round), message (from 1), from and values."""
    rounds = context_turns(df.withColumn("_media", is_media), key, order, is_media, "turn")
    w = Window.partitionBy(key, "turn").orderBy(*order)
    placed = rounds.withColumn("message", F.greatest(F.count_if(~F.col("_media")).over(w), F.lit(1)))
    values = F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v"))))
    out = placed.groupBy(key, "turn", "message").agg(values.alias("_v"))
    return out.select(key, "turn", "message", F.when(F.col("message") % 2 == 1, "human").otherwise("gpt").alias("from"), F.transform("_v", lambda x: x["_v"]).alias("values"))


def sample_lengths(df: DataFrame, key: str, order: list[str], position: str) -> DataFrame:
    """Lengths of packed samples from their position ids: a sample begins where the id isn't above the sample's first; padding (-1) doesn't count.

    Every sample begins at the sequence's least id, so that comparing with the first id of all is enough."""
    w = Window.partitionBy(key).orderBy(*order)
    real = df.where(F.col(position) != -1)
    begins = (F.col(position) <= F.first(position).over(w)).cast("int")
    return real.withColumn("_b", begins).withColumn("sample", F.sum("_b").over(w) - 1).groupBy(key, "sample").agg(F.count("*").alias("length"))


#: Keys whose partial softmax a task holds at once.
HELD_KEYS = 100_000


def merged_softmax(a: Column, b: Column) -> Column:
    """Two partial states (m: greatest logit, e: summed exponents over it, v: summed values by them) as one. Any grouping gives the same."""
    m = F.greatest(a["m"], b["m"])
    scale = lambda s: F.when(s["m"] == m, 1.0).otherwise(F.exp(s["m"] - m))
    return F.struct(m.alias("m"), (a["e"] * scale(a) + b["e"] * scale(b)).alias("e"), (a["v"] * scale(a) + b["v"] * scale(b)).alias("v"))


def softmax_states(df: DataFrame, key: list[str], logit: str, value: str) -> DataFrame:
    """key and state, a partial state for each key of a partition; HELD_KEYS of them at a time. Rows with a null logit or value don't count."""
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in key)
    state = pa.struct([("m", pa.float64()), ("e", pa.float64()), ("v", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[float, float, float]] = {}
        types: list[pa.DataType] = []

        def flushed() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*held), types)]
            states = pa.StructArray.from_arrays([pa.array(c, pa.float64()) for c in zip(*held.values())], fields=list(state))
            held.clear()
            return pa.RecordBatch.from_arrays([*columns, states], [*key, "state"])

        for batch in batches:
            types = [batch.column(i).type for i in range(len(key))]
            names: dict[tuple, int] = {}
            of = np.array([names.setdefault(k, len(names)) for k in zip(*(batch.column(i).to_pylist() for i in range(len(key))))], np.int64)
            x, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in (-2, -1))
            m = np.full(len(names), -np.inf)
            np.maximum.at(m, of, x)
            weight = np.where(x == m[of], 1.0, np.exp(x - m[of]))
            e, v = np.bincount(of, weight, len(names)), np.bincount(of, weight * y, len(names))
            for k, new in zip(names, zip(m.tolist(), e.tolist(), v.tolist())):
                old = held.get(k)
                if old is not None:
                    top = max(old[0], new[0])
                    p, q = (1.0 if s[0] == top else math.exp(s[0] - top) for s in (old, new))
                    new = (top, old[1] * p + new[1] * q, old[2] * p + new[2] * q)
                held[k] = new
            if len(held) >= HELD_KEYS:
                yield flushed()
        if held:
            yield flushed()

    rows = df.select(*key, F.col(logit).cast("double").alias("_x"), F.col(value).cast("double").alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL")
    return rows.mapInArrow(run, f"{kinds}, state struct<m: double, e: double, v: double>")


def online_softmax(df: DataFrame, key: list[str], logit: str, value: str) -> DataFrame:
    """The softmax-weighted mean of value (out) and the log of the summed exponents (lse), for each key.

    One scan: each partition makes a state for each of its keys, and a key's states, as many as there are
    partitions, are merged. A key with most rows is so spread over all partitions."""
    states = softmax_states(df, key, logit, value).groupBy(*key).agg(F.collect_list("state").alias("_s"))
    zero = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("e"), F.lit(0.0).alias("v"))
    one = F.aggregate("_s", zero, merged_softmax)
    return states.withColumn("_one", one).select(*key, (F.col("_one.v") / F.col("_one.e")).alias("out"), (F.col("_one.m") + F.log("_one.e")).alias("lse"))


def uniform(seed: int, *place: Column) -> Column:
    """A number strictly between 0 and 1 for each place, by 52 bits of an MD5 of seed and place: the same in every run and engine."""
    bits = F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), *[p.cast("string") for p in place]).cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 52)


def gumbel(seed: int, *place: Column) -> Column:
    """Standard Gumbel noise of a place."""
    return -F.log(-F.log(uniform(seed, *place)))


def gumbel_soft(score: Column, weight: Column | float, temperature: float, noise: Column | None = None) -> Column:
    """Probability of a boundary: a two-class softmax of the score with noise (the boundary's less the other class's) of a given weight."""
    noisy = score if noise is None else score + noise * weight
    return 1 / (1 + F.exp(-noisy / temperature))


def cosine_anneal(step: Column, total: int, high: float, low: float, warm_up: int = 0) -> Column:
    """A weight that falls from high to low along a half cosine, after a linear rise."""
    p = F.least((step - warm_up) / float(max(1, total - warm_up)), F.lit(1.0))
    fall = low + (high - low) * 0.5 * (1 + F.cos(p * 3.141592653589793))
    return F.when(step < warm_up, high * step / float(max(1, warm_up))).otherwise(fall)
