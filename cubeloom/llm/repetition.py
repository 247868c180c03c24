"""Quality rules by suffix arrays: how much of a text is repeated inside it, and the longest repeat.

Each text is a sequence of words. The suffixes of many texts at once are sorted by doubling: ranks of
the first 2**i words give those of the first 2**(i+1), and only suffixes that still tie are sorted
again. No repeat reaches over the end of its text. Suffixes that share d words are an interval of
the suffix array whose longest common prefix (LCP) is d or more; ranks of w words give the intervals of
any depth d from w to 2w, as equal pairs of ranks at a place and at d - w words behind it. So two
levels of ranks are held at a time, and memory is in proportion to the text, however it repeats.

If d + 1 words repeat at a place, then d words do at it and at the next one; so the union of all
maximal repeats of d words or more is the union of the d words at each place of an interval of depth d.
The longest repeat of a text lies between the last two levels, and is found there by halving.

Words and lines are compared by numbers given to their bytes, so that no two different ones are taken
for one another.

A text is kept if the base rules hold (50 words or more, and no more than half of the words in 3-word
windows that occur twice), and the union of its maximal repeats of MIN_REPEAT words or more covers at
most ALLOWED words and MAX_COVERED of the text's, and the longest has at most MAX_LONGEST words. So a
short text may say a sentence twice.

Defined results: a null or empty text, or one of white space, has no words, fails the base rules and
isn't kept. Rows are independent; repeated rows and equal or null doc_ids each give a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 50, 3, 50
#: Words of the shortest repeat that counts, the part of a text's words that repeats may cover, words that they may cover besides, and words of the longest.
MIN_REPEAT, MAX_COVERED, ALLOWED, MAX_LONGEST = 5, 0.25, 40, 100
SYMBOLS = "#*$%&|<>"
#: Values a text from which they are counted text by text, without sums over all.
MANY = 100_000
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, covered_words long, longest_repeat long, base_failed boolean, kept boolean"


class Repeats:
    """What repeats inside each of several sequences of numbers (words), each by itself.

    places(depth, times): a boolean for each place, true where ``depth`` words begin that begin at ``times`` places or more of the text.
    longest[times]: for each text, the most words that begin at ``times`` places, for each number of times asked for; 0 if fewer than ``least``."""

    def __init__(self, symbols: np.ndarray, of: np.ndarray, depths: dict[int, tuple[int, ...]], least: int):
        n, texts = len(symbols), len(of) - 1
        self.text, self.end = np.repeat(np.arange(texts, dtype=np.int32), np.diff(of)), of[1:]
        self.times = sorted({t for times in depths.values() for t in times})
        self.found = {(d, t): np.zeros(n, bool) for d, times in depths.items() for t in times}
        self.longest = {t: np.zeros(texts, np.int64) for t in self.times}
        if not n:
            return
        # Level 0: the text and the word. A place that is the only one of its rank is settled: it has no repeat.
        order = np.lexsort((symbols, self.text))
        new = np.ones(n, bool)
        new[1:] = (symbols[order[1:]] != symbols[order[:-1]]) | (self.text[order[1:]] != self.text[order[:-1]])
        rank = np.empty(n, np.int64 if n >= 2**31 else np.int32)
        rank[order] = _starts(new)
        tied, counts = _tied(order, new)
        width = 1
        del order, new
        while len(tied):
            for d in depths:
                if width <= d < 2 * width:
                    repeated = self._times(rank, tied, counts, np.full(texts, d - width))
                    for t in depths[d]:
                        self.found[d, t][tied[repeated >= t]] = True
            higher, tied_higher, counts_higher = self._doubled(rank, tied, width)
            for t in self.times:
                now, then = (np.bincount(self.text[x[c >= t]], minlength=texts) > 0 for x, c in ((tied, counts), (tied_higher, counts_higher)))
                last = now & ~then
                if 2 * width > least and last.any():
                    self._between(rank, tied, counts, width, t, last)
            rank, tied, counts = higher, tied_higher, counts_higher
            width *= 2
        for t in self.times:
            self.longest[t][self.longest[t] < least] = 0

    def places(self, depth: int, times: int = 2) -> np.ndarray:
        return self.found[depth, times]

    def _doubled(self, rank: np.ndarray, tied: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranks of twice as many words, and what ties still. tied has places in the order of rank."""
        own, ahead = rank[tied], tied + width
        # A suffix that ends first comes first; two of one text never end at the same length.
        follow = np.where(ahead < self.end[self.text[tied]], rank[np.minimum(ahead, len(rank) - 1)], -1)
        by = np.lexsort((follow, own))
        at, own, follow = tied[by], own[by], follow[by]
        start = np.ones(len(at), bool)
        start[1:] = own[1:] != own[:-1]
        new = start.copy()
        new[1:] |= (follow[1:] != follow[:-1]) | (follow[1:] < 0)
        out = rank.copy()
        out[at] = own + (_starts(new) - _starts(start)).astype(rank.dtype)
        return out, *_tied(at, new)

    def _times(self, rank: np.ndarray, tied: np.ndarray, counts: np.ndarray, further: np.ndarray) -> np.ndarray:
        """How often the words that begin at each tied place, those of rank's width and so many further ones for each text, begin in the text; 0 if they aren't all in it."""
        text = self.text[tied]
        if not further.any():
            return counts
        ahead = tied + further[text]
        inside = ahead < self.end[text]
        follow = np.where(inside, rank[np.minimum(ahead, len(rank) - 1)], -1)
        own = rank[tied]
        by = np.lexsort((follow, own))
        new = np.ones(len(by), bool)
        new[1:] = (own[by[1:]] != own[by[:-1]]) | (follow[by[1:]] != follow[by[:-1]])
        out = np.empty(len(by), np.int64)
        out[by] = _sizes(new)
        return np.where(inside, out, 0)

    def _between(self, rank: np.ndarray, tied: np.ndarray, counts: np.ndarray, width: int, times: int, last: np.ndarray) -> None:
        """The longest of the texts ``last``, whose words repeat at this width but not at its double."""
        some = last[self.text[tied]] & (counts >= times)
        tied, counts = tied[some], counts[some]
        low, high = np.zeros(len(last), np.int64), np.where(last, width - 1, 0)
        while (low < high).any():
            middle = (low + high + 1) // 2
            enough = self._times(rank, tied, counts, middle) >= times
            full = np.bincount(self.text[tied[enough]], minlength=len(last)) > 0
            low, high = np.where(full & (low < high), middle, low), np.where(~full & (low < high), middle - 1, high)
        self.longest[times][last] = width + low[last]


def _starts(new: np.ndarray) -> np.ndarray:
    """For each place in an order, where its group begins; new is true at each group's first."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _sizes(new: np.ndarray) -> np.ndarray:
    first = np.flatnonzero(new)
    return np.repeat(np.diff(np.append(first, len(new))), np.diff(np.append(first, len(new))))


def _tied(order: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places in order, those that aren't alone in their group, and their groups' sizes."""
    sizes = _sizes(new)
    return order[sizes > 1], sizes[sizes > 1]


def spread(places: np.ndarray, words: int) -> np.ndarray:
    """Places that lie in ``words`` words from a true one on; those end inside their text."""
    edge = np.zeros(len(places) + words, np.int32)
    edge[: len(places)] += places
    edge[words:] -= places
    return np.cumsum(edge[: len(places)], dtype=np.int32) > 0


def _sums(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """How many of a boolean array's values are true in each text."""
    if len(values) > MANY * (len(of) - 1):
        return np.array([np.count_nonzero(values[i:j]) for i, j in zip(of[:-1].tolist(), of[1:].tolist())], np.int64)
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[of[1:]] - total[of[:-1]]


def measure(data: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of SCHEMA but the verdicts, for texts given as bytes."""
    first, last, of = tv.words(data, starts)
    found = Repeats(tv.span_numbers(data, first, last), of, {WINDOW: (2,), MIN_REPEAT: (2,)}, MIN_REPEAT)
    return {
        "n_words": np.diff(of),
        "word_chars": _sums(tv.solid(data) & ((data & 0xC0) != 0x80), starts),
        "n_symbols": _sums(np.isin(data, np.frombuffer(SYMBOLS.encode(), np.uint8)), starts),
        "n_dup_lines": duplicate_lines(data, starts, first),
        "n_repeat_words": _sums(spread(found.places(WINDOW), WINDOW), of),
        "covered_words": _sums(spread(found.places(MIN_REPEAT), MIN_REPEAT), of),
        "longest_repeat": found.longest[2],
    }


def duplicate_lines(data: np.ndarray, starts: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of the same text."""
    breaks = np.flatnonzero(data == 10)
    # A text's lines begin at its start and after each \n in it.
    begin = np.concatenate([starts[:-1], breaks + 1])
    owner = np.concatenate([np.arange(len(starts) - 1), np.searchsorted(starts, breaks, "right") - 1])
    by = np.lexsort((begin, owner))
    begin, text = begin[by], owner[by]
    end = np.empty(len(begin), np.int64)
    end[:-1] = np.where(text[1:] == text[:-1], begin[1:] - 1, starts[1:][text[:-1]])
    end[-1:] = starts[-1]
    full = np.searchsorted(word_starts, end) > np.searchsorted(word_starts, begin)
    begin, end, text = begin[full], end[full], text[full]
    lines = tv.span_numbers(data, begin, end)
    by = np.lexsort((lines, text))
    again = np.zeros(len(by), bool)
    again[1:] = (lines[by[1:]] == lines[by[:-1]]) & (text[by[1:]] == text[by[:-1]])
    return np.bincount(text[by[again]], minlength=len(starts) - 1)


def verdicts(m: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    return m | {"base_failed": failed, "kept": ~failed & (m["covered_words"] <= ALLOWED + MAX_COVERED * m["n_words"]) & (m["longest_repeat"] <= MAX_LONGEST)}


def rules(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The named columns of docs (doc_id if none are named) and those of SCHEMA.

    Names of the input that clash with SCHEMA's are left out of what is carried along."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    carried = [c for c in columns or ["doc_id"] if c not in names]
    body = docs.select(F.struct(*carried).alias("row"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = tv.text_bytes(batch.column(1))
            for i, j in tv.slices(starts):
                found = verdicts(measure(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(found[n]) for n in names)], ["row", *names])

    return body.mapInArrow(run, f"row {body.schema['row'].dataType.simpleString()}, {SCHEMA}").select("row.*", *names)
