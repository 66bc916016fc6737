"""Periodic runs of words and texts without their repetitions.

A run is a stretch of words with smallest period q, at least ``max(least_words, exponent * q)`` words long,
that no neighbouring word extends.  A run and its copy q words on overlap in at least k words
(``overlap``), so every word of a run lies in a k-gram that the text holds twice.  Words outside of such
k-grams are masked; what is left falls into segments, and no run leaves its segment.

The segments of a piece of texts are searched together as Main and Lorentz do: blocks are halved, and a run that crosses
the middle of the smallest block around it is found from its period alone, by how far the words to both sides of the middle
agree with those one period away.  All periods of all blocks of one size are compared at once.  How far two
places agree is read from names of the 1, 2, 4, ... words from each place, which are equal only for equal words, so
segments of any length take n log n steps.

Texts are not split over tasks; memory is in proportion to the longest text.  Words are known by 64-bit hashes.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; repeated rows get equal results; null ids
are rows like others; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import SPACED, byte_values, chunks, mix, window_hashes, word_bounds, word_hashes

EXACT = byte_values(False)
#: Places compared together.
STEP = 1 << 20


@dataclass(frozen=True)
class RunParams:
    least_words: int = 6
    exponent: int = 4

    def least(self, period: np.ndarray) -> np.ndarray:
        """Words of the shortest run of each period."""
        return np.maximum(self.least_words, self.exponent * period)

    @property
    def overlap(self) -> int:
        """Least number of words that a run shares with its copy one period on."""
        periods = np.arange(1, self.least_words + 1)
        return int((self.least(periods) - periods).min())


def repeated_segments(words: np.ndarray, row: np.ndarray, row_ends: np.ndarray, params: RunParams) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the stretches of words in k-grams that occur twice in their row."""
    none, k = np.empty(0, np.int64), params.overlap
    grams = window_hashes(words, k)
    n = len(grams)
    if not n:
        return none, none
    inside = np.flatnonzero(np.arange(k, n + k) <= row_ends[:n])
    keys = grams[inside] ^ mix(row[inside].astype(np.uint64))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return none, none
    at = inside[np.isin(keys, twice)]
    cover = np.zeros(len(words) + 1, np.int32)
    cover[at] += 1  # places are distinct
    cover[at + k] -= 1
    covered = np.cumsum(cover[:-1]) > 0
    starts = covered.copy()
    starts[1:] &= ~covered[:-1] | (row[1:] != row[:-1])
    first = np.flatnonzero(starts)
    stops = covered.copy()
    stops[:-1] &= ~covered[1:] | (row[1:] != row[:-1])
    end = np.flatnonzero(stops) + 1
    long = end - first >= params.least_words
    return first[long], end[long]


class Agreement:
    """How far the words from two places on, or before them, are equal."""

    def __init__(self, words: np.ndarray) -> None:
        names = np.unique(words, return_inverse=True)[1].astype(np.int64)
        self.names = [names.astype(np.int32)]
        while True:
            width = 1 << (len(self.names) - 1)
            n = len(names) - width
            if n <= 0:
                break
            pairs = names[:n] * np.int64(len(words) + 1) + names[width : width + n]
            kinds, names = np.unique(pairs, return_inverse=True)
            if len(kinds) == n:  # no two places agree so far
                break
            self.names.append(names.astype(np.int32))

    def same(self, i: np.ndarray, j: np.ndarray, level: int) -> np.ndarray:
        """Whether the 2 ** level words from i and from j on, i < j, are equal."""
        names = self.names[level]
        inside = (i >= 0) & (j < len(names))
        return inside & (names[np.where(inside, i, 0)] == names[np.where(inside, j, 0)])

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        found = np.zeros(len(i), np.int64)
        for level in reversed(range(len(self.names))):
            found += self.same(i + found, j + found, level).astype(np.int64) << level
        return found

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        found = np.zeros(len(i), np.int64)
        for level in reversed(range(len(self.names))):
            back = found + (1 << level)
            found += self.same(i - back, j - back, level).astype(np.int64) << level
        return found


def _pairs(middles: np.ndarray, low: int, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(middle, period) for the periods from low to each middle's high, in bounded portions where middles allow."""
    many = np.maximum(high - low + 1, 0)
    middles, many = middles[many > 0], many[many > 0]
    ends = np.cumsum(many)
    i = 0
    while i < len(middles):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP, "right")))
        count = many[i:j]
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        yield np.repeat(middles[i:j], count), low + step
        i = j


def runs_of(words: np.ndarray, span: np.ndarray, params: RunParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period; span: for each place, an upper bound of the length of runs there.

    Places that no run may contain hold words of their own.
    """
    agree, n = Agreement(words), len(words)
    found: list[np.ndarray] = []
    size = 1 << (params.least_words - 1).bit_length()
    while size < 2 * n:
        middles = np.arange(size // 2, n, size)
        widest = np.minimum(size, span[middles])
        high = np.where(widest >= params.least_words, widest // params.exponent, 0)
        for level in range(len(agree.names)):
            # the periods whose shortest run agrees in 2 ** level words ahead of or behind any two places a period apart
            low, top = _periods(level, int(high.max(initial=0)), params)
            for middle, period in _pairs(middles, low, np.minimum(high, top)):
                for i in (middle, middle - period):
                    j = i + period
                    near = np.flatnonzero(agree.same(i, j, level) | agree.same(i - (1 << level), j - (1 << level), level))
                    a, b, q = i[near], j[near], period[near]
                    ahead, behind = agree.ahead(a, b), agree.behind(a, b)
                    whole = np.flatnonzero(ahead + behind + q >= params.least(q))
                    found.append(np.stack([(a - behind)[whole], (q + ahead + behind)[whole], q[whole]]))
        size *= 2
    if not found:
        e = np.empty(0, np.int64)
        return e, e, e
    start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # a stretch found by multiples of its period counts once, by the smallest
    first = np.ones(len(start), bool)
    first[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[first], length[first], period[first]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _periods(level: int, most: int, params: RunParams) -> tuple[int, int]:
    """The periods, up to most, of which half the overlap of the shortest run has from 2 ** level to 2 ** (level + 1) - 1 words."""
    periods = np.arange(1, most + 1)
    half = -(-(params.least(periods) - periods) // 2)
    fit = periods[(half >> level == 1)]
    return (int(fit[0]), int(fit[-1])) if len(fit) else (1, 0)


def piece_runs(words: np.ndarray, before: np.ndarray, params: RunParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in the row, length, period) of the runs of the rows of a piece; before: words before each row."""
    row = np.repeat(np.arange(len(before) - 1), np.diff(before))
    first, end = repeated_segments(words, row, before[row + 1], params)
    if not len(first):
        e = np.empty(0, np.int64)
        return e, e, e, e
    many = end - first
    place = np.arange(many.sum()) + np.repeat(np.arange(len(many)), many)  # one place between segments
    source = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    joined = np.full(len(source) + len(many), -1, np.int64)
    joined[place] = source
    gaps = np.flatnonzero(joined < 0)
    names = np.empty(len(joined), np.int64)
    names[place] = np.unique(words[source], return_inverse=True)[1]
    names[gaps] = len(source) + np.arange(len(gaps))
    span = np.zeros(len(joined), np.int64)
    span[place] = np.repeat(many, many)
    start, length, period = runs_of(names, span, params)
    at = joined[start]
    return row[at], at - before[row[at]], length, period


SCHEMA = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([pa.field(x, pa.int64()) for x in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, params: RunParams = RunParams()) -> DataFrame:
    """doc_id, runs (start, length, period; by start, then period), collapsed: one row per document.

    collapsed: the words, joined by one space, without those that a run holds after its first period.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in chunks(batch.column(1)):
                starts, ends, before = word_bounds(buf, offs, SPACED)
                row, start, length, period = piece_runs(word_hashes(buf, starts, ends, EXACT), before, params)
                held = np.searchsorted(row, np.arange(j - i + 1))
                texts = []
                for r in range(j - i):
                    words = buf[offs[r] : offs[r + 1]].tobytes().split()
                    own = slice(held[r], held[r + 1])
                    if held[r] < held[r + 1]:
                        drop = np.zeros(len(words) + 1, np.int64)
                        np.add.at(drop, start[own] + period[own], 1)
                        np.add.at(drop, start[own] + length[own], -1)
                        words = compress(words, (np.cumsum(drop[:-1]) == 0).tolist())
                    texts.append(b" ".join(words))
                values = pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], fields=list(_RUN))
                runs = pa.ListArray.from_arrays(pa.array(held.astype(np.int32)), values)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), runs, pa.array(texts, pa.binary()).view(pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: the contract's documents, of which about a tenth repeat a stretch of words up to their end.

    Which ones, from which word and with which period follows from the id; texts of the others stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    split = own.withColumn("g", F.floor(h / 10)).withColumn("words", F.when(h % 10 == 0, words)).withColumn("n", F.expr("nullif(size(words), 0)"))
    shaped = split.withColumn("a", F.col("g") % F.col("n")).withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    tail = F.expr("concat(slice(words, 1, cast(a AS int)), transform(sequence(cast(a AS int), n - 1), i -> words[cast(a + (i - a) % p AS int)]))")
    return shaped.select("doc_id", F.when(F.col("n") > 0, F.array_join(tail, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The contract's columns: how many runs, the longest one, and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
