"""Fuzzy line deduplication: SimHash, pigeonhole blocks, edit similarity and connected groups.

Lines are normalised: A-Z in lower case, digits to 0, other ASCII signs and spaces to single spaces.  Equal lines are one
node.  Two nodes are linked if they share a block, their SimHashes are within a distance and their edit similarity,
1 - distance / longer length, is 0.8 or more, the last by exact edit distance.

SimHash adds up random signs of a line's features.  Of 1,024 sums (byte pairs: 2,048), the signs of 256 make the SimHash that distances are taken
of, and of each 64 (byte pairs: 16) the place and sign of the strongest make a symbol; a sum serves several symbols, by permutations.  A small change of the line changes it
far more seldom than it changes as many sign bits.  Symbols are cut into blocks, and lines that differ in fewer symbols than
there are blocks share one (pigeonhole); lines that differ in more mostly do too.  Features are words of over three bytes
(the commonest would make all lines of a language alike), or pairs of adjacent bytes for lines of at most ``short`` characters and for those with few
words for their length (Chinese, Japanese, Thai, addresses); lines near either border have blocks of both kinds, so that pairs within the similarity hardly ever lack a common
kind.  The blocks are the same at every size of the table: what is linked does not depend on what else is in it.

Plan
  1. One pass over the texts makes two 64-bit keys, SimHashes and blocks of each line; equal lines collapse.
  2. Members of a bucket are compared with its smallest one, then the members outside of the bucket's largest component with all
     of other components: no pair of a bucket is left out, unless both are in one component already.
  3. A pair is decided by an alignment of words where that is near enough, by the q-gram bound (q = 2) where that rules it out, else by
     the edit distance, with a column of its table in one integer.

Each connected group keeps its first line in order of (doc_id, line number).

Defined cases: null texts and lines without a letter or digit have no row and are never removed; repeated rows
of a document are the same lines, all kept or all removed with the group's first; a null id comes first in
order; an empty table gives an empty result; other columns are ignored by ``line_groups`` and kept by ``deduplicated``,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, extended
from .textbatch import _POWERS, ALNUM, byte_values, chunks, mix, word_bounds, word_hashes
from .workspace import Workspace, fresh


@dataclass(frozen=True)
class LineParams:
    """blocks of so many symbols for each kind of feature, at every size of the table; apart: most differing bits, of 256, of a linked pair.

    word_group, byte_group: of so many sums a symbol names the strongest; a power of two, 64 at most.
    word_sums, byte_sums: sums that are made, ``SUMS`` at most.
    few_words: from so many characters a word on, a line counts as text without spaces and has byte pairs for features.
    """

    similarity_percent: int = 80
    short: int = 40
    few_words: int = 16
    word_blocks: tuple[int, int] = (40, 4)
    byte_blocks: tuple[int, int] = (64, 6)
    word_group: int = 64
    byte_group: int = 16
    word_sums: int = 1024
    byte_sums: int = 2048
    word_apart: int = 66
    byte_apart: int = 80
    bitmap_words: int = 1 << 20


GROUP = 16
SIGNS = 256
#: Most sums that are made of a line; what needs more takes them again, in other orders.
SUMS = 2048
#: Buckets are made in so many rounds, each with its share of the blocks, so that the shuffle of one is gone before the next.
ROUNDS = 2
#: Bytes of text that are cut into lines at a time.
PIECE = 1 << 20
#: Features fall into so many rows of random signs.
ROW_BITS = 12
ROWS = 1 << ROW_BITS
VALUES = byte_values(True)
VALUES[ord("0") : ord("9") + 1] = VALUES[ord("0")]
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
FOLD[ord("0") : ord("9") + 1] = ord("0")


@lru_cache(maxsize=4)
def _columns(sums: int, group: int, made: int = SUMS) -> np.ndarray:
    """Which of the sums made stands for each one: itself, or where there are fewer one of permutations of all, so that a symbol has different ones."""
    if sums <= made:
        return np.arange(sums)
    r, more = np.random.default_rng(0), sums - SIGNS
    again = np.concatenate([r.permutation(made) for _ in range(-(-more // made))])[:more]
    return np.r_[np.arange(SIGNS), again.reshape(-1, group).T.ravel()]


@lru_cache(maxsize=4)
def _signs(sums: int, seed: int) -> np.ndarray:
    """Random bits of each row, with a byte for each and eight to a word."""
    made = np.random.default_rng(seed).integers(0, 2, (ROWS, SUMS), dtype=np.uint8)
    return np.ascontiguousarray(made[:, _columns(sums, GROUP)]).view(np.uint64)


def _sums(rows: np.ndarray, first: np.ndarray, sums: int, seed: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(i, j, sums of signs for lines i to j - 1): line k has the features from first[k] to first[k + 1]."""
    table, n, i = _signs(sums, seed), np.diff(first), 0
    long = np.flatnonzero(n > 255)
    while i < len(n):
        if n[i] > 255:
            # in runs whose counts fit a byte
            total = np.zeros(sums, np.int64)
            for a in range(first[i], first[i + 1], 255):
                total += np.add.reduce(table[rows[a : min(a + 255, first[i + 1])]], axis=0).view(np.uint8)
            yield i, i + 1, (2 * total - n[i])[None]
            i += 1
            continue
        j = max(i + 1, int(np.searchsorted(first, first[i] + 4096, "right")) - 1)
        k = np.searchsorted(long, i)
        j = min(j, int(long[k])) if k < len(long) else j
        own = table[rows[first[i] : first[j]]]
        ones = np.empty((j - i, own.shape[1]), np.uint64)
        cuts = (first[i : j + 1] - first[i]).tolist()
        for x in range(j - i):
            np.add.reduce(own[cuts[x] : cuts[x + 1]], axis=0, out=ones[x])
        yield i, j, 2 * ones.view(np.uint8).astype(np.int16) - n[i:j, None].astype(np.int16)
        i = j


def signatures(rows: np.ndarray, first: np.ndarray, blocks: tuple[int, int], seed: int, group: int = GROUP, made: int = SUMS) -> tuple[np.ndarray, np.ndarray]:
    """(four longs of sign bits, block keys) of each line of at least one feature.

    Sum x of the later ones is of symbol x mod places; of equally strong sums the last counts.
    """
    count, width = blocks
    lines, places, bits = len(first) - 1, count * width, group.bit_length()
    sims, keys = np.empty((lines, SIGNS // 64), np.int64), np.empty((lines, count), np.int64)
    numbers = (np.arange(count, dtype=np.uint64) + np.uint64(64 * seed)) << np.uint64(bits * width)
    weights = np.left_shift(np.uint64(1), np.uint64(bits) * np.arange(width, dtype=np.uint64))
    columns = _columns(SIGNS + group * places, group, made)[SIGNS:]
    for i, j, s in _sums(rows, first, min(made, SIGNS + group * places), seed):
        sims[i:j] = np.packbits(s[:, :SIGNS] > 0, axis=1).view(np.int64)
        # lines are the last axis, so that sums are taken and compared in runs
        strength = np.ascontiguousarray(((np.abs(s) << bits) | (s > 0)).T)[columns].reshape(group, places, j - i)
        strength |= (np.arange(group, dtype=s.dtype) << 1)[:, None, None]
        symbol = (strength.max(axis=0).T & (2 * group - 1)).astype(np.uint64).reshape(j - i, count, width)
        packed = (symbol * weights).sum(axis=2, dtype=np.uint64) + numbers
        keys[i:j] = (packed if bits * width < 56 else mix(packed)).view(np.int64)
    return sims, keys


@dataclass
class Lines:
    """Lines with a word of a piece of a batch: document row, number, keys, characters, and their words."""

    row: np.ndarray
    number: np.ndarray
    k1: np.ndarray
    k2: np.ndarray
    size: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray


def cut_lines(buf: np.ndarray, offs: np.ndarray) -> Lines:
    starts, ends, _ = word_bounds(buf, offs, ALNUM)
    breaks = np.sort(np.concatenate([np.flatnonzero(buf == 10) + 1, offs[1:-1]]))
    line = np.searchsorted(breaks, starts, "right")
    head = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.empty(0, np.int64)
    first = np.r_[head, len(starts)]
    row = np.searchsorted(offs, starts[head], "right") - 1
    number = line[head] - np.searchsorted(breaks, offs[row], "right")
    hashes = word_hashes(buf, starts, ends, VALUES)
    letters = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80, dtype=np.int64)])
    chars = np.r_[0, np.cumsum(letters[ends] - letters[starts] + 1)]
    up, down = _POWERS.get(len(hashes) + 1)
    keys = []
    with np.errstate(over="ignore"):
        for salt in (0x51ED270B, 0xC2B2AE3D):
            run = np.r_[np.uint64(0), np.cumsum(mix(hashes ^ np.uint64(salt)) * up[: len(hashes)], dtype=np.uint64)]
            keys.append(mix((run[first[1:]] - run[head]) * down[head] + np.diff(first).astype(np.uint64)).view(np.int64))
    return Lines(row, number, *keys, chars[first[1:]] - chars[head] - 1, starts, ends, hashes, first)


def _words(cut: Lines, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of signs, first) of the words of over three bytes of the given lines, or of all where there are fewer than four such."""
    n = cut.first[lines + 1] - cut.first[lines]
    words = _ranges(cut.first[lines], cut.first[lines + 1])
    long = cut.ends[words] - cut.starts[words] > 3
    most = np.add.reduceat(long, np.cumsum(n) - n) if len(n) else n
    used = long | np.repeat(most < 4, n)
    return (cut.hashes[words[used]] >> np.uint64(64 - ROW_BITS)).astype(np.int64), np.r_[0, np.cumsum(np.where(most < 4, n, most))]


def _byte_pairs(buf: np.ndarray, cut: Lines, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows of signs, first) of pairs of adjacent bytes in the given lines; each word's first byte follows a blank, a line's a line feed."""
    words = _ranges(cut.first[lines], cut.first[lines + 1])
    length = cut.ends[words] - cut.starts[words]
    byte = FOLD[buf[_ranges(cut.starts[words], cut.ends[words])]].astype(np.int64)
    before = np.r_[0, byte[:-1]]
    at = np.r_[0, np.cumsum(length)]
    before[at[:-1]] = 32
    first = at[np.r_[0, np.cumsum(cut.first[lines + 1] - cut.first[lines])]]
    before[first[:-1]] = 10
    return (mix((before * 256 + byte).astype(np.uint64)) >> np.uint64(64 - ROW_BITS)).astype(np.int64), first


def _ranges(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """a[0], ..., z[0] - 1, a[1], ..."""
    n = z - a
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - a, n)


def _narrow(p: LineParams) -> bool:
    """Whether the symbols of a block fit 31 bits."""
    return max(p.word_blocks[1] * p.word_group.bit_length(), p.byte_blocks[1] * p.byte_group.bit_length()) <= 31


_ATTRIBUTES = ("size", *(f"{x}{k}" for x in "wb" for k in range(1, 5)))
_SKETCH = "doc_id long, line_no int, k1 long, k2 long, size int, " + ", ".join(f"{x}{k} long" for x in "wb" for k in range(1, 5))


def sketches(docs: DataFrame, p: LineParams) -> DataFrame:
    """docs (doc_id, text) -> keys, characters, SimHashes of words and of byte pairs (null where a line has none) and blocks of each line with a word.

    Blocks are their symbols alone where these fit an int: those of words, if any, come before those of byte pairs.
    """
    narrow = _narrow(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, buf, offs in chunks(batch.column(1), PIECE):
                cut = cut_lines(buf, offs)
                n = len(cut.row)
                kinds = []
                # a change of the similarity moves characters per word by less than a fourth, so near pairs have a kind in common
                density, edge = cut.size / np.diff(cut.first), 100 / p.similarity_percent
                words = (cut.size >= p.short / edge) & (density <= p.few_words * edge)
                pairs = (cut.size <= p.short) | (density > p.few_words / edge)
                for which, blocks, group, made, seed in ((words, p.word_blocks, p.word_group, p.word_sums, 1), (pairs, p.byte_blocks, p.byte_group, p.byte_sums, 2)):
                    at = np.flatnonzero(which)
                    rows, first = _words(cut, at) if seed == 1 else _byte_pairs(buf, cut, at)
                    sim, keys = signatures(rows, first, blocks, seed, group, made)
                    kinds.append((at, which, sim, keys & ((1 << group.bit_length() * blocks[1]) - 1) if narrow else keys))
                counts = sum(np.where(which, keys.shape[1], 0) for _, which, _, keys in kinds)
                offsets = np.r_[0, np.cumsum(counts)]
                flat, sims, filled = np.empty(offsets[-1], np.int32 if narrow else np.int64), [], offsets[:-1].copy()
                for at, which, sim, keys in kinds:
                    flat[(filled[at][:, None] + np.arange(keys.shape[1])).ravel()] = keys.ravel()
                    filled[at] += keys.shape[1]
                    for half in range(SIGNS // 64):
                        column = np.zeros(n, np.int64)
                        column[at] = sim[:, half]
                        sims.append(pa.array(column, mask=~which))
                ids = batch.column(0).take(pa.array(i + cut.row))
                columns = [ids, pa.array(cut.number, pa.int32()), pa.array(cut.k1), pa.array(cut.k2), pa.array(cut.size, pa.int32()), *sims, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))]
                for a in range(0, n, 4096):
                    yield pa.RecordBatch.from_arrays([c.slice(a, 4096) for c in columns], ["doc_id", "line_no", "k1", "k2", *_ATTRIBUTES, "blocks"])

    return _plain(docs).mapInArrow(run, f"{_SKETCH}, blocks array<{'int' if narrow else 'long'}>")


def _members(lines: DataFrame, p: LineParams, turn: int) -> DataFrame:
    """(node, bucket) for each block of the round of lines (node, w1, blocks)."""
    if not _narrow(p):
        return lines.select("node", F.explode("blocks").alias("bucket")).where(F.pmod("bucket", F.lit(ROUNDS)) == turn)
    each = lines.select("node", F.when(F.col("w1").isNull(), p.word_blocks[0]).otherwise(0).alias("before"), F.posexplode("blocks").alias("number", "symbols")).where(F.pmod("number", F.lit(ROUNDS)) == turn)
    return each.select("node", F.shiftleft((F.col("before") + F.col("number")).cast("long"), 32).bitwiseOR(F.col("symbols").cast("long")).alias("bucket"))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, line_no, k1, k2 of each line with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, buf, offs in chunks(batch.column(1), PIECE):
                cut = cut_lines(buf, offs)
                ids = batch.column(0).take(pa.array(i + cut.row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(cut.number, pa.int32()), pa.array(cut.k1), pa.array(cut.k2)], ["doc_id", "line_no", "k1", "k2"])

    return _plain(docs).mapInArrow(run, "doc_id long, line_no int, k1 long, k2 long")


def _normalised(docs: DataFrame) -> DataFrame:
    """k1, k2, norm of each line with a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, buf, offs in chunks(batch.column(1), PIECE):
                cut = cut_lines(buf, offs)
                length = cut.ends - cut.starts
                # the words' bytes, each word followed by a blank, cut off at the line's end
                at = np.r_[0, np.cumsum(length + 1)]
                out = np.full(at[-1], 32, np.uint8)
                out[_ranges(at[:-1], at[1:] - 1)] = FOLD[buf[_ranges(cut.starts, cut.ends)]]
                begin, end = at[cut.first[:-1]], at[cut.first[1:]] - 1
                text = out.tobytes()
                lines = [text[a:z].decode("utf-8", "replace") for a, z in zip(begin.tolist(), end.tolist(), strict=True)]
                for a in range(0, len(lines), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(cut.k1[a : a + 4096]), pa.array(cut.k2[a : a + 4096]), pa.array(lines[a : a + 4096], pa.string())], ["k1", "k2", "norm"])

    return _plain(docs).select("doc_id", "text").mapInArrow(run, "k1 long, k2 long, norm string")


def distance(x: str, y: str) -> int:
    """Edit distance with a column of the table in each integer (bit-parallel)."""
    m, codes = len(x), np.frombuffer(x.encode("utf-32-le"), np.uint32)
    at = {chr(c): int.from_bytes(np.packbits(codes == c, bitorder="little").tobytes(), "little") for c in np.unique(codes).tolist()}
    full = (1 << m) - 1
    up, down, score = full, 0, m  # where a column's entries rise and fall
    for c in y:
        equal = at.get(c, 0)
        across = (((equal & up) + up) ^ up) | equal
        rise, fall = down | (full & ~(across | up)), up & across
        score += (rise >> m - 1 & 1) - (fall >> m - 1 & 1)
        rise, fall, diagonal = rise << 1 | 1, fall << 1, equal | down
        up, down = (fall | ~(diagonal | rise)) & full, rise & diagonal & full
    return score


def most_apart(x: list[str], y: list[str], enough: int) -> int:
    """An upper bound of the edit distance of two lines of words, or a number above ``enough``: words are aligned from the left, and what
    lies between two equal ones is replaced as a whole."""
    i = j = cost = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        step = next(((a, s - a) for s in range(1, 9) for a in range(s + 1) if x[i + a : i + a + 1] == y[j + s - a : j + s - a + 1] != []), None)
        if step is None:
            step = (len(x) - i, len(y) - j)
        cost += max(sum(map(len, z[k : k + n])) + n for z, k, n in ((x, i, step[0]), (y, j, step[1])))
        if cost > enough:
            return cost
        i, j = i + step[0], j + step[1]
    return cost + max(sum(map(len, x[i:])) + len(x) - i, sum(map(len, y[j:])) + len(y) - j)


def _pair_counts(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.bincount((codes[1:] * 31 + codes[:-1]) & 2047, minlength=2048)


def similar(s: str, t: str, percent: int) -> bool:
    """Whether the edit similarity is percent or more: by an upper bound, by the q-gram bound, else by the distance.

    A change of one character changes at most two pairs of adjacent characters on either side, so a distance of d
    leaves the counts of pairs at most 4 * d apart in all.
    """
    most = max(len(s), len(t)) * (100 - percent) // 100
    if abs(len(s) - len(t)) > most:
        return False
    if most_apart(s.split(" "), t.split(" "), most) <= most:
        return True
    return np.abs(_pair_counts(s) - _pair_counts(t)).sum() <= 4 * most and distance(s, t) <= most


def _links(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose texts are similar enough, by edit distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [k for k in range(batch.num_rows) if similar(batch.column(2)[k].as_py(), batch.column(3)[k].as_py(), percent)]
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    side = lambda end: texts.select(F.col("node").alias(end), F.col("norm").alias(f"norm_{end}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "norm_a", "norm_b")
    return both.mapInArrow(run, "a long, b long")


def _bitmap(keys: DataFrame, hash_: F.Column, size: int) -> DataFrame:
    """(slot, bits) with a bit for each hash: at most ``size`` rows."""
    return keys.groupBy(F.pmod(hash_, F.lit(size)).alias("slot")).agg(F.bit_or(_bit(hash_)).alias("bits"))


def _bit(hash_: F.Column) -> F.Column:
    return F.element_at(F.array(*(F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64))), (F.pmod(F.shiftrightunsigned(hash_, 32), F.lit(64)) + 1).cast("int"))


def _alike(p: LineParams) -> F.Column:
    """The lengths allow the similarity, and the SimHashes of a kind that both lines a and b have are within the distance."""

    def apart(kind: str) -> F.Column:
        return sum((F.bit_count(F.col(f"a_{kind}{k}").bitwiseXOR(F.col(f"b_{kind}{k}"))) for k in range(1, 5)), F.lit(0))

    near = F.coalesce(apart("w") <= p.word_apart, F.lit(False)) | F.coalesce(apart("b") <= p.byte_apart, F.lit(False))
    return (100 * F.least("a_size", "b_size") >= p.similarity_percent * F.greatest("a_size", "b_size")) & near


def _named(df: DataFrame, end: str, *more: str) -> DataFrame:
    return df.select(*more, F.col("node").alias(end), *(F.col(x).alias(f"{end}_{x}") for x in _ATTRIBUTES))


def _texts(docs: DataFrame, wanted: DataFrame, p: LineParams, work: Workspace) -> DataFrame:
    """(node, norm) of the nodes (node, k1, k2), a stored table.

    A bitmap of at most ``bitmap_words`` longs, broadcast as a table, keeps most other lines out of the shuffle while few are wanted.
    """
    words = min(p.bitmap_words, 1 << max(10, (wanted.count() // 4).bit_length()))
    some = _normalised(docs).withColumn("slot", F.pmod(F.col("k1"), F.lit(words))).join(F.broadcast(_bitmap(wanted, F.col("k1"), words)), "slot")
    some = some.where(F.col("bits").bitwiseAND(_bit(F.col("k1"))) != 0).drop("slot", "bits")
    return work.save(some.join(wanted, ["k1", "k2"]).groupBy("node").agg(F.first("norm").alias("norm")), "texts")


def _crowded(lines: DataFrame, p: LineParams, turn: int, work: Workspace) -> DataFrame:
    """(bucket, node, hub, m) for each member of the round's buckets of two members and more: the smallest one, how many."""
    member = _members(lines, p, turn).repartition("bucket")
    star = member.groupBy("bucket").agg(F.min("node").alias("hub"), F.count("*").alias("m")).where("m > 1")
    # few buckets have two members, so they are looked up and the members need no sort
    return work.save(member.join(star.hint("shuffle_hash"), "bucket"), "buckets")


def line_groups(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """doc_id, line_no (from 0), group_lines, kept, first_doc_id, first_line_no (the group's first line): one row per line with a word."""
    work, percent = Workspace(docs.sparkSession, "lines", tidy=True), params.similarity_percent
    p = params
    grouped = sketches(docs, p).groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"), *(F.first(x).alias(x) for x in (*_ATTRIBUTES, "blocks")))
    whole = work.save(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")
    nodes = whole.drop("blocks")

    crowded = _crowded(whole, p, 0, work)
    for turn in range(1, ROUNDS):
        crowded = crowded.unionAll(_crowded(whole, p, turn, work))
    # all that follows is about lines with company
    busy = work.save(nodes.drop("first", "n").join(crowded.select("node").distinct(), "node", "left_semi"), "busy")

    near = _alike(p)
    spokes = crowded.where("node <> hub").select("node", "hub", "m").groupBy(F.col("hub").alias("a"), F.col("node").alias("b")).agg(F.max("m").alias("m"))
    sides = spokes.join(_named(busy, "b"), "b").join(_named(busy, "a"), "a")
    pairs = work.save(sides.where(near).select("a", "b"), "pairs")
    # of two in a bucket that are not near, no text is needed
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionAll(crowded.where("m > 2").select("node")).distinct()
    texts = _texts(docs, work.save(busy.select("node", "k1", "k2").join(ends, "node", "left_semi"), "wanted"), p, work)

    groups = connected_components(work.save(_links(pairs, texts, percent), "links"), work)

    # buckets that still hold several components: all pairs between two of them but those with the hub
    placed = crowded.where("m > 2 AND node <> hub").join(groups, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    sizes = placed.groupBy("bucket", "component").count()
    main = sizes.groupBy("bucket").agg(F.max(F.struct("count", "component")).alias("c"), F.count("*").alias("several")).where("several > 1").select("bucket", F.col("c.component").alias("main"))
    mixed = work.save(placed.join(main, "bucket").join(busy.select("node", *_ATTRIBUTES), "node"), "mixed")
    left = _named(mixed.where("component <> main").withColumnRenamed("component", "of_a"), "a", "bucket", "of_a", "main")
    right = _named(mixed.withColumnRenamed("component", "of_b"), "b", "bucket", "of_b")
    # two that are both outside of the main component meet once
    met = left.join(right, "bucket").where((F.col("of_a") != F.col("of_b")) & ((F.col("of_b") == F.col("main")) | (F.col("a") < F.col("b"))) & near)
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    more = work.save(met, "pairs")
    groups = extended(groups, work.save(_links(more, texts, percent), "links"), work)

    named = nodes.join(groups, "node", "left").select("k1", "k2", "n", "first", F.coalesce("component", "node").alias("group"))
    totals = named.groupBy("group").agg(F.sum("n").alias("group_lines"), F.min("first").alias("first"))
    answer = named.select("k1", "k2", "group").join(totals, "group").select("k1", "k2", "group_lines", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").alias("first_line_no"))
    kept = F.col("doc_id").eqNullSafe(F.col("first_doc_id")) & (F.col("line_no") == F.col("first_line_no"))
    return _numbered(docs).join(answer, ["k1", "k2"]).select("doc_id", "line_no", "group_lines", kept.alias("kept"), "first_doc_id", "first_line_no")


def deduplicated(docs: DataFrame, params: LineParams = LineParams()) -> DataFrame:
    """The documents without the lines that their groups don't keep."""
    gone_, id_ = fresh(docs, "gone"), fresh(docs, "id")
    gone = line_groups(docs, params).where("NOT kept").groupBy(F.col("doc_id").alias(id_)).agg(F.collect_set("line_no").alias(gone_))
    found = docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)), "left")
    parts = F.split(F.col("text").cast("string"), "\n")
    left = F.array_join(F.filter(parts, lambda x, k: ~F.array_contains(gone_, k)), "\n")
    return found.withColumn("text", F.when(F.col(gone_).isNull(), F.col("text")).otherwise(left)).select(*docs.columns)
