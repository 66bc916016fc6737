"""Benchmark decontamination by a distributed positional inverted index.

The documents are the index's shards: every task stores, for each piece of its texts,
the postings (word positions) of the terms that the test items use, in the order of the
terms.  A window of an item is looked up from its rarest term in that shard: the list of
that term, shifted by the term's offset in the window, gives the possible starts, and the
shifted lists of the next rarest terms are intersected with it one after the other.
What survives all terms is an exact phrase match; the same walk that lets every term, the rarest too,
stand up to ``slop`` words away from its place gives proximity matches: what is found does not depend on which term is the rarest
in a shard.  Words are known by 64-bit hashes.

Test items travel to the shards in blocks of at most ``block_words`` words.  One block is the usual
case; with more, each pass keeps a bitmap of the words that were hit so far and is written to the
shared folder before the next, so memory is bounded whatever the size of the benchmark.

Defined cases: a null text has no words and is not contaminated; an item without words or
without an id matches nothing; equal windows of several items count for each of them, repeated
item ids once; repeated documents get equal rows; no test items: no hits; an empty documents table
gives an empty result; other columns of either table are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbatch import ALNUM, chunks, word_bounds, word_hashes
from .workspace import Workspace, fresh


@dataclass(frozen=True)
class DecontaminationParams:
    window: int = 10
    slop: int = 2
    block_words: int = 2_000_000


class TestBlock:
    """Windows of some items as rows of term numbers, -1 past the end of a short one."""

    __test__ = False

    def __init__(self, ids: list[int], texts: pa.Array, window: int) -> None:
        rows, owners, hashes = [], [], []
        k = 0
        for i, j, buf, offs in chunks(texts):
            starts, ends, first = word_bounds(buf, offs, ALNUM)
            h = word_hashes(buf, starts, ends)
            for r in range(j - i):
                own = h[first[r] : first[r + 1]]
                if len(own):
                    hashes.append(own)
                    for s in range(max(1, len(own) - window + 1)):
                        rows.append(own[s : s + window])
                        owners.append(ids[k + r])
            k += j - i
        self.terms = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
        grid = np.full((len(rows), window), -1, np.int32)
        for x, r in enumerate(rows):
            grid[x, : len(r)] = np.searchsorted(self.terms, r)
        self.windows, which = np.unique(grid, axis=0, return_inverse=True) if len(rows) else (grid, np.empty(0, np.int64))
        self.length = (self.windows >= 0).sum(axis=1)
        pairs = np.unique(np.stack([which.ravel(), np.array(owners, np.int64)], axis=1), axis=0) if len(rows) else np.empty((0, 2), np.int64)
        self.items = pairs[:, 1]
        self.items_from = np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, first[row] + 0, 1, ... count[row] - 1) for every row."""
    row = np.repeat(np.arange(len(count)), count)
    step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return row, first[row] + step


#: Possible starts that are looked at together.
STARTS = 1 << 20


def search(words: np.ndarray, row_ends: np.ndarray, block: TestBlock, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, start) of exact matches and (window, a place in its row) of proximity matches in one shard.

    A proximity match has a start from which every term stands at most ``slop`` words away from its place, in one row.
    row_ends: for each word, the number of words before the end of its row.
    """
    none = np.empty(0, np.int64)
    if not len(words) or not len(block.windows):
        return none, none, none, none
    term = np.searchsorted(block.terms, words)
    term[term == len(block.terms)] = 0
    known = np.flatnonzero(block.terms[term] == words)
    number = np.full(len(words), -2, np.int32)
    number[known] = term[known]
    order = np.argsort(number[known], kind="stable")
    postings = known[order]  # the inverted index: positions, in order, by term
    size = np.bincount(number[known], minlength=len(block.terms))
    first = np.cumsum(size) - size

    width = block.windows.shape[1]
    cost = np.where(block.windows >= 0, size[block.windows], len(words) + 1)
    rank = np.argsort(cost, axis=1, kind="stable")  # each window's offsets, rarest term first
    live = np.flatnonzero((cost > 0).all(axis=1))
    lists = block.windows[live, rank[live, 0]]

    def narrow(window: np.ndarray, start: np.ndarray, home: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is left of the possible starts, all in the row of the word at home."""
        for k in range(width):
            offset = rank[window, k]
            wanted = block.windows[window, offset]
            found = wanted < 0
            for d in sorted(range(-slack, slack + 1), key=abs):
                place = start + offset + d
                inside = np.flatnonzero((place >= 0) & (place < len(words)))
                same = (number[place[inside]] == wanted[inside]) & (row_ends[place[inside]] == row_ends[home[inside]])
                found[inside[same]] = True
            window, start, home = window[found], start[found], home[found]
        return window, start, home

    out: list[list[np.ndarray]] = [[none], [none], [none], [none]]
    load, i = np.cumsum(size[lists]), 0
    while i < len(live):
        j = max(i + 1, int(np.searchsorted(load, (load[i - 1] if i else 0) + STARTS, "right")))
        row, at = _expand(first[lists[i:j]], size[lists[i:j]])
        window, home = live[i:j][row], postings[at]
        start = home - rank[window, 0]
        exact = narrow(window, start, home, 0)
        out[0].append(exact[0])
        out[1].append(exact[1])
        for d in range(-slop, slop + 1):  # the rarest term may be off its place, too
            near = narrow(window, start + d, home, slop)
            out[2].append(near[0])
            out[3].append(near[2])
        i = j
    return tuple(np.concatenate(x) for x in out)  # type: ignore[return-value]


def _scan(df: DataFrame, block: TestBlock, p: DecontaminationParams, last: bool, first: bool) -> DataFrame:
    """df (doc_id, text, bits, items, near): the hits of a block added, counts in place of the bits in the last pass."""
    sent = df.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        for batch in batches:
            counts, hits, bits, items, nears = [], [], [], [], []
            for i, j, buf, offs in chunks(batch.column(1)):
                starts, ends, before = word_bounds(buf, offs, ALNUM)
                n = len(starts)
                row = np.repeat(np.arange(j - i), np.diff(before))
                w, s, nw, ns = search(word_hashes(buf, starts, ends), before[row + 1], block, p.slop)
                cover = np.zeros(n + 1, np.int64)
                np.add.at(cover, s, 1)
                np.add.at(cover, s + block.length[w], -1)
                hit = np.cumsum(cover)[:n] > 0
                mine = [_by_row(row, x, y, block) for x, y in ((w, s), (nw, ns))]
                for r in range(j - i):
                    own = hit[before[r] : before[r + 1]]
                    if not first:
                        old = batch.column(2)[i + r].as_py()
                        own = own | np.unpackbits(np.frombuffer(old, np.uint8), count=len(own)).astype(bool)
                    counts.append(len(own))
                    hits.append(int(own.sum()))
                    bits.append(None if last else np.packbits(own).tobytes())
                    for out, got, at in ((items, mine[0], 3), (nears, mine[1], 4)):
                        new = got.get(r, [])
                        out.append(new if first else sorted({*new, *batch.column(at)[i + r].as_py()}))
            ids, lists = batch.column(0), pa.list_(pa.int64())
            items, nears = pa.array(items, lists), pa.array(nears, lists)
            if last:
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), items, nears], ["doc_id", "n_words", "n_hit", "items", "near_items"])
            else:
                yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.array(bits, pa.binary()), items, nears], ["doc_id", "text", "bits", "items", "near"])

    lists = "items array<long>, "
    return df.mapInArrow(run, f"doc_id long, n_words long, n_hit long, {lists}near_items array<long>" if last else f"doc_id long, text string, bits binary, {lists}near array<long>")


def _by_row(row: np.ndarray, window: np.ndarray, start: np.ndarray, block: TestBlock) -> dict[int, list[int]]:
    """The distinct items of the matches of each row."""
    k, at = _expand(block.items_from[window], block.items_from[window + 1] - block.items_from[window])
    pairs = np.unique(np.stack([row[start[k]], block.items[at]], axis=1), axis=0) if len(k) else np.empty((0, 2), np.int64)
    out: dict[int, list[int]] = {}
    for r, item in pairs.tolist():
        out.setdefault(r, []).append(item)
    return out


def _blocks(tests: DataFrame, p: DecontaminationParams) -> int:
    """How many blocks hold the items; a word takes two bytes with its separator, or more."""
    words = tests.agg(F.sum((F.octet_length("text") / 2).cast("long") + 1)).first()[0] or 0
    return -(-words // p.block_words) or 1


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id IS NOT NULL AND text IS NOT NULL")


def _block(tests: DataFrame, k: int, blocks: int, p: DecontaminationParams) -> TestBlock:
    rows = tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
    return TestBlock([r[0] for r in rows], pa.array([r[1] for r in rows], pa.string()), p.window)


def decontaminate(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items, near_items_sha256, items, near_items: one row per document.

    Items have occurring windows; near items have proximity matches, exact ones included.
    """
    work, p = Workspace(docs.sparkSession, "decontaminate"), params
    tests = _items(benchmark)
    blocks = _blocks(tests, p)
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for k in range(blocks):
        df = _scan(df, _block(tests, k, blocks, p), p, last=k == blocks - 1, first=k == 0)
        if k < blocks - 1:
            df = work.save(df, "pass")
    named = lambda c: F.sha2(F.concat_ws(",", F.array_sort(F.col(c).cast("array<string>"))), 256)
    count = lambda c: F.size(c).cast("long")
    return df.select(
        "doc_id", "n_words", "n_hit", count("items").alias("n_items"), named("items").alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        count("near_items").alias("n_near_items"), named("near_items").alias("near_items_sha256"), "items", "near_items",
    )


def near_matches(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """doc_id, n_items, n_near_items, near_items_sha256, near: proximity matches, exact ones included, one row per document."""
    out = decontaminate(docs, benchmark, params)
    return out.select("doc_id", "n_items", "n_near_items", "near_items_sha256", (F.col("n_near_items") > 0).alias("near"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """The documents without an exact or proximity match of a window, with all their columns."""
    tests, names = _items(benchmark), docs.columns
    blocks = _blocks(tests, params)
    if blocks > 1:
        row = fresh(docs, "row")
        wide = Workspace(docs.sparkSession, "decontaminate").save(docs.withColumn(row, F.monotonically_increasing_id()), "documents")
        found = decontaminate(wide.select(F.col(row).alias("doc_id"), "text"), benchmark, params)
        return wide.join(found.where("contaminated OR size(near_items) > 0").select(F.col("doc_id").alias(row)), row, "left_anti").select(*names)
    sent, where = docs.sparkSession.sparkContext.broadcast(_block(tests, 0, 1, params)), names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for i, j, buf, offs in chunks(batch.column(where)):
                starts, ends, before = word_bounds(buf, offs, ALNUM)
                row = np.repeat(np.arange(j - i), np.diff(before))
                _, start, _, near = search(word_hashes(buf, starts, ends), before[row + 1], sent.value, params.slop)
                kept.append(i + np.setdiff1d(np.arange(j - i), row[np.concatenate([start, near])]))
            yield batch.take(pa.array(np.concatenate(kept))) if kept else batch

    return docs.mapInArrow(run, docs.schema)


_WORDS_SQL = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_COMMON_SQL = f"""
w AS (SELECT doc_id, {_WORDS_SQL.format("coalesce(text, '')")} AS ws FROM documents),
b AS (SELECT item_id, {_WORDS_SQL.format("text")} AS ws FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS k, ws[p : p + 9] AS words, array_to_string(ws[p : p + 9], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS p FROM b WHERE len(ws) > 0)
), bt AS (SELECT win, k, words[q] AS word, q FROM (SELECT DISTINCT win, k, words, unnest(range(1, k + 1)) AS q FROM bw)),
rarest AS (
  SELECT win, k, word, q, row_number() OVER (PARTITION BY win ORDER BY coalesce(n, 0), q) AS r
  FROM bt LEFT JOIN (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM w) GROUP BY word) USING (word)
), dt AS (SELECT doc_id, ws[p] AS word, p, ws FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w) WHERE ws[p] IN (SELECT word FROM rarest WHERE r = 1)),
starts AS (SELECT DISTINCT doc_id, win, p - q + d AS s, ws FROM dt JOIN (SELECT * FROM rarest WHERE r = 1) USING (word) CROSS JOIN (SELECT unnest(range(-2, 3)) AS d)),
near AS (
  SELECT DISTINCT doc_id, win FROM starts JOIN (SELECT DISTINCT win, words, k FROM bw) USING (win)
  WHERE {" AND ".join(f"(k < {q} OR list_contains(ws[greatest(1, s + {q - 2}) : greatest(0, s + {q + 2})], words[{q}]))" for q in range(1, 11))}
), near_items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM near JOIN bw USING (win)) GROUP BY doc_id
), lengths AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT doc_id, k, p, array_to_string(ws[p : p + k - 1], ' ') AS win
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM w CROSS JOIN lengths WHERE len(ws) >= k)
), m AS (
  SELECT doc_id, dw.k AS k, p, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.k = bw.k
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM (SELECT DISTINCT doc_id, p, k FROM m)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id
)"""

#: The digest columns in DuckDB's SQL.
ORACLE_SQL = f"""WITH {_COMMON_SQL}
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(near_items.n, 0) AS BIGINT) AS n_near_items, sha256(coalesce(near_items.names, '')) AS near_items_sha256
FROM w LEFT JOIN hit ON w.doc_id = hit.doc_id LEFT JOIN items ON w.doc_id = items.doc_id LEFT JOIN near_items ON w.doc_id = near_items.doc_id
"""

NEAR_SQL = f"SELECT doc_id, n_items, n_near_items, near_items_sha256, n_near_items > 0 AS near FROM ({ORACLE_SQL})"
