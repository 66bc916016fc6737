"""Near-duplicate documents by circulant MinHash, banding and exact verification.

Two permutations make a whole signature: sigma spreads a shingle's 64-bit hash (a
bijection) over SLOTS positions, and pi, a fixed random permutation of the positions,
is read at the position shifted circularly by 0, 1, 2, ... for coordinate 0, 1, 2, ...
A shingle's values for all coordinates are so one contiguous slice of pi.

Plan
  1. One pass over the texts gives set size, a 128-bit key of the whole set and the
     band keys.  Equal sets collapse to a class, named by its smallest id.
  2. In each bucket of a band key the smallest class is the hub.  Classes are compared exactly, on full sets, with their
     smallest hub, then with their other hubs where these are in another component by then: each set is
     sent to the hub once for each comparison, and a hub's members are dealt to tasks of bounded size.
  3. Buckets that still hold several components are compared in full: the classes outside of the main component
     of such buckets, in blocks of bounded size, with one another and with the main component's, each
     pair of blocks in one task that returns a spanning forest of the true links.  So no pair that shares a bucket and isn't in
     one component already is skipped, no group is gathered whole, and the main component of m classes is not compared with itself.
  4. Components of the verified links give the result.

Sets are of 64-bit hashes of shingles; two shingles of one hash are taken as equal.

At a Jaccard similarity of 0.85 the chance that no band meets is (1 - 0.85**8)**40,
about 3e-6; at 0.8 with the general defaults it is 5e-4 for one link.

Defined cases: null or blank texts have an empty set and link with nothing; texts with
fewer words than a shingle count as one shingle of all their words; repeated rows get
equal results; a null id is returned unlinked with null component and kept false;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, extended
from .textbatch import SPACED, chunks, whole_hash, window_hashes, word_bounds, word_hashes
from .workspace import Workspace

SLOTS = 1 << 20


@dataclass(frozen=True)
class MinHashParams:
    """width: words in a shingle; links need 100 * intersection >= percent * union."""

    width: int = 5
    percent: int = 80
    rows: int = 8
    bands: int = 40
    block: int = 128
    block_shingles: int = 400_000


@lru_cache(maxsize=2)
def _shifts(coordinates: int) -> np.ndarray:
    """Row p holds pi at p, p + 1, ... (circularly): the values of slot p for every coordinate."""
    pi = np.random.default_rng(20_011).permutation(SLOTS).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:coordinates]]), coordinates)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash signature of a nonempty set of 64-bit hashes."""
    table = _shifts(coordinates)
    slots = (shingles >> np.uint64(44)).astype(np.int64)  # the hashes come out of a bijective mix: sigma
    out = np.full(coordinates, SLOTS, np.uint32)
    for i in range(0, len(slots), 1024):
        np.minimum(out, table[slots[i : i + 1024]].min(axis=0), out=out)
    return out


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for i, j, buf, offs in chunks(column):
        starts, ends, first = word_bounds(buf, offs, SPACED)
        words = word_hashes(buf, starts, ends)
        windows = window_hashes(words, width)
        for k in range(j - i):
            a, z = first[k], first[k + 1]
            if z - a >= width:
                yield np.unique(windows[a : z - width + 1])
            else:
                yield whole_hash(words[a:z]) if z > a else np.empty(0, np.uint64)


_SKETCH = "doc_id long, n_shingles long, set_key binary, bands array<long>"


def sketches(docs: DataFrame, p: MinHashParams) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands) of each row; no key or bands for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = np.random.default_rng(5).integers(1, 1 << 62, p.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        salt = np.arange(p.bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            sizes, keys, bands = [], [], []
            for s in shingle_sets(batch.column(1), p.width):
                sizes.append(len(s))
                if not len(s):
                    keys.append(None)
                    bands.append(None)
                    continue
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig = signature(s, p.rows * p.bands).astype(np.uint64).reshape(p.bands, p.rows)
                x = (sig * mult).sum(axis=1, dtype=np.uint64) + salt
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                bands.append((x ^ (x >> np.uint64(32))).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "set_key", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SKETCH)


def _forest(ids: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the same members as all pairs with 100 * i >= percent * u would."""
    k = len(ids)
    sizes = np.array([len(s) for s in sets])
    tokens, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(k), sizes)
    shared = counts[inverse] > 1
    column = (np.cumsum(counts > 1) - 1)[inverse][shared]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((k, k), np.float64)
    n = int(column[-1]) + 1 if len(column) else 0
    step = 4096
    for c in range(0, n, step):
        lo, hi = np.searchsorted(column, [c, c + step])
        grid = np.zeros((k, min(step, n - c)), np.float32)
        grid[owner[lo:hi], column[lo:hi] - c] = 1
        common += grid @ grid.T
    common = np.rint(common).astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    near = (100 * common >= percent * union) & (ids[:, None] != ids[None, :])
    root, links = np.full(k, -1), []
    for s in range(k):
        if root[s] >= 0:
            continue
        root[s], todo = s, [s]
        while todo:
            x = todo.pop()
            for y in np.flatnonzero(near[x] & (root < 0)):
                root[y] = s
                todo.append(int(y))
                links.append((int(ids[x]), int(ids[y])))
    return links


def _verified(candidates: DataFrame, percent: int) -> DataFrame:
    """candidates (comp, i, j, doc_id, shingles), sorted by (comp, i, j) in each partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sets = None, [], []

        def close() -> list[tuple[int, int]]:
            _, at = np.unique(np.array(ids, np.int64), return_index=True)
            return _forest(np.array(ids, np.int64)[at], [sets[x] for x in at], percent) if len(at) > 1 else []

        for batch in batches:
            out: list[tuple[int, int]] = []
            comp, i, j, doc = (batch.column(x).to_numpy(zero_copy_only=False) for x in range(4))
            for r in range(batch.num_rows):
                k = (comp[r], i[r], j[r])
                if k != key:
                    if key is not None:
                        out += close()
                    key, ids, sets = k, [], []
                ids.append(doc[r])
                sets.append(np.frombuffer(batch.column(4)[r].as_py(), np.uint64))
            yield _links(out)
        if key is not None:
            yield _links(close())

    return candidates.select("comp", "i", "j", "doc_id", "shingles").mapInArrow(run, "a long, b long")


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    ab = np.array(pairs, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])


def _common(x: np.ndarray, y: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def _hub_links(spokes: DataFrame, sets: DataFrame, p: MinHashParams) -> DataFrame:
    """The true links among spokes (a, b): a hub's set meets its members' in tasks of at most about four blocks of these."""
    hubs = spokes.groupBy("a").agg(F.ceil(F.count("*") / (4 * p.block)).cast("int").alias("parts"))
    mine = sets.withColumnsRenamed({"doc_id": "end"})
    members = spokes.join(hubs, "a").select("a", F.expr("cast(pmod(xxhash64(b), parts) AS int)").alias("part"), F.lit(1).alias("kind"), F.col("b").alias("end"))
    heads = hubs.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("a").alias("end"))
    dealt = members.unionByName(heads).join(mine.hint("merge"), "end").select("a", "part", "kind", "end", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hubs = None, []  # an id of several texts has several sets
        for batch in batches:
            out, head, part, kind, end = [], *(batch.column(x).to_numpy(zero_copy_only=False) for x in range(4))
            for r in range(batch.num_rows):
                own = np.frombuffer(batch.column(4)[r].as_py(), np.uint64)
                if at != (head[r], part[r]):
                    at, hubs = (head[r], part[r]), []
                if not kind[r]:
                    hubs.append(own)
                elif any(100 * (both := _common(hub, own)) >= p.percent * (len(hub) + len(own) - both) for hub in hubs):
                    out.append((head[r], end[r]))
            yield _links(out)

    return dealt.repartition("a", "part").sortWithinPartitions("a", "part", "kind").mapInArrow(run, "a long, b long")


def _block_links(mixed: DataFrame, sets: DataFrame, p: MinHashParams, work: Workspace) -> DataFrame:
    """The true links between components among mixed (bucket, rep, component, n): members of buckets that hold several."""
    star = mixed.groupBy("bucket").agg(F.min("rep").alias("hub"))
    edges = work.save(mixed.join(star, "bucket").select(F.col("hub").alias("a"), F.col("rep").alias("b")), "rough")
    rough = connected_components(edges, work).withColumnRenamed("component", "comp").withColumnRenamed("node", "rep")
    every = rough.join(mixed.select("rep", "component", "n").distinct(), "rep")
    main = every.groupBy("comp", "component").agg(F.count("*").alias("c")).groupBy("comp").agg(F.max(F.struct("c", "component"))["component"].alias("main"))
    sided = work.save(every.join(main, "comp").withColumn("other", (F.col("component") != F.col("main")).cast("int")), "sided")
    count = lambda k: F.greatest(F.ceil(F.count_if(F.col("other") == k) / p.block), F.ceil(F.sum(F.when(F.col("other") == k, F.col("n"))) / p.block_shingles)).cast("int")
    parts = sided.groupBy("comp").agg(count(0).alias("mains"), count(1).alias("others"))
    part = F.when(F.col("other") == 0, F.expr("pmod(xxhash64(rep), mains)")).otherwise(F.expr("mains + pmod(xxhash64(rep), others)")).cast("int")
    placed = sided.join(parts, "comp").withColumn("part", part)
    # parts of the main component meet only parts of others; those meet all
    partner = F.sequence(F.when(F.col("other") == 0, F.col("mains")).otherwise(F.lit(0)), F.col("mains") + F.col("others") - 1)
    dealt = placed.withColumn("with", F.explode(partner)).select(F.col("rep").alias("doc_id"), "comp", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"))
    dealt = dealt.join(sets.hint("merge"), "doc_id")
    return _verified(dealt.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j"), p.percent)


def near_duplicates(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, n_shingles, component_id, kept; one row per input row."""
    work, p = Workspace(docs.sparkSession, "minhash"), params
    sketch = work.save(sketches(docs, p), "sketches")
    filled = sketch.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = work.save(filled.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n")), "classes")

    heads = filled.withColumnRenamed("doc_id", "rep").join(classes.select("rep", "set_key"), ["rep", "set_key"], "left_semi")
    member = heads.select("rep", F.explode("bands").alias("bucket")).repartition("bucket")
    star = member.groupBy("bucket").agg(F.min("rep").alias("hub"), F.count("*").alias("m")).where("m > 1")
    crowded = work.save(member.join(star, "bucket"), "buckets")
    spokes = work.save(crowded.where("rep <> hub").groupBy(F.col("hub").alias("a"), F.col("rep").alias("b")).agg(F.lit(1)).select("a", "b"), "spokes")

    candidates = spokes.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([s.tobytes() for s in shingle_sets(batch.column(1), p.width)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["doc_id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    # a sort-merge join at every size: the candidates grow with the table
    sets = work.save(candidates.join(texts.hint("merge"), "doc_id").select("doc_id", "text").mapInArrow(to_sets, "doc_id long, shingles binary"), "sets")

    first = spokes.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = work.save(_hub_links(first, sets, p), "verified")
    found = connected_components(links, work)
    of = lambda end: found.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    apart = spokes.join(first, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b"))
    found = extended(found, work.save(_hub_links(apart.select("a", "b"), sets, p), "verified"), work)

    # hubs of buckets of two have met their only other member
    placed = crowded.where("m > 2").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "hub", F.coalesce("component", "rep").alias("component"))
    several = placed.where("rep <> hub").groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    mixed = work.save(placed.join(several, "bucket").join(classes.groupBy("rep").agg(F.sum("n").alias("n")), "rep").select("bucket", "rep", "component", "n"), "mixed")
    if not mixed.isEmpty():
        found = extended(found, work.save(_block_links(mixed, sets, p, work), "verified"), work)

    final = found.select(F.col("node").alias("rep"), F.col("component"))
    named = classes.select("set_key", "rep").join(final, "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component"))
    return (
        sketch.select("doc_id", "n_shingles", "set_key")
        .join(named, "set_key", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def one_of_each(docs: DataFrame, params: MinHashParams = MinHashParams()) -> DataFrame:
    """The first document (smallest id) of each group, with all its columns; rows with a null id stay."""
    work = Workspace(docs.sparkSession, "one-of-each")
    found = work.save(near_duplicates(docs, params).select("doc_id", "kept").where("doc_id IS NOT NULL"), "found")
    firsts = docs.join(found.where("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    repeated = found.where("kept").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return firsts
    once = firsts.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(*docs.columns)
    return firsts.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
