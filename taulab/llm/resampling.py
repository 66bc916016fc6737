"""Importance resampling of documents towards a target corpus, over inverted postings.

Features are the runs of 1 to 2 words of a text, hashed to buckets.  Every piece of texts is inverted: for each
bucket the list of (document, count).  Lists travel in blocks, all buckets of one part and one piece together, to the tasks of their part,
where they meet the counts that both corpora have in the part's buckets.  There each bucket's gain, the
logarithm of how much more frequent it is in the target, is computed, and the lists give every document its contribution
(count times gain); contributions are added up by document.  A task reads the counts first and the blocks one by one after them, so it holds
one block at a time however many documents a bucket has; parts are split over many tasks by a hash of the piece,
so a bucket that nearly all documents share makes no task long.  Counts are added up inside tasks before they are shuffled.

Documents of at least ``least_words`` words are drawn without replacement: those with the highest sums of weight and
Gumbel noise, which follows from the id.  Ranks come from ranges of the order, not from one sort.

Defined cases: a null or empty text has no features and weight 0; a null id is hashed like an empty one and comes
last among ties; repeated rows are documents of their own, and which of equal rows with equal ids comes first makes no difference;
without target texts all gains follow from the documents alone; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import numbered
from .textbatch import ALNUM, chunks, word_bounds, word_hashes
from .workspace import Workspace


@dataclass(frozen=True)
class ResamplingParams:
    buckets: int = 10_000
    parts: int = 16
    percent: int = 25
    least_words: int = 20
    seed: int = 7

    @property
    def slots(self) -> int:
        """Buckets of a part: number b is slot b // parts of part b % parts."""
        return -(-self.buckets // self.parts)


#: Words of up to so many bytes are appended by tables.
TABLED = 64


def _shift_tables() -> np.ndarray:
    """For each length and each byte of a CRC-32, what becomes of it when so many zero bytes follow."""
    one = np.array([zlib.crc32(b"\0", b) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    tables = np.empty((TABLED + 1, 4, 256), np.uint32)
    tables[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(TABLED):
        tables[n + 1] = (tables[n] >> np.uint32(8)) ^ one[tables[n] & np.uint32(255)]
    return tables


_TABLES: list[np.ndarray] = []


def followed(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32s of texts from which those of the texts with ``length`` more bytes follow by XOR with the CRC-32 of the rest."""
    if not _TABLES:
        _TABLES.append(_shift_tables())
    short = np.minimum(length, TABLED)
    out = np.zeros(len(crc), np.uint32)
    for k in range(4):
        out ^= _TABLES[0][short, k, (crc >> np.uint32(8 * k)) & np.uint32(255)]
    for i in np.flatnonzero(length > TABLED):
        zeros = bytes(int(length[i]))
        out[i] = zlib.crc32(zeros, int(crc[i])) ^ zlib.crc32(zeros)
    return out


def features(buf: np.ndarray, offs: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of all features of a piece of texts, and the words of each row."""
    starts, ends, before = word_bounds(buf, offs, ALNUM)
    kinds, first, which = np.unique(word_hashes(buf, starts, ends), return_index=True, return_inverse=True)
    texts = [buf[a:b].tobytes().lower() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    crc = np.fromiter(map(zlib.crc32, texts), np.uint32, len(texts))
    spaced = np.fromiter((zlib.crc32(b" ", c) for c in crc.tolist()), np.uint32, len(texts))
    length = (ends - starts)[first]
    row = np.repeat(np.arange(len(offs) - 1), np.diff(before))
    pair = np.flatnonzero(row[1:] == row[:-1])
    left, right = which[pair], which[pair + 1]
    both = followed(spaced[left], length[right]) ^ crc[right]
    return np.concatenate([row, row[pair]]), np.concatenate([crc[which], both]).astype(np.int64) % buckets, np.diff(before)


def packed(numbers: list[np.ndarray]) -> bytes:
    """Small numbers, one byte of each after the other, compressed."""
    flat = np.concatenate(numbers).astype("<u4")
    return pa.compress(flat.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def inverted(row: np.ndarray, bucket: np.ndarray, rows: int, params: ResamplingParams) -> Iterator[tuple[int, int, bytes]]:
    """(part, postings, block) for the parts of a piece's inverted lists.

    A block has the length of each slot's list, then the steps from document to document in each list (its first document itself), then the counts.
    """
    slot = bucket % params.parts * params.slots + bucket // params.parts
    keys, counts = np.unique(slot * rows + row, return_counts=True)
    slot, doc = keys // rows, keys % rows
    step = doc.copy()
    same = slot[1:] == slot[:-1]
    step[1:][same] -= doc[:-1][same]
    edges = np.searchsorted(slot, np.arange(params.parts + 1) * params.slots)
    for part, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
        if a < b:
            lengths = np.bincount(slot[a:b] - part * params.slots, minlength=params.slots)
            yield part, b - a, packed([lengths, step[a:b], counts[a:b]])


def postings(block: bytes, n: int, params: ResamplingParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, document, count) of a block's n postings."""
    numbers = unpacked(block, params.slots + 2 * n)
    lengths, step, counts = np.split(numbers, [params.slots, params.slots + n])
    run = np.cumsum(step)
    first = np.cumsum(lengths) - lengths
    base = np.concatenate([[0], run])[first]
    return np.repeat(np.arange(params.slots), lengths), run - np.repeat(base, lengths), counts


#: Rows of three kinds: a block of lists (part from 0), the documents of a piece (part -1), a task's counts by bucket (part -2).
INDEX = "chunk long, part int, n_postings long, lists binary, ids array<long>, n_features array<long>, n_words array<long>, totals array<long>"
DOCUMENTS, TOTALS = -1, -2
_LISTS = pa.list_(pa.int64())
_FIELDS = [("chunk", pa.int64()), ("part", pa.int32()), ("n_postings", pa.int64()), ("lists", pa.binary()), ("ids", _LISTS), ("n_features", _LISTS), ("n_words", _LISTS), ("totals", _LISTS)]


def _index_rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, pa.schema(_FIELDS))


def index(texts: DataFrame, params: ResamplingParams, whole: bool = True) -> DataFrame:
    """INDEX rows of a table (doc_id, text); only the counts if not whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, chunk = np.zeros(params.buckets, np.int64), TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j, buf, offs in chunks(batch.column(1)):
                row, bucket, n_words = features(buf, offs, params.buckets)
                totals += np.bincount(bucket, minlength=params.buckets)
                if not whole:
                    continue
                ids, sizes = batch.column(0).slice(i, j - i).to_pylist(), np.bincount(row, minlength=j - i)
                yield _index_rows([{"chunk": chunk, "part": DOCUMENTS, "ids": ids, "n_features": sizes.tolist(), "n_words": n_words.tolist()}])
                for part, n, block in inverted(row, bucket, j - i, params):
                    yield _index_rows([{"chunk": chunk, "part": part, "n_postings": n, "lists": block}])
                chunk += 1
        yield _index_rows([{"part": TOTALS, "totals": totals.tolist()}])

    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, INDEX)


def _counts(rows: DataFrame, name: str) -> DataFrame:
    """bucket, count: a row for each bucket that occurs."""
    each = rows.where(F.col("part") == TOTALS).select(F.posexplode("totals").alias("bucket", name)).where(F.col(name) > 0)
    return each.groupBy("bucket").agg(F.sum(name).alias(name))


def gain(s: int, t: int, all_s: int, all_t: int, buckets: int) -> int:
    """Thousandths of the logarithm of how much more frequent a bucket is in the target, smoothed by one."""
    return math.floor(1000 * math.log((t + 1.0) * (all_s + buckets) / ((s + 1.0) * (all_t + buckets))))


def contributions(rows: DataFrame, counts: DataFrame, params: ResamplingParams) -> DataFrame:
    """chunk, place, gain: for each document of a piece what the buckets of one part contribute to its sum of gains.

    rows: a stored index; counts: bucket, s, t, at most a row for each bucket.
    """
    all_s, all_t = counts.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = -(-4 * tasks // params.parts)
    part = (F.col("bucket") % params.parts).cast("int")
    both = counts.groupBy(part.alias("part")).agg(F.collect_list(F.struct("bucket", "s", "t")).alias("counts"))
    both = both.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("chunk", F.lit(-1).cast("long"))
    blocks = rows.where("part >= 0").select("part", "chunk", "n_postings", "lists", F.pmod(F.xxhash64("chunk"), F.lit(salts)).cast("int").alias("salt"))
    met = both.unionByName(blocks, allowMissingColumns=True).repartition(tasks, "part", "salt")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = np.zeros(params.slots, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                if r["lists"] is None:
                    gains[:] = 0
                    for x in r["counts"]:
                        gains[x["bucket"] // params.parts] = gain(x["s"], x["t"], all_s, all_t, params.buckets)
                    continue
                slot, doc, count = postings(r["lists"], r["n_postings"], params)
                seen = np.flatnonzero(np.bincount(doc))
                total = np.zeros(int(doc.max()) + 1, np.int64)
                np.add.at(total, doc, gains[slot] * count)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen), r["chunk"])), pa.array(seen), pa.array(total[seen])], ["chunk", "place", "gain"])

    # the counts, of chunk -1, come first in each part and salt
    return met.sortWithinPartitions("part", "salt", "chunk").select("part", "chunk", "n_postings", "lists", "counts").mapInArrow(run, "chunk long, place long, gain long")


def importance(docs: DataFrame, target: DataFrame, params: ResamplingParams = ResamplingParams()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank: one row per document; rank is null for those not drawn."""
    work = Workspace(docs.sparkSession, "resampling")
    rows = work.save(index(docs, params), "index")
    counts = _counts(rows, "s").join(_counts(index(target, params, whole=False), "t"), "bucket", "full").na.fill(0, ["s", "t"])
    counts = work.save(counts, "counts")
    sums = contributions(rows, counts, params).groupBy("chunk", "place").agg(F.sum("gain").alias("gain"))
    zipped = F.posexplode(F.arrays_zip("ids", "n_features", "n_words"))
    listed = rows.where(F.col("part") == DOCUMENTS).select("chunk", zipped.alias("place", "of")).select("chunk", F.col("place").cast("long").alias("place"), "of.*")
    whole = listed.join(sums, ["chunk", "place"], "left")
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0))
    key = F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col("ids").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = whole.select(F.col("ids").alias("doc_id"), "n_words", "n_features", weight.cast("long").alias("weight"), noise.alias("noise"), "chunk", "place")
    scored = work.save(scored.withColumn("score", F.col("weight") + F.col("noise")).withColumn("fit", F.col("n_words") >= params.least_words), "scores")
    drawn = params.percent * scored.where("fit").count() // 100
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("chunk").asc(), F.col("place").asc()]
    ranked = numbered(scored, order, work, "at")
    rank = F.when(F.col("at") < drawn, F.col("at") + 1)
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", rank.cast("long").alias("rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, params: ResamplingParams = ResamplingParams()) -> DataFrame:
    """The documents that are drawn, with all their columns; rows of one id stay together and are drawn if one of them is."""
    ids = importance(docs, target, params).where("rank IS NOT NULL").select(F.col("doc_id").alias("drawn_id")).distinct()
    return docs.join(ids, F.col("doc_id").cast("long").eqNullSafe(F.col("drawn_id")), "left_semi")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_FEATURES_SQL = "unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])))"

#: The contract's columns in DuckDB's SQL, with CRC-32 computed byte by byte for all distinct features at once.
ORACLE_SQL = f"""WITH RECURSIVE
w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS ws FROM documents),
fd AS MATERIALIZED (SELECT r, feature, count(*) AS n FROM (SELECT r, {_FEATURES_SQL} AS feature FROM w) GROUP BY r, feature),
ft AS MATERIALIZED (SELECT feature, count(*) AS n FROM (SELECT {_FEATURES_SQL} AS feature FROM (SELECT {_WORDS_SQL} AS ws FROM benchmark)) GROUP BY feature),
tab AS MATERIALIZED (
  SELECT b, list_reduce(list_prepend(b, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v
  FROM (SELECT unnest(range(256)) AS b)
),
crc AS (
  SELECT feature, hex(feature) AS hx, 0 AS pos, 4294967295::BIGINT AS c FROM (SELECT feature FROM fd UNION SELECT feature FROM ft)
  UNION ALL
  SELECT feature, hx, pos + 1, xor(c >> 8, tab.v) FROM crc JOIN tab
  ON tab.b = xor(c & 255, 16 * (instr('0123456789ABCDEF', hx[2 * pos + 1]) - 1) + instr('0123456789ABCDEF', hx[2 * pos + 2]) - 1) WHERE 2 * pos < len(hx)
),
of AS MATERIALIZED (SELECT feature, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE 2 * pos = len(hx)),
s AS (SELECT bucket, sum(n)::BIGINT AS s FROM fd JOIN of USING (feature) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::BIGINT AS t FROM ft JOIN of USING (feature) GROUP BY bucket),
g AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket)
),
d AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM fd JOIN of USING (feature) JOIN g USING (bucket) GROUP BY r),
e AS (
  SELECT w.r, doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM w LEFT JOIN d ON w.r = d.r
),
k AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, r) AS place FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= (SELECT 25 * count(*) // 100 FROM e WHERE n_words >= 20) THEN place END AS rank FROM k
"""
