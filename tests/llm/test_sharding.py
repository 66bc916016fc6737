import zlib
from collections import Counter, defaultdict

from taulab.llm.sharding import ShardParams, assign_shards

SCHEMA = "doc_id long, text string, shard string, key int"


def check(rows, out, shards=16):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32(t.encode()) if t is not None else None) for i, t in rows
    )
    slots, sizes = defaultdict(list), Counter()
    for r in out:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    most = max((r.size for r in out), default=0) + sum(sizes.values()) / shards / 100
    assert max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 2 * most


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1) for i, t in rows], SCHEMA).repartition(3)


def test_shards_are_near_equal_with_a_large_group_and_odd_rows(spark):
    rows = [(i, f"text {i} " * (i % 7 + 1)) for i in range(400)] + [(1000 + i, "same text of a large group") for i in range(300)]
    rows += [(5000, None), (None, "null id"), (7, "text again"), (7, "text again"), (8, ""), (9, "ü" * 300)]
    for params in (ShardParams(), ShardParams(range_rows=20, samples_per_range=3)):
        check(rows, assign_shards(frame(spark, rows), params).collect())


def test_repeated_rows_are_subdivided(spark):
    rows = [(1, "copy")] * 500 + [(2, "other")] * 20
    check(rows, assign_shards(frame(spark, rows), ShardParams(range_rows=10)).collect())


def test_equal_texts_lie_together(spark):
    rows = [(i, f"group {i % 2000}") for i in range(6000)] + [(9000 + i, "a large one") for i in range(2000)]
    where = defaultdict(set)
    for r in assign_shards(frame(spark, rows)).collect():
        where[r.text_crc32].add(r.shard)
    assert [len(s) > 1 for s in where.values()].count(True) == 1


def test_the_table_and_an_empty_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check([(r.doc_id, r.text) for r in docs.collect()], assign_shards(docs).collect())
    assert assign_shards(docs.limit(0)).collect() == []
