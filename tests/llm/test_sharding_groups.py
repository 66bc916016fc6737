from collections import defaultdict

from taulab.llm.sharding import ShardParams, assign_shards


def test_equal_texts_lie_together_in_subdivided_ranges(spark):
    rows = [(i, f"group {i % 2000} " + "x" * 50) for i in range(6000)] + [(9000 + i, "a") for i in range(4000)] + [(20_000, "b")] * 4000
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    where, copies, slots = defaultdict(set), defaultdict(int), set()
    for r in assign_shards(docs, ShardParams(range_rows=1000)).collect():
        where[r.text_crc32].add(r.shard)
        copies[r.text_crc32] += 1
        slots.add((r.shard, r.slot))
    assert len(slots) == len(rows)
    assert [c for c, s in where.items() if len(s) > 1 and copies[c] < 1000] == []
