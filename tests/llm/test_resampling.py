import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from taulab.llm import resampling
from taulab.llm.resampling import ResamplingParams, drawn_documents, followed, importance, inverted, postings

SCHEMA = "doc_id long, text string, score string, rank long"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(rows, target, p):
    bags = []
    for text in [t for _, t in rows] + target:
        w = words(text)
        bags.append(Counter(zlib.crc32(f.encode()) % p.buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]))
    own, other = bags[: len(rows)], bags[len(rows) :]
    s, t = sum(own, Counter()), sum(other, Counter())
    all_s, all_t = sum(s.values()), sum(t.values())
    gains = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + p.buckets) / ((s[b] + 1) * (all_t + p.buckets)))) for b in s}
    out = []
    for (i, text), bag in zip(rows, own, strict=True):
        n = sum(bag.values())
        weight = sum(gains[b] * c for b, c in bag.items()) // n if n else 0
        h = int(hashlib.sha256(f"{p.seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(words(text)), n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    fit = sorted((r for r in out if r[1] >= p.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = p.percent * len(fit) // 100
    ranks = {}
    for k, r in enumerate(fit[:drawn]):
        ranks.setdefault(r, []).append(k + 1)
    return sorted(((*r, ranks[r].pop(0) if ranks.get(r) else None) for r in out), key=str)


def documents():
    rng = random.Random(5)
    vocabulary = ["the", "Of", "é", "x" * 70, "ß9", "longer-word", "ONE", "two"]
    rows = [(None, "the one " * 15), (1, None), (2, ""), (3, "..."), (4, "The"), (5, "the of " * 20_000), (6, "one two " * 12), (6, "one two " * 12), (7, "y" * 3000 + " z")]
    rows += [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(10, 150)]
    return rows


TARGET = ["one two é the", None, "", "ß9 of the x longer word " * 3]


def tables(spark, rows=None, target=TARGET):
    rows = documents() if rows is None else rows
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], SCHEMA).repartition(3), spark.createDataFrame([(k, t, 0) for k, t in enumerate(target)], "doc_id long, text string, s long")


@pytest.mark.parametrize("p", [ResamplingParams(), ResamplingParams(buckets=97, parts=5, percent=60, least_words=3, seed=11)])
def test_matches_brute_force(spark, p):
    docs, target = tables(spark)
    assert sorted(map(tuple, importance(docs, target, p).collect()), key=str) == brute(documents(), TARGET, p)


def test_empty_tables(spark):
    p = ResamplingParams(least_words=1)
    docs, target = tables(spark)
    none = spark.createDataFrame([], "doc_id long, text string, s long")
    assert importance(docs.limit(0), target, p).collect() == []
    assert sorted(map(tuple, importance(docs, none, p).collect()), key=str) == brute(documents(), [], p)


def test_drawn_documents_keep_their_columns(spark):
    docs, target = tables(spark)
    p = ResamplingParams(percent=50)
    ids = {r.doc_id for r in importance(docs, target, p).collect() if r.rank}
    out = drawn_documents(docs, target, p)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == ids and len(ids) > 20


def test_layout_makes_no_difference(spark):
    docs, target = tables(spark)
    runs = [sorted(map(tuple, importance(docs.repartition(n), target.repartition(n)).collect()), key=str) for n in (1, 7)]
    assert runs[0] == runs[1]


def test_blocks_of_postings_round_trip():
    rng, p = np.random.default_rng(3), ResamplingParams(buckets=50, parts=4)
    row, bucket = rng.integers(0, 300, 5000), rng.integers(0, 50, 5000)
    got = Counter()
    for part, n, block in inverted(row, bucket, 300, p):
        slot, doc, count = postings(block, n, p)
        got.update({(s * p.parts + part, d): c for s, d, c in zip(slot.tolist(), doc.tolist(), count.tolist(), strict=True)})
    assert got == Counter(zip(bucket.tolist(), row.tolist(), strict=True))


def test_crc_of_appended_texts():
    rng = random.Random(6)
    pairs = [(rng.randbytes(rng.randrange(9)), rng.randbytes(rng.choice([0, 1, 2, 7, 63, 64, 65, 400]))) for _ in range(200)]
    crc = np.array([zlib.crc32(a) for a, _ in pairs], np.uint32)
    rest = np.array([zlib.crc32(b) for _, b in pairs], np.uint32)
    assert (followed(crc, np.array([len(b) for _, b in pairs])) ^ rest).tolist() == [zlib.crc32(a + b) for a, b in pairs]


def test_each_part_meets_its_counts_in_many_tasks(spark):
    docs, target = tables(spark)
    plan = resampling.contributions(
        spark.createDataFrame([], resampling.INDEX), spark.createDataFrame([(1, 2, 3)], "bucket int, s long, t long"), ResamplingParams()
    )._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
