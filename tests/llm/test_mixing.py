import math
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from taulab.llm.mixing import MixParams, _met, _packed, mix, mixed_documents

SCHEMA = "doc_id long, text string, source string, size int, extra string"


def water(sizes):
    """Targets by sharing what is over again and again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, float(sum(sizes.values())), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def check(rows, out):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, largest, source = Counter(), Counter(), {}
    for i, t, s in rows:
        sizes[s] += size(t)
        largest[s] = max(largest[s], size(t))
        source[i] = s
    want, taken = water({s: sizes[s] for s in {s for _, _, s in rows}}), defaultdict(int)
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, size(t)) for i, t, _ in rows)
    for r in out:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert r.taken % max(r.size, 1) == 0 and 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= largest[s] + 1e-6


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], SCHEMA).repartition(3)


ROWS = [(i, "w " * (i % 50 + 1), f"s{i % 3}") for i in range(600)] + [(1000 + i, "hot words here " * (i % 9), "hot") for i in range(900)]
ROWS += [(5000 + i, "tiny", "tiny") for i in range(3)] + [(6000, None, "none"), (6001, "", "none"), (6002, "a b c", None), (6003, "big " * 5000, "s1")]


def test_targets_and_rounding(spark):
    for p in (MixParams(), MixParams(chunk=4)):
        check(ROWS, mix(frame(spark, ROWS), p).collect())


def test_reruns_agree_whatever_the_layout(spark):
    a = mix(frame(spark, ROWS)).collect()
    b = mix(frame(spark, ROWS[::-1]).repartition(5)).collect()
    assert sorted((r.doc_id, r.taken) for r in a) == sorted((r.doc_id, r.taken) for r in b)


def test_repeated_rows_and_an_empty_table(spark):
    rows = [(1, "same words", "a")] * 2000 + [(2, "other", "b"), (None, "x y", "b")]
    out = mix(frame(spark, rows), MixParams(chunk=16)).collect()
    assert len(out) == 2002
    got = sum(r.taken for r in out if r.doc_id == 1)
    assert abs(got - next(r.target for r in out if r.doc_id == 1)) <= 2
    assert mix(frame(spark, ROWS).limit(0)).collect() == []


def test_documents_of_the_mix(spark):
    out = Counter(r.doc_id for r in mixed_documents(frame(spark, ROWS)).collect())
    size = {i: len((t or "").split()) for i, t, _ in ROWS}
    assert {(r.doc_id, r.taken) for r in mix(frame(spark, ROWS)).collect() if r.taken} == {(i, n * size[i]) for i, n in out.items() if size[i]}
    assert mixed_documents(frame(spark, ROWS)).columns == ["doc_id", "text", "source", "size", "extra"]


def test_each_document_keeps_its_expectation(spark):
    rows = [(i, "w " * (1 + i % 3), "a" if i < 40 else "b") for i in range(60)]
    total = Counter()
    for seed in range(12):
        for r in mix(frame(spark, rows), MixParams(seed=seed)).collect():
            total[r.doc_id] += r.taken / r.size
    first = sum(total[i] for i in range(20)) / sum(total[i] for i in range(20, 40))
    assert 0.8 < first < 1.25


def replay(units, level):
    """The meetings of one chunk, document by document: units (row, w, p, u, v), the largest first."""
    q, done, aside, c = units[0][2], {}, [], None
    rest = sum(x[1] for x in units)
    for row, w, own, u, v in units:
        if not level and c and math.floor(math.log2(c[1])) != math.floor(math.log2(w)):
            need, give = (1 - c[2]) * c[1], c[2] * c[1]
            if need >= q * rest or give >= (1 - q) * rest:
                aside.append(c)
            else:
                done[c[0]] = int(c[4] < c[2])
                q += (give if c[4] >= c[2] else -need) / rest
            c = None
        rest -= w
        x = (row, w, own if level else q, u, v)
        if c is None:
            c = x
            continue
        up, down = min(1 - c[2], x[2] * w / c[1]), min(c[2], (1 - x[2]) * w / c[1])
        if u * (up + down) < down:  # words move from x to c
            if 1 - c[2] <= x[2] * w / c[1]:
                done[c[0]], c = 1, (row, w, max(0.0, x[2] - (1 - c[2]) * c[1] / w), u, v)
            else:
                done[row], c = 0, (*c[:2], min(1.0, c[2] + x[2] * w / c[1]), *c[3:])
        elif c[2] <= (1 - x[2]) * w / c[1]:
            done[c[0]], c = 0, (row, w, min(1.0, x[2] + c[2] * c[1] / w), u, v)
        else:
            done[row], c = 1, (*c[:2], max(0.0, c[2] - (1 - x[2]) * w / c[1]), *c[3:])
    return done, aside + ([c] if c else [])


def test_meetings_against_a_replay(spark):
    r = random.Random(4)
    rows = [("s", k % 7, k, float(r.choice((1, 2, 3, 5, 8, 40, 500, 9000))), 0.37, k * 977) for k in range(300)]
    for level in (0, 1):
        units = spark.createDataFrame([(*x[:4], 0.37 if not level else r.random(), x[5]) for x in rows], "source string, chunk int, row long, w double, p double, h long")
        packed = _packed(units, level, 9).withColumn("met", F.expr(_met(level))).collect()
        assert sum(len(x.units) for x in packed) == len(rows)
        for x in packed:
            assert [u.w for u in x.units] == sorted((u.w for u in x.units), reverse=True)
            done, left = replay([tuple(u) for u in x.units], level)
            assert {d.row: d.extra for d in x.met.done} == done
            got = [*x.met.left, *([x.met.c] if x.met.c else [])]
            assert [g.row for g in got] == [y[0] for y in left] and all(abs(g.p - y[2]) < 1e-12 for g, y in zip(got, left, strict=True))
            # expected words are the same before and after, but for what documents decided by their own chance gave to the others
            before, after = sum(u.w * u.p for u in x.units), sum(u.w * done.get(u.row, 0) for u in x.units)
            if level:
                assert abs(before - after - sum(y[1] * y[2] for y in left)) < 1e-6 * before


def test_small_documents_beside_a_large_one_are_decided_one_by_one(spark):
    rows = [(0, "w " * 10_000, "a")] + [(i, f"one{i}", "a") for i in range(1, 201)] + [(i, "w " * 100, "b") for i in range(300, 500)]
    taken = {r.doc_id: r.taken for r in mix(frame(spark, rows)).collect()}
    assert len({taken[i] for i in range(1, 201)}) > 1


def test_any_column_names(spark):
    names = ["_copies", "_h", "_id", "_source", "_rows", "_again", "_mix_h", "_mix_doc_id", "_Mix_Copies", "chunk"]
    docs = frame(spark, ROWS).select("doc_id", "text", "source", *(F.lit(7).alias(x) for x in names))
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert len(got) == mixed_documents(frame(spark, ROWS)).count() and all(r[x] == 7 for r in got for x in names)
