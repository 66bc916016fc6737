import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from taulab.operators import inject, quantiles, sweep
from taulab.operators.ladder import at_ranks, merged, ranked
from taulab.operators.quantiles import order_statistics, percentiles
from taulab.sources.store import Store


def table(spark, groups):
    return spark.createDataFrame([(k, i, float(v)) for k, values in groups.items() for i, v in enumerate(values)], "k string, i long, v double").repartition(5)


def groups(rng):
    return {
        "ties": rng.integers(0, 4, 300),
        "plain": rng.normal(size=257),
        "scales": np.exp(rng.uniform(-30, 30, 211)) * rng.choice([-1, 1], 211),
        "one": [3.5],
        "two": [-1e308, 1e308],
        "flat": [2.0] * 50,
        "near": 1 + np.arange(40) * 2.0**-52,
        "small": np.arange(30) * 5e-324,
    }


@pytest.mark.parametrize("gather", [0, 7])
def test_order_statistics_by_rounds(spark, gather):
    data = groups(np.random.default_rng(1))
    df = table(spark, data)
    wanted = spark.createDataFrame([(k, r) for k, v in data.items() for r in sorted({0, len(v) // 3, len(v) // 2, len(v) - 1})], "k string, rank long")
    got = {(x.k, x.rank): x.value for x in order_statistics(df, ["k"], "v", wanted, gather, bins=64).collect()}
    assert got == {(k, r): float(np.sort(np.asarray(data[k], float))[r]) for k, r in got} and len(got) == wanted.count()


def test_percentiles_of_large_groups_are_those_of_the_aggregate(spark, monkeypatch):
    data = {k: v for k, v in groups(np.random.default_rng(2)).items() if k not in ("two", "scales")}
    names = {"low": 0.0, "a": 0.05, "b": 0.5, "c": 0.95, "top": 1.0}
    df = table(spark, data).unionByName(spark.createDataFrame([("null", 0, None)], "k string, i long, v double"))
    plain = {x.k: tuple(x)[1:] for x in percentiles(df, ["k"], "v", names).collect()}
    monkeypatch.setattr(quantiles, "LARGE", 5)
    rounds = {x.k: tuple(x)[1:] for x in percentiles(df, ["k"], "v", names, 300).select("k", *names).collect()}
    assert set(plain) == set(rounds) == set(data)
    assert all(rounds[k] == pytest.approx(plain[k], rel=1e-12) for k in data)


def test_ranks_and_counted_ranks(spark):
    data = groups(np.random.default_rng(3))
    df = table(spark, data)
    store = Store(spark, "test")
    got = ranked(df, ["k"], ["v", "i"], store).collect()
    for k, values in data.items():
        order = sorted((float(v), i) for i, v in enumerate(values))
        assert sorted((r.rank, r.v, r.i) for r in got if r.k == k) == [(p, v, i) for p, (v, i) in enumerate(order)]
    odd = ranked(df, ["k"], ["v", "i"], store, odd=F.col("i") % 2 == 1).collect()
    assert sorted(map(tuple, odd)) == sorted(map(tuple, ranked(df, ["k"], ["v", "i"], store, largest=300, odd=F.col("i") % 2 == 1).collect()))
    for r in odd:
        assert r.odd == sum(i % 2 == 1 and (float(v), i) < (r.v, r.i) for i, v in enumerate(data[r.k]))


@pytest.mark.parametrize("blocks", [(3, 3), (8, 65536)])
def test_merged_ranks_match_a_sort(spark, blocks):
    rng = np.random.default_rng(blocks[0])
    store = Store(spark, "test")
    clean = {f"g{k}": np.round(rng.normal(size=n), 1) for k, n in enumerate((1, 2, 10, 60, 200))}
    steps = store.save(ranked(table(spark, clean), ["k"], ["v", "i"], store), "ladder")
    changes, wanted, want = [], [], {}
    for k, values in clean.items():
        order, n = np.sort(values), len(values)
        for cell in range(6):
            m = 0 if cell == 0 else int(rng.integers(1, n + 1))
            out = rng.choice(n, m, replace=False)
            new = np.round(rng.normal(size=m) * (1 if cell < 4 else 5), 1)
            changes += [(k, cell, n, int(r), None) for r in out] + [(k, cell, n, int((order <= x).sum()), float(x)) for x in new]
            perturbed = np.sort(np.concatenate([np.delete(order, out), new]))
            for r in range(n):
                wanted.append((k, cell, n, r))
                want[k, cell, r] = perturbed[r]
    c = spark.createDataFrame(changes, "k string, cell long, n long, at long, added double")
    w = spark.createDataFrame(wanted, "k string, cell long, n long, rank long")
    got = merged(steps, c, w, ["k"], ["k", "cell"], "v", blocks).collect()
    assert {(r.k, r.cell, r.rank): r.value for r in got} == want
    assert {(r.k, r.rank): r.value for r in at_ranks(steps, w.where("cell = 0"), ["k"], "v").collect()} == {(k, r): v for (k, cell, r), v in want.items() if cell == 0}


def test_replacements_are_the_first_of_each_cells_order(spark):
    store = Store(spark, "test")
    rng = np.random.default_rng(7)
    cal = {"a": rng.normal(size=150), "b": rng.normal(size=37)}
    rows = spark.createDataFrame([(0, k, "cal", i, float(v)) for k, values in cal.items() for i, v in enumerate(values)], "seed long, client_id string, stage string, pos long, score double")
    cells = inject.grid(spark.createDataFrame([(0, "a"), (0, "b")], "seed long, client_id string"))
    train = spark.createDataFrame([(0, k, 1000 * j + i, i, float(v)) for j, k in enumerate("abc") for i, v in enumerate(rng.normal(size=400))], "seed long, client_id string, row_id long, pos long, score double")
    ladder = inject.client_ladder(rows, rows.groupBy("seed", "client_id").agg(F.count("*").alias("n")), store)
    replaced = inject.replacements(cells, ladder, train, store)
    got = {}
    for r in replaced.collect():
        got.setdefault((r.victim, r.source, r.objective, r.fraction), []).append(r)
    for c in cells.where("fraction > 0").collect():
        values = cal[c.victim]
        n, m = len(values), max(1, round(c.fraction * len(values)))
        first = sorted(range(n), key=lambda p: (((p + 1) * 7919 + (c.child + 1) * 104729 + 15485863) % inject.PRIME, p))[:m]
        own = got[c.victim, c.source, c.objective, c.fraction]
        assert sorted(r.pos for r in own) == sorted(first)
        order = np.sort(values)
        assert all(order[r.rank] == r.clean_score == values[r.pos] for r in own)
        assert all((r.at == 0 or order[r.at - 1] <= r.score) and (r.at == n or order[r.at] >= r.score) for r in own)
    assert replaced.count() == sum(max(1, round(c.fraction * len(cal[c.victim]))) for c in cells.where("fraction > 0").collect())


@pytest.mark.parametrize("shape", ["own ids", "shared ids", "one client"])
def test_first_donors_are_those_of_the_whole_pools(spark, shape):
    rng = np.random.default_rng(11)
    clients = "a" if shape == "one client" else "abcd"
    rows = []
    for seed in (0, 3):
        for k in clients:
            for i in range(int(rng.integers(20, 260))):
                row = int(rng.integers(0, 150)) if shape == "shared ids" else len(rows) * 37
                rows.append((seed, k, row, i, float(np.round(rng.normal() + (2 if k == "a" else 0), 1))))
    train = spark.createDataFrame(rows, "seed long, client_id string, row_id long, pos long, score double")
    budgets = spark.createDataFrame([(s, v, int(rng.integers(1, 60))) for s in (0, 3) for v in clients + "z"], "seed long, victim string, most long")
    whole = inject.donors(train, budgets.select("seed", F.col("victim").alias("client_id")))
    want = whole.join(budgets, ["seed", "victim"]).where("draw <= most").select("seed", "victim", "source", "draw", "row_id", "score")
    got = inject.first_donors(train, budgets, Store(spark, "test"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_a_replaced_test_row_reaches_the_perturbed_state(spark):
    kind = "seed long, client_id string, stage string, pos long, event_id long, score double"
    scores = spark.createDataFrame([(0, "a", stage, i, i, float(i)) for stage in ("cal", "test_benign", "test_attack") for i in range(3)], kind)
    replaced = lambda stage: spark.createDataFrame([(0, "a", stage, 1, 9.0)], "seed long, victim string, stage string, pos long, score double")
    values = lambda stage: sorted((r.stage, r.pos, r.score) for r in sweep.perturbed_tests(scores, replaced(stage)).collect())
    clean = sorted((r.stage, r.pos, r.score) for r in scores.where("stage <> 'cal'").collect())
    assert values("cal") == clean
    assert [x for x, y in zip(values("test_attack"), clean, strict=True) if x != y] == [("test_attack", 1, 9.0)]


def test_rows_of_cells_do_not_pass_the_driver(spark, monkeypatch):
    plans, save = [], Store.save

    def kept(self, df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString().splitlines())
        return save(self, df, name)

    store = Store(spark, "test")
    rows = spark.range(20_000).selectExpr("0L AS seed", "'a' AS client_id", "'cal' AS stage", "id AS pos", "id AS event_id", "CAST(id * 7919 % 10007 AS double) / 3 AS score")
    ladder = inject.client_ladder(rows, spark.createDataFrame([(0, "a", 20_000)], "seed long, client_id string, n long"), store)
    cells = store.save(inject.grid(spark.createDataFrame([(0, "a")], "seed long, client_id string")), "cells")
    monkeypatch.setattr(Store, "save", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 64 << 10)
    try:
        asked, replaced = inject.variant_replacements(cells, ladder, store, 20_000)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert replaced.count() == asked.agg(F.sum("effective")).first()[0] > 40_000
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    sent = [x for plan in plans for k, line in enumerate(plan) if "BroadcastExchange" in line for x in itertools.takewhile(lambda x: depth(x) > depth(line), plan[k + 1 :])]
    assert not any("Generate explode(sequence" in x for x in sent)


@pytest.mark.parametrize("n", [1, 2, 7, 63, 64, 65, 200])
def test_taken_turns_are_consecutive(spark, n):
    steps = spark.createDataFrame([(0, "a", n, t, 10 * t) for t in range(n)], "seed long, victim string, n long, turn long, x long")
    cells = spark.createDataFrame([(0, "a", n, t, m) for t in sorted({0, n // 3, n - 1}) for m in sorted({1, n // 2, n} - {0})], "seed long, victim string, n long, turn0 long, m long")
    got = inject.taken_turns(cells, "m", steps, ["x"]).collect()
    want = [(c.turn0, c.m, k, 10 * ((c.turn0 + k - 1) % n)) for c in cells.collect() for k in range(1, c.m + 1)]
    assert sorted((r.turn0, r.m, r.k, r.x) for r in got) == sorted(want)
