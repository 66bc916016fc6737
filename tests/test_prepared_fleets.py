import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from taulab.operators import inject, prepare
from taulab.plans import registry
from taulab.sources import readers
from taulab.sources.store import Store


@pytest.mark.parametrize("name", ["prepared_fleet", "prepared_audit", "donor_guards", "balance_test"])
def test_queries_match_their_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    got = registry.queries()[name](spark, sf).toPandas()
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want) > 0
    keys = [c for c in sorted(got.columns) if got[c].dtype.kind != "f"]
    a, b = (x.fillna({c: "" for c in keys}).sort_values(keys).reset_index(drop=True) for x in (got, want[got.columns]))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-6, atol=1e-6)


def fleet(spark, clients=("01", "b"), n=50, attacks=4):
    rows = [(c, k < attacks, k, [float(k + len(c)), 3.0]) for c in clients for k in range(n + attacks)]
    return spark.createDataFrame(rows, "client_id string, attack boolean, row_idx long, features array<double>")


@pytest.mark.parametrize("largest", [None, 54])
def test_a_fleet_is_split_scaled_and_balanced(spark, tmp_path, largest):
    path = f"file://{tmp_path}/fleet"
    manifest = prepare.prepare(fleet(spark), path, 2, Store(spark, "fleet"), largest)
    assert manifest["clients"] == 2 and manifest["rows"] == 2 * (30 + 10 + 4 + 4)
    rows = readers.splits(spark, path, 2).toPandas()
    assert rows.groupby(["client_id", "split"]).size().to_dict() == {(c, s): n for c in ("01", "b") for s, n in (("train", 30), ("cal", 10), ("test_benign", 4), ("test_attack", 4))}
    train = rows[(rows.split == "train") & (rows.client_id == "01")].features.tolist()
    assert abs(sum(x for x, _ in train)) < 1e-9 and abs(sum(x * x for x, _ in train) / 30 - 1) < 1e-9 and {y for _, y in train} == {0.0}
    prepare.require_prepared(spark, path, spark.createDataFrame([("01",), ("b",)], "client_id string"), 2)
    with pytest.raises(ValueError, match="no scaler"):
        prepare.require_prepared(spark, path, spark.createDataFrame([("01",), ("b",), ("z",)], "client_id string"), 2)


def test_bad_rows_leave_no_finished_fleet(spark, tmp_path):
    path = f"file://{tmp_path}/fleet"
    prepare.prepare(fleet(spark), path, 2, Store(spark, "fleet"))
    for bad in ([1.0], [1.0, float("nan")], [1.0, None], None):
        more = spark.createDataFrame([("01", False, 99, bad)], "client_id string, attack boolean, row_idx long, features array<double>")
        with pytest.raises(Exception, match="2 finite figures"):
            prepare.prepare(fleet(spark).unionByName(more), path, 2, Store(spark, "fleet"))
    with pytest.raises(FileNotFoundError):
        readers.splits(spark, path, 2)


def test_balanced_leaves_clients_with_more_attacks_or_none(spark):
    rows = [(c, s, k) for c, b, a in (("none", 5, 0), ("few", 5, 2), ("many", 2, 5)) for s, n in (("test_benign", b), ("test_attack", a)) for k in range(n)]
    df = spark.createDataFrame(rows, "client_id string, stage string, event_id long")
    got = {(r.client_id, r.stage): r["count"] for r in prepare.balanced(df, Store(spark, "b")).groupBy("client_id", "stage").count().collect()}
    assert got == {("none", "test_benign"): 5, ("few", "test_benign"): 2, ("few", "test_attack"): 2, ("many", "test_benign"): 2, ("many", "test_attack"): 5}


def test_donor_problems_against_a_count_by_hand(spark):
    pool = [(0, c, "train", k, 1.0) for c, ids in (("a", range(10)), ("b", range(5, 15)), ("c", range(3))) for k in ids]
    pool += [(0, "a", "test_attack", 0, 1.0), (0, "b", "train", 5, float("nan")), (0, "c", None, 1, None), (1, "a", "train", 0, 1.0)]
    cal = [(0, "a", 1.0), (0, "b", None), (1, "a", 1.0)]
    budgets = [(0, "a", 2), (0, "b", 2), (0, "c", 4), (1, "a", 1)]
    got = inject.donor_problems(
        spark.createDataFrame(pool, "seed long, client_id string, stage string, row_id long, score double"),
        spark.createDataFrame(cal, "seed long, client_id string, score double"),
        spark.createDataFrame(budgets, "seed long, victim string, most long"),
    )
    want = set()
    for seed, victim, most in budgets:
        others = [p for p in pool if p[0] == seed and p[1] != victim]
        ids = {p[3] for p in others}
        own = [x for s, c, x in cal if (s, c) == (seed, victim)]
        broken = lambda x: x is None or x != x
        figures = {"stage": sum(p[2] != "train" for p in others), "not finite": sum(broken(p[4]) for p in others)}
        want |= {(seed, victim, rule, n) for rule, n in figures.items() if n}
        if not own or any(map(broken, own)):
            want.add((seed, victim, "calibration", sum(map(broken, own))))
        if not ids or max(1, int(0.2 * len(ids))) < most:
            want.add((seed, victim, "too few", len(ids)))
    assert {tuple(r) for r in got.collect()} == want and {w[2] for w in want} == {"stage", "not finite", "calibration", "too few"}
    assert got.where(F.col("n") < 0).count() == 0
