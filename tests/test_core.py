import math

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from taulab.functions.columns import cv, duplicate_rate, iqr, rates
from taulab.functions.inference import binomial_upper_tail, bootstrap_interval, holm, sign_flip_column, sign_flip_p
from taulab.operators import evaluate, inject
from taulab.operators.cluster import group_points, silhouette
from taulab.operators.positions import with_positions
from taulab.operators.quantiles import percentile
from taulab.operators.range_count import count_above
from taulab.operators.training import Monitor, Network, errors, gradients, score, train
from taulab.plans import registry
from taulab.operators import guards
from taulab.sources import readers, sinks, state
from taulab.streaming.alerts import alert_counts

SF = "/root/testdata/sf0.001"


def one(df):
    return df.first()[0]


def column(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


def test_dispersion_rules(spark):
    assert one(column(spark, [-1, 1]).select(cv("x"))) is None
    assert one(column(spark, [3]).select(cv("x"))) is None
    assert one(column(spark, [1, 3]).select(cv("x"))) == pytest.approx(0.5)
    assert one(column(spark, [1]).select(iqr("x"))) is None
    assert one(column(spark, [1, 1, 1, 2]).select(duplicate_rate("x"))) == 0.5
    assert one(column(spark, [1, 2, 3, 4]).select(duplicate_rate("x"))) == 0


def test_scale_base_falls_back(spark):
    rows = [("a", x) for x in (1.0, 1.0, 1.0, 1.0, 1.5)] + [("b", 2.0)] * 3 + [("c", float(x)) for x in range(9)]
    got = {r.k: r.scale_base for r in evaluate.scale_bases(spark.createDataFrame(rows, "k string, score double"), ["k"]).collect()}
    assert got == {"a": 0.5, "b": None, "c": 4.0}


def test_rates_without_attacks(spark):
    df = spark.createDataFrame([(0, 1, 3, 0), (2, 0, 4, 0), (0, 0, 0, 0)], "tp long, fp long, tn long, fn long")
    a, b, c = df.select(*(x.alias(k) for k, x in rates("tp", "fp", "tn", "fn").items())).collect()
    assert a.fpr == 0.25 and a.tpr is None and a.macro_f1 is None and a.balanced_accuracy is None
    assert b.macro_f1 == 1 and b.balanced_accuracy == 1
    assert all(x is None for x in c)


def test_counts_above_are_strict(spark):
    r = np.random.default_rng(1)
    values = [(k, float(x)) for k in "ab" for x in np.round(r.normal(size=500), 1)] + [("c", 5.0)] * 3
    taus = [(i, k, t) for i, (k, t) in enumerate((k, t) for k in "abcd" for t in (-9.0, -0.3, 0.0, 0.1, 5.0, 9.0, 4.9))] + [(99, "a", None)]
    got = count_above(spark.createDataFrame(values, "k string, v double"), spark.createDataFrame(taus, "tau_id int, k string, t double"), ["k"], "v", "t", "n").collect()
    assert len(got) == len(taus)
    for row in got:
        assert row.n == (None if row.t is None else sum(k == row.k and v > row.t for k, v in values))


def test_positions_in_buckets_equal_those_in_one(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("o"), (F.col("id") % 3).alias("k"))
    plain = {tuple(r) for r in with_positions(df, ["k"], "o", 1, "p", "n").collect()}
    assert plain == {tuple(r) for r in with_positions(df, ["k"], "o", 7, "p", "n").collect()}


@pytest.mark.parametrize("q", [0.0, 0.03, 0.5, 0.95, 1.0])
def test_bracketed_percentile_is_exact(spark, q):
    r = np.random.default_rng(2)
    rows = [(k, float(x)) for k in "ab" for x in r.lognormal(size=3000)] + [("c", 1.0), ("c", 2.0), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    want = {k: np.percentile([v for c, v in rows if c == k], 100 * q) for k in "abc"}
    got = {x.k: x.p for x in percentile(df, ["k"], "v", q, "p", large=True).collect()}
    assert got == pytest.approx(want)


def test_ranking_metrics_with_ties(spark):
    r = np.random.default_rng(3)
    rows = [("a", s, float(x)) for s, m in (("test_benign", 0), ("test_attack", 1)) for x in np.round(r.normal(m, 1, 80), 1)]
    rows += [("tie", "test_benign", 1.0), ("tie", "test_attack", 1.0), ("none", "test_benign", 1.0)]
    df = spark.createDataFrame(rows, "k string, stage string, score double")
    auc = {x.k: x.auroc for x in evaluate.auroc(df, ["k"]).collect()}
    pos, neg = ([v for k, s, v in rows if k == "a" and s == t] for t in ("test_attack", "test_benign"))
    assert auc["tie"] == 0.5 and auc["none"] is None
    assert auc["a"] == pytest.approx(np.mean([(p > n) + (p == n) / 2 for p in pos for n in neg]))
    ap = {x.k: x.average_precision for x in evaluate.average_precision(df, ["k"]).collect()}
    steps, last = 0.0, 0
    for t in sorted({*pos, *neg}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
        steps, last = steps + (tp - last) / len(pos) * tp / (tp + fp), tp
    assert ap["a"] == pytest.approx(steps) and ap["none"] is None


def test_exact_tests(spark):
    assert sign_flip_p(np.ones(10)) == 2 / 1024 and sign_flip_p(np.array([1, -1, 2, -2])) == 1 and sign_flip_p(np.array([1, math.nan, 1])) == 0.5
    r = np.random.default_rng(4)
    for v in ([1.0] * 10, [1.0, -1.0, 2.0, -2.0], r.normal(size=7).tolist()):
        df = spark.createDataFrame([(v,)], "v array<double>")
        assert one(df.select(sign_flip_column("v"))) == pytest.approx(sign_flip_p(np.array(v)))
    tail = [x[0] for x in spark.range(0, 22).select(binomial_upper_tail("id", F.lit(20))).collect()]
    assert tail[16] == pytest.approx(sum(math.comb(20, k) for k in range(16, 21)) / 2**20) and tail[0] == 1 and tail[20] == 2**-20 and tail[21] == 0
    p = spark.createDataFrame([("x", 0.01), ("x", 0.04), ("x", 0.03)], "k string, p double")
    assert {x.p: round(x.p_holm, 6) for x in holm(p, ["k"], "p").collect()} == {0.01: 0.03, 0.03: 0.06, 0.04: 0.06}


def test_bootstrap():
    mean, low, high = bootstrap_interval(np.array([1.0, 2.0, 3.0, math.nan]), 500, 0.95, 42)
    rng = np.random.default_rng(42)
    want = np.percentile([rng.choice([1.0, 2.0, 3.0], size=3, replace=True).mean() for _ in range(500)], [2.5, 97.5])
    assert (mean, low, high) == pytest.approx((2.0, *want))
    assert bootstrap_interval(np.array([1.0]), 10, 0.95, 1) == (1.0, None, None)


def test_injection_draws():
    cal = np.arange(100.0)
    for source in ("random_benign", "high_score_benign", "low_score_benign"):
        for draw in ("with_replacement", "without_replacement", "disjoint_reservoir", "interpolated_tail"):
            out, m, ok = inject.inject_array(cal, source, 0.2, draw, (0, 100, 1, 0), 1200)
            changed = (out != cal).sum()
            assert ok and len(out) == 100 and changed <= m <= 20
            if source == "high_score_benign" and draw != "disjoint_reservoir":
                assert out.mean() > cal.mean()
            assert (out == inject.inject_array(cal, source, 0.2, draw, (0, 100, 1, 0), 1200)[0]).all()
    assert inject.inject_array(np.ones(50), "high_score_benign", 0.2, "with_replacement", (0, 0, 0, 0), 1)[2] is False
    assert (inject.inject_array(cal, "random_benign", 0.0, "with_replacement", (0, 0, 0, 0), 1)[0] == cal).all()


def test_budgets_round_half_to_even(spark):
    df = spark.createDataFrame([(0.1, 25), (0.1, 35), (0.0, 50), (0.001, 10)], "f double, n long")
    assert [x[0] for x in df.select(inject.budget("f", "n")).collect()] == [round(0.1 * 25), round(0.1 * 35), 0, 1]


def test_donors_count_an_id_once(spark):
    train = [(0, "a", i, p, s) for p, (i, s) in enumerate(zip((0, 0, 1, 2, 2, 3, 4), (0.1, 0.1, 0.2, 0.4, 0.4, 0.8, 0.9)))]
    rows = spark.createDataFrame(train, "seed long, client_id string, row_id long, pos long, score double")
    got = inject.donors(rows, spark.createDataFrame([(0, "v")], "seed long, client_id string"))
    assert sorted(x.score for x in got.where("source LIKE 'random%'").collect()) == [0.1, 0.2, 0.4, 0.8, 0.9]
    assert [x.score for x in got.where("source LIKE 'high%'").collect()] == [0.9]


def test_grouping_is_optimal_and_silhouette_matches():
    r = np.random.default_rng(5)
    x = np.vstack([r.normal(c, 0.1, (3, 4)) for c in (0, 5, 9)])
    assert group_points(x, 3).tolist() == [0, 0, 0, 1, 1, 1, 2, 2, 2]
    big = np.vstack([r.normal(c, 0.1, (8, 2)) for c in (0, 5, 9)])
    assert group_points(big, 3).tolist() == [0] * 8 + [1] * 8 + [2] * 8
    labels = np.array([0, 0, 1, 1, 2])
    pts = r.normal(size=(5, 2))
    d = np.linalg.norm(pts[:, None] - pts[None], axis=2)
    want = []
    for i in range(5):
        own = [j for j in range(5) if labels[j] == labels[i] and j != i]
        if not own:
            want.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, labels == g].mean() for g in set(labels) - {labels[i]})
        want.append((b - a) / max(a, b))
    assert silhouette(pts, labels) == pytest.approx(np.mean(want))
    assert silhouette(pts, np.zeros(5)) == 0


def test_training_lowers_the_loss(spark):
    r = np.random.default_rng(6)
    rows = [(f"c{k % 2}", "cal" if k % 3 == 0 else "train", (r.normal(size=2) @ np.array([[1.0, 2, 0, 1], [0, 1, 1, -1]])).tolist()) for k in range(200)]
    df = spark.createDataFrame(rows, "client_id string, split string, features array<double>")
    net = Network(4, (3, 2))
    w, losses = train(df, net, 1, Monitor(rounds_initial=2, rounds_max=4, window=1, threshold=0.0), batch=16, rate=0.02)
    assert len(losses) == 4 and losses[-1] < losses[0]
    x = np.array([f for _, _, f in rows])
    got = score(df, w).select("features", "score").collect()
    assert np.allclose([g.score for g in got], errors(w, np.array([g.features for g in got])))
    loss, g = gradients(w, x)
    k, eps = (0, 1, 1), 1e-6
    moved = [a.copy() for a in w]
    moved[0][1, 1] += eps
    assert (gradients(moved, x)[0] - loss) / eps == pytest.approx(g[0][1, 1], rel=1e-3, abs=1e-6)


def test_convergence_monitor():
    m = Monitor(rounds_initial=4, rounds_max=100, window=2, threshold=0.01)
    stops = [m.record(x) for x in (8.0, 4.0, 2.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    assert stops.index(True) == 6
    with pytest.raises(ValueError):
        m.record(float("nan"))


def test_device_files_and_score_files(spark, tmp_path):
    r = np.random.default_rng(7)
    for d in ("dev_a", "dev_b"):
        (tmp_path / "raw" / d / "gafgyt_attacks").mkdir(parents=True)
        for name, n in (("benign_traffic.csv", 30), ("gafgyt_attacks/combo.csv", 5), ("gafgyt_attacks/udp.csv", 4)):
            pd.DataFrame(r.normal(size=(n, 3)), columns=["f0", "f1", "f2"]).to_csv(tmp_path / "raw" / d / name, index=False)
    rows = readers.device_csv(spark, str(tmp_path / "raw"), columns=["f0", "f1", "f2"])
    counts = {(x.client_id, x.kind, x.attack_class): x["count"] for x in rows.groupBy("client_id", "kind", "attack_class").count().collect()}
    assert counts[("dev_a", "benign", None)] == 30 and counts[("dev_b", "attack", "gafgyt_udp")] == 4
    first = pd.read_csv(tmp_path / "raw/dev_a/benign_traffic.csv").iloc[7].tolist()
    assert rows.where("client_id = 'dev_a' AND kind = 'benign' AND row_idx = 7").first().features == pytest.approx(first)
    assert readers.file_hashes(spark, str(tmp_path / "raw"), "*.csv").count() == 6

    base = tmp_path / "scores"
    for stage in ("cal", "test_benign"):
        (base / stage).mkdir(parents=True)
        pq.write_table(pa.table({"reconstruction_error": pa.array([0.5, math.nan, 0.25], pa.float32())}), base / stage / "c1.parquet")
    got = readers.score_files(spark, str(base))
    assert [x.score for x in got.where("stage = 'cal'").orderBy("pos").collect()][0] == 0.5
    rec = readers.score_records(got).where("stage = 'cal'").first()
    assert (rec.rows, rec.min_score, rec.max_score, rec.n_nan) == (3, 0.25, 0.5, 1)
    missing = readers.missing_sets(got, spark.createDataFrame([("c1",), ("c2",)], "client_id string"))
    assert {(x.client_id, x.stage) for x in missing.collect()} == {("c1", "test_attack"), ("c2", "cal"), ("c2", "test_benign"), ("c2", "test_attack")}
    pd.DataFrame({"other": [1.0]}).to_parquet(base / "cal" / "c2.parquet")
    (base / "test_benign" / "c1.parquet").unlink()
    (base / "cal" / "c1.parquet").unlink()
    with pytest.raises(ValueError):
        readers.score_files(spark, str(base))


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([(0, "c1", "cal", 0, 1.0), (1, "c1", "cal", 0, 2.0)], readers.SCORES)
    sinks.write_scores(s, str(tmp_path / "t"))
    assert readers.score_table(spark, str(tmp_path / "t")).where("seed = 1").first().score == 2.0
    rec = spark.createDataFrame([("b", float("nan"), [1, 2]), ("a", 1.5, None)], "k string, v double, l array<int>")
    sinks.write_records(rec, str(tmp_path / "r"), ["k"])
    text = "".join(p.read_text() for p in (tmp_path / "r.csv").glob("part-*"))
    assert text.splitlines()[0] == "k,l,v" and text.splitlines()[1].startswith("a,")
    sinks.write_json({"b": float("nan"), "a": [1, float("inf")]}, spark, str(tmp_path / "d.json"))
    assert (tmp_path / "d.json").read_text() == '{\n  "a": [\n    1,\n    null\n  ],\n  "b": null\n}'
    table = registry.results_table(spark, "/root/testdata/sf0.01")
    latex = sinks.latex_table(table)
    assert "\\mathbf" in latex and "global\\_threshold" in latex
    with pytest.raises(Exception, match="too small"):
        readers.require(s, "score > 1.5", "too small").collect()


def test_stream_gives_the_batch_counts(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartition(2).write.parquet(str(tmp_path / "in"))
    want = {tuple(r) for r in alert_counts(e, 100.0).collect()}
    stream = alert_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), 100.0)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("alerts").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("alerts").collect()} == want


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.count() == 10 and "cv_fpr" in df.columns


CHECKED = ["split_rows", "thresholds_all_policies", "client_rates", "fleet_dispersion", "auroc", "sweep_rows", "threshold_shift", "claim_gates", "trust_boundary"]


@pytest.mark.parametrize("name", CHECKED)
def test_queries_match_their_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    got = registry.queries()[name](spark, sf).toPandas()
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    keys = [c for c in sorted(got.columns) if got[c].dtype.kind != "f" or c == "fraction"]
    a, b = (x.sort_values(keys).reset_index(drop=True) for x in (got, want[got.columns]))
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9, atol=1e-8)


def test_guards(spark):
    cells = spark.createDataFrame([("random_benign", "threshold_raise", 0.1), ("low_score_benign", "threshold_raise", 0.2), ("random_benign", "threshold_lower", 0.3)], "source string, objective string, fraction double")
    assert sorted(r.rule for r in guards.invalid_cells(cells).collect()) == ["fraction", "pair"]
    with pytest.raises(ValueError, match="cells"):
        guards.require_empty(guards.invalid_cells(cells), "cells")
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [1.0]), ("b", [math.inf]), ("c", [0.0])], "k string, x array<double>")
    got = {r.k: (r.min_width, r.max_width, r.all_finite) for r in guards.feature_validity(rows, ["k"], "x").collect()}
    assert got == {"a": (1, 2, True), "b": (1, 1, False), "c": (1, 1, True)}
    marks = spark.createDataFrame([(1, "done"), (2, "done"), (2, "aborted")], "run_id int, marker string")
    assert {r.run_id: r.state for r in guards.run_states(marks).collect()} == {1: "done", 2: "corrupt"}


def test_runs_and_weights(spark, tmp_path):
    folder = str(tmp_path / "run")
    assert state.run_state(spark, folder) == "missing"
    with state.Run(spark, folder):
        assert state.run_state(spark, folder) == "in_progress"
    assert state.run_state(spark, folder) == "done"
    with pytest.raises(KeyError), state.Run(spark, folder):
        raise KeyError("x")
    assert state.run_state(spark, folder) == "aborted"
    w = Network(3, (2,)).start(1)
    digest = state.save_weights(spark, w, str(tmp_path / "w"))
    back = state.load_weights(spark, str(tmp_path / "w"))
    assert digest == state.weights_hash(back) and all((a == b).all() for a, b in zip(w, back))
    grid = spark.createDataFrame([(1, "a"), (2, "a")], "seed int, policy string")
    assert state.pending_runs(grid, grid.where("seed = 1"), ["seed", "policy"]).first().seed == 2
    spark.range(3).write.parquet(str(tmp_path / "p"))
    with pytest.raises(ValueError):
        readers.schema_audit(spark, str(tmp_path / "p"), 2)
