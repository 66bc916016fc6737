from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from taulab.operators.cluster import enumerated, fixed_k, group_points, silhouettes_by_k
from taulab.operators.sensitivity import cluster_stability
from taulab.operators.sweep import auroc_invariance
from taulab.plans import registry
from taulab.plans.registry import the_sweep
from taulab.plans.reports import cluster_stability_summary

SF = "/root/testdata/sf0.01"


def test_the_stability_grid_restarts_small_fleets_too(spark):
    s = the_sweep(spark, SF)
    rows = cluster_stability(s, ks=(3,), inits=(1,), states=(0, 1)).toPandas()
    by_cell = rows.groupby(["seed", "victim", "source", "objective", "fraction", "k"])["cluster_silhouette_poisoned"]
    assert (by_cell.size() == 2).all() and (by_cell.max() - by_cell.min() > 1e-9).any()
    assert rows[["victim_delta_tau", "fixed_victim_delta_tau"]].notna().all().all()


def test_restarts_against_enumeration():
    x = np.random.default_rng(3).normal(size=(9, 4))

    def loss(labels):
        return sum(((x[labels == g] - x[labels == g].mean(axis=0)) ** 2).sum() for g in set(labels.tolist()))

    single = [loss(group_points(x, 3, 1, 300, state)) for state in range(8)]
    best = loss(enumerated(x, 3))
    assert loss(group_points(x, 3, 50)) <= best + 1e-9
    assert min(single) >= best - 1e-9 and max(single) > best + 1e-6


def test_candidate_numbers_of_clusters(spark):
    schema = "seed long, client_id string, mean double, std double, skew double, tail double"
    rows = [(0, f"c{k}", float(k // 3), 1.0, 0.0, float(k // 3)) for k in range(9)] + [(1, f"c{k}", float(k), 1.0, 0.0, 0.0) for k in range(3)]
    found = silhouettes_by_k(spark.createDataFrame(rows, schema), (2, 3, 4, 9))
    got = {(r.seed, r.k): r.silhouette for r in found.collect()}
    assert set(got) == {(0, 2), (0, 3), (0, 4), (1, 2)} and got[0, 3] == got[0, 4] == 1.0 > got[0, 2]  # three different points make three groups at most
    assert {r.seed: r.valid for r in fixed_k(found, 3).collect()} == {0: True, 1: False}
    for bad in ([(0, "a", 1.0, 1.0, 0.0, 1.0), (0, "b", 1.0, 1.0, 0.0, 1.0)], [(0, "a", float("nan"), 1.0, 0.0, 1.0), (0, "b", 1.0, 1.0, 0.0, 1.0)]):
        with pytest.raises(Exception, match="equal|finite"):
            silhouettes_by_k(spark.createDataFrame(bad, schema), (2,)).collect()


def test_evidence_turns_false_on_other_test_scores(spark):
    s = the_sweep(spark, SF)
    assert all(r.auroc_invariant for r in auroc_invariance(s).collect())
    other = s.scores.withColumn("score", F.when((F.col("seed") == 1) & (F.col("stage") == "test_attack") & (F.col("pos") < 40), 0.0).otherwise(F.col("score")))
    assert {r.seed: r.auroc_invariant for r in auroc_invariance(replace(s, perturbed_tests=other)).collect()} == {k: k != 1 for k in range(5)}


def test_summary_of_cluster_stability(spark):
    f = registry.the_facts(spark, SF, True)
    got = cluster_stability_summary(f).toPandas().set_index(["policy", "objective", "source", "fraction"])
    rows = f.where("policy = 'cluster_threshold' AND fraction > 0").toPandas()
    for key, part in rows.groupby(["policy", "objective", "source", "fraction"]):
        x = got.loc[key]
        assert x.n_rows == len(part) and x.reassignment_rate == pytest.approx((part.cluster_n_reassigned > 0).mean())
        assert x.recomputed_victim_delta_tau == pytest.approx(part.cluster_victim_effect.mean()) and x.fixed_victim_delta_tau == pytest.approx(part.fixed_cluster_victim_delta_tau.mean())
        counts = part.cluster_sizes_poisoned.map(tuple).value_counts()
        assert counts[tuple(x.modal_sizes_poisoned)] == counts.max()
