"""Cluster thresholds: fingerprints of calibration scores, k groups of clients, one threshold per group."""

from __future__ import annotations

from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taulab.constants import CLUSTER_K, QUANTILE
from taulab.functions.columns import moment_skewness
from taulab.sources.store import Store

FINGERPRINT = ("mean", "std", "skew", "tail")


def fingerprints(cal: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """keys plus mean, sample deviation (0 under two rows), skewness (0 without spread) and the threshold percentile."""
    return cal.groupBy(*keys).agg(
        F.avg(score).alias("mean"), F.coalesce(F.stddev_samp(score), F.lit(0.0)).alias("std"), moment_skewness(score).alias("skew"), F.percentile(score, F.lit(QUANTILE)).alias("tail")
    )


def scale(points: np.ndarray, like: np.ndarray) -> np.ndarray:
    """z-scores by the mean and population deviation of like; no spread counts as 1."""
    s = like.std(axis=0)
    return (points - like.mean(axis=0)) / np.where(s == 0, 1.0, s)


@lru_cache(maxsize=64)
def _partitions(n: int, k: int) -> np.ndarray:
    """All labelings of n points with k groups, numbered by first appearance, in lexicographic order."""
    rows = [()]
    for _ in range(n):
        rows = [r + (x,) for r in rows for x in range(min(k, max(r, default=-1) + 2))]
    return np.array([r for r in rows if max(r) == k - 1], np.int8)


def _canonical(labels: np.ndarray) -> np.ndarray:
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(int(x), len(seen)) for x in labels])


def enumerated(points: np.ndarray, k: int) -> np.ndarray:
    """The optimal labels of a few points, over all partitions: what restarts are tested against."""
    labels = _partitions(len(points), k)
    gain = np.zeros(len(labels))
    for g in range(k):
        member = labels == g
        gain += ((member @ points) ** 2).sum(axis=1) / member.sum(axis=1)
    best = gain.max()
    return labels[np.flatnonzero(gain >= best - 1e-9 * max(1.0, abs(best)))[0]].astype(int)


def group_points(points: np.ndarray, k: int, n_init: int = 10, max_iter: int = 300, seed: int = 42) -> np.ndarray:
    """Labels of the best of n_init Lloyd runs from k-means++ starts drawn by seed, whatever the number of points."""
    n = len(points)
    rng, best = np.random.default_rng(seed), (np.inf, None)
    for _ in range(n_init):
        centers = points[[int(rng.integers(n))]]
        while len(centers) < k:
            near = ((points[:, None] - centers) ** 2).sum(axis=2).min(axis=1)
            p = near / near.sum() if near.sum() > 0 else np.full(n, 1 / n)
            centers = np.vstack([centers, points[rng.choice(n, p=p)]])
        for _ in range(max_iter):
            labels = ((points[:, None] - centers) ** 2).sum(axis=2).argmin(axis=1)
            moved = np.array([points[labels == g].mean(axis=0) if (labels == g).any() else centers[g] for g in range(k)])
            if np.allclose(moved, centers):
                break
            centers = moved
        loss = ((points - centers[labels]) ** 2).sum()
        if loss < best[0] - 1e-12:
            best = (loss, labels)
    return _canonical(best[1])


def silhouette(points: np.ndarray, labels: np.ndarray) -> float:
    """Mean Euclidean silhouette; a singleton counts 0, fewer than two groups give 0."""
    names = np.unique(labels)
    if len(names) < 2 or len(names) >= len(points):
        return 0.0
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    mean_to = np.stack([d[:, labels == g].sum(axis=1) for g in names], axis=1)
    size = np.array([(labels == g).sum() for g in names])
    own = np.searchsorted(names, labels)
    rows = np.arange(len(points))
    inside = mean_to[rows, own] / np.maximum(1, size[own] - 1)
    other = mean_to / size
    other[rows, own] = np.inf
    outside = other.min(axis=1)
    value = np.where(size[own] > 1, (outside - inside) / np.maximum(np.maximum(inside, outside), 1e-300), 0.0)
    return float(value.mean())


def fleet_states(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, client_id, clean fingerprint, poisoned fingerprint as arrays) -> (keys, clients, clean, poisoned, a state key for each of the three fits of a fleet).

    A state is a fleet's points and the points whose scale they are brought to; equal states have equal keys whatever cells they come from.
    """
    packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("client_id", "clean", "poisoned"))).alias("fleet"))
    fleet = packed.select(*keys, F.col("fleet.client_id").alias("clients"), F.col("fleet.clean").alias("clean"), F.col("fleet.poisoned").alias("poisoned"))
    key = lambda points, like: F.sha2(F.to_json(F.struct(F.col(points).alias("points"), F.col(like).alias("like"))), 256)
    return fleet.withColumns({"state_clean": key("clean", "clean"), "state_poisoned": key("poisoned", "poisoned"), "state_frozen": key("poisoned", "clean")})


def fitted_states(fleets: DataFrame, params: list[tuple[int, int, int]]) -> DataFrame:
    """(state, k, n_init, random_state, labels, silhouette): one row for each distinct state of ``fleet_states`` and each parameter that the fleet allows, fitted once."""
    kinds = (("state_clean", "clean", "clean"), ("state_poisoned", "poisoned", "poisoned"), ("state_frozen", "poisoned", "clean"))
    each = F.explode(F.array(*(F.struct(F.col(s).alias("state"), F.col(x).alias("points"), F.col(y).alias("like")) for s, x, y in kinds)))
    states = fleets.select(each.alias("s")).select("s.*").dropDuplicates(["state"])
    wanted = F.explode(F.array(*(F.struct(*(F.lit(x).cast("long").alias(name) for x, name in zip(p, ("k", "n_init", "random_state"), strict=True))) for p in params)))
    tasks = states.withColumn("p", wanted).select("state", "points", "like", "p.*").repartition("state", "k", "n_init", "random_state")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                points, like = (np.array([np.asarray(x, float) for x in v]) for v in (r.points, r.like))
                if len(points) > r.k:
                    scaled = scale(points, like)
                    labels = group_points(scaled, r.k, r.n_init, 300, r.random_state)
                    out.append((r.state, r.k, r.n_init, r.random_state, labels.tolist(), silhouette(scaled, labels)))
            yield pd.DataFrame(out, columns=["state", "k", "n_init", "random_state", "labels", "silhouette"])

    return tasks.mapInPandas(run, "state string, k long, n_init long, random_state long, labels array<int>, silhouette double")


def label_states(rows: DataFrame, keys: list[str], params: list[tuple[int, int, int]] = ((CLUSTER_K, 10, 42),)) -> DataFrame:
    """rows (keys, client_id, clean fingerprint, poisoned fingerprint as arrays) -> labels of each client and silhouettes.

    For every (k, n_init, random_state): labels of the clean and of the perturbed fleet, each scaled by itself, and of the perturbed
    fleet scaled by the clean one.  Equal fleets of several keys are fitted once; keys with no more than k clients have none.
    """
    store, how = Store(rows.sparkSession, "fits"), ["k", "n_init", "random_state"]
    fleets = store.save(fleet_states(rows, keys), "fleets")
    fits = store.save(fitted_states(fleets, params), "fits")
    out = fleets.drop("clean", "poisoned").withColumnRenamed("clients", "client_id")
    for name in ("clean", "poisoned", "frozen"):
        side = fits.select(F.col("state").alias(f"state_{name}"), *how, F.col("labels").alias(f"label_{name}"), F.col("silhouette").alias(f"silhouette_{name}"))
        out = out.join(side, [f"state_{name}"] if name == "clean" else [f"state_{name}", *how])
    zipped = F.explode(F.arrays_zip("client_id", "label_clean", "label_poisoned", "label_frozen"))
    return out.select(*keys, *how, zipped.alias("c"), "silhouette_clean", "silhouette_poisoned").select(*keys, *how, "c.client_id", "c.label_clean", "c.label_poisoned", "c.label_frozen", "silhouette_clean", "silhouette_poisoned")


def grid_params(ks: tuple[int, ...], inits: tuple[int, ...], states: tuple[int, ...]) -> list[tuple[int, int, int]]:
    return list(product(ks, inits, states))


def check_fingerprints(points: np.ndarray) -> None:
    """Fingerprints must be finite and of two different clients at least."""
    if not np.isfinite(points).all():
        raise ValueError("fingerprints must be finite")
    if len(np.unique(points, axis=0)) < 2:
        raise ValueError("all fingerprints are equal")


def silhouettes_by_k(clean: DataFrame, ks: tuple[int, ...], n_init: int = 10, random_state: int = 42) -> DataFrame:
    """clean (seed, client_id, FINGERPRINT) -> (seed, n_clients, k, silhouette): the candidates that leave two groups and a group of two at least.

    One Arrow row per seed, of a fleet's size.
    """
    fleet = clean.groupBy("seed").agg(F.sort_array(F.collect_list(F.struct("client_id", F.array(*FINGERPRINT).alias("x")))).alias("fleet")).select("seed", F.col("fleet.x").alias("points"))

    def run(batches):
        for pdf in batches:
            out = []
            for seed, rows in zip(pdf["seed"], pdf["points"], strict=True):
                points = np.array([np.asarray(x, float) for x in rows])
                check_fingerprints(points)
                scaled = scale(points, points)
                for k in ks:
                    if k >= len(points):
                        continue
                    labels = group_points(scaled, k, n_init, 300, random_state)
                    if 2 <= len(np.unique(labels)) < len(points):
                        out.append((seed, len(points), k, silhouette(scaled, labels)))
            yield pd.DataFrame(out, columns=["seed", "n_clients", "k", "silhouette"])

    return fleet.mapInPandas(run, "seed long, n_clients long, k long, silhouette double")


def fixed_k(candidates: DataFrame, k: int = CLUSTER_K) -> DataFrame:
    """(seed, n_clients, k, silhouette, valid): whether the fixed k is between 0 and the fleet's size and has a silhouette."""
    own = candidates.groupBy("seed", "n_clients").agg(F.max(F.when(F.col("k") == k, F.col("silhouette"))).alias("silhouette"))
    return own.select("seed", "n_clients", F.lit(k).cast("long").alias("k"), "silhouette", ((F.lit(k) > 0) & (F.lit(k) < F.col("n_clients")) & F.col("silhouette").isNotNull()).alias("valid"))
