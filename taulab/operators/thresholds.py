"""Decision thresholds of the policies from calibration scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taulab.constants import GLOBAL, LOCAL, N_MIN, QUANTILE

from .quantiles import percentiles


def eligibility(scores: DataFrame, n_min: int = N_MIN) -> DataFrame:
    """(seed, client_id, n_cal, status): clients with fewer calibration rows are pending."""
    return scores.groupBy("seed", "client_id").agg(F.count_if(F.col("stage") == "cal").alias("n_cal")).withColumn("status", F.when(F.col("n_cal") >= n_min, "eligible").otherwise("calibration_pending"))


def local_taus(scores: DataFrame, n_min: int = N_MIN, q: float = QUANTILE, largest: int = 0) -> DataFrame:
    """(seed, client_id, tau) of eligible clients; largest: rows of the largest client (see ``percentiles``)."""
    cal = scores.where("stage = 'cal'")
    eligible = eligibility(scores, n_min).where("status = 'eligible'")
    return percentiles(cal, ["seed", "client_id"], "score", {"tau": q}, largest).join(eligible.select("seed", "client_id"), ["seed", "client_id"], "left_semi")


def global_taus(local: DataFrame) -> DataFrame:
    """(seed, tau_global, n_eligible): the mean of the clients' thresholds, not a pooled percentile."""
    return local.groupBy("seed").agg(F.avg("tau").alias("tau_global"), F.count("*").alias("n_eligible"))


def thresholds(scores: DataFrame, n_min: int = N_MIN, q: float = QUANTILE, largest: int = 0) -> DataFrame:
    """(seed, policy, client_id, status, tau) of both policies; pending clients fall back to the global threshold."""
    local = local_taus(scores, n_min, q, largest)
    every = eligibility(scores, n_min).join(global_taus(local), "seed").join(local, ["seed", "client_id"], "left")
    policies = F.array(F.struct(F.lit(GLOBAL).alias("policy"), F.col("tau_global").alias("tau")), F.struct(F.lit(LOCAL).alias("policy"), F.coalesce("tau", "tau_global").alias("tau")))
    return every.withColumn("p", F.explode(policies)).select("seed", "p.policy", "client_id", "status", "p.tau")


def trimmed(ladder: DataFrame, fraction: float) -> DataFrame:
    """A client ladder (rank, n) without the floor(fraction * n) smallest and largest scores of each client."""
    cut = F.floor(F.col("n") * F.lit(fraction))
    return ladder.where((F.col("rank") >= cut) & (F.col("rank") < F.col("n") - cut))
