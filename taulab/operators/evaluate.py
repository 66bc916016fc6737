"""Confusion counts, rates, ranking metrics and fleet dispersion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taulab.functions.columns import cv, iqr, ratio, rates, sample_std

from .quantiles import percentiles
from .range_count import count_above


def client_eval(scores: DataFrame, taus: DataFrame) -> DataFrame:
    """taus (seed, policy, client_id, status, tau) plus confusion counts, rates and evaluation_incomplete."""
    sizes = scores.groupBy("seed", "client_id").agg(F.count_if(F.col("stage") == "test_benign").alias("n_benign"), F.count_if(F.col("stage") == "test_attack").alias("n_attack"))
    keyed = taus.withColumn("tau_id", F.concat_ws("|", "seed", "policy", "client_id"))
    out = keyed
    for stage, name in (("test_benign", "fp"), ("test_attack", "tp")):
        out = count_above(scores.where(F.col("stage") == stage).select("seed", "client_id", "score"), out, ["seed", "client_id"], "score", "tau", name)
    out = out.join(sizes, ["seed", "client_id"]).withColumns({"tn": F.col("n_benign") - F.col("fp"), "fn": F.col("n_attack") - F.col("tp")})
    return out.withColumns(rates("tp", "fp", "tn", "fn")).withColumn("evaluation_incomplete", F.col("n_attack") == 0).drop("tau_id")


def fleet_stats(fpr: str, client: str = "client_id") -> dict:
    """Dispersion of a rate over clients; the worst client is the first of those with the largest rate."""
    x = F.col(fpr)
    return {
        "cv_fpr": cv(x),
        "mean_fpr": F.avg(x),
        "std_fpr": sample_std(x),
        "iqr_fpr": iqr(x),
        "max_min_fpr": F.max(x) - F.min(x),
        "worst_client_fpr": F.max(x),
        "worst_client_id": F.min_by(client, F.struct(-x, F.col(client))),
    }


def dispersion(evals: DataFrame) -> DataFrame:
    """One row per (seed, policy): false-positive dispersion over eligible clients, attack-side figures over complete ones."""
    ok = F.col("status") == "eligible"
    done = ok & ~F.col("evaluation_incomplete")
    marked = evals.withColumns({"e_fpr": F.when(ok, F.col("fpr")), "e_id": F.when(ok, F.col("client_id")), **{f"d_{c}": F.when(done, F.col(c)) for c in ("tpr", "balanced_accuracy", "macro_f1")}})
    stats = fleet_stats("e_fpr", "e_id")
    stats["worst_client_id"] = F.min_by("e_id", F.when(ok, F.struct(-F.col("e_fpr"), F.col("e_id"))))
    return marked.groupBy("seed", "policy").agg(
        *(c.alias(k) for k, c in stats.items()),
        cv("d_tpr").alias("cv_tpr"),
        iqr("d_tpr").alias("iqr_tpr"),
        F.min("d_balanced_accuracy").alias("min_balanced_accuracy"),
        F.percentile("d_macro_f1", F.lit(0.1)).alias("p10_macro_f1"),
        F.count("e_fpr").alias("n_eligible"),
        F.count("*").alias("n_clients"),
        ratio(F.count("e_fpr"), F.count("*")).alias("coverage_ratio"),
    )


def auroc(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, auroc) by rank sums with midranks; null if a class is empty.

    Ties are collapsed to one row per distinct score first, so the window sees distinct scores only.
    """
    two = scores.where("stage IN ('test_benign', 'test_attack')")
    distinct = two.groupBy(*keys, "score").agg(F.count_if(F.col("stage") == "test_attack").alias("p"), F.count_if(F.col("stage") == "test_benign").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wins = distinct.withColumn("w", F.col("p") * (below + F.col("n") / 2))
    return wins.groupBy(*keys).agg(ratio(F.sum("w"), F.sum("p") * F.sum("n")).alias("auroc"))


def average_precision(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, average_precision): the steps of recall times precision over distinct scores, highest first."""
    two = scores.where("stage IN ('test_benign', 'test_attack')")
    distinct = two.groupBy(*keys, "score").agg(F.count_if(F.col("stage") == "test_attack").alias("p"), F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    steps = distinct.withColumns({"tp": F.sum("p").over(w), "seen": F.sum("c").over(w)})
    return steps.groupBy(*keys).agg(F.when((F.sum("p") > 0) & (F.sum("c") > F.sum("p")), F.sum(F.col("p") * F.col("tp") / F.col("seen")) / F.sum("p")).alias("average_precision"))


def scale_bases(cal: DataFrame, keys: list[str], largest: int = 0) -> DataFrame:
    """(keys, iqr, mad, gap, scale_base): the first positive of IQR, median deviation and smallest gap of distinct scores.

    largest: rows of the largest group (see ``percentiles``).
    """
    picked = percentiles(cal, keys, "score", {"q25": 0.25, "median": 0.5, "q75": 0.75}, largest)
    sizes = cal.groupBy(*keys).agg(F.count("score").alias("n"))
    stats = sizes.join(picked, keys, "left").select(*keys, F.when(F.col("n") >= 2, F.col("q75") - F.col("q25")).alias("iqr"), "median")
    mad = percentiles(cal.join(stats, keys).withColumn("off", F.abs(F.col("score") - F.col("median"))), keys, "off", {"mad": 0.5}, largest)
    step = F.col("score") - F.lag("score").over(Window.partitionBy(*keys).orderBy("score"))
    gap = cal.select(*keys, "score").distinct().withColumn("step", step).where("step > 0").groupBy(*keys).agg(F.min("step").alias("gap"))
    base = F.coalesce(*(F.when(F.col(c) > 0, F.col(c)) for c in ("iqr", "mad", "gap")))
    return stats.join(mad, keys).join(gap, keys, "left").select(*keys, "iqr", "median", "mad", "gap", base.alias("scale_base"))
