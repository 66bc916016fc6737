"""Sensitivity tables of the sweep: scale normalization, trimming, cluster parameters; convergence and ECDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taulab.constants import CONVERGENCE, GLOBAL, LOCAL, RAISE
from taulab.functions.columns import cv
from taulab.sources.store import Store

from .cluster import grid_params
from .inject import CELL, variant_replacements
from .ladder import ranked
from .quantiles import percentiles
from .sweep import TRIMS, Sweep, cluster_labels, cluster_shape, perturbed_figures


def scale_normalization(s: Sweep) -> DataFrame:
    """The victim's shift of the global threshold, raw and with every client's threshold divided by its median score."""
    fleet = s.clients.select("seed", "client_id", "tau", F.col("median").alias("scale"))
    rows = s.shifts.where("fraction > 0").select(*CELL, "victim_tau_poisoned").join(fleet, "seed")
    rows = rows.withColumn("new", F.when(F.col("client_id") == F.col("victim"), F.col("victim_tau_poisoned")).otherwise(F.col("tau")))
    own = F.max(F.when(F.col("client_id") == F.col("victim"), F.col("scale")))
    return rows.groupBy(*CELL).agg(
        (F.avg("new") - F.avg("tau")).alias("raw_delta"),
        (own * (F.avg(F.col("new") / F.col("scale")) - F.avg(F.col("tau") / F.col("scale")))).alias("normalized_delta"),
        cv("tau").alias("tau_cv"),
        F.when(F.min("tau") > 0, F.max("tau") / F.min("tau")).alias("tau_ratio"),
        cv("scale").alias("scale_cv"),
    )


def trust_boundary(s: Sweep) -> DataFrame:
    """The victim's shift undefended and with both states trimmed, and what is left against the clean threshold, per policy.

    The global threshold is the mean of the local ones, so its figures follow from the victim's and the fleet's means.
    """
    fleet = s.clients.groupBy("seed").agg(F.avg("tau").alias("global_clean"), F.count("*").alias("n"), *(F.avg(f"tau_{k}").alias(f"mean_{k}") for k in TRIMS))
    out = s.shifts.where("fraction > 0").join(fleet, "seed")
    c, p, g, n = F.col("victim_tau_clean"), F.col("victim_tau_poisoned"), F.col("global_clean"), F.col("n")
    extreme = F.when(F.col("objective") == RAISE, F.col("cal_max")).otherwise(F.col("cal_min"))
    moved = {k: F.col(f"trimmed_{k}_poisoned") - F.col(f"trimmed_{k}_clean") for k in TRIMS}
    policies = {
        LOCAL: {"undefended": p - c, **{f"trim_{k}": m for k, m in moved.items()}, **{f"residual_{k}": F.col(f"trimmed_{k}_poisoned") - c for k in moved}, "overwrite_reference": extreme - c},
        GLOBAL: {"undefended": (p - c) / n, **{f"trim_{k}": m / n for k, m in moved.items()}, **{f"residual_{k}": F.col(f"mean_{k}") + m / n - g for k, m in moved.items()}, "overwrite_reference": extreme - g},
    }
    each = F.array(*(F.struct(F.lit(name).alias("policy"), *(v.alias(k) for k, v in figures.items())) for name, figures in policies.items()))
    return out.select(*CELL, F.explode(each).alias("x")).select(*CELL, "x.*")


def draw_variants(s: Sweep) -> DataFrame:
    """CELL, draw, policy with the requested and effective budgets, the pool, and the victim's shift and duplicates beside those of drawing with replacement.

    The global threshold is the mean of the local ones and moves by its share of the victim's.
    """
    cell = [*CELL, "draw"]
    asked, replaced = variant_replacements(s.cells, s.ladder, s.store, s.largest)
    new = perturbed_figures(replaced, s.ladder, s.clients, cell).select(*cell, "tau_poisoned", "duplicate_rate_poisoned")
    fleet = s.clients.select("seed", F.col("client_id").alias("victim"), "n_eligible")
    base = s.shifts.select(*CELL, "victim_tau_clean", "victim_tau_poisoned", "cal_duplicate_rate_clean", "cal_duplicate_rate_poisoned")
    rows = asked.join(new, cell, "left").join(base, CELL).join(fleet, ["seed", "victim"])
    with_, variant = F.col("victim_tau_poisoned") - F.col("victim_tau_clean"), F.coalesce("tau_poisoned", "victim_tau_clean") - F.col("victim_tau_clean")
    each = F.array(*(F.struct(F.lit(p).alias("policy"), (with_ / by).alias("delta_tau_with_replacement"), (variant / by).alias("delta_tau_variant")) for p, by in ((LOCAL, F.lit(1)), (GLOBAL, F.col("n_eligible")))))
    dup = {"duplicate_rate_with_replacement": F.col("cal_duplicate_rate_poisoned"), "duplicate_rate_variant": F.coalesce("duplicate_rate_poisoned", "cal_duplicate_rate_clean")}
    return rows.withColumn("x", F.explode(each)).select(*cell, "requested", "effective", "pool_n", "x.*", *(c.alias(k) for k, c in dup.items()))


def cluster_stability(s: Sweep, ks=(2, 3, 4), inits=(1, 10), states=(0, 1, 7, 42, 123)) -> DataFrame:
    """Cluster shapes and the victim's threshold shift, with clusters recomputed and fixed, of every perturbed cell for each
    (k, n_init, random_state) that the fleet allows."""
    keys = [*CELL, "k", "n_init", "random_state"]
    labels = cluster_labels(s, grid_params(ks, inits, states), only_perturbed=True)
    fleet = s.clients.select("seed", "client_id", "tau")
    rows = labels.join(fleet, ["seed", "client_id"]).join(s.shifts.select(*CELL, "victim_tau_poisoned"), CELL)
    own, is_victim = F.col("client_id") == F.col("victim"), lambda label: F.max(F.when(F.col("client_id") == F.col("victim"), F.col(label))).over(Window.partitionBy(*keys))
    rows = rows.withColumn("new", F.when(own, F.col("victim_tau_poisoned")).otherwise(F.col("tau"))).withColumns({"at_clean": is_victim("label_clean"), "at_poisoned": is_victim("label_poisoned")})
    mates = {x: F.col(f"label_{x}") == F.col(f"at_{x}") for x in ("clean", "poisoned")}
    mean = lambda value, state: F.avg(F.when(mates[state], F.col(value)))
    shift = rows.groupBy(*keys).agg((mean("new", "poisoned") - mean("tau", "clean")).alias("victim_delta_tau"), (mean("new", "clean") - mean("tau", "clean")).alias("fixed_victim_delta_tau"))
    return cluster_shape(labels, keys).join(shift, keys)


def convergence(loss: DataFrame, window: int = CONVERGENCE["window"], relative: float = CONVERGENCE["relative_threshold"]) -> DataFrame:
    """loss (round_no, loss) plus the means of the last and the previous window and whether to stop after the round.

    One short series: the rounds of one training run.
    """
    w = Window.orderBy("round_no")
    out = loss.withColumns({"seen": F.count("*").over(w), "last_mean": F.avg("loss").over(w.rowsBetween(1 - window, 0)), "prev_mean": F.avg("loss").over(w.rowsBetween(1 - 2 * window, -window))})
    still = F.when(F.col("prev_mean") < 1e-12, True).otherwise(F.abs(F.col("last_mean") - F.col("prev_mean")) / F.col("prev_mean") < relative)
    ready = (F.col("round_no") >= CONVERGENCE["rounds_initial"]) & (F.col("seen") >= 2 * window)
    return out.withColumn("stop", (ready & F.coalesce(still, F.lit(False))) | (F.col("round_no") >= CONVERGENCE["rounds_max"])).drop("seen")


def ecdf(cal: DataFrame, store: Store, largest: int = 0) -> DataFrame:
    """(client_id, event_id, score, ecdf): i / n per client, up to the pooled 99th percentile; largest: rows of all clients together."""
    rows = cal.withColumn("pool", F.lit(0))
    top = percentiles(rows, ["pool"], "score", {"top": 0.99}, largest)
    sizes = rows.groupBy("client_id").agg(F.count("*").alias("n"))
    placed = ranked(rows, ["client_id"], ["score", "event_id"], store, "place").join(sizes, "client_id").join(top, "pool").where("score <= top")
    return placed.select("client_id", "event_id", "score", ((F.col("place") + 1) / F.col("n")).alias("ecdf"))
