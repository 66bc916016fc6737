"""The fact table of the perturbation sweep: one row per (seed, victim, policy, source, objective, fraction).

Only some of the victim's calibration scores change.  A cell is made of the rows that it replaces; percentiles, distinct values and moments of
the perturbed group follow from these and from the victim's ladder, which is stored once, so that rows are never copied to cells.  An injection
serves all policies; fraction 0 is the clean state.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taulab.constants import CLUSTER, EPS, GLOBAL, IQR_FLOOR_FACTOR, LOCAL, MATERIALITY_FACTOR, MU_FLAG_DIVISOR, N_MIN, QUANTILE, RAISE, TRAIN_FEATURE_SOURCES, TRIM_APPENDIX, TRIM_PRIMARY, WITH_REPLACEMENT, WITHOUT_REPLACEMENT
from taulab.functions.columns import cv, defined, duplicate_rate, iqr, rates
from taulab.sources.store import Store

from .cluster import label_states
from .evaluate import auroc, scale_bases
from .inject import CELL, budget, changes, client_ladder, grid, replacements
from .ladder import at_ranks, merged
from .quantiles import interpolated, wanted_ranks
from .range_count import count_above


@dataclass
class Sweep:
    """The stages of a sweep; each is a lazy DataFrame."""

    scores: DataFrame
    clients: DataFrame  # eligible clients with their clean figures
    cells: DataFrame
    ladder: DataFrame  # calibration rows of eligible clients with their ranks
    replaced: DataFrame  # the calibration rows that the cells with fraction > 0 replace
    shifts: DataFrame  # CELL with the victim's clean and perturbed figures
    n_min: int
    store: Store
    perturbed_tests: DataFrame  # test scores of the perturbed state
    largest: int  # calibration rows of the largest client

    @property
    def cal(self) -> DataFrame:
        return self.ladder.select("seed", "client_id", "stage", "pos", "event_id", "score")


def clean_figures(ladder: DataFrame, largest: int = 0) -> DataFrame:
    """seed, client_id and the ladder's figures: extremes, distinct values, moments, IQR, scale bases, and thresholds of the whole and the trimmed group by rank."""
    keys = ["seed", "client_id"]
    moments = ladder.groupBy(*keys).agg(
        F.count("*").alias("n_cal"), F.min("score").alias("cal_min"), F.max("score").alias("cal_max"), F.count_distinct("score").alias("n_distinct"), duplicate_rate("score").alias("duplicate_rate"),
        F.avg("score").alias("mean"), F.coalesce(F.stddev_pop("score"), F.lit(0.0)).alias("spread"), F.coalesce(defined(F.skewness("score")), F.lit(0.0)).alias("skew"),
    )
    places = {"tau": percentile_place("n_cal", QUANTILE)} | {f"tau_{name}": percentile_place("n_cal", QUANTILE, t) for name, t in TRIMS.items()}
    sizes = ladder.select(*keys, F.col("n").alias("n_cal")).distinct()
    picked = interpolated(at_ranks(ladder, wanted_ranks(sizes, "n_cal", places), keys), keys, list(places))
    return moments.join(picked, keys).join(scale_bases(ladder, keys, largest), keys)


#: Shares trimmed from both ends by the defence, by name.
TRIMS = {"primary": TRIM_PRIMARY, "appendix": TRIM_APPENDIX}


def percentile_place(n: str, q: float, trim: float = 0.0) -> Column:
    """Where the percentile lies among n ordered values, from 0, after a share of them is dropped at both ends."""
    cut = F.floor(F.col(n) * F.lit(trim))
    return cut + F.lit(q) * (F.col(n) - 2 * cut - 1)


def perturbed_figures(replaced: DataFrame, ladder: DataFrame, clients: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """cell, n_replaced and the victim's figures after replacement, from its clean figures and the replaced rows alone."""
    keys = ["seed", "victim"]
    steps = ladder.withColumnRenamed("client_id", "victim")
    moved = changes(replaced, cell)
    # power sums about the clean mean
    clean = clients.select("seed", F.col("client_id").alias("victim"), "mean", "spread", "skew", "n_distinct")
    power = lambda c, k: F.pow(F.col(c) - F.col("mean"), F.lit(k))
    cells = replaced.join(clean, keys).groupBy(*cell, "n", *clean.columns[2:]).agg(
        F.count("*").alias("n_replaced"), (F.count_distinct("donor_id") / F.nullif(F.count("donor_id"), F.lit(0))).alias("donor_feature_unique_fraction"),
        *(F.sum(power("score", k) - power("clean_score", k)).alias(f"d{k}") for k in (1, 2, 3)),
    )
    places = {"tau": percentile_place("n", QUANTILE)} | {f"tau_{name}": percentile_place("n", QUANTILE, t) for name, t in TRIMS.items()}
    wanted = wanted_ranks(cells.select(*cell, "n"), "n", places)
    picked = interpolated(merged(steps, moved, wanted, keys, cell), cell, list(places))
    # values that appear or vanish, from how often the touched ones were there before
    both = replaced.select(*cell, F.explode(F.array(F.struct(F.col("score").alias("value"), F.lit(1).alias("net")), F.struct(F.col("clean_score").alias("value"), F.lit(-1).alias("net")))).alias("x")).select(*cell, "x.*")
    had = steps.groupBy(*keys, F.col("score").alias("value")).agg(F.count("*").alias("had"))
    nets = both.groupBy(*cell, "value").agg(F.sum("net").alias("net")).join(had, [*keys, "value"], "left").withColumn("had", F.coalesce("had", F.lit(0)))
    kinds = nets.groupBy(*cell).agg(F.sum((F.col("had") + F.col("net") > 0).cast("int") - (F.col("had") > 0).cast("int")).alias("more_values"))
    out = cells.join(picked, cell).join(kinds, cell)
    n = F.col("n")
    s2, s3, shift = n * F.pow("spread", F.lit(2)) + F.col("d2"), n * F.col("skew") * F.pow("spread", F.lit(3)) + F.col("d3"), F.col("d1") / n
    m2, m3 = F.greatest(F.lit(0.0), s2 - n * shift * shift), s3 - 3 * shift * s2 + 2 * n * F.pow(shift, F.lit(3))
    flat = m2 <= F.lit(EPS) * s2
    return out.select(
        *cell,
        "n_replaced",
        "donor_feature_unique_fraction",
        *(F.col(name).alias(f"{name}_poisoned") for name in places),
        (1 - (F.col("n_distinct") + F.col("more_values")) / n).alias("duplicate_rate_poisoned"),
        F.array(F.col("mean") + shift, F.when(flat | (n < 2), 0.0).otherwise(F.sqrt(m2 / (n - 1))), F.when(flat, 0.0).otherwise(m3 / n / F.pow(m2 / n, F.lit(1.5))), F.col("tau")).alias("fingerprint_poisoned"),
    )


def prepare(scores: DataFrame, n_min: int = N_MIN) -> Sweep:
    store = Store(scores.sparkSession, "sweep")
    scores = store.save(scores, "scores")
    stage = lambda x: F.count_if(F.col("stage") == x)
    sizes = scores.groupBy("seed", "client_id").agg(stage("cal").alias("n"), stage("train").alias("n_train"), stage("test_benign").alias("n_benign"), stage("test_attack").alias("n_attack"))
    sizes = store.save(sizes, "sizes")
    seeds = sizes.groupBy("seed").agg(F.count("*").alias("n_total"), F.max("n").alias("most"), F.sum("n_train").alias("donors"))
    largest, largest_seed = seeds.agg(F.coalesce(F.max("most"), F.lit(0)), F.coalesce(F.max("donors"), F.lit(0))).first()
    eligible = sizes.where(F.col("n") >= n_min)
    cal = scores.where("stage = 'cal'").join(eligible.select("seed", "client_id"), ["seed", "client_id"])
    ladder = client_ladder(cal, eligible, store, largest)
    by_seed = Window.partitionBy("seed")
    clients = (
        clean_figures(ladder, largest)
        .join(eligible.select("seed", "client_id", "n_benign", "n_attack"), ["seed", "client_id"])
        .join(seeds.select("seed", "n_total"), "seed")
        .withColumns({"n_eligible": F.count("*").over(by_seed), "tau_global": F.avg("tau").over(by_seed), "iqr_median": F.percentile("iqr", F.lit(0.5)).over(by_seed)})
        .withColumn("client_idx", F.row_number().over(by_seed.orderBy("client_id")) - 1)
    )
    clients = store.save(clients, "clients")
    cells = store.save(grid(clients), "cells")
    train = scores.where("stage = 'train'").select("seed", "client_id", F.col("event_id").alias("row_id"), "pos", "score")
    replaced = replacements(cells, ladder, train, store, largest, largest_seed)
    new = perturbed_figures(replaced, ladder, clients)
    victims = clients.select("seed", F.col("client_id").alias("victim"), "tau", "n_cal", "duplicate_rate", "cal_min", "cal_max", "client_idx", *(f"tau_{name}" for name in TRIMS))
    shifts = cells.join(victims, ["seed", "victim"]).join(new.drop("n_replaced"), CELL, "left").select(
        *CELL,
        F.col("tau").alias("victim_tau_clean"),
        F.coalesce("tau_poisoned", "tau").alias("victim_tau_poisoned"),
        budget("fraction", "n_cal").alias("n_replaced"),
        F.col("duplicate_rate").alias("cal_duplicate_rate_clean"),
        F.coalesce("duplicate_rate_poisoned", "duplicate_rate").alias("cal_duplicate_rate_poisoned"),
        "donor_feature_unique_fraction",
        "cal_min",
        "cal_max",
        "client_idx",
        *(F.col(f"tau_{name}").alias(f"trimmed_{name}_clean") for name in TRIMS),
        *(F.coalesce(f"tau_{name}_poisoned", f"tau_{name}").alias(f"trimmed_{name}_poisoned") for name in TRIMS),
        "fingerprint_poisoned",
    )
    return Sweep(scores, clients, cells, ladder, replaced, store.save(shifts, "shifts"), n_min, store, perturbed_tests(scores, replaced), largest)


def perturbed_tests(scores: DataFrame, replaced: DataFrame) -> DataFrame:
    """The test rows of the perturbed state: those of the scores, with the replacements that any cell makes among them."""
    new = replaced.groupBy("seed", F.col("victim").alias("client_id"), "stage", "pos").agg(F.max("score").alias("new"))
    tests = scores.where("stage IN ('test_benign', 'test_attack')")
    return tests.join(new, ["seed", "client_id", "stage", "pos"], "left").withColumn("score", F.coalesce("new", "score")).drop("new")


def cluster_labels(s: Sweep, params=None, only_perturbed: bool = False) -> DataFrame:
    """Labels of all eligible clients for each cell (see ``label_states``)."""
    std = F.when(F.col("n_cal") < 2, 0.0).otherwise(F.col("spread") * F.sqrt(F.col("n_cal") / (F.col("n_cal") - 1)))
    clean = s.clients.select("seed", "client_id", F.array("mean", std, "skew", "tau").alias("clean"))
    cells = s.shifts.where("fraction > 0") if only_perturbed else s.shifts
    rows = cells.select(*CELL, F.col("fingerprint_poisoned").alias("changed")).join(clean, "seed")
    rows = rows.withColumn("poisoned", F.when((F.col("client_id") == F.col("victim")) & F.col("changed").isNotNull(), F.col("changed")).otherwise(F.col("clean")))
    return s.store.save(label_states(rows, CELL, params) if params else label_states(rows, CELL), "labels")


def cell_taus(s: Sweep, labels: DataFrame | None = None) -> DataFrame:
    """One row per (CELL, policy, client_id): clean and perturbed thresholds; with labels also the cluster policy and its decomposition."""
    clean = s.clients.select("seed", "client_id", "tau", "tau_global", "n_eligible")
    every = s.shifts.select(*CELL, "victim_tau_clean", "victim_tau_poisoned").join(clean, "seed")
    own = F.when(F.col("client_id") == F.col("victim"), F.col("victim_tau_poisoned")).otherwise(F.col("tau"))
    cell = Window.partitionBy(*CELL)
    every = every.withColumn("own_poisoned", own).withColumn("global_poisoned", F.when(F.col("fraction") == 0, F.col("tau_global")).otherwise(F.avg("own_poisoned").over(cell)))
    kinds = [(GLOBAL, "tau_global", "global_poisoned", None, None), (LOCAL, "tau", "own_poisoned", None, None)]
    if labels is not None:
        mean = lambda x, label: F.avg(x).over(Window.partitionBy(*CELL, label))
        every = every.join(labels.drop("k", "n_init", "random_state"), [*CELL, "client_id"])
        every = every.withColumns({
            "cluster_clean": mean("tau", "label_clean"), "cluster_poisoned": mean("own_poisoned", "label_poisoned"),
            "cluster_fixed": mean("own_poisoned", "label_clean"), "cluster_frozen": mean("own_poisoned", "label_frozen"),
        })
        kinds.append((CLUSTER, "cluster_clean", "cluster_poisoned", "cluster_fixed", "cluster_frozen"))
    null = F.lit(None).cast("double")
    policies = F.array(*(
        F.struct(F.lit(p).alias("policy"), F.col(a).alias("tau_clean"), F.col(b).alias("tau_poisoned"), (F.col(c) if c else null).alias("tau_fixed"), (F.col(d) if d else null).alias("tau_frozen"))
        for p, a, b, c, d in kinds
    ))
    return s.store.save(every.withColumn("p", F.explode(policies)).select(*CELL, "client_id", "p.*"), "taus")


def client_effects(s: Sweep, taus: DataFrame) -> DataFrame:
    """taus plus confusion counts and rates of each client under the clean, perturbed and fixed-cluster thresholds."""
    wanted = taus.select("seed", "client_id", F.explode(F.array_distinct(F.array("tau_clean", "tau_poisoned", "tau_fixed"))).alias("tau")).where("tau IS NOT NULL").distinct()
    wanted = wanted.withColumn("tau_id", F.concat_ws("|", "seed", "client_id", F.col("tau").cast("string")))
    wanted = s.store.save(wanted, "wanted")
    for stage, name in (("test_benign", "fp"), ("test_attack", "tp")):
        wanted = count_above(s.scores.where(F.col("stage") == stage).select("seed", "client_id", "score"), wanted, ["seed", "client_id"], "score", "tau", name)
    sizes = s.clients.select("seed", "client_id", "n_benign", "n_attack")
    wanted = s.store.save(wanted, "counted")
    counted = wanted.join(sizes, ["seed", "client_id"]).withColumns({"tn": F.col("n_benign") - F.col("fp"), "fn": F.col("n_attack") - F.col("tp")})
    r = rates("tp", "fp", "tn", "fn")
    counted = counted.select("seed", "client_id", "tau", F.struct("tp", "fp", "fn", *(r[k].alias(k) for k in ("fpr", "tpr", "balanced_accuracy", "macro_f1"))).alias("m"))
    out = taus
    for state in ("clean", "poisoned", "fixed"):
        side = counted.withColumnsRenamed({"tau": f"tau_{state}", "m": f"m_{state}"})
        out = out.join(side, ["seed", "client_id", f"tau_{state}"], "left")
    base = s.clients.select("seed", "client_id", "scale_base", "iqr_median", "n_benign", "n_attack", "n_eligible", "n_total")
    return s.store.save(out.join(base, ["seed", "client_id"]), "effects")


def auroc_invariance(s: Sweep) -> DataFrame:
    """(seed, auroc_invariant): whether every eligible client's AUROC is the same in the clean and the perturbed state."""
    states = [auroc(x.join(s.clients.select("seed", "client_id"), ["seed", "client_id"]), ["seed", "client_id"]) for x in (s.scores, s.perturbed_tests)]
    both = states[0].join(states[1].withColumnRenamed("auroc", "again"), ["seed", "client_id"], "full")
    return both.groupBy("seed").agg(F.bool_and(F.col("auroc").eqNullSafe(F.col("again"))).alias("auroc_invariant"))


def materiality(base: str, median: str, factor: float = MATERIALITY_FACTOR, floor: float = IQR_FLOOR_FACTOR):
    return F.when(F.col(base).isNotNull(), F.greatest(F.lit(factor) * F.col(base), F.lit(floor) * F.col(median)))


def facts(s: Sweep, labels: DataFrame | None = None) -> DataFrame:
    """The fact rows; cluster columns are null for the other policies."""
    e = client_effects(s, cell_taus(s, labels))
    e = e.withColumns({
        "is_victim": F.col("client_id") == F.col("victim"),
        "delta": F.col("tau_poisoned") - F.col("tau_clean"),
        "d_tpr": F.col("m_poisoned.tpr") - F.col("m_clean.tpr"),
        "d_fpr": F.col("m_poisoned.fpr") - F.col("m_clean.fpr"),
        "d_ba": F.col("m_poisoned.balanced_accuracy") - F.col("m_clean.balanced_accuracy"),
        "d_f1": F.col("m_poisoned.macro_f1") - F.col("m_clean.macro_f1"),
        "d_fpr_fixed": F.col("m_fixed.fpr") - F.col("m_clean.fpr"),
        "d_tpr_fixed": F.col("m_fixed.tpr") - F.col("m_clean.tpr"),
    })
    e = e.withColumn("material", F.coalesce(F.abs("delta") >= materiality("scale_base", "iqr_median"), F.lit(False)))
    worse = F.when(F.col("objective") == RAISE, (F.col("d_tpr") < 0) | (F.col("d_ba") < 0) | (F.col("d_f1") < 0)).otherwise(F.col("d_fpr") > 0)
    e = e.withColumn("worse", F.coalesce(worse, F.lit(False)))
    v = lambda c: F.max(F.when(F.col("is_victim"), c if not isinstance(c, str) else F.col(c)))
    o = lambda f, c: f(F.when(~F.col("is_victim"), F.col(c)))
    aggs = {
        "delta_tau": v("delta"), "tau_clean": v("tau_clean"), "is_victim_significant": v("material"),
        "n_blast_significant": F.count_if(~F.col("is_victim") & F.col("material")), "n_spillover": F.count_if(~F.col("is_victim") & F.col("worse")), "n_non_victims": F.count_if(~F.col("is_victim")),
        "n_eligible": F.max("n_eligible"), "n_total": F.max("n_total"), "victim_delta_tau_scale_base": v("scale_base"), "iqr_median_clean": F.max("iqr_median"),
        "victim_n_test_benign": v("n_benign"), "victim_n_test_attack": v("n_attack"),
        "nonvictim_mean_delta_tpr": o(F.avg, "d_tpr"), "nonvictim_worst_delta_tpr": o(F.min, "d_tpr"), "nonvictim_mean_delta_fpr": o(F.avg, "d_fpr"), "nonvictim_worst_delta_fpr": o(F.max, "d_fpr"),
        "nonvictim_mean_delta_ba": o(F.avg, "d_ba"), "nonvictim_mean_delta_macro_f1": o(F.avg, "d_f1"),
    }
    for state in ("clean", "poisoned"):
        m = f"m_{state}"
        x = F.col(f"{m}.fpr")
        aggs |= {
            f"cv_fpr_{state}": cv(x), f"mean_fpr_{state}": F.avg(x), f"iqr_fpr_{state}": iqr(x), f"max_min_fpr_{state}": F.max(x) - F.min(x), f"worst_client_fpr_{state}": F.max(x),
            f"victim_tpr_{state}": v(f"{m}.tpr"), f"victim_fpr_{state}": v(f"{m}.fpr"), f"victim_ba_{state}": v(f"{m}.balanced_accuracy"), f"victim_macro_f1_{state}": v(f"{m}.macro_f1"),
            f"victim_fp_{state}": v(f"{m}.fp"), f"victim_fn_{state}": v(f"{m}.fn"), f"nonvictim_mean_tpr_{state}": o(F.avg, f"{m}.tpr"), f"nonvictim_mean_fpr_{state}": o(F.avg, f"{m}.fpr"),
            f"nonvictim_fp_{state}": o(F.sum, f"{m}.fp"), f"nonvictim_fn_{state}": o(F.sum, f"{m}.fn"),
        }
    if labels is not None:
        y = F.col("m_fixed.fpr")
        aggs |= {
            "cluster_delta_tau_agg": v(F.col("tau_fixed") - F.col("tau_clean")), "cluster_delta_tau_churn": v(F.col("tau_poisoned") - F.col("tau_fixed")),
            "cluster_delta_tau_frozen_scaler": v(F.col("tau_frozen") - F.col("tau_clean")), "cluster_delta_tau_normalization_gap": v(F.col("tau_poisoned") - F.col("tau_frozen")),
            "cluster_non_victim_effect": F.avg(F.when(~F.col("is_victim") & F.col("tau_fixed").isNotNull(), F.col("delta"))),
            "fixed_cluster_victim_delta_tau": v(F.col("tau_fixed") - F.col("tau_clean")), "fixed_cluster_victim_delta_tpr": v("d_tpr_fixed"), "fixed_cluster_victim_delta_fpr": v("d_fpr_fixed"),
            "cv_fpr_fixed": cv(y), "mean_fpr_fixed": F.avg(y),
            "fixed_cluster_nonvictim_mean_delta_tpr": o(F.avg, "d_tpr_fixed"), "fixed_cluster_nonvictim_mean_delta_fpr": o(F.avg, "d_fpr_fixed"),
        }
    out = s.store.save(e.groupBy(*CELL, "policy").agg(*(c.alias(k) for k, c in aggs.items())), "totals")
    deltas = {f"delta_{c}": F.col(f"{c}_poisoned") - F.col(f"{c}_clean") for c in ("cv_fpr", "mean_fpr", "iqr_fpr", "max_min_fpr", "worst_client_fpr")}
    deltas |= {f"victim_delta_{c}": F.col(f"victim_{c}_poisoned") - F.col(f"victim_{c}_clean") for c in ("tpr", "fpr", "ba", "macro_f1")}
    out = out.withColumns(deltas).withColumns({f"nonvictim_delta_{c}_total": F.col(f"nonvictim_{c}_poisoned") - F.col(f"nonvictim_{c}_clean") for c in ("fp", "fn")})
    floor = out.groupBy("seed").agg(F.coalesce(F.min(F.when(F.col("mean_fpr_clean") > 0, F.col("mean_fpr_clean"))) / MU_FLAG_DIVISOR, F.lit(0.0)).alias("mu_floor"))
    out = out.join(floor, "seed").join(s.shifts, CELL).join(auroc_invariance(s), "seed", "left")
    reach = F.when(F.col("objective") == RAISE, F.col("cal_max") - F.col("tau_clean")).otherwise(F.col("tau_clean") - F.col("cal_min"))
    moved = F.when(F.col("objective") == RAISE, F.col("delta_tau")).otherwise(-F.col("delta_tau"))
    feature = F.col("source").isin(*TRAIN_FEATURE_SOURCES)
    out = out.withColumns({
        "training_seed": F.col("seed"), "poisoning_seed": F.col("seed") + 100, "victim_id": F.col("victim"), "target_scope": F.lit("single_client"),
        "seed_record": F.struct(F.col("seed").alias("training_seed"), (F.col("seed") + 100).alias("poisoning_seed"), F.col("client_idx").cast("long").alias("client_idx"), F.lit(0).cast("long").alias("scope_idx")),
        "delta_tau_rel": F.col("delta_tau") / F.greatest(F.abs("tau_clean"), F.lit(EPS)), "coverage_ratio": F.col("n_eligible") / F.col("n_total"),
        "mu_flag_triggered": F.coalesce(F.col("mean_fpr_poisoned") < F.col("mu_floor"), F.lit(False)), 
        "blast_fraction": F.when(F.col("n_non_victims") > 0, F.col("n_blast_significant") / F.col("n_non_victims")).otherwise(0.0),
        "delta_tau_bound_utilization": F.when(reach > 0, moved / reach),
        "reservoir_draw": F.when(feature, WITHOUT_REPLACEMENT).otherwise(WITH_REPLACEMENT),
    })
    if labels is not None:
        out = out.withColumns({"fixed_cluster_delta_cv_fpr": F.col("cv_fpr_fixed") - F.col("cv_fpr_clean"), "fixed_cluster_delta_mean_fpr": F.col("mean_fpr_fixed") - F.col("mean_fpr_clean"), "cluster_victim_effect": F.when(F.col("policy") == CLUSTER, F.col("delta_tau"))})
        out = out.join(cluster_shape(labels), CELL, "left")
        only = [c for c in cluster_shape(labels).columns if c not in CELL]
        out = out.withColumns({c: F.when(F.col("policy") == CLUSTER, F.col(c)) for c in only})
    return out


def cluster_shape(labels: DataFrame, keys: list[str] = CELL) -> DataFrame:
    """Sizes (descending), the victim's cluster size, clients whose mates changed, and silhouettes of each cell."""
    out = labels
    for state in ("clean", "poisoned"):
        w = Window.partitionBy(*keys, f"label_{state}")
        out = out.withColumns({f"size_{state}": F.count("*").over(w), f"mates_{state}": F.array_sort(F.collect_set("client_id").over(w))})
    victim = F.col("client_id") == F.col("victim")
    sizes = lambda s: F.sort_array(F.transform(F.array_distinct(F.collect_list(F.struct(f"label_{s}", f"size_{s}"))), lambda x: x[f"size_{s}"]), asc=False)
    return out.groupBy(*keys).agg(
        sizes("clean").alias("cluster_sizes_clean"),
        sizes("poisoned").alias("cluster_sizes_poisoned"),
        F.max(F.when(victim, F.col("size_clean"))).cast("double").alias("cluster_victim_size_clean"),
        F.max(F.when(victim, F.col("size_poisoned"))).cast("double").alias("cluster_victim_size_poisoned"),
        F.count_if(F.col("mates_clean") != F.col("mates_poisoned")).cast("double").alias("cluster_n_reassigned"),
        F.max("silhouette_clean").alias("cluster_silhouette_clean"),
        F.max("silhouette_poisoned").alias("cluster_silhouette_poisoned"),
    )
