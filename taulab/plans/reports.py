"""Decision tables from the fact rows of a sweep; every function takes and returns DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taulab.constants import CLUSTER, CONTROL_OF, GATE_GRID, IQR_FLOOR_FACTOR, LOWER, MATERIALITY_FACTOR, RAISE, RANDOM_CONTROLS, SIGN_CONSISTENCY, VICTIM_MAJORITY
from taulab.functions.columns import defined, iqr
from taulab.functions.inference import binomial_upper_tail, with_resampling
from taulab.operators.evaluate import dispersion
from taulab.operators.sweep import materiality

KEY = ["policy", "objective", "source", "fraction"]
FULL, MECHANISM, NONE, INSTABILITY = "full_vulnerability", "mechanism_only", "null_or_conditional", "calibration_instability"


@dataclass(frozen=True)
class Gate:
    sign: int = SIGN_CONSISTENCY
    majority: int = VICTIM_MAJORITY
    materiality: float = MATERIALITY_FACTOR
    iqr_floor: float = IQR_FLOOR_FACTOR


def sign_of(objective: str = "objective"):
    return F.when(F.col(objective) == RAISE, 1.0).otherwise(-1.0)


def marked(facts: DataFrame, gate: Gate) -> DataFrame:
    """facts plus the signed shift and whether it is material at the gate."""
    scale = materiality("victim_delta_tau_scale_base", "iqr_median_clean", gate.materiality, gate.iqr_floor)
    return facts.withColumn("signed", sign_of() * F.col("delta_tau")).withColumn("material", F.coalesce(F.abs("delta_tau") >= scale, F.lit(False)))


def _by_seed(rows: DataFrame, gate: Gate, keys: list[str] = KEY) -> DataFrame:
    return rows.groupBy(*keys, "seed").agg(
        F.avg("signed").alias("seed_value"), (F.count_if(F.col("material") & (F.col("signed") > 0)) >= gate.majority).alias("majority"), (F.count_if("material") >= gate.majority).alias("majority_absolute")
    )


def threshold_shift(facts: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """Shift of the victim's threshold per group, and how many seeds support its direction."""
    rows = marked(facts, gate)
    shift = rows.groupBy(*KEY).agg(
        F.avg("delta_tau").alias("mean_delta_tau"),
        F.percentile("delta_tau", F.lit(0.5)).alias("median_delta_tau"),
        iqr("delta_tau").alias("iqr_delta_tau"),
        (F.count_if(F.col("material") & (F.col("signed") > 0)) / F.count("*")).alias("material_signed_rate"),
    )
    seeds = _by_seed(rows, gate).groupBy(*KEY).agg(
        F.count_if(F.col("seed_value") > 0).alias("seed_sign_count"), F.count_if("majority").alias("victim_majority_count"), F.count("*").alias("n_seeds")
    )
    out = shift.join(seeds, KEY).withColumn("support_p", binomial_upper_tail("seed_sign_count", "n_seeds"))
    return out.withColumn("claim_bearing", (F.col("fraction") > 0) & ~F.col("source").isin(*RANDOM_CONTROLS))


def excess_by_seed(facts: DataFrame) -> DataFrame:
    """(KEY, control_source, seed, excess): how much more than its random control a source shifts, per seed."""
    controls = facts.sparkSession.createDataFrame(list(CONTROL_OF.items()), "source string, control_source string")
    keys = ["policy", "objective", "fraction", "victim", "seed"]
    treated = facts.where("fraction > 0").join(F.broadcast(controls), "source")
    other = facts.select(*keys, F.col("source").alias("control_source"), F.col("delta_tau").alias("control_delta"))
    both = treated.join(other, [*keys, "control_source"])
    return both.groupBy(*KEY, "control_source", "seed").agg(F.avg(sign_of() * (F.col("delta_tau") - F.col("control_delta"))).alias("excess"))


def directional_excess(facts: DataFrame, gate: Gate = Gate()) -> DataFrame:
    out = excess_by_seed(facts).groupBy(*KEY, "control_source").agg(
        F.count_if(F.col("excess") > 0).alias("seed_support"),
        F.percentile("excess", F.lit(0.5)).alias("median_excess"),
        F.avg(defined("excess")).alias("mean_excess"),
        F.sort_array(F.collect_list(F.struct("seed", "excess")))["excess"].alias("per_seed"),
        F.count("*").alias("n_seeds"),
    )
    return out.withColumns({"gate_pass": (F.col("seed_support") >= gate.sign) & (F.col("median_excess") > 0), "support_p": binomial_upper_tail("seed_support", "n_seeds")})


def random_instability(facts: DataFrame, gate: Gate = Gate()) -> DataFrame:
    rows = marked(facts.where(F.col("source").isin(*RANDOM_CONTROLS)), gate)
    out = _by_seed(rows, gate).groupBy(*KEY).agg(F.count_if("majority_absolute").alias("instability_count"), F.count_if("majority").alias("directional_count"))
    return out.withColumns({"unstable": F.col("instability_count") >= gate.sign, "directional_unstable": F.col("directional_count") >= gate.sign})


def leave_one_out(facts: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """Median seed value with each victim left out: its range and the number of exclusions that keep the sign."""
    rows = marked(facts.where(F.col("source").isin("high_score_benign", "low_score_benign") & (F.abs("fraction") > 1e-12)), gate).select(*KEY, "seed", "victim", "signed")
    # sums per (seed, victim) once; leaving a victim out subtracts it, so victims are not crossed with rows
    own = rows.groupBy(*KEY, "seed", "victim").agg(F.sum("signed").alias("s"), F.count("signed").alias("n"))
    seed = own.groupBy(*KEY, "seed").agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    victims = own.select(*KEY, "victim").distinct()
    left = victims.join(seed, KEY).join(own, [*KEY, "seed", "victim"], "left")
    value = (F.col("all_s") - F.coalesce("s", F.lit(0.0))) / F.nullif(F.col("all_n") - F.coalesce("n", F.lit(0)), F.lit(0))
    med = left.withColumn("value", value).groupBy(*KEY, "victim").agg(F.percentile("value", F.lit(0.5)).alias("median"), F.count_if(F.col("value") > 0).alias("support"))
    return med.groupBy(*KEY).agg(
        F.min("median").alias("lovo_min"),
        F.percentile("median", F.lit(0.5)).alias("lovo_median"),
        F.max("median").alias("lovo_max"),
        F.count_if((F.col("support") >= gate.sign) & (F.col("median") > 0)).alias("sign_stable_exclusions"),
        F.count("*").alias("n_exclusions"),
    )


#: (metric, its name in the report, sign, seed aggregate)
RAISE_METRICS = (
    ("victim_delta_tpr", "victim_delta_tpr", -1.0, "mean"),
    ("victim_delta_ba", "victim_delta_ba", -1.0, "mean"),
    ("victim_delta_macro_f1", "victim_delta_macro_f1", -1.0, "mean"),
    ("victim_delta_tpr", "worst_victim_drop", -1.0, "max"),
)
LOWER_METRICS = tuple((m, m, 1.0, "mean") for m in ("delta_mean_fpr", "delta_cv_fpr", "delta_iqr_fpr", "delta_max_min_fpr", "delta_worst_client_fpr"))
EXTENDED_METRICS = tuple(
    (m, m, 1.0, "mean")
    for m in (
        "victim_delta_tpr", "victim_delta_ba", "victim_delta_macro_f1", "victim_delta_fpr", "nonvictim_mean_delta_tpr", "nonvictim_worst_delta_tpr", "nonvictim_mean_delta_fpr", "nonvictim_worst_delta_fpr",
        "nonvictim_mean_delta_ba", "nonvictim_mean_delta_macro_f1", "delta_mean_fpr", "delta_cv_fpr", "delta_iqr_fpr", "delta_max_min_fpr", "delta_worst_client_fpr", "delta_tau_bound_utilization",
    )
)


def metric_records(facts: DataFrame, metrics, gate: Gate = Gate()) -> DataFrame:
    """One row per group and metric: the metrics become rows in one pass, then seeds, then groups are aggregated."""
    long = facts.select(*KEY, "seed", F.explode(F.array(*(F.struct(F.lit(name).alias("metric"), defined(F.lit(s) * F.col(m)).alias("value"), F.lit(how == "max").alias("largest")) for m, name, s, how in metrics))).alias("x"))
    seeds = long.select(*KEY, "seed", "x.*").where("value IS NOT NULL").groupBy(*KEY, "metric", "seed").agg(F.when(F.first("largest"), F.max("value")).otherwise(F.avg("value")).alias("v"))
    out = seeds.groupBy(*KEY, "metric").agg(
        F.count_if(F.col("v") > 0).alias("seed_support"), F.count_if(F.col("v") < 0).alias("negative_seed_count"), F.percentile("v", F.lit(0.5)).alias("median_harm"), F.avg("v").alias("mean_effect"),
        F.sort_array(F.collect_list(F.struct("seed", "v")))["v"].alias("per_seed"), F.count("*").alias("n_seeds"),
    )
    return out.withColumns({"gate_pass": (F.col("seed_support") >= gate.sign) & (F.col("median_harm") > 0), "support_p": binomial_upper_tail("seed_support", "n_seeds")})


def _bearing(facts: DataFrame, objective: str) -> DataFrame:
    return facts.where((F.col("objective") == objective) & ~F.col("source").isin(*RANDOM_CONTROLS) & (F.col("fraction") > 0))


def downstream_raise(facts: DataFrame, gate: Gate = Gate()) -> DataFrame:
    return metric_records(_bearing(facts, RAISE), RAISE_METRICS, gate)


def downstream_lower(facts: DataFrame, gate: Gate = Gate()) -> DataFrame:
    return metric_records(_bearing(facts, LOWER), LOWER_METRICS, gate)


def downstream_extended(facts: DataFrame, gate: Gate = Gate()) -> DataFrame:
    return metric_records(facts.where("fraction > 0"), EXTENDED_METRICS, gate)


def classify(unstable, g1, g2, g3):
    return F.when(unstable | ~g2, INSTABILITY).when(g1 & g3, FULL).when(g1, MECHANISM).otherwise(NONE)


def gate_counts(facts: DataFrame, grid: list[tuple[float, float]]) -> DataFrame:
    """(KEY, materiality, iqr_floor, seed, material victims, of them in the right direction, seed value) for each grid point.

    Per seed only counts are kept, so thresholds on seeds and victims need no further pass over the facts.
    """
    points = facts.sparkSession.createDataFrame(grid, "materiality double, iqr_floor double")
    rows = facts.crossJoin(F.broadcast(points)).withColumn("signed", sign_of() * F.col("delta_tau"))
    scale = F.greatest(F.col("materiality") * F.col("victim_delta_tau_scale_base"), F.col("iqr_floor") * F.col("iqr_median_clean"))
    rows = rows.withColumn("material", F.coalesce(F.when(F.col("victim_delta_tau_scale_base").isNotNull(), F.abs("delta_tau") >= scale), F.lit(False)))
    return rows.groupBy(*KEY, "materiality", "iqr_floor", "seed").agg(F.count_if("material").alias("n_material"), F.count_if(F.col("material") & (F.col("signed") > 0)).alias("n_signed"), F.avg("signed").alias("seed_value"))


def decisions(facts: DataFrame, gates: list[Gate]) -> DataFrame:
    """The claim of every claim-bearing group at every gate: three gates, the random control's stability and the class."""
    spark = facts.sparkSession
    g = spark.createDataFrame([(x.sign, x.majority, x.materiality, x.iqr_floor) for x in gates], "sign int, majority int, materiality double, iqr_floor double")
    points = sorted({(x.materiality, x.iqr_floor) for x in gates})
    gk = ["sign", "majority", "materiality", "iqr_floor"]
    seeds = gate_counts(facts, points).join(F.broadcast(g), ["materiality", "iqr_floor"])
    per = seeds.groupBy(*KEY, *gk).agg(
        F.count_if(F.col("seed_value") > 0).alias("sign_count"), F.count_if(F.col("n_signed") >= F.col("majority")).alias("majority_count"), F.count_if(F.col("n_material") >= F.col("majority")).alias("absolute_count")
    )
    claims = per.where((F.col("fraction") > 0) & ~F.col("source").isin(*RANDOM_CONTROLS)).withColumn("gate1_pass", (F.col("sign_count") >= F.col("sign")) & (F.col("majority_count") >= F.col("sign")))
    excess = directional_excess(facts).select(*KEY, "seed_support", "median_excess")
    harm = downstream_raise(facts).unionByName(downstream_lower(facts)).select(*KEY, F.col("seed_support").alias("harm_support"), "median_harm")
    harm = harm.where("median_harm > 0").groupBy(*KEY).agg(F.max("harm_support").alias("harm_support"))
    control = per.where(F.col("source").isin(*RANDOM_CONTROLS)).select("policy", "objective", "fraction", F.col("source").alias("control_source"), *gk, F.col("absolute_count").alias("control_absolute"), F.col("majority_count").alias("control_directional"))
    names = spark.createDataFrame(list(CONTROL_OF.items()), "source string, control_source string")
    out = claims.join(excess, KEY, "left").join(harm, KEY, "left").join(F.broadcast(names), "source", "left").join(control, ["policy", "objective", "fraction", "control_source", *gk], "left")
    no = lambda c: F.coalesce(c, F.lit(False))
    out = out.withColumns({
        "gate2_pass": no((F.col("seed_support") >= F.col("sign")) & (F.col("median_excess") > 0)), "gate3_pass": no(F.col("harm_support") >= F.col("sign")),
        "random_control_unstable": no(F.col("control_absolute") >= F.col("sign")), "random_control_unstable_directional": no(F.col("control_directional") >= F.col("sign")),
    })
    gates_ = [F.col(f"gate{k}_pass") for k in (1, 2, 3)]
    out = out.withColumns({"claim_class": classify(F.col("random_control_unstable_directional"), *gates_), "claim_class_absolute": classify(F.col("random_control_unstable"), *gates_)})
    return out.select(*KEY, *gk, "gate1_pass", "gate2_pass", "gate3_pass", "random_control_unstable", "random_control_unstable_directional", "claim_class", "claim_class_absolute")


def claim_gates(facts: DataFrame, gate: Gate = Gate()) -> DataFrame:
    return decisions(facts, [gate]).drop("sign", "majority", "materiality", "iqr_floor")


def fixed_assignment_gate(facts: DataFrame, gate: Gate = Gate()) -> DataFrame:
    """(KEY, cluster_fixed_gate1_pass): gate 1 with clusters held at their clean assignment."""
    scale = materiality("victim_delta_tau_scale_base", "iqr_median_clean", gate.materiality, gate.iqr_floor)
    rows = facts.where(F.col("policy") == CLUSTER).withColumn("shift", defined(sign_of() * F.col("fixed_cluster_victim_delta_tau")))
    seeds = rows.groupBy(*KEY, "seed").agg((F.count_if(F.col("shift") >= scale) >= gate.majority).alias("many"), F.avg("shift").alias("mean"))
    return seeds.groupBy(*KEY).agg((F.count_if(F.col("many") & (F.col("mean") > 0)) >= gate.sign).alias("cluster_fixed_gate1_pass"))


def gate_grid(sign=GATE_GRID["sign"], majority=GATE_GRID["majority"], materiality=GATE_GRID["materiality"], iqr_floor=GATE_GRID["iqr_floor"]) -> list[Gate]:
    return [Gate(a, b, c, d) for a in sign for b in majority for c in materiality for d in iqr_floor]


def gate_sensitivity(facts: DataFrame, gates: list[Gate], default: Gate = Gate()) -> DataFrame:
    """Classes per grid point and how many claims differ from the default gate's."""
    every = decisions(facts, sorted({*gates, default}, key=lambda g: (g.sign, g.majority, g.materiality, g.iqr_floor)))
    at = (F.col("sign") == default.sign) & (F.col("majority") == default.majority) & (F.col("materiality") == default.materiality) & (F.col("iqr_floor") == default.iqr_floor)
    base = every.where(at).select(*KEY, F.col("claim_class").alias("default_class"))
    n = lambda c: F.count_if(F.col("claim_class") == c)
    wanted = facts.sparkSession.createDataFrame([(x.sign, x.majority, x.materiality, x.iqr_floor) for x in gates], "sign int, majority int, materiality double, iqr_floor double")
    return (
        every.join(F.broadcast(wanted), ["sign", "majority", "materiality", "iqr_floor"], "left_semi")
        .join(base, KEY)
        .groupBy("sign", "majority", "materiality", "iqr_floor")
        .agg(n(FULL).alias("n_full"), n(MECHANISM).alias("n_mechanism"), n(NONE).alias("n_null"), n(INSTABILITY).alias("n_instability"), F.count_if(F.col("claim_class") != F.col("default_class")).alias("n_changed"))
    )


def claim_robustness(facts: DataFrame, gates: list[Gate]) -> DataFrame:
    every = decisions(facts, gates)
    share = lambda c: F.avg(F.when(F.col(c) == FULL, 1.0).otherwise(0.0))
    return every.groupBy(*KEY).agg(share("claim_class").alias("robust_share"), share("claim_class_absolute").alias("robust_share_absolute"), F.count("*").alias("n_points"))


CLIENT_METRICS = ("delta_tau", "victim_delta_tpr", "victim_delta_fpr", "victim_delta_ba", "victim_delta_macro_f1", "delta_tau_bound_utilization")


def client_level_effects(facts: DataFrame) -> DataFrame:
    aggs = [F.count_distinct("seed").alias("n_seeds")]
    for m in CLIENT_METRICS:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.when(F.count(m) >= 2, F.stddev_samp(m)).alias(f"{m}_std"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max")]
    return facts.where("fraction > 0").groupBy(*KEY, "victim").agg(*aggs)


def duplicates_and_bounds(facts: DataFrame) -> DataFrame:
    return facts.where("fraction > 0").groupBy(*KEY).agg(
        F.avg("cal_duplicate_rate_clean").alias("duplicate_rate_clean"), F.avg("cal_duplicate_rate_poisoned").alias("duplicate_rate_poisoned"), F.avg("delta_tau_bound_utilization").alias("bound_utilization"), F.max("delta_tau_bound_utilization").alias("max_bound_utilization")
    )


def cluster_diagnostics(facts: DataFrame) -> DataFrame:
    """Means over the cluster policy's rows, the most frequent size vectors (ties: the larger vector) and reassignment rates."""
    rows = facts.where(F.col("policy") == CLUSTER)
    means = ("cluster_delta_tau_agg", "cluster_delta_tau_churn", "cluster_delta_tau_frozen_scaler", "cluster_delta_tau_normalization_gap", "cluster_victim_effect", "cluster_non_victim_effect", "cluster_silhouette_clean", "cluster_silhouette_poisoned", "fixed_cluster_victim_delta_tau")
    flat = rows.groupBy(*KEY).agg(*(F.avg(defined(c)).alias(c) for c in means), F.avg((F.col("cluster_n_reassigned") > 0).cast("double")).alias("reassigned_rate"), F.max("cluster_n_reassigned").alias("max_reassigned"))
    for s in ("clean", "poisoned"):
        c = f"cluster_sizes_{s}"
        modal = rows.groupBy(*KEY, c).count().groupBy(*KEY).agg(F.max(F.struct("count", c))[c].alias(f"modal_sizes_{s}"))
        flat = flat.join(modal, KEY)
    return flat


def paired_deltas(fleet: DataFrame, left: str, right: str) -> DataFrame:
    """(seed, delta): CV of the false-positive rate under one policy minus under another."""
    wide = fleet.groupBy("seed").pivot("policy", [left, right]).agg(F.first("cv_fpr"))
    return wide.select("seed", (F.col(left) - F.col(right)).alias("delta"))


def results_table(fleet: DataFrame) -> DataFrame:
    """One row per policy: mean and deviation over seeds (0 for one seed)."""
    aggs = []
    for c in ("cv_fpr", "cv_tpr", "min_balanced_accuracy", "p10_macro_f1"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std")]
    return fleet.groupBy("policy").agg(*aggs, F.count("*").alias("n_seeds"), F.max("n_eligible").alias("n_eligible"), F.max("n_clients").alias("n_clients"))


def representative_picks(evals: DataFrame, policy: str) -> DataFrame:
    """(seed, pick, client_id, fpr, cv_fpr): the seed whose dispersion is the lower median, and three of its eligible clients by false-positive rate.

    Rates that agree to nine digits are ties; the smaller seed or id is first.
    """
    rows = evals.where(F.col("policy") == policy)
    # one row for each seed
    w = Window.orderBy(F.round("cv_fpr", 9), "seed")
    fleet = dispersion(rows).select("seed", "cv_fpr", F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy(F.lit(0))).alias("n"))
    seed = fleet.where(F.col("k") == F.floor((F.col("n") + 1) / 2)).select("seed", "cv_fpr")
    own = Window.partitionBy("seed")
    ranked = rows.where("status = 'eligible'").join(F.broadcast(seed), "seed").withColumns({"k": F.row_number().over(own.orderBy(F.round("fpr", 9), "client_id")), "n": F.count("*").over(own)})
    picks = F.array(*(F.struct(F.lit(name).alias("pick"), at.cast("long").alias("at")) for name, at in (("lowest", F.lit(1)), ("median", F.floor(F.col("n") / 2) + 1), ("highest", F.col("n")))))
    return ranked.withColumn("p", F.explode(picks)).where("k = p.at").select("seed", "p.pick", "client_id", "fpr", "cv_fpr")


def paired_bootstrap(fleet: DataFrame, policies: tuple[str, ...], resamples: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """(left, right, n_seeds, mean, ci_low, ci_high, permutation_p, excludes_zero) of the dispersion differences of each two policies."""
    pairs = reduce(DataFrame.unionByName, [paired_deltas(fleet, a, b).select(F.lit(a).alias("left"), F.lit(b).alias("right"), "seed", "delta") for k, a in enumerate(policies) for b in policies[k + 1 :]])
    packed = pairs.where("delta IS NOT NULL").groupBy("left", "right").agg(F.sort_array(F.collect_list(F.struct("seed", "delta")))["delta"].alias("deltas"))
    out = with_resampling(packed, ["left", "right"], "deltas", resamples, level, seed)
    return out.withColumns({"n_seeds": F.size("deltas").cast("long"), "excludes_zero": F.coalesce((F.col("ci_low") > 0) | (F.col("ci_high") < 0), F.lit(False))}).drop("deltas")


def shared_resamples(deltas: DataFrame, resamples: int = 10_000, level: float = 0.95, seed: int = 42) -> DataFrame:
    """deltas (left, right, seed, delta) -> (left, right, n_seeds, mean, ci_low, ci_high, excludes_zero): percentile intervals of resampled means.

    The places drawn in a resample depend on how many seeds a pair has and on nothing else, so pairs with as many seeds share their resamples
    and their intervals can be compared; each draw is a row that is joined to the seeds, not an array in a task.
    """
    pair = ["left", "right"]
    own = Window.partitionBy(*pair)
    placed = deltas.where("delta IS NOT NULL").withColumns({"n": F.count("*").over(own), "place": (F.row_number().over(own.orderBy("seed")) - 1).cast("long")})
    slots = placed.select("n").distinct().withColumn("resample", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(resamples - 1).cast("long")))).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    mixed = slots.withColumn("h", (F.col("resample") * 1000003 + F.col("slot") * 7919 + seed * 104729) % (1 << 31))
    for _ in range(3):
        mixed = mixed.withColumn("h", F.col("h").bitwiseXOR(F.shiftright("h", 15)) * 73244475 % (1 << 31))
    drawn = mixed.select("n", "resample", (F.shiftright("h", 8) % F.col("n")).alias("place"))
    means = drawn.join(placed, ["n", "place"]).groupBy(*pair, "resample").agg(F.avg("delta").alias("m"))
    tail = (1 - level) / 2
    bounds = means.groupBy(*pair).agg(F.percentile("m", F.lit(tail)).alias("ci_low"), F.percentile("m", F.lit(1 - tail)).alias("ci_high"))
    out = placed.groupBy(*pair).agg(F.count("*").alias("n_seeds"), F.avg("delta").alias("mean")).join(bounds, pair)
    enough = F.col("n_seeds") >= 2  # no interval from one seed
    out = out.withColumns({c: F.when(enough, F.col(c)) for c in ("ci_low", "ci_high")})
    return out.withColumn("excludes_zero", F.coalesce((F.col("ci_low") > 0) | (F.col("ci_high") < 0), F.lit(False)))


def pair_deltas(fleet: DataFrame, pairs: tuple[tuple[str, str], ...]) -> DataFrame:
    """(left, right, seed, delta): CV of the false-positive rate under one policy minus under the other, for each pair."""
    each = fleet.sparkSession.createDataFrame(list(pairs), "left string, right string")
    side = lambda name: fleet.select("seed", F.col("policy").alias(name), F.col("cv_fpr").alias(f"cv_{name}"))
    return side("left").join(F.broadcast(each), "left").join(side("right"), ["seed", "right"]).select("left", "right", "seed", (F.col("cv_left") - F.col("cv_right")).alias("delta"))


def cluster_stability_summary(facts: DataFrame) -> DataFrame:
    """Per KEY with fraction > 0, over victims and seeds: how often clients change clusters, sizes (the most frequent vectors) and the effects
    with clusters recomputed beside those with clusters fixed."""
    rows = facts.where((F.col("policy") == CLUSTER) & (F.col("fraction") > 0))
    mean = lambda c: F.avg(defined(c))
    rate = lambda c: F.avg(c.cast("double"))
    both = {"victim_delta_tau": ("cluster_victim_effect", "fixed_cluster_victim_delta_tau"), "victim_delta_tpr": ("victim_delta_tpr", "fixed_cluster_victim_delta_tpr"), "victim_delta_fpr": ("victim_delta_fpr", "fixed_cluster_victim_delta_fpr"), "delta_cv_fpr": ("delta_cv_fpr", "fixed_cluster_delta_cv_fpr"), "nonvictim_delta_tpr": ("nonvictim_mean_delta_tpr", "fixed_cluster_nonvictim_mean_delta_tpr"), "nonvictim_delta_fpr": ("nonvictim_mean_delta_fpr", "fixed_cluster_nonvictim_mean_delta_fpr")}
    out = rows.groupBy(*KEY).agg(
        F.count("*").alias("n_rows"), mean("cluster_n_reassigned").alias("mean_n_reassigned"), F.max("cluster_n_reassigned").alias("max_n_reassigned"), rate(F.col("cluster_n_reassigned") > 0).alias("reassignment_rate"),
        *(rate(F.col(f"cluster_victim_size_{s}") == 1).alias(f"victim_singleton_{s}_rate") for s in ("clean", "poisoned")), *(mean(f"cluster_victim_size_{s}").alias(f"mean_victim_size_{s}") for s in ("clean", "poisoned")),
        *(mean(f"cluster_silhouette_{s}").alias(f"mean_silhouette_{s}") for s in ("clean", "poisoned")), *(mean(c).alias(f"{kind}_{name}") for name, pair in both.items() for kind, c in zip(("recomputed", "fixed"), pair, strict=True)),
    )
    for s in ("clean", "poisoned"):
        sizes = rows.groupBy(*KEY, F.col(f"cluster_sizes_{s}").alias("sizes")).count()
        out = out.join(sizes.groupBy(*KEY).agg(F.max(F.struct("count", "sizes"))["sizes"].alias(f"modal_sizes_{s}")), KEY)
    return out
