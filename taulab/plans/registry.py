"""Queries over the driver's tables and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from taulab.constants import CLUSTER, DISJOINT, INTERPOLATED, LOWER, PAIRS, RAISE, WITH_REPLACEMENT, WITHOUT_REPLACEMENT
from taulab.functions.inference import binomial_upper_tail, holm, sign_flip_column, with_resampling
from taulab.operators import evaluate, inject, sensitivity, sweep
from taulab.operators.positions import dense_ids
from taulab.operators.prepare import balanced
from taulab.operators.scaling import row_errors, scale_splits
from taulab.operators.quantiles import percentiles
from taulab.operators.thresholds import eligibility, global_taus, local_taus, thresholds, trimmed
from taulab.sources import events
from taulab.sources.events import labelled, table
from taulab.sources.store import Store
from taulab.streaming.alerts import alert_counts

from . import reports, sql
from .sql import CONTROLS, RANDOM, K

Query = Callable[[SparkSession, str], DataFrame]
GATE = reports.Gate(sign=4, majority=3)
#: All 225 points; sign and majority gates in steps of one seed and one victim, for the five of either here.
GRID = reports.gate_grid(sign=(1, 2, 3, 4, 5), majority=(1, 2, 3, 4, 5))

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(text: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if text:
            _SQL[f.__name__] = text
        return f

    return add


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to so many digits: engines add in different orders."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r(*names: str) -> str:
    """The same in SQL; ``a=b`` renames a to b.  Adding 0 makes a negative zero positive."""
    return ", ".join(f"round({a}, 9) + 0 AS {b or a}" for a, _, b in (n.partition("=") for n in names))


_LARGEST: dict[tuple, int] = {}
_SWEEPS: dict[tuple, sweep.Sweep] = {}
_FACTS: dict[tuple, DataFrame] = {}


def forget() -> None:
    """The next query makes the sweep's stages anew."""
    _LARGEST.clear()
    _SWEEPS.clear()
    _FACTS.clear()


def _state(spark: SparkSession, sf_dir: str) -> tuple[str, str, int, int]:
    """The application and the event table as it is now: a rewritten table has other stages."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.sparkContext.applicationId, sf_dir, fs.getFileStatus(path).getModificationTime(), fs.getContentSummary(path).getLength()


def largest(spark: SparkSession, sf_dir: str) -> int:
    """Rows of the largest client, counted once per application and directory."""
    key = _state(spark, sf_dir)
    if key not in _LARGEST:
        _LARGEST[key] = events.largest_client(labelled(spark, sf_dir))
    return _LARGEST[key]


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.staged(labelled(spark, sf_dir), largest(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.scored(staged(spark, sf_dir))


def the_sweep(spark: SparkSession, sf_dir: str, n_min: int = sql.N_MIN) -> sweep.Sweep:
    """The stages of the sweep, stored once per application and directory."""
    key = (*_state(spark, sf_dir), n_min)
    if key not in _SWEEPS:
        _SWEEPS[key] = sweep.prepare(scores(spark, sf_dir), n_min)
    return _SWEEPS[key]


def the_facts(spark: SparkSession, sf_dir: str, clusters: bool = False) -> DataFrame:
    key = (*_state(spark, sf_dir), clusters)
    if key not in _FACTS:
        s = the_sweep(spark, sf_dir)
        _FACTS[key] = s.store.save(sweep.facts(s, sweep.cluster_labels(s) if clusters else None), "facts")
    return _FACTS[key]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fleet dispersion of the false-positive rate under local and global thresholds."""
    s = scores(spark, sf_dir)
    return rounded(evaluate.dispersion(evaluate.client_eval(s, thresholds(s, n_min=10, largest=largest(spark, sf_dir)))))


# ---- scans, splits, scaling


@query(sql.base("SELECT DISTINCT client_id, CAST(n AS BIGINT) AS n, CAST(b1 AS BIGINT) AS train_end, CAST(b1 + g AS BIGINT) AS gap1_end, CAST(b1 + g + c AS BIGINT) AS cal_end, CAST(b1 + 2 * g + c AS BIGINT) AS gap2_end FROM cuts"))
def split_bounds(spark, sf_dir):
    n = labelled(spark, sf_dir).where("NOT attack").groupBy("client_id").agg(F.count("*").alias("n"))
    return n.select("client_id", "n", *(end.cast("long").alias(f"{stage}_end") for stage, end in events.split_bounds("n")))


@query(sql.base(f"SELECT client_id, stage, pos, event_id, {r('raw')} FROM staged"))
def split_rows(spark, sf_dir):
    return rounded(staged(spark, sf_dir))


@query(sql.base("SELECT client_id, count(*) FILTER (stage = 'train') AS n_train, count(*) FILTER (stage = 'cal') AS n_cal, count(*) FILTER (stage = 'test_benign') AS n_benign, count(*) FILTER (stage = 'test_attack') AS n_attack, count(*) FILTER (stage = 'cal') >= 175 AS eligible FROM staged GROUP BY client_id"))
def split_counts_audit(spark, sf_dir):
    n = lambda s: F.count_if(F.col("stage") == s)
    return staged(spark, sf_dir).groupBy("client_id").agg(n("train").alias("n_train"), n("cal").alias("n_cal"), n("test_benign").alias("n_benign"), n("test_attack").alias("n_attack"), (n("cal") >= 175).alias("eligible"))


@query("""WITH e AS (SELECT vec_id, label, embedding, vec_id % 5 < 3 AS train FROM embeddings), x AS (SELECT vec_id, label, train, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS v FROM e),
s AS (SELECT label, i, avg(v) AS m, stddev_pop(v) AS sd FROM x WHERE train GROUP BY label, i)
SELECT vec_id, label, round(avg(abs((v - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END)), 9) AS mean_abs_z, round(sum((v - m) / CASE WHEN sd = 0 THEN 1 ELSE sd END), 5) AS sum_z FROM x JOIN s USING (label, i) GROUP BY vec_id, label""")
def scale_features(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("train", F.col("vec_id") % 5 < 3)
    z = scale_splits(e, "label", "embedding", F.col("train"))
    total = F.aggregate("scaled", F.lit(0.0), lambda a, x: a + x)
    size = F.aggregate("scaled", F.lit(0.0), lambda a, x: a + F.abs(x)) / F.size("scaled")
    return z.select("vec_id", "label", F.round(size, 9).alias("mean_abs_z"), F.round(total, 5).alias("sum_z"))


@query("""WITH x AS (SELECT vec_id, label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT label, i, avg(v) AS m FROM x GROUP BY label, i)
SELECT vec_id, label, round(avg((v - m) * (v - m)), 9) AS error FROM x JOIN m USING (label, i) GROUP BY vec_id, label""")
def reconstruction_error(spark, sf_dir):
    return row_errors(table(spark, sf_dir, "embeddings"), "label", "embedding").select("vec_id", "label", F.round("error", 9).alias("error"))


@query(sql.base("""SELECT client_id, event_id FROM (SELECT client_id, event_id, row_number() OVER (PARTITION BY client_id ORDER BY (event_id * 48271 + 7) % 1000003, event_id) AS k, n_attack FROM staged JOIN (SELECT client_id, count(*) FILTER (stage = 'test_attack') AS n_attack, count(*) FILTER (stage = 'test_benign') AS n_benign FROM staged GROUP BY client_id) USING (client_id) WHERE stage = 'test_benign')
WHERE n_attack = 0 OR k <= n_attack"""))
def balance_test(spark, sf_dir):
    rows = balanced(staged(spark, sf_dir), Store(spark, "balance"), largest(spark, sf_dir))
    return rows.where("stage = 'test_benign'").select("client_id", "event_id")


@query("SELECT vec_id, dense_rank() OVER (ORDER BY embedding) AS row_id FROM embeddings")
def global_row_ids(spark, sf_dir):
    """Equal feature rows share an id."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    ids = dense_ids(rows, "embedding", "row_id", int(spark.conf.get("spark.sql.shuffle.partitions")), Store(spark, "ids"))
    return ids.select("vec_id", (F.col("row_id") + 1).alias("row_id"))


# ---- thresholds and evaluation


@query(sql.base("SELECT seed, client_id, n_cal, status FROM elig"))
def client_eligibility(spark, sf_dir):
    return eligibility(scores(spark, sf_dir), sql.N_MIN)


@query(sql.base(f"SELECT seed, client_id, {r('tau')} FROM taus"))
def tau_local(spark, sf_dir):
    return rounded(local_taus(scores(spark, sf_dir), sql.N_MIN, largest=largest(spark, sf_dir)))


@query(sql.base(f"SELECT seed, {r('tau_global')}, n_eligible FROM tau_global"))
def tau_global(spark, sf_dir):
    return rounded(global_taus(local_taus(scores(spark, sf_dir), sql.N_MIN, largest=largest(spark, sf_dir))))


@query(sql.base(f"SELECT seed, policy, client_id, status, {r('tau')} FROM thr"))
def thresholds_all_policies(spark, sf_dir):
    return rounded(thresholds(scores(spark, sf_dir), sql.N_MIN, largest=largest(spark, sf_dir)))


def _evals(spark, sf_dir):
    s = scores(spark, sf_dir)
    return evaluate.client_eval(s, thresholds(s, sql.N_MIN, largest=largest(spark, sf_dir)))


@query(sql.base("SELECT seed, policy, client_id, tp, fp, tn, fn FROM rates"))
def confusion_counts(spark, sf_dir):
    return _evals(spark, sf_dir).select("seed", "policy", "client_id", "tp", "fp", "tn", "fn")


RATES = ("fpr", "tpr", "tnr", "fnr", "balanced_accuracy", "precision", "macro_f1")


@query(sql.base(f"SELECT seed, policy, client_id, status, {r(*RATES)}, na = 0 AS evaluation_incomplete FROM rates"))
def client_rates(spark, sf_dir):
    return rounded(_evals(spark, sf_dir).select("seed", "policy", "client_id", "status", *RATES, "evaluation_incomplete"))


FLEET = ("cv_fpr", "mean_fpr", "std_fpr", "iqr_fpr", "max_min_fpr", "worst_client_fpr", "cv_tpr", "iqr_tpr", "min_balanced_accuracy", "p10_macro_f1", "coverage_ratio")


@query(sql.base(f"SELECT seed, policy, {r(*FLEET)}, n_eligible, n_clients FROM fleet"))
def fleet_dispersion(spark, sf_dir):
    return rounded(evaluate.dispersion(_evals(spark, sf_dir)).drop("worst_client_id"))


@query(sql.base("SELECT seed, policy, client_id AS worst_client_id, round(fpr, 9) AS fpr FROM (SELECT *, row_number() OVER (PARTITION BY seed, policy ORDER BY fpr DESC, client_id) AS k FROM rates WHERE status = 'eligible') WHERE k = 1"))
def worst_client(spark, sf_dir):
    return rounded(evaluate.dispersion(_evals(spark, sf_dir)).select("seed", "policy", "worst_client_id", F.col("worst_client_fpr").alias("fpr")))


@query(sql.base("SELECT seed, round(coalesce(min(CASE WHEN mean_fpr > 0 THEN mean_fpr END) / 8, 0), 9) AS mu_floor FROM fleet GROUP BY seed"))
def fleet_fpr_floor(spark, sf_dir):
    d = evaluate.dispersion(_evals(spark, sf_dir))
    return rounded(d.groupBy("seed").agg(F.coalesce(F.min(F.when(F.col("mean_fpr") > 0, F.col("mean_fpr"))) / 8, F.lit(0.0)).alias("mu_floor")))


@query(sql.base("""SELECT a.seed, a.client_id, round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 9)::DOUBLE AS auroc
FROM scores a JOIN scores b ON a.seed = b.seed AND a.client_id = b.client_id AND a.stage = 'test_attack' AND b.stage = 'test_benign' GROUP BY a.seed, a.client_id"""))
def auroc(spark, sf_dir):
    return rounded(evaluate.auroc(scores(spark, sf_dir), ["seed", "client_id"]))


@query(sql.base("""SELECT seed, client_id, round(sum(p * tp / seen) / sum(p), 9) AS average_precision FROM (
  SELECT seed, client_id, p, sum(p) OVER w AS tp, sum(c) OVER w AS seen FROM (SELECT seed, client_id, score, count(*) FILTER (stage = 'test_attack') AS p, count(*) AS c FROM scores WHERE stage IN ('test_benign', 'test_attack') GROUP BY ALL) WINDOW w AS (PARTITION BY seed, client_id ORDER BY score DESC)) GROUP BY seed, client_id"""))
def average_precision(spark, sf_dir):
    return rounded(evaluate.average_precision(scores(spark, sf_dir), ["seed", "client_id"]))


@query(sql.base("""SELECT seed, client_id, stage, count(*) AS n, round(min(score), 9) + 0 AS min_score, round(max(score), 9) + 0 AS max_score, round(avg(score), 8) + 0 AS mean_score, round(median(score), 9) + 0 AS median_score,
  round(stddev_samp(score), 5) AS std_score, round((avg(score ** 3) - 3 * avg(score) * avg(score ** 2) + 2 * avg(score) ** 3) / stddev_pop(score) ** 3, 4) + 0 AS skew FROM scores GROUP BY ALL"""))
def score_stats(spark, sf_dir):
    x = "score"
    return scores(spark, sf_dir).groupBy("seed", "client_id", "stage").agg(
        F.count("*").alias("n"), F.round(F.min(x), 9).alias("min_score"), F.round(F.max(x), 9).alias("max_score"), F.round(F.avg(x), 8).alias("mean_score"), F.round(F.percentile(x, F.lit(0.5)), 9).alias("median_score"), F.round(F.stddev_samp(x), 5).alias("std_score"), F.round(F.skewness(x), 4).alias("skew")
    )


@query(sql.base("SELECT seed, client_id, round(stddev_pop(score) / avg(score), 9) AS cv, round(quantile_cont(score, 0.75) - quantile_cont(score, 0.25), 9) AS iqr, round(1 - count(DISTINCT score) / count(*), 9) AS duplicate_rate FROM cal GROUP BY seed, client_id"))
def cv_iqr(spark, sf_dir):
    s = the_sweep(spark, sf_dir)
    spread = F.when((F.col("n_cal") >= 2) & (F.col("mean") != 0), F.col("spread") / F.col("mean"))
    return rounded(s.clients.select("seed", "client_id", spread.alias("cv"), "iqr", "duplicate_rate"))


@query(sql.base("""SELECT c.seed, c.client_id, round(any_value(iqr), 9) AS iqr, round(median(abs(score - med)), 9) AS mad, round(any_value(gap), 9) AS gap, round(CASE WHEN any_value(iqr) > 0 THEN any_value(iqr) WHEN median(abs(score - med)) > 0 THEN median(abs(score - med)) ELSE any_value(gap) END, 9) AS scale_base
FROM cal c JOIN (SELECT seed, client_id, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS iqr, median(score) AS med FROM cal GROUP BY ALL) USING (seed, client_id)
JOIN (SELECT seed, client_id, min(d) AS gap FROM (SELECT seed, client_id, score - lag(score) OVER (PARTITION BY seed, client_id ORDER BY score) AS d FROM (SELECT DISTINCT seed, client_id, score FROM cal)) WHERE d > 0 GROUP BY ALL) USING (seed, client_id) GROUP BY c.seed, c.client_id"""))
def scale_base(spark, sf_dir):
    s = the_sweep(spark, sf_dir)
    b = evaluate.scale_bases(s.cal, ["seed", "client_id"], s.largest)
    return b.select("seed", "client_id", *(F.round(c, 9).alias(c) for c in ("iqr", "mad", "gap", "scale_base")))


# ---- reservoirs and injection


def _reservoir(source: str):
    def f(spark, sf_dir):
        s = the_sweep(spark, sf_dir)
        return rounded(inject.reservoirs(s.ladder).where(F.col("source") == source).select("seed", "client_id", "pos", "score", F.col("pool_index").cast("long").alias("pool_index")))

    f.__name__ = "reservoir_" + source.split("_")[0]
    return query(sql.cells(f"SELECT seed, client_id, pos, {r('score')}, CAST(pool_index AS BIGINT) AS pool_index FROM pools WHERE source = '{source}'"))(f)


for _source in ("high_score_benign", "low_score_benign", "random_benign"):
    _reservoir(_source)


@query(sql.cells("SELECT seed, victim, source, objective, fraction, CAST(child AS BIGINT) AS child FROM cells"))
def sweep_grid(spark, sf_dir):
    return the_sweep(spark, sf_dir).cells.select(*inject.CELL, "child")


@query(sql.cells(f"SELECT seed, victim, source, objective, fraction, pos, {r('score', 'clean_score')}, replaced FROM poisoned"))
def inject_rows(spark, sf_dir):
    """All rows of all cells, replaced or not."""
    s = the_sweep(spark, sf_dir)
    return rounded(inject.injected(s.cells, s.cal, s.replaced).drop("donor_id"))


@query(sql.cells(f"SELECT seed, victim, source, objective, fraction, {r('tau_c=tau_clean', 'tau_p=tau_poisoned', 'dup_c=duplicate_rate_clean', 'dup_p=duplicate_rate_poisoned')}, CAST(n_replaced AS BIGINT) AS n_replaced FROM shifts"))
def delta_tau(spark, sf_dir):
    s = the_sweep(spark, sf_dir).shifts
    return rounded(s.select(*inject.CELL, F.col("victim_tau_clean").alias("tau_clean"), F.col("victim_tau_poisoned").alias("tau_poisoned"), F.col("cal_duplicate_rate_clean").alias("duplicate_rate_clean"), F.col("cal_duplicate_rate_poisoned").alias("duplicate_rate_poisoned"), F.col("n_replaced").cast("long").alias("n_replaced")))


def _donors(spark, sf_dir):
    """Donors of all eligible clients, without the other stages of the sweep."""
    store = Store(spark, "donors")
    s = store.save(scores(spark, sf_dir).where("stage IN ('train', 'cal')"), "scores")
    train = s.where("stage = 'train'").select("seed", "client_id", F.col("event_id").alias("row_id"), "pos", "score")
    return inject.donors(train, eligibility(s, sql.N_MIN).where("status = 'eligible'"), store, 9)


@query(sql.cells(f"SELECT seed, victim, source, CAST(draw AS BIGINT) AS draw, {r('score')} FROM gifts"))
def cross_device_donors(spark, sf_dir):
    """All donors in draw order."""
    return _donors(spark, sf_dir).select("seed", "victim", "source", "draw", "score")


@query(sql.cells(f"SELECT seed, victim, source, CAST(draw AS BIGINT) AS draw, CAST(event_id AS BIGINT) AS row_id, {r('score')} FROM gifts"))
def cross_device_donors_all(spark, sf_dir):
    """All donors in draw order, with their row ids."""
    return _donors(spark, sf_dir).select("seed", "victim", "source", "draw", "row_id", "score")


@query(sql.base(f"""SELECT user_id % 9 AS device, event_id, {r('value')} FROM (SELECT *, row_number() OVER (PARTITION BY user_id % 9, user_id ORDER BY event_id) AS k FROM events WHERE value IS NOT NULL) WHERE k = 1"""))
def donor_dedupe(spark, sf_dir):
    """The first row of each repeated id within a device."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").withColumn("device", F.col("user_id") % 9)
    first = e.groupBy("device", "user_id").agg(F.min_by(F.struct("event_id", "value"), "event_id").alias("x"))
    return rounded(first.select("device", "x.event_id", "x.value"))


@query(sql.cells(f"""SELECT seed, client_id, trim, {r('tau')} FROM (SELECT seed, client_id, trim, quantile_cont(score, 0.95) AS tau FROM (SELECT *, floor(n * trim) AS cut FROM ranked CROSS JOIN (VALUES (0.05::DOUBLE), (0.1::DOUBLE)) AS t(trim)) WHERE r >= cut AND r < n - cut GROUP BY ALL)"""))
def trimmed_cal(spark, sf_dir):
    s = the_sweep(spark, sf_dir)
    one = lambda t: percentiles(trimmed(s.ladder, t), ["seed", "client_id"], "score", {"tau": 0.95}, s.largest).select("seed", "client_id", F.lit(t).alias("trim"), "tau")
    return rounded(one(0.05).unionByName(one(0.1)))


@query("""WITH n AS (SELECT unnest(range(1, 400)) AS n), q AS (SELECT n, s.source, unnest(range(1, 60)) AS requested FROM n CROSS JOIN (VALUES ('random_benign'), ('high_score_benign')) AS s(source))
SELECT n, source, requested, coalesce((SELECT max(m) FROM range(1, 60) AS t(m) WHERE m <= requested AND CASE WHEN source = 'random_benign' THEN n - m ELSE greatest(1, floor(0.1::DOUBLE * (n - m))) END >= m), 0) AS m FROM q""")
def disjoint_budget(spark, sf_dir):
    n = spark.range(1, 400).withColumnRenamed("id", "n").withColumn("requested", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(59).cast("long"))))
    q = n.withColumn("source", F.explode(F.array(F.lit("random_benign"), F.lit("high_score_benign"))))
    return q.select("n", "source", "requested", inject.disjoint_budget(F.col("n"), F.col("requested"), F.col("source")).alias("m"))


# ---- facts


FACT_COLUMNS = ("delta_tau", "delta_cv_fpr", "delta_mean_fpr", "delta_iqr_fpr", "delta_max_min_fpr", "delta_worst_client_fpr", "victim_delta_tpr", "victim_delta_fpr", "victim_delta_ba", "victim_delta_macro_f1")
NONVICTIM = ("nonvictim_mean_delta_tpr", "nonvictim_worst_delta_tpr", "nonvictim_mean_delta_fpr", "nonvictim_worst_delta_fpr", "nonvictim_mean_delta_ba", "nonvictim_mean_delta_macro_f1")


@query(sql.facts(f"SELECT seed, victim, policy, source, objective, fraction, {r(*FACT_COLUMNS)}, is_victim_significant, n_eligible, n_total FROM f"))
def sweep_rows(spark, sf_dir):
    return rounded(the_facts(spark, sf_dir).select(*inject.CELL, "policy", *FACT_COLUMNS, "is_victim_significant", "n_eligible", "n_total"))


@query(sql.facts("SELECT seed, victim, policy, source, objective, fraction, n_blast_significant, n_non_victims, round(n_blast_significant / n_non_victims, 9) AS blast_fraction FROM f"))
def blast_radius(spark, sf_dir):
    return rounded(the_facts(spark, sf_dir).select(*inject.CELL, "policy", "n_blast_significant", "n_non_victims", "blast_fraction"))


@query(sql.facts("SELECT seed, victim, policy, source, objective, fraction, n_spillover FROM f WHERE fraction > 0"))
def spillover(spark, sf_dir):
    return the_facts(spark, sf_dir).where("fraction > 0").select(*inject.CELL, "policy", "n_spillover")


@query(sql.facts(f"SELECT seed, victim, policy, source, objective, fraction, {r(*NONVICTIM)}, nonvictim_delta_fp_total FROM f"))
def nonvictim_agg(spark, sf_dir):
    return rounded(the_facts(spark, sf_dir).select(*inject.CELL, "policy", *NONVICTIM, "nonvictim_delta_fp_total"))


@query(sql.facts(f"SELECT seed, victim, policy, source, objective, fraction, {r('delta_tau_bound_utilization')}, victim_fp_clean, victim_fp_poisoned FROM f"))
def bound_utilization(spark, sf_dir):
    return rounded(the_facts(spark, sf_dir).select(*inject.CELL, "policy", "delta_tau_bound_utilization", "victim_fp_clean", "victim_fp_poisoned"))


@query(sql.facts("SELECT seed, victim, policy, source, objective, fraction, round(scale_base, 9) AS scale_base, round(iqr_median, 9) AS iqr_median, round(greatest(0.1::DOUBLE * scale_base, 0.01::DOUBLE * iqr_median), 9) AS scale FROM f"))
def materiality(spark, sf_dir):
    return rounded(the_facts(spark, sf_dir).select(*inject.CELL, "policy", F.col("victim_delta_tau_scale_base").alias("scale_base"), F.col("iqr_median_clean").alias("iqr_median"), sweep.materiality("victim_delta_tau_scale_base", "iqr_median_clean").alias("scale")))


@query(sql.facts("""SELECT seed, victim, policy, source, objective, fraction, auroc_invariant, round(donor_unique, 9) AS donor_feature_unique_fraction
FROM f JOIN (SELECT a.seed, bool_and(a.auroc = b.auroc) AS auroc_invariant FROM auc a JOIN auc_again b ON a.seed = b.seed AND a.client_id = b.client_id GROUP BY a.seed) USING (seed)
JOIN (SELECT seed, victim, source, objective, fraction, donor_unique FROM shifts) USING (seed, victim, source, objective, fraction)""", """auc AS (
  SELECT a.seed, a.client_id, sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*) AS auroc FROM scores a JOIN scores b ON a.seed = b.seed AND a.client_id = b.client_id AND a.stage = 'test_attack' AND b.stage = 'test_benign' JOIN cl ON cl.seed = a.seed AND cl.client_id = a.client_id GROUP BY a.seed, a.client_id
), auc_again AS (
  SELECT seed, client_id, avg(below) AS auroc FROM (
    SELECT a.seed, a.client_id, (SELECT avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) FROM scores b WHERE b.seed = a.seed AND b.client_id = a.client_id AND b.stage = 'test_benign') AS below
    FROM scores a JOIN cl ON cl.seed = a.seed AND cl.client_id = a.client_id WHERE a.stage = 'test_attack') GROUP BY seed, client_id
)""".replace("bool_and(a.auroc = b.auroc)", "bool_and(abs(a.auroc - b.auroc) < 1e-12)")).replace("bool_and(a.auroc = b.auroc)", "bool_and(abs(a.auroc - b.auroc) < 1e-12)"))
def sweep_evidence(spark, sf_dir):
    """What shows that an injection only moved thresholds: AUROC of both states, and donors that are used once."""
    return rounded(the_facts(spark, sf_dir).select(*inject.CELL, "policy", "auroc_invariant", "donor_feature_unique_fraction"))


@query()
def sweep_rows_cluster(spark, sf_dir):
    """All fact columns with the cluster policy (labels come from a Python function)."""
    return the_facts(spark, sf_dir, True)


# ---- reports


_TAIL = "(SELECT sum(CASE WHEN b.k >= {k} THEN b.c ELSE 0 END) / 32.0 FROM (VALUES (0, 1), (1, 5), (2, 10), (3, 10), (4, 5), (5, 1)) AS b(k, c))"
_SEED_VALUES = f"""sv AS (SELECT {K}, seed, avg(signed) AS v, count(*) FILTER (is_victim_significant AND signed > 0) AS ns, count(*) FILTER (is_victim_significant) AS na FROM f GROUP BY ALL)"""


@query(sql.facts(f"""SELECT {K}, {r('m=mean_delta_tau', 'md=median_delta_tau', 'i=iqr_delta_tau', 'mr=material_signed_rate')}, seed_sign_count, victim_majority_count, n_seeds, {_TAIL.format(k='seed_sign_count')}::DOUBLE AS support_p,
  fraction > 0 AND source NOT IN ({RANDOM}) AS claim_bearing FROM
  (SELECT {K}, avg(delta_tau) AS m, median(delta_tau) AS md, quantile_cont(delta_tau, 0.75) - quantile_cont(delta_tau, 0.25) AS i, avg(CASE WHEN is_victim_significant AND signed > 0 THEN 1.0 ELSE 0.0 END) AS mr FROM f GROUP BY {K})
  JOIN (SELECT {K}, count(*) FILTER (v > 0) AS seed_sign_count, count(*) FILTER (ns >= 3) AS victim_majority_count, count(*) AS n_seeds FROM sv GROUP BY {K}) USING ({K})""", _SEED_VALUES))
def threshold_shift(spark, sf_dir):
    return rounded(reports.threshold_shift(the_facts(spark, sf_dir), GATE))


_EXCESS = f"""ex AS (SELECT a.policy, a.objective, a.source, a.fraction, c.control AS control_source, a.seed, avg(CASE WHEN a.objective = '{RAISE}' THEN 1 ELSE -1 END * (a.delta_tau - b.delta_tau)) AS excess
  FROM f a JOIN (VALUES {CONTROLS}) AS c(source, control) ON a.source = c.source JOIN f b ON b.source = c.control AND b.objective = a.objective AND b.policy = a.policy AND b.fraction = a.fraction AND b.victim = a.victim AND b.seed = a.seed WHERE a.fraction > 0 GROUP BY ALL),
dx AS (SELECT {K}, control_source, count(*) FILTER (excess > 0) AS seed_support, median(excess) AS median_excess, avg(excess) AS mean_excess FROM ex GROUP BY ALL)"""


@query(sql.facts(f"SELECT {K}, control_source, seed_support, {r('median_excess', 'mean_excess')}, seed_support >= 4 AND median_excess > 0 AS gate_pass, {_TAIL.format(k='seed_support')}::DOUBLE AS support_p FROM dx", _EXCESS))
def directional_excess(spark, sf_dir):
    return rounded(reports.directional_excess(the_facts(spark, sf_dir), GATE).drop("per_seed", "n_seeds"))


@query(sql.facts(f"SELECT {K}, count(*) FILTER (na >= 3) AS instability_count, count(*) FILTER (ns >= 3) AS directional_count, count(*) FILTER (na >= 3) >= 4 AS unstable, count(*) FILTER (ns >= 3) >= 4 AS directional_unstable FROM sv WHERE source IN ({RANDOM}) GROUP BY {K}", _SEED_VALUES))
def random_instability(spark, sf_dir):
    return reports.random_instability(the_facts(spark, sf_dir), GATE)


@query(sql.facts(f"""SELECT {K}, {r('min(md)=lovo_min', 'median(md)=lovo_median', 'max(md)=lovo_max')}, count(*) FILTER (sup >= 4 AND md > 0) AS sign_stable_exclusions, count(*) AS n_exclusions FROM (
  SELECT {K}, x, median(v) AS md, count(*) FILTER (v > 0) AS sup FROM (
    SELECT f.policy, f.objective, f.source, f.fraction, e.victim AS x, f.seed, avg(f.signed) AS v FROM f JOIN (SELECT DISTINCT {K}, victim FROM f) e ON e.policy = f.policy AND e.objective = f.objective AND e.source = f.source AND e.fraction = f.fraction AND e.victim <> f.victim
    WHERE f.source IN ('high_score_benign', 'low_score_benign') AND f.fraction > 0 GROUP BY ALL) GROUP BY ALL) GROUP BY {K}"""))
def leave_one_out(spark, sf_dir):
    return rounded(reports.leave_one_out(the_facts(spark, sf_dir), GATE))


def _metric_sql(metrics, where: str) -> str:
    parts = " UNION ALL ".join(f"SELECT {K}, seed, '{name}' AS metric, {'max' if how == 'max' else 'avg'}({s} * {m}) AS v FROM f WHERE {where} GROUP BY {K}, seed" for m, name, s, how in metrics)
    return f"mv AS ({parts}), mr AS (SELECT {K}, metric, count(*) FILTER (v > 0) AS seed_support, count(*) FILTER (v < 0) AS negative_seed_count, median(v) AS median_harm, avg(v) AS mean_effect FROM mv WHERE v IS NOT NULL GROUP BY ALL)"


_METRIC_SELECT = f"SELECT {K}, metric, seed_support, negative_seed_count, {r('median_harm', 'mean_effect')}, seed_support >= 4 AND median_harm > 0 AS gate_pass FROM mr"
_RAISE_WHERE, _LOWER_WHERE = (f"objective = '{o}' AND source NOT IN ({RANDOM}) AND fraction > 0" for o in (RAISE, LOWER))


@query(sql.facts(_METRIC_SELECT, _metric_sql(reports.RAISE_METRICS, _RAISE_WHERE)))
def downstream_raise(spark, sf_dir):
    return rounded(reports.downstream_raise(the_facts(spark, sf_dir), GATE).drop("per_seed", "n_seeds", "support_p"))


@query(sql.facts(_METRIC_SELECT, _metric_sql(reports.LOWER_METRICS, _LOWER_WHERE)))
def downstream_lower(spark, sf_dir):
    return rounded(reports.downstream_lower(the_facts(spark, sf_dir), GATE).drop("per_seed", "n_seeds", "support_p"))


@query(sql.facts(_METRIC_SELECT, _metric_sql(reports.EXTENDED_METRICS, "fraction > 0")))
def downstream_extended(spark, sf_dir):
    return rounded(reports.downstream_extended(the_facts(spark, sf_dir), GATE).drop("per_seed", "n_seeds", "support_p"))


_EFFECTS = ", ".join(f"round(avg({m}), 9) + 0 AS {m}_mean, round(stddev_samp({m}), 9) + 0 AS {m}_std, round(min({m}), 9) + 0 AS {m}_min, round(max({m}), 9) + 0 AS {m}_max" for m in reports.CLIENT_METRICS)


@query(sql.facts(f"SELECT {K}, victim, count(DISTINCT seed) AS n_seeds, {_EFFECTS} FROM f WHERE fraction > 0 GROUP BY {K}, victim"))
def client_level_effects(spark, sf_dir):
    return rounded(reports.client_level_effects(the_facts(spark, sf_dir)))


@query(sql.facts(f"SELECT {K}, {r('avg(cal_duplicate_rate_clean)=duplicate_rate_clean', 'avg(cal_duplicate_rate_poisoned)=duplicate_rate_poisoned', 'avg(delta_tau_bound_utilization)=bound_utilization', 'max(delta_tau_bound_utilization)=max_bound_utilization')} FROM f WHERE fraction > 0 GROUP BY {K}"))
def duplicates_and_bounds(spark, sf_dir):
    return rounded(reports.duplicates_and_bounds(the_facts(spark, sf_dir)))


def _decision_sql(gates: list[reports.Gate]) -> str:
    rows = ", ".join(f"({g.sign}, {g.majority}, {g.materiality}::DOUBLE, {g.iqr_floor}::DOUBLE)" for g in gates)
    return f"""gates(sg, mj, mf, fl) AS (VALUES {rows}),
mp AS (SELECT DISTINCT mf, fl FROM gates),
gc AS (SELECT {K}, mf, fl, seed, avg(signed) AS v, count(*) FILTER (mat) AS na, count(*) FILTER (mat AND signed > 0) AS ns FROM (SELECT f.*, mf, fl, abs(delta_tau) >= greatest(mf * scale_base, fl * iqr_median) AS mat FROM f CROSS JOIN mp) GROUP BY ALL),
per AS (SELECT {K}, sg, mj, gates.mf AS mf, gates.fl AS fl, count(*) FILTER (v > 0) AS sc, count(*) FILTER (ns >= mj) AS mc, count(*) FILTER (na >= mj) AS ac FROM gc JOIN gates ON gc.mf = gates.mf AND gc.fl = gates.fl GROUP BY ALL),
{_EXCESS},
{_metric_sql(reports.RAISE_METRICS, _RAISE_WHERE)},
{_metric_sql(reports.LOWER_METRICS, _LOWER_WHERE).replace('mv AS', 'mv2 AS').replace('FROM mv ', 'FROM mv2 ').replace('mr AS', 'mr2 AS')},
hm AS (SELECT {K}, max(seed_support) AS hs FROM (SELECT * FROM mr UNION ALL SELECT * FROM mr2) WHERE median_harm > 0 GROUP BY ALL),
dec AS (
  SELECT p.policy, p.objective, p.source, p.fraction, p.sg, p.mj, p.mf, p.fl, p.sc >= p.sg AND p.mc >= p.sg AS g1, coalesce(dx.seed_support >= p.sg AND dx.median_excess > 0, false) AS g2, coalesce(hm.hs >= p.sg, false) AS g3,
    coalesce(q.ac >= p.sg, false) AS ua, coalesce(q.mc >= p.sg, false) AS ud
  FROM per p LEFT JOIN dx ON dx.policy = p.policy AND dx.objective = p.objective AND dx.source = p.source AND dx.fraction = p.fraction
  LEFT JOIN hm ON hm.policy = p.policy AND hm.objective = p.objective AND hm.source = p.source AND hm.fraction = p.fraction
  LEFT JOIN (VALUES {CONTROLS}) AS c(source, control) ON c.source = p.source
  LEFT JOIN per q ON q.policy = p.policy AND q.objective = p.objective AND q.fraction = p.fraction AND q.source = c.control AND q.sg = p.sg AND q.mj = p.mj AND q.mf = p.mf AND q.fl = p.fl
  WHERE p.fraction > 0 AND p.source NOT IN ({RANDOM})
), cls AS (
  SELECT *, CASE WHEN ud OR NOT g2 THEN 'calibration_instability' WHEN g1 AND g3 THEN 'full_vulnerability' WHEN g1 THEN 'mechanism_only' ELSE 'null_or_conditional' END AS claim_class,
    CASE WHEN ua OR NOT g2 THEN 'calibration_instability' WHEN g1 AND g3 THEN 'full_vulnerability' WHEN g1 THEN 'mechanism_only' ELSE 'null_or_conditional' END AS claim_class_absolute FROM dec
)"""


@query(sql.facts(f"SELECT {K}, g1 AS gate1_pass, g2 AS gate2_pass, g3 AS gate3_pass, ua AS random_control_unstable, ud AS random_control_unstable_directional, claim_class, claim_class_absolute FROM cls", _decision_sql([GATE])))
def claim_gates(spark, sf_dir):
    return reports.claim_gates(the_facts(spark, sf_dir), GATE)


_COUNT = lambda c: f"count(*) FILTER (a.claim_class = '{c}')"


@query(sql.facts(f"""SELECT a.sg AS sign, a.mj AS majority, a.mf AS materiality, a.fl AS iqr_floor, {_COUNT('full_vulnerability')} AS n_full, {_COUNT('mechanism_only')} AS n_mechanism, {_COUNT('null_or_conditional')} AS n_null, {_COUNT('calibration_instability')} AS n_instability,
  count(*) FILTER (a.claim_class <> b.claim_class) AS n_changed FROM cls a JOIN cls b ON a.policy = b.policy AND a.objective = b.objective AND a.source = b.source AND a.fraction = b.fraction AND b.sg = 4 AND b.mj = 3 AND b.mf = 0.1::DOUBLE AND b.fl = 0.01::DOUBLE GROUP BY 1, 2, 3, 4""", _decision_sql(GRID)))
def gate_sensitivity(spark, sf_dir):
    return reports.gate_sensitivity(the_facts(spark, sf_dir), GRID, GATE)


_SHARE = ", ".join(f"round(avg(CASE WHEN {c} = 'full_vulnerability' THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS {n}" for c, n in (("claim_class", "robust_share"), ("claim_class_absolute", "robust_share_absolute")))


@query(sql.facts(f"SELECT {K}, {_SHARE}, count(*) AS n_points FROM cls GROUP BY {K}", _decision_sql(GRID)))
def claim_robustness(spark, sf_dir):
    return rounded(reports.claim_robustness(the_facts(spark, sf_dir), GRID))


@query()
def cluster_diagnostics(spark, sf_dir):
    return rounded(reports.cluster_diagnostics(the_facts(spark, sf_dir, True)))


@query()
def claim_gates_cluster(spark, sf_dir):
    """Claims of all policies, with the fixed-assignment gate of the cluster policy."""
    f = the_facts(spark, sf_dir, True)
    return reports.claim_gates(f, GATE).join(reports.fixed_assignment_gate(f, GATE), reports.KEY, "left")


# ---- inference


@query("WITH k AS (SELECT unnest(range(0, 21)) AS k), p AS (SELECT unnest(range(0, 21)) AS i) SELECT k, 20 AS n, round(sum(CASE WHEN i >= k THEN factorial(20) / (factorial(CAST(i AS INT)) * factorial(CAST(20 - i AS INT))) ELSE 0 END)::DOUBLE / 1048576, 9) AS p FROM k CROSS JOIN p GROUP BY k")
def binomial_support(spark, sf_dir):
    return spark.range(0, 21).select(F.col("id").alias("k"), F.lit(20).alias("n"), F.round(binomial_upper_tail("id", F.lit(20)), 9).alias("p"))


@query(sql.facts(f"""SELECT {K}, round(avg(CASE WHEN abs(s) >= 5 * (o - 1e-15) THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS p FROM (
  SELECT {K}, m, sum(excess * CASE WHEN (m >> (seed)) & 1 = 1 THEN 1 ELSE -1 END) AS s, abs(avg(excess)) AS o FROM ex CROSS JOIN (SELECT unnest(range(32)) AS m) GROUP BY ALL) GROUP BY {K}""", _EXCESS))
def sign_flip(spark, sf_dir):
    d = reports.directional_excess(the_facts(spark, sf_dir), GATE)
    return d.select(*reports.KEY, F.round(sign_flip_column("per_seed"), 6).alias("p"))


@query(sql.facts(f"""SELECT {K}, p, round(least(1, max(p * (m - k + 1)) OVER (PARTITION BY policy ORDER BY p, k ROWS UNBOUNDED PRECEDING)), 9) AS p_holm FROM (
  SELECT {K}, p, row_number() OVER (PARTITION BY policy ORDER BY p, objective, source, fraction) AS k, count(*) OVER (PARTITION BY policy) AS m FROM (SELECT {K}, {_TAIL.format(k='seed_support')}::DOUBLE AS p FROM dx))""", _EXCESS))
def holm_adjusted(spark, sf_dir):
    d = reports.directional_excess(the_facts(spark, sf_dir), GATE).select(*reports.KEY, F.col("support_p").alias("p"))
    return rounded(holm(d, ["policy"], "p"))


@query()
def bootstrap_excess(spark, sf_dir):
    """Resampled intervals and exact sign-flip p of the per-seed excess (numpy's generator)."""
    d = reports.directional_excess(the_facts(spark, sf_dir), GATE)
    return rounded(with_resampling(d, reports.KEY, "per_seed", 10_000, 0.95, 300))


# ---- fleet reports and sensitivity


@query(sql.base("SELECT a.seed, round(a.cv_fpr - b.cv_fpr, 9) + 0 AS delta FROM fleet a JOIN fleet b ON a.seed = b.seed AND a.policy = 'global_threshold' AND b.policy = 'local_threshold'"))
def paired_deltas(spark, sf_dir):
    return rounded(reports.paired_deltas(evaluate.dispersion(_evals(spark, sf_dir)), "global_threshold", "local_threshold"))


_TABLE = [x for c in ("cv_fpr", "cv_tpr", "min_balanced_accuracy", "p10_macro_f1") for x in (f"avg({c})={c}_mean", f"coalesce(stddev_samp({c}), 0)={c}_std")]


@query(sql.base(f"SELECT policy, {r(*_TABLE)}, count(*) AS n_seeds, max(n_eligible) AS n_eligible, max(n_clients) AS n_clients FROM fleet GROUP BY policy"))
def results_table(spark, sf_dir):
    return rounded(reports.results_table(evaluate.dispersion(_evals(spark, sf_dir))))


@query(sql.base("SELECT client_id, event_id, round(score, 9) + 0 AS score, round(k / n, 9) AS ecdf FROM (SELECT client_id, event_id, score, row_number() OVER (PARTITION BY client_id ORDER BY score, event_id) AS k, count(*) OVER (PARTITION BY client_id) AS n, (SELECT quantile_cont(score, 0.99) FROM scores WHERE seed = 0 AND stage = 'cal') AS top FROM scores WHERE seed = 0 AND stage = 'cal') WHERE score <= top"))
def ecdf(spark, sf_dir):
    cal = scores(spark, sf_dir).where("seed = 0 AND stage = 'cal'")
    return rounded(sensitivity.ecdf(cal, Store(spark, "ecdf"), events.CLIENTS * largest(spark, sf_dir)))


@query(sql.cells("""SELECT s.seed, s.victim, source, objective, fraction, round(avg(CASE WHEN l.client_id = s.victim THEN tau_p ELSE l.tau END) - avg(l.tau), 9) + 0 AS raw_delta,
  round(max(CASE WHEN l.client_id = s.victim THEN med END) * (avg(CASE WHEN l.client_id = s.victim THEN tau_p ELSE l.tau END / med) - avg(l.tau / med)), 9) + 0 AS normalized_delta, round(stddev_pop(l.tau) / avg(l.tau), 9) AS tau_cv, round(max(l.tau) / min(l.tau), 9) AS tau_ratio, round(stddev_pop(med) / avg(med), 9) AS scale_cv
FROM shifts s JOIN cl l ON s.seed = l.seed JOIN (SELECT seed, client_id, median(score) AS med FROM cal GROUP BY ALL) m ON m.seed = l.seed AND m.client_id = l.client_id WHERE fraction > 0 GROUP BY ALL"""))
def scale_normalization(spark, sf_dir):
    return rounded(sensitivity.scale_normalization(the_sweep(spark, sf_dir)))


_TRIMS = """trim_new AS (
  SELECT seed, victim, source, objective, fraction, quantile_cont(score, 0.95) FILTER (k > floor(n * 0.05::DOUBLE) AND k <= n - floor(n * 0.05::DOUBLE)) AS d5, quantile_cont(score, 0.95) FILTER (k > floor(n * 0.1::DOUBLE) AND k <= n - floor(n * 0.1::DOUBLE)) AS d10
  FROM (SELECT *, row_number() OVER (PARTITION BY seed, victim, source, objective, fraction ORDER BY score, pos) AS k, count(*) OVER (PARTITION BY seed, victim, source, objective, fraction) AS n FROM poisoned) GROUP BY ALL
), trim_old AS (
  SELECT *, avg(c5) OVER (PARTITION BY seed) AS m5, avg(c10) OVER (PARTITION BY seed) AS m10, count(*) OVER (PARTITION BY seed) AS nf FROM (
    SELECT seed, client_id AS victim, quantile_cont(score, 0.95) FILTER (r >= floor(n * 0.05::DOUBLE) AND r < n - floor(n * 0.05::DOUBLE)) AS c5, quantile_cont(score, 0.95) FILTER (r >= floor(n * 0.1::DOUBLE) AND r < n - floor(n * 0.1::DOUBLE)) AS c10 FROM ranked GROUP BY ALL)
), tb AS (
  SELECT *, CASE objective WHEN 'threshold_raise' THEN cal_max ELSE cal_min END AS extreme FROM shifts JOIN trim_new USING (seed, victim, source, objective, fraction) JOIN trim_old USING (seed, victim) JOIN tau_global USING (seed)
)"""
_TRUST_TWO = f"""WITH {sql.BASE}, {sql.CELLS}, {_TRIMS}
SELECT seed, victim, source, objective, fraction, 'local_threshold' AS policy, {r('tau_p - tau_c=undefended', 'd5 - c5=trim_primary', 'd10 - c10=trim_appendix', 'd5 - tau_c=residual_primary', 'd10 - tau_c=residual_appendix', 'extreme - tau_c=overwrite_reference')} FROM tb
UNION ALL SELECT seed, victim, source, objective, fraction, 'global_threshold', {r('(tau_p - tau_c) / nf=undefended', '(d5 - c5) / nf=trim_primary', '(d10 - c10) / nf=trim_appendix', 'm5 + (d5 - c5) / nf - tau_global=residual_primary', 'm10 + (d10 - c10) / nf - tau_global=residual_appendix', 'extreme - tau_global=overwrite_reference')} FROM tb"""


@query(_TRUST_TWO)
def trust_boundary(spark, sf_dir):
    return rounded(sensitivity.trust_boundary(the_sweep(spark, sf_dir)))


@query()
def draw_variants(spark, sf_dir):
    """Draws with replacement against the other draw modes (numpy's generators from the recorded seeds)."""
    s = the_sweep(spark, sf_dir)
    return rounded(inject.injected_rng(s.cells.where("fraction > 0"), s.cal.select("seed", "client_id", "pos", "score"), (WITH_REPLACEMENT, WITHOUT_REPLACEMENT, DISJOINT, INTERPOLATED)))


@query()
def cluster_stability(spark, sf_dir):
    """Cluster shapes over group counts, restarts and random states, for all fractions."""
    return rounded(sensitivity.cluster_stability(the_sweep(spark, sf_dir)))


@query(sql.base("SELECT seed, client_id, round(avg(score), 8) + 0 AS mean, round(coalesce(stddev_samp(score), 0), 5) AS std, round((avg(score ** 3) - 3 * avg(score) * avg(score ** 2) + 2 * avg(score) ** 3) / stddev_pop(score) ** 3, 4) + 0 AS skew, round(quantile_cont(score, 0.95), 9) + 0 AS tail FROM cal GROUP BY seed, client_id"))
def fingerprints(spark, sf_dir):
    s = the_sweep(spark, sf_dir)
    std = F.when(F.col("n_cal") < 2, 0.0).otherwise(F.col("spread") * F.sqrt(F.col("n_cal") / (F.col("n_cal") - 1)))
    f = s.clients.select("seed", "client_id", "mean", std.alias("std"), "skew", F.col("tau").alias("tail"))
    return f.select("seed", "client_id", F.round("mean", 8).alias("mean"), F.round("std", 5).alias("std"), F.round("skew", 4).alias("skew"), F.round("tail", 9).alias("tail"))


@query()
def cluster_taus(spark, sf_dir):
    """Clean, perturbed, fixed-assignment and frozen-scaler thresholds of the cluster policy."""
    s = the_sweep(spark, sf_dir)
    return rounded(sweep.cell_taus(s, sweep.cluster_labels(s)).where(F.col("policy") == CLUSTER))


# ---- state and completeness


@query("""WITH loss AS (SELECT CAST(round_no AS BIGINT) AS round_no, avg(l_extendedprice) / (1 + CAST(0.05 AS DOUBLE) * round_no) AS loss FROM (SELECT l_orderkey % 120 + 1 AS round_no, l_extendedprice FROM lineitem) GROUP BY round_no),
w AS (SELECT round_no, count(*) OVER (ORDER BY round_no) AS seen, avg(loss) OVER (ORDER BY round_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS last_mean, avg(loss) OVER (ORDER BY round_no ROWS BETWEEN 19 PRECEDING AND 10 PRECEDING) AS prev_mean FROM loss)
SELECT round_no, round(last_mean, 4) AS last_mean, round(prev_mean, 4) AS prev_mean, round_no >= 40 AND seen >= 20 AND (prev_mean < 1e-12 OR abs(last_mean - prev_mean) / prev_mean < CAST(0.05 AS DOUBLE)) OR round_no >= 150 AS stop FROM w""")
def convergence_rule(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 120 + 1).alias("round_no"), "l_extendedprice")
    loss = li.groupBy("round_no").agg((F.avg("l_extendedprice") / (1 + 0.05 * F.col("round_no"))).alias("loss"))
    c = sensitivity.convergence(loss, relative=0.05)
    return c.select(F.col("round_no"), F.round("last_mean", 4).alias("last_mean"), F.round("prev_mean", 4).alias("prev_mean"), "stop")


@query(sql.base("SELECT c.client_id, s.stage FROM (SELECT DISTINCT client_id FROM staged) c CROSS JOIN (VALUES ('cal'), ('test_benign'), ('test_attack'), ('validation')) AS s(stage) WHERE NOT EXISTS (SELECT 1 FROM staged x WHERE x.client_id = c.client_id AND x.stage = s.stage)"))
def coverage_missing(spark, sf_dir):
    rows = staged(spark, sf_dir).select("client_id", "stage").distinct()
    wanted = rows.select("client_id").distinct().withColumn("stage", F.explode(F.array(*map(F.lit, ("cal", "test_benign", "test_attack", "validation")))))
    return wanted.join(rows, ["client_id", "stage"], "left_anti")


@query("SELECT coalesce(o_orderstatus, 'overall') AS stage, count(*) FILTER (o_orderpriority LIKE '1%') AS complete, count(*) FILTER (o_orderpriority LIKE '2%') AS missing, count(*) FILTER (NOT (o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%')) AS aborted FROM orders GROUP BY ROLLUP (o_orderstatus)")
def status_rollup(spark, sf_dir):
    p = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").rollup("o_orderstatus").agg(F.count_if(p == "1").alias("complete"), F.count_if(p == "2").alias("missing"), F.count_if(~p.isin("1", "2")).alias("aborted")).select(F.coalesce("o_orderstatus", F.lit("overall")).alias("stage"), "complete", "missing", "aborted")


@query(sql.base("SELECT seed, policy, count(*) AS n, count(*) FILTER (abs(fpr + tnr - 1) <= 1e-9) AS n_fpr_ok, count(*) FILTER (abs(tpr + fnr - 1) <= 1e-9) AS n_tpr_ok FROM rates GROUP BY seed, policy"))
def metric_recheck(spark, sf_dir):
    """Rates recomputed from stored counts against the stored rates, within 1e-9; null equals null."""
    e = _evals(spark, sf_dir)
    close = lambda a, b: F.coalesce(F.abs(a - b) <= 1e-9, a.isNull() & b.isNull())
    again = (F.col("fp") / (F.col("fp") + F.col("tn")), F.col("tp") / (F.col("tp") + F.col("fn")))
    return e.groupBy("seed", "policy").agg(F.count("*").alias("n"), F.count_if(close(again[0], F.col("fpr"))).alias("n_fpr_ok"), F.count_if(close(again[1], F.col("tpr"))).alias("n_tpr_ok"))


@query(sql.base("SELECT seed, client_id FROM elig WHERE status = 'eligible' EXCEPT SELECT seed, client_id FROM rates WHERE policy = 'local_threshold' AND fpr > 0.04"))
def eligible_minus_noisy(spark, sf_dir):
    s = scores(spark, sf_dir)
    noisy = _evals(spark, sf_dir).where("policy = 'local_threshold' AND fpr > 0.04").select("seed", "client_id")
    return eligibility(s, sql.N_MIN).where("status = 'eligible'").select("seed", "client_id").subtract(noisy)


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, 'c' || CAST(user_id % 9 AS VARCHAR) AS client_id, count(*) AS n, count(*) FILTER (value > 100) AS n_alerts FROM events WHERE value IS NOT NULL GROUP BY 1, 2")
def alert_windows(spark, sf_dir):
    out = alert_counts(table(spark, sf_dir, "events"), threshold=100.0)
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "client_id", "n", "n_alerts")


def queries() -> dict[str, Query]:
    from . import summaries  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
