"""Summaries of the sensitivity tables, data behind the figures, and checks, as registered queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from taulab.constants import POLICIES, WITH_REPLACEMENT
from taulab.functions.columns import ratio
from taulab.operators import cluster, evaluate, guards, inject, prepare, sensitivity, sweep
from taulab.operators.thresholds import eligibility, thresholds
from taulab.sources import documents, readers, runs
from taulab.sources.events import table
from taulab.sources.store import Store

from . import registry, reports, sql
from .registry import GRID, query, r, rounded, scores, the_facts, the_sweep
from .sql import K

_BY = "source, objective, fraction"


@query(sql.facts("SELECT count(*) AS n_rows, count(DISTINCT seed) AS n_seeds, count(DISTINCT victim) AS n_victims, count(DISTINCT policy) AS n_policies, count(DISTINCT source || objective) AS n_pairs, count(DISTINCT fraction) AS n_fractions FROM f"))
def manifest_summary(spark, sf_dir):
    d = F.count_distinct
    return the_facts(spark, sf_dir).agg(F.count("*").alias("n_rows"), d("seed").alias("n_seeds"), d("victim").alias("n_victims"), d("policy").alias("n_policies"), d("source", "objective").alias("n_pairs"), d("fraction").alias("n_fractions"))


@query("SELECT policy, seed FROM (VALUES ('global_threshold'), ('local_threshold'), ('cluster_threshold')) AS p(policy) CROSS JOIN (SELECT unnest(range(20)) AS seed)")
def baseline_grid(spark, sf_dir):
    return spark.createDataFrame([(p,) for p in POLICIES], "policy string").crossJoin(spark.range(20).withColumnRenamed("id", "seed"))


@query(sql.facts(f"SELECT {K}, seed, {r('avg(delta_tau)=delta_tau', 'avg(victim_delta_tpr)=victim_delta_tpr', 'avg(delta_cv_fpr)=delta_cv_fpr')}, count(*) AS n_victims FROM f GROUP BY {K}, seed"))
def seed_means(spark, sf_dir):
    means = [F.avg(c).alias(c) for c in ("delta_tau", "victim_delta_tpr", "delta_cv_fpr")]
    return rounded(the_facts(spark, sf_dir).groupBy(*reports.KEY, "seed").agg(*means, F.count("*").alias("n_victims")))


_SCALE = registry._SQL["scale_normalization"]


@query(f"SELECT {_BY}, {r('avg(raw_delta)=raw_delta', 'avg(normalized_delta)=normalized_delta', 'avg(tau_cv)=tau_cv', 'avg(scale_cv)=scale_cv')}, count(*) AS n_rows FROM ({_SCALE}) GROUP BY {_BY}")
def scale_normalization_summary(spark, sf_dir):
    rows = rounded(sensitivity.scale_normalization(the_sweep(spark, sf_dir)))
    return rounded(rows.groupBy("source", "objective", "fraction").agg(*(F.avg(c).alias(c) for c in ("raw_delta", "normalized_delta", "tau_cv", "scale_cv")), F.count("*").alias("n_rows")))


_TRUST = registry._SQL["trust_boundary"]


@query(f"SELECT policy, {_BY}, {r('avg(undefended)=undefended', 'avg(trim_primary)=trim_primary', 'avg(trim_appendix)=trim_appendix')}, round(1 - avg(trim_primary) / nullif(avg(undefended), 0), 6) + 0 AS reduction_primary FROM ({_TRUST}) GROUP BY policy, {_BY}")
def trust_boundary_summary(spark, sf_dir):
    rows = rounded(sensitivity.trust_boundary(the_sweep(spark, sf_dir)))
    out = rows.groupBy("policy", "source", "objective", "fraction").agg(*(F.avg(c).alias(c) for c in ("undefended", "trim_primary", "trim_appendix")))
    return rounded(out).withColumn("reduction_primary", F.round(1 - ratio("trim_primary", "undefended"), 6))


@query()
def draw_variant_summary(spark, sf_dir):
    """Mean threshold and duplicates of each draw mode against drawing with replacement."""
    rows = registry.draw_variants(spark, sf_dir)
    base = rows.where(F.col("draw") == WITH_REPLACEMENT).select(*inject.CELL, F.col("tau").alias("tau_with"), F.col("duplicate_rate").alias("duplicates_with"))
    both = rows.where(F.col("draw") != WITH_REPLACEMENT).join(base, inject.CELL)
    out = both.groupBy("source", "objective", "fraction", "draw").agg(
        F.avg(F.col("feasible").cast("double")).alias("feasible_rate"), F.avg("n_replaced").alias("n_replaced"), F.avg("tau").alias("tau"), F.avg("tau_with").alias("tau_with"), F.avg("duplicate_rate").alias("duplicates"), F.avg("duplicates_with").alias("duplicates_with")
    )
    return rounded(out.withColumns({"tau_ratio": ratio("tau", "tau_with"), "synthesized": F.col("draw") == "interpolated_tail"}))


@query()
def cluster_sensitivity_summary(spark, sf_dir):
    """Means over cells for each k and number of restarts, and the mean deviation across random states."""
    rows = sensitivity.cluster_stability(the_sweep(spark, sf_dir))
    cell = rows.groupBy(*inject.CELL, "k", "n_init").agg(F.avg("cluster_silhouette_clean").alias("silhouette"), F.avg("cluster_n_reassigned").alias("reassigned"), F.stddev_samp("cluster_silhouette_poisoned").alias("state_std"))
    return rounded(cell.groupBy("source", "objective", "fraction", "k", "n_init").agg(F.avg("silhouette").alias("silhouette"), F.avg("reassigned").alias("reassigned"), F.avg("state_std").alias("mean_state_std"), F.count("*").alias("n_cells")))


@query()
def cluster_members(spark, sf_dir):
    """Members and mean threshold of each clean cluster."""
    s = the_sweep(spark, sf_dir)
    labels = sweep.cluster_labels(s).where("fraction = 0").select("seed", "client_id", "label_clean").distinct()
    both = labels.join(s.clients.select("seed", "client_id", "tau"), ["seed", "client_id"])
    out = both.groupBy("seed", F.concat(F.lit("cluster_"), F.col("label_clean").cast("string")).alias("cluster_id")).agg(F.array_join(F.array_sort(F.collect_list("client_id")), ",").alias("members"), F.avg("tau").alias("tau"))
    return rounded(out)


@query(sql.base(f"SELECT policy, {r('quantile_cont(fpr, 0.25)=q25', 'median(fpr)=q50', 'quantile_cont(fpr, 0.75)=q75', 'min(fpr)=low', 'max(fpr)=high')}, count(*) AS n FROM rates WHERE status = 'eligible' GROUP BY policy"))
def figure_fpr_quartiles(spark, sf_dir):
    e = registry._evals(spark, sf_dir).where("status = 'eligible'")
    q = lambda p: F.percentile("fpr", F.lit(p))
    return rounded(e.groupBy("policy").agg(q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.min("fpr").alias("low"), F.max("fpr").alias("high"), F.count("*").alias("n")))


@query(sql.facts(f"SELECT policy, source, victim, {r('avg(delta_tau)=mean', 'avg(delta_tau) - min(delta_tau)=below', 'max(delta_tau) - avg(delta_tau)=above')} FROM f WHERE fraction = 0.4::DOUBLE GROUP BY policy, source, victim"))
def figure_effects(spark, sf_dir):
    x = "delta_tau"
    return rounded(the_facts(spark, sf_dir).where("fraction = 0.4D").groupBy("policy", "source", "victim").agg(F.avg(x).alias("mean"), (F.avg(x) - F.min(x)).alias("below"), (F.max(x) - F.avg(x)).alias("above")))


@query(sql.facts("SELECT source, policy, round(avg(CASE WHEN claim_class = 'full_vulnerability' THEN 1.0 ELSE 0 END) FILTER (fraction < 0.15), 9)::DOUBLE AS f10, round(avg(CASE WHEN claim_class = 'full_vulnerability' THEN 1.0 ELSE 0 END) FILTER (fraction > 0.15 AND fraction < 0.3), 9)::DOUBLE AS f20, round(avg(CASE WHEN claim_class = 'full_vulnerability' THEN 1.0 ELSE 0 END) FILTER (fraction > 0.3), 9)::DOUBLE AS f40 FROM cls GROUP BY source, policy", registry._decision_sql(GRID)))
def figure_robustness(spark, sf_dir):
    """(source, policy) by fraction: the share of gates at which a claim is full."""
    c = reports.claim_robustness(the_facts(spark, sf_dir), GRID)
    wide = c.withColumn("f", F.concat(F.lit("f"), F.bround(F.col("fraction") * 100).cast("int").cast("string"))).groupBy("source", "policy").pivot("f", ["f10", "f20", "f40"]).agg(F.avg("robust_share"))
    return rounded(wide)


@query(sql.base("SELECT client_id, event_id FROM (SELECT client_id, event_id, row_number() OVER (PARTITION BY client_id ORDER BY ((event_id + 1) * 48271 + 5 * 104729) % 1000003, event_id) AS k FROM staged WHERE stage = 'cal') WHERE k <= 5000"))
def figure_sample(spark, sf_dir):
    """At most 5,000 calibration rows per client, for a plot (a sampling operator)."""
    from taulab.sources.events import labelled, staged

    return guards.exact_sample(staged(labelled(spark, sf_dir)).where("stage = 'cal'"), ["client_id"], "event_id", 5000, 5).select("client_id", "event_id")


@query(sql.base("""SELECT s.seed, p.pick, c.client_id, round(c.fpr, 9) AS fpr, round(s.cv_fpr, 9) AS cv_fpr FROM (SELECT seed, cv_fpr FROM (SELECT seed, cv_fpr, row_number() OVER (ORDER BY round(cv_fpr, 9), seed) AS k, count(*) OVER () AS n FROM fleet WHERE policy = 'global_threshold') WHERE k = (n + 1) // 2) s
JOIN (SELECT seed, client_id, fpr, row_number() OVER (PARTITION BY seed ORDER BY round(fpr, 9), client_id) AS k, count(*) OVER (PARTITION BY seed) AS n FROM rates WHERE policy = 'global_threshold' AND status = 'eligible') c USING (seed)
JOIN (VALUES ('lowest'), ('median'), ('highest')) AS p(pick) ON c.k = CASE p.pick WHEN 'lowest' THEN 1 WHEN 'median' THEN c.n // 2 + 1 ELSE c.n END"""))
def representative_picks(spark, sf_dir):
    """The seed of lower-median dispersion under the global threshold, and its clients of lowest, median and highest false-positive rate."""
    return rounded(reports.representative_picks(registry._evals(spark, sf_dir), "global_threshold"))


@query()
def paired_bootstrap(spark, sf_dir):
    """Resampled interval of the paired dispersion difference of each two policies (numpy's generator)."""
    return rounded(reports.paired_bootstrap(evaluate.dispersion(registry._evals(spark, sf_dir)), ("global_threshold", "local_threshold")))


_MIX = "xor(h, h >> 15) * 73244475 % 2147483648 AS h"


@query(sql.base(f"""SELECT 'global_threshold' AS "left", 'local_threshold' AS "right", max(n) AS n_seeds, round(max(mean), 9) + 0 AS mean, round(quantile_cont(m, 0.025), 9) + 0 AS ci_low, round(quantile_cont(m, 0.975), 9) + 0 AS ci_high, quantile_cont(m, 0.025) > 0 OR quantile_cont(m, 0.975) < 0 AS excludes_zero
FROM (SELECT resample, max(n) AS n, max(mean) AS mean, avg(delta) AS m FROM (
  SELECT resample, n, (h >> 8) % n AS place FROM (SELECT n, resample, {_MIX} FROM (SELECT n, resample, {_MIX} FROM (SELECT n, resample, {_MIX} FROM (
    SELECT n, resample, (resample * 1000003 + slot * 7919 + 4398618) % 2147483648 AS h FROM (SELECT DISTINCT n FROM pd) CROSS JOIN (SELECT unnest(range(10000)) AS resample) CROSS JOIN LATERAL (SELECT unnest(range(n)) AS slot)))))
  ) JOIN pd USING (n, place) GROUP BY resample)""").replace("\nSELECT 'global", """, pd AS (
  SELECT a.cv_fpr - b.cv_fpr AS delta, row_number() OVER (ORDER BY a.seed) - 1 AS place, count(*) OVER () AS n, avg(a.cv_fpr - b.cv_fpr) OVER () AS mean FROM fleet a JOIN fleet b ON a.seed = b.seed AND a.policy = 'global_threshold' AND b.policy = 'local_threshold')
SELECT 'global""", 1))
def paired_resampling(spark, sf_dir):
    """Resampled interval of the paired dispersion difference, with draws that any SQL engine makes alike."""
    fleet = Store(spark, "fleet").save(evaluate.dispersion(registry._evals(spark, sf_dir)).select("seed", "policy", "cv_fpr"), "fleet")
    return rounded(reports.shared_resamples(reports.pair_deltas(fleet, (("global_threshold", "local_threshold"),))))


@query()
def paired_resampling_all(spark, sf_dir):
    """The same for all three pairs of policies on shared resamples; the cluster policy's dispersion comes from fitted clusters."""
    clean = the_facts(spark, sf_dir, True).where("fraction = 0").select("seed", "policy", F.col("cv_fpr_clean").alias("cv_fpr")).groupBy("seed", "policy").agg(F.min("cv_fpr").alias("cv_fpr"))
    clean = Store(spark, "fleet").save(clean, "fleet")
    a, b, c = "global_threshold", "local_threshold", "cluster_threshold"
    return rounded(reports.shared_resamples(reports.pair_deltas(clean, ((a, b), (a, c), (c, b)))))


@query(sql.base("SELECT seed, policy, client_id, tp, fp, tn, fn FROM rates"))
def resumed_evaluation(spark, sf_dir):
    """Confusion counts through a grid run that is stopped after two seeds and taken up again."""
    s = scores(spark, sf_dir)
    store = Store(spark, "grid")
    s = store.save(s, "scores")
    largest = registry.largest(spark, sf_dir)
    cells = s.select("seed").distinct().withColumn("policy", F.explode(F.array(F.lit("global_threshold"), F.lit("local_threshold"))))

    def compute(todo):
        own = s.join(todo.select("seed").distinct(), "seed", "left_semi")
        taus = thresholds(own, sql.N_MIN, largest=largest).join(todo, ["seed", "policy"], "left_semi")
        return evaluate.client_eval(own, taus).select("seed", "policy", "client_id", "tp", "fp", "tn", "fn")

    run = runs.GridRun(spark, f"{store.root}/runs", ["seed", "policy"], runs.state_of({"scores": s}, {"n_min": sql.N_MIN}))
    run.run(cells.where("seed < 2"), compute)
    run.run(cells, compute, waves=2)
    return run.results(cells).select("seed", "policy", "client_id", "tp", "fp", "tn", "fn")


_PROPS = documents.DocumentSchema("k int", ("k",), (("k_below_90", "k < 90"),))


@query("""WITH e AS (SELECT event_id, regexp_extract(props, '[0-9]+')::INT AS k, props, event_id % 97 = 1 AS cut, event_id % 89 = 1 AS renamed, event_id % 83 = 1 AS texts, event_id % 79 = 1 AS more FROM events WHERE props IS NOT NULL)
SELECT event_id, 'malformed' AS rule, NULL::VARCHAR AS field FROM e WHERE cut
UNION ALL SELECT event_id, 'missing', 'k' FROM e WHERE NOT cut AND renamed UNION ALL SELECT event_id, 'unknown', 'j' FROM e WHERE NOT cut AND renamed
UNION ALL SELECT event_id, 'type', 'k' FROM e WHERE NOT cut AND NOT renamed AND texts
UNION ALL SELECT event_id, 'unknown', 'z' FROM e WHERE NOT cut AND NOT renamed AND NOT texts AND more
UNION ALL SELECT event_id, 'k_below_90', NULL FROM e WHERE NOT cut AND NOT renamed AND NOT texts AND k >= 90""")
def document_violations(spark, sf_dir):
    """The events' JSON documents, some of which are cut off, renamed, of another type or too long, against a schema."""
    e, n = table(spark, sf_dir, "events").where("props IS NOT NULL"), F.col("event_id")
    bad = F.when(n % 97 == 1, F.substring("props", 1, 4)).when(n % 89 == 1, F.replace("props", F.lit('"k"'), F.lit('"j"'))).when(n % 83 == 1, F.lit('{"k": "text"}')).when(n % 79 == 1, F.replace("props", F.lit("}"), F.lit(', "z": 1}')))
    found = documents.checked(e.select("event_id", F.coalesce(bad, "props").alias("text")), "text", _PROPS)
    return documents.violations(found, ["event_id"]).drop("value")


@query(sql.base("""SELECT seed, policy, client_id, 'differs' AS problem, 'tp' AS figure, CAST(tp + 1 AS DOUBLE) AS stored, CAST(tp AS DOUBLE) AS computed FROM rates WHERE seed = 1 AND client_id = 'c3'
UNION ALL SELECT seed, policy, client_id, 'missing', NULL, NULL, NULL FROM rates WHERE seed = 2 AND client_id = 'c4' UNION ALL SELECT seed, policy, 'c99', 'surplus', NULL, NULL, NULL FROM rates WHERE seed = 3 AND client_id = 'c5'"""))
def stored_recheck(spark, sf_dir):
    """Stored metric documents, of which some were altered, lost or added, against what the scores give now."""
    store = Store(spark, "documents")
    now = store.save(registry._evals(spark, sf_dir).select("seed", "policy", "client_id", "tp", "fp", "fpr", "tpr"), "evals")
    wrong = F.when((F.col("seed") == 1) & (F.col("client_id") == "c3"), F.col("tp") + 1).otherwise(F.col("tp"))
    kept = now.where("NOT (seed = 2 AND client_id = 'c4')").withColumn("tp", wrong)
    kept = kept.unionByName(now.where("seed = 3 AND client_id = 'c5'").withColumn("client_id", F.lit("c99")))
    docs = kept.groupBy("seed", "policy").agg(F.collect_list(F.struct("client_id", "tp", "fp", "fpr", "tpr")).alias("per_client"))
    docs.write.json(f"{store.root}/metrics")
    schema = "seed long, policy string, per_client array<struct<client_id: string, tp: long, fp: long, fpr: double, tpr: double>>"
    stored = spark.read.schema(schema).json(f"{store.root}/metrics").select("seed", "policy", F.explode("per_client").alias("c")).select("seed", "policy", "c.*")
    return documents.differences(stored, now, ["seed", "policy", "client_id"], ["tp", "fp", "fpr", "tpr"])


_VARIANTS = """hv AS (
  SELECT h.*, CAST(CASE source WHEN 'random_benign' THEN n ELSE greatest(1, floor(0.1::DOUBLE * n)) END AS BIGINT) AS pool FROM hits h WHERE source IN ('random_benign', 'high_score_benign', 'low_score_benign')
), asked AS (
  SELECT seed, victim, source, objective, fraction, child, n, m, pool, draw, CASE draw WHEN 'without_replacement' THEN least(m, pool) WHEN 'interpolated_tail' THEN CASE WHEN pool >= 2 THEN m ELSE 0 END
    ELSE coalesce((SELECT max(q) FROM (SELECT unnest(range(1, m + 1)) AS q) WHERE CASE source WHEN 'random_benign' THEN n - q ELSE greatest(1, floor(0.1::DOUBLE * (n - q))) END >= q), 0) END AS eff
  FROM (SELECT DISTINCT seed, victim, source, objective, fraction, child, n, m, pool FROM hv) CROSS JOIN (VALUES ('without_replacement'), ('disjoint_reservoir'), ('interpolated_tail')) AS d(draw)
), av AS (
  SELECT *, CASE WHEN draw = 'disjoint_reservoir' THEN CAST(CASE source WHEN 'random_benign' THEN n - eff ELSE greatest(1, floor(0.1::DOUBLE * (n - eff))) END AS BIGINT) ELSE pool END AS pool_n,
    CASE WHEN draw = 'disjoint_reservoir' THEN n - eff ELSE n END AS of FROM asked
), every AS (
  SELECT a.seed, a.victim, a.source, a.objective, a.fraction, a.draw, h.pos, h.clean_score, h.k, h.k <= eff AS gone, a.n,
    CASE WHEN h.k <= eff THEN CASE a.source WHEN 'high_score_benign' THEN of - pool_n ELSE 0 END + (a.child * 13 + a.seed * 7 + (h.k - 1) * CASE WHEN (pool_n - (draw = 'interpolated_tail')::INT) % 48271 = 0 THEN 1 ELSE 48271 END) % (pool_n - (draw = 'interpolated_tail')::INT) END AS drawn,
    (h.k * 7919 + a.child) % 1000 / 1000.0::DOUBLE AS toward
  FROM av a JOIN hv h USING (seed, victim, source, objective, fraction)
), steps AS (
  SELECT seed, victim, source, objective, fraction, draw, clean_score AS v, lead(clean_score) OVER w AS up, row_number() OVER w - 1 AS place FROM every WHERE draw <> 'disjoint_reservoir' OR NOT gone
  WINDOW w AS (PARTITION BY seed, victim, source, objective, fraction, draw ORDER BY clean_score, pos)
), vp AS (
  SELECT e.seed, e.victim, e.source, e.objective, e.fraction, e.draw, CASE WHEN NOT gone THEN clean_score WHEN e.draw = 'interpolated_tail' THEN v + toward * (up - v) ELSE v END AS score
  FROM every e LEFT JOIN steps s ON s.seed = e.seed AND s.victim = e.victim AND s.source = e.source AND s.objective = e.objective AND s.fraction = e.fraction AND s.draw = e.draw AND s.place = e.drawn
), vm AS (SELECT seed, victim, source, objective, fraction, draw, quantile_cont(score, 0.95) AS tau_v, 1 - count(DISTINCT score) / count(*) AS dup_v FROM vp GROUP BY ALL)"""


@query(sql.cells(f"""SELECT seed, victim, source, objective, fraction, draw, policy, CAST(m AS BIGINT) AS requested, CAST(eff AS BIGINT) AS effective, pool_n, round((tau_p - tau_c) / f, 9) + 0 AS delta_tau_with_replacement, round((tau_v - tau_c) / f, 9) + 0 AS delta_tau_variant,
  round(dup_p, 9) + 0 AS duplicate_rate_with_replacement, round(dup_v, 9) + 0 AS duplicate_rate_variant
FROM (SELECT *, CASE policy WHEN 'local_threshold' THEN 1 ELSE (SELECT max(n_eligible) FROM cl WHERE cl.seed = av.seed) END AS f FROM av CROSS JOIN (VALUES ('local_threshold'), ('global_threshold')) AS p(policy))
JOIN vm USING (seed, victim, source, objective, fraction, draw) JOIN shifts USING (seed, victim, source, objective, fraction)""").replace("\nSELECT seed, victim, source, objective, fraction, draw, policy", ", " + _VARIANTS + "\nSELECT seed, victim, source, objective, fraction, draw, policy", 1))
def draw_variant_shifts(spark, sf_dir):
    """Budgets, threshold shifts by policy and duplicates of three other ways to draw, beside drawing with replacement."""
    return rounded(sensitivity.draw_variants(the_sweep(spark, sf_dir)))


_VARIANT_ROWS = registry._SQL["draw_variant_shifts"]


@query(f"SELECT policy, {_BY}, draw, {r('avg(delta_tau_variant)=delta_tau', 'avg(delta_tau_with_replacement)=delta_tau_with')}, round(avg(effective), 9) AS effective, round(avg(CASE WHEN effective = requested THEN 1.0 ELSE 0.0 END)::DOUBLE, 9) AS feasible_rate, count(*) AS n_rows FROM ({_VARIANT_ROWS}) GROUP BY policy, {_BY}, draw")
def draw_variant_shift_summary(spark, sf_dir):
    rows = rounded(sensitivity.draw_variants(the_sweep(spark, sf_dir)))
    whole = F.avg(F.when(F.col("effective") == F.col("requested"), 1.0).otherwise(0.0))
    return rounded(rows.groupBy("policy", "source", "objective", "fraction", "draw").agg(F.avg("delta_tau_variant").alias("delta_tau"), F.avg("delta_tau_with_replacement").alias("delta_tau_with"), F.avg("effective").alias("effective"), whole.alias("feasible_rate"), F.count("*").alias("n_rows")))


@query()
def cluster_k_candidates(spark, sf_dir):
    """Silhouettes of the candidate numbers of clusters, and whether the fixed one is valid."""
    s = the_sweep(spark, sf_dir)
    cal = s.cal
    found = cluster.silhouettes_by_k(cluster.fingerprints(cal, ["seed", "client_id"]), (2, 3, 4))
    fixed = cluster.fixed_k(found).select("seed", F.col("k").alias("fixed"), F.col("valid").alias("fixed_valid"))
    return rounded(found.join(fixed, "seed").withColumn("is_fixed", F.col("k") == F.col("fixed")).drop("fixed"))


@query()
def cluster_stability_summary(spark, sf_dir):
    """Reassignment, sizes and effects of the cluster policy, with clusters recomputed and fixed, per pair and fraction."""
    return rounded(reports.cluster_stability_summary(the_facts(spark, sf_dir, True)))


@query(sql.base("SELECT round(avg(d), 9) + 0 AS mean_delta, count(*) FILTER (d > 0) AS n_positive, count(*) AS n_seeds, avg(d) > 0 AND count(*) FILTER (d > 0) = count(*) AS consistent FROM (SELECT a.cv_fpr - b.cv_fpr AS d FROM fleet a JOIN fleet b ON a.seed = b.seed AND a.policy = 'global_threshold' AND b.policy = 'local_threshold')"))
def heterogeneity_check(spark, sf_dir):
    d = reports.paired_deltas(evaluate.dispersion(registry._evals(spark, sf_dir)), "global_threshold", "local_threshold")
    n, up = F.count("*"), F.count_if(F.col("delta") > 0)
    return rounded(d.agg(F.avg("delta").alias("mean_delta"), up.alias("n_positive"), n.alias("n_seeds"), ((F.avg("delta") > 0) & (up == n)).alias("consistent")))


@query(sql.base("SELECT seed, client_id, row_number() OVER (PARTITION BY seed ORDER BY client_id) - 1 AS client_idx, round(avg(CASE WHEN status = 'eligible' THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY seed), 9)::DOUBLE AS coverage_ratio FROM elig"))
def client_index(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("seed")
    e = eligibility(scores(spark, sf_dir), sql.N_MIN)
    share = F.avg(F.when(F.col("status") == "eligible", 1.0).otherwise(0.0)).over(w)
    return rounded(e.select("seed", "client_id", (F.row_number().over(w.orderBy("client_id")) - 1).cast("long").alias("client_idx"), share.alias("coverage_ratio")))


@query("SELECT label, count(*) AS n_rows, min(len(embedding)) AS min_width, max(len(embedding)) AS max_width, bool_and(isfinite(list_sum(embedding)) AND list_count(embedding) = len(embedding)) AS all_finite FROM embeddings GROUP BY label")
def feature_validity(spark, sf_dir):
    return guards.feature_validity(table(spark, sf_dir, "embeddings"), ["label"], "embedding")


@query(sql.cells("SELECT rule, count(*) AS n FROM (SELECT CASE WHEN fraction + 0.05::DOUBLE * (seed % 2) NOT IN (0::DOUBLE, 0.1::DOUBLE, 0.2::DOUBLE, 0.4::DOUBLE) THEN 'fraction' END AS rule FROM cells) WHERE rule IS NOT NULL GROUP BY rule"))
def guard_violations(spark, sf_dir):
    """A grid with shifted fractions: how many cells the guards find."""
    cells = the_sweep(spark, sf_dir).cells.withColumn("fraction", F.col("fraction") + 0.05 * (F.col("seed") % 2))
    return guards.invalid_cells(cells).groupBy("rule").agg(F.count("*").alias("n"))


_VECTORS = """v AS (SELECT vec_id, CAST(label AS VARCHAR) AS client_id, vec_id % 7 = 0 AS attack, embedding FROM embeddings WHERE label IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY client_id, attack ORDER BY vec_id) - 1 AS r, count(*) OVER (PARTITION BY client_id, attack) AS n FROM v),
cut AS (SELECT *, floor(n * 0.6::DOUBLE) AS b, floor(n * 0.01::DOUBLE) AS g, floor(n * 0.2::DOUBLE) AS c FROM placed),
parts AS (SELECT vec_id, client_id, embedding, CASE WHEN attack THEN 'test_attack' WHEN r < b THEN 'train' WHEN r < b + g THEN 'gap' WHEN r < b + g + c THEN 'cal' WHEN r < b + g + c + g THEN 'gap' ELSE 'test_benign' END AS split FROM cut),
drawn AS (SELECT *, row_number() OVER (PARTITION BY client_id, split ORDER BY (vec_id * 48271 + 7) % 1000003, vec_id) AS k, count(*) FILTER (split = 'test_attack') OVER (PARTITION BY client_id) AS n_attack FROM parts),
kept AS (SELECT * FROM drawn WHERE split <> 'gap' AND (split <> 'test_benign' OR n_attack = 0 OR k <= n_attack)),
long AS (SELECT vec_id, client_id, split, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding)::DOUBLE AS x FROM kept),
fit AS (SELECT client_id, i, avg(x) AS m, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS s FROM long WHERE split = 'train' GROUP BY client_id, i)"""
WIDTH = 64


def _fleet(spark, sf_dir) -> str:
    """The embeddings as a fleet's feature rows, prepared and stored; returns the folder."""
    e = table(spark, sf_dir, "embeddings").where("label IS NOT NULL")
    rows = e.select(F.col("label").cast("string").alias("client_id"), (F.col("vec_id") % 7 == 0).alias("attack"), F.col("vec_id").alias("row_idx"), F.col("embedding").alias("features"))
    store = Store(spark, "fleet")
    prepare.prepare(rows, f"{store.root}/splits", WIDTH, store)
    return f"{store.root}/splits"


@query(f"WITH {_VECTORS} SELECT client_id, split, count(DISTINCT vec_id) AS n_rows, round(avg(abs((x - m) / s)), 6) AS mean_abs_z, round(max((x - m) / s), 6) + 0 AS max_z FROM long JOIN fit USING (client_id, i) GROUP BY client_id, split")
def prepared_fleet(spark, sf_dir):
    """Scaled, balanced splits by client, as they are read back from a stored fleet."""
    path = _fleet(spark, sf_dir)
    z = readers.splits(spark, path, WIDTH).withColumns({"total": F.aggregate("features", F.lit(0.0), lambda a, x: a + F.abs(x)), "top": F.array_max("features")})
    each = z.groupBy("client_id", "split").agg(F.count("*").alias("n_rows"), (F.avg("total") / WIDTH).alias("mean_abs_z"), F.max("top").alias("max_z"))
    return rounded(each, 6)


@query(f"""WITH {_VECTORS}, n AS (SELECT client_id, split, count(*) AS n FROM kept GROUP BY ALL)
SELECT client_id, split, unnest(CASE WHEN split = 'cal' AND client_id = '1' THEN ['missing', 'count'] WHEN split = 'train' AND client_id = '2' THEN ['width'] WHEN split = 'train' AND client_id = '3' THEN ['not finite', 'count'] ELSE [] END) AS problem FROM n
UNION ALL SELECT 'new', s, 'missing' FROM (SELECT DISTINCT split AS s FROM n) UNION ALL SELECT 'new', NULL, 'no scaler'
UNION ALL SELECT client_id, split, 'unexpected' FROM n WHERE client_id = '4' UNION ALL SELECT DISTINCT client_id, NULL, 'unexpected scaler' FROM n WHERE client_id = '4'""")
def prepared_audit(spark, sf_dir):
    """A stored fleet that was damaged: a split lost, rows cut, rows added that are not finite, a client that nobody wants and one that is not there."""
    path = _fleet(spark, sf_dir)
    rows = spark.read.schema("features array<double>, client_id string, split string").parquet(path)
    on = lambda split, client: (F.col("split") == split) & (F.col("client_id") == client)
    cut = rows.where(~on("cal", "1")).withColumn("features", F.when(on("train", "2"), F.slice("features", 1, WIDTH - 1)).otherwise(F.col("features")))
    more = rows.where(on("train", "3")).withColumn("features", F.transform("features", lambda x: F.lit(float("nan"))))
    damaged = f"{path}-damaged"
    cut.unionByName(more).write.partitionBy("client_id", "split").parquet(damaged)
    ids = rows.select("client_id").distinct().where("client_id <> '4'").unionByName(spark.createDataFrame([("new",)], "client_id string"))
    return prepare.prepared_audit(spark, damaged, ids, WIDTH, recorded=path)


_MARKED = """p AS (SELECT seed, client_id, event_id % 101 = 0 AS other_stage, event_id % 97 = 0 AND seed = 1 AS endless, CASE WHEN seed = 2 THEN event_id % 500 ELSE event_id END AS row_id FROM scores WHERE stage = 'train'),
own AS (SELECT seed, client_id, count(*) FILTER (other_stage) AS o, count(*) FILTER (endless) AS e FROM p GROUP BY ALL),
ids AS (SELECT e.seed, e.client_id, (SELECT count(DISTINCT row_id) FROM p WHERE p.seed = e.seed AND p.client_id <> e.client_id) AS n FROM elig e WHERE status = 'eligible')"""


@query(sql.base("""SELECT a.seed, a.client_id AS victim, 'stage' AS rule, CAST(sum(b.o) AS BIGINT) AS n FROM ids a JOIN own b ON a.seed = b.seed AND a.client_id <> b.client_id GROUP BY ALL HAVING sum(b.o) > 0
UNION ALL SELECT a.seed, a.client_id, 'not finite', CAST(sum(b.e) AS BIGINT) FROM ids a JOIN own b ON a.seed = b.seed AND a.client_id <> b.client_id GROUP BY ALL HAVING sum(b.e) > 0
UNION ALL SELECT seed, client_id, 'too few', n FROM ids WHERE greatest(1, floor(0.2::DOUBLE * n)) < 150
UNION ALL SELECT seed, client_id, 'calibration', count(*) FROM cal WHERE seed = 3 AND pos % 10 = 0 GROUP BY ALL""").replace("\nSELECT a.seed, a.client_id AS victim, 'stage'", ", " + _MARKED + "\nSELECT a.seed, a.client_id AS victim, 'stage'", 1))
def donor_guards(spark, sf_dir):
    """What the guards find in a reservoir with rows of another stage, endless scores, repeated ids and undefined calibration scores."""
    s, n = the_sweep(spark, sf_dir), F.col("event_id")
    train = s.scores.where("stage = 'train'")
    pool = train.select("seed", "client_id", F.when(n % 101 == 0, "test_benign").otherwise(F.col("stage")).alias("stage"), F.when(F.col("seed") == 2, n % 500).otherwise(n).alias("row_id"), F.when((F.col("seed") == 1) & (n % 97 == 0), float("inf")).otherwise(F.col("score")).alias("score"))
    cal = s.cal.select("seed", "client_id", F.when(~((F.col("seed") == 3) & (F.col("pos") % 10 == 0)), F.col("score")).alias("score"))
    return inject.donor_problems(pool, cal, s.clients.select("seed", F.col("client_id").alias("victim"), F.lit(150).alias("most")))
