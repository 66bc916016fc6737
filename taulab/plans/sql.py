"""The queries' equivalents in DuckDB's SQL, built from common table expressions."""

from __future__ import annotations

from taulab.constants import CONTROL_OF, FRACTIONS, LOWER, PAIRS, RAISE, RANDOM_CONTROLS, SOURCES

N_MIN = 175

BASE = """
ev AS (
  SELECT event_id, 'c' || CAST(user_id % 9 AS VARCHAR) AS client_id, event_type = 'error' AS attack,
         value + CASE WHEN event_type = 'error' THEN CAST(40 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS raw
  FROM events WHERE value IS NOT NULL AND isfinite(value) AND user_id IS NOT NULL AND event_type IS NOT NULL
), benign AS (
  SELECT client_id, event_id, raw, row_number() OVER (PARTITION BY client_id ORDER BY event_id) - 1 AS r, count(*) OVER (PARTITION BY client_id) AS n FROM ev WHERE NOT attack
), cuts AS (
  SELECT *, floor(n * CAST(0.6 AS DOUBLE)) AS b1, floor(n * CAST(0.01 AS DOUBLE)) AS g, floor(n * CAST(0.2 AS DOUBLE)) AS c FROM benign
), staged AS (
  SELECT client_id, event_id, raw,
    CASE WHEN r < b1 THEN 'train' WHEN r < b1 + g THEN 'gap1' WHEN r < b1 + g + c THEN 'cal' WHEN r < b1 + g + c + g THEN 'gap2' ELSE 'test_benign' END AS stage,
    CAST(CASE WHEN r < b1 THEN r WHEN r < b1 + g THEN r - b1 WHEN r < b1 + g + c THEN r - b1 - g WHEN r < b1 + g + c + g THEN r - b1 - g - c ELSE r - b1 - g - c - g END AS BIGINT) AS pos
  FROM cuts
  UNION ALL
  SELECT client_id, event_id, raw, 'test_attack', row_number() OVER (PARTITION BY client_id ORDER BY event_id) - 1 FROM ev WHERE attack
), scores AS (
  SELECT seed, client_id, stage, pos, event_id, raw * (1 + CAST(0.01 AS DOUBLE) * ((event_id * 31 + seed * 17) % 7)) AS score
  FROM staged CROSS JOIN (SELECT unnest(range(5)) AS seed)
), elig AS (
  SELECT seed, client_id, count(*) FILTER (stage = 'cal') AS n_cal, CASE WHEN count(*) FILTER (stage = 'cal') >= N_MIN_ROWS THEN 'eligible' ELSE 'calibration_pending' END AS status,
         count(*) FILTER (stage = 'test_benign') AS n_benign, count(*) FILTER (stage = 'test_attack') AS n_attack
  FROM scores GROUP BY seed, client_id
), cal AS (
  SELECT s.seed, s.client_id, pos, score FROM scores s JOIN elig e ON s.seed = e.seed AND s.client_id = e.client_id WHERE stage = 'cal' AND status = 'eligible'
), taus AS (SELECT seed, client_id, quantile_cont(score, 0.95) AS tau FROM cal GROUP BY seed, client_id),
tau_global AS (SELECT seed, avg(tau) AS tau_global, count(*) AS n_eligible FROM taus GROUP BY seed),
thr AS (
  SELECT e.seed, p.policy, e.client_id, e.status, CASE p.policy WHEN 'global_threshold' THEN tau_global ELSE coalesce(tau, tau_global) END AS tau
  FROM elig e JOIN tau_global g ON e.seed = g.seed LEFT JOIN taus t ON e.seed = t.seed AND e.client_id = t.client_id
  CROSS JOIN (VALUES ('global_threshold'), ('local_threshold')) AS p(policy)
), conf AS (
  SELECT t.seed, t.policy, t.client_id, t.status, t.tau, count(*) FILTER (stage = 'test_benign' AND score > t.tau) AS fp, count(*) FILTER (stage = 'test_attack' AND score > t.tau) AS tp,
         count(*) FILTER (stage = 'test_benign') AS nb, count(*) FILTER (stage = 'test_attack') AS na
  FROM thr t JOIN scores s ON t.seed = s.seed AND t.client_id = s.client_id GROUP BY ALL
), rates AS (
  SELECT *, nb - fp AS tn, na - tp AS fn, CASE WHEN nb > 0 THEN fp / nb END AS fpr, CASE WHEN na > 0 THEN tp / na END AS tpr,
    CASE WHEN nb > 0 THEN (nb - fp) / nb END AS tnr, CASE WHEN na > 0 THEN (na - tp) / na END AS fnr,
    CASE WHEN nb > 0 AND na > 0 THEN (tp / na + (nb - fp) / nb) / 2 END AS balanced_accuracy,
    CASE WHEN nb > 0 AND na > 0 THEN CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END END AS precision,
    CASE WHEN nb > 0 AND na > 0 THEN (coalesce(2.0 * (nb - fp) / nullif(2 * (nb - fp) + (na - tp) + fp, 0), 0) + coalesce(2.0 * tp / nullif(2 * tp + fp + (na - tp), 0), 0)) / 2 END AS macro_f1
  FROM conf
), fleet AS (
  SELECT seed, policy,
    CASE WHEN count(*) FILTER (status = 'eligible') >= 2 AND avg(fpr) FILTER (status = 'eligible') <> 0 THEN stddev_pop(fpr) FILTER (status = 'eligible') / avg(fpr) FILTER (status = 'eligible') END AS cv_fpr,
    avg(fpr) FILTER (status = 'eligible') AS mean_fpr, stddev_samp(fpr) FILTER (status = 'eligible') AS std_fpr,
    quantile_cont(fpr, 0.75) FILTER (status = 'eligible') - quantile_cont(fpr, 0.25) FILTER (status = 'eligible') AS iqr_fpr,
    max(fpr) FILTER (status = 'eligible') - min(fpr) FILTER (status = 'eligible') AS max_min_fpr, max(fpr) FILTER (status = 'eligible') AS worst_client_fpr,
    CASE WHEN avg(tpr) FILTER (status = 'eligible' AND na > 0) <> 0 THEN stddev_pop(tpr) FILTER (status = 'eligible' AND na > 0) / avg(tpr) FILTER (status = 'eligible' AND na > 0) END AS cv_tpr,
    quantile_cont(tpr, 0.75) FILTER (status = 'eligible' AND na > 0) - quantile_cont(tpr, 0.25) FILTER (status = 'eligible' AND na > 0) AS iqr_tpr,
    min(balanced_accuracy) FILTER (status = 'eligible' AND na > 0) AS min_balanced_accuracy, quantile_cont(macro_f1, 0.1) FILTER (status = 'eligible' AND na > 0) AS p10_macro_f1,
    count(*) FILTER (status = 'eligible') AS n_eligible, count(*) AS n_clients, count(*) FILTER (status = 'eligible') / count(*) AS coverage_ratio
  FROM rates GROUP BY seed, policy
)""".replace("N_MIN_ROWS", str(N_MIN))

_PAIR_ROWS = ", ".join(f"('{s}', '{o}', {SOURCES.index(s) * 2000 + (LOWER, RAISE).index(o) * 1000})" for s, o in PAIRS)
_FRACTION_ROWS = ", ".join(f"(CAST({f} AS DOUBLE))" for f in FRACTIONS)
_ORDER = "((({0} + 1) * 7919 + ({1} + 1) * 104729 + (seed + 1) * 15485863) % 1000003)"

CELLS = f"""
cf AS (
  SELECT seed, client_id, quantile_cont(score, 0.95) AS tau, quantile_cont(score, 0.75) - quantile_cont(score, 0.25) AS iqr, min(score) AS cal_min, max(score) AS cal_max,
         1 - count(DISTINCT score) / count(*) AS dup, count(*) AS n_cal
  FROM cal GROUP BY seed, client_id
), cl AS (
  SELECT cf.*, n_benign, n_attack, avg(tau) OVER w AS tau_global, count(*) OVER w AS n_eligible, median(iqr) OVER w AS iqr_median,
         (SELECT count(*) FROM elig x WHERE x.seed = cf.seed) AS n_total
  FROM cf JOIN elig USING (seed, client_id) WINDOW w AS (PARTITION BY cf.seed)
), cells AS (
  SELECT seed, client_id AS victim, source, objective, fraction, stream, stream + CAST(round_even(fraction * 1000, 0) AS BIGINT) AS child
  FROM cl CROSS JOIN (VALUES {_PAIR_ROWS}) AS p(source, objective, stream) CROSS JOIN (VALUES {_FRACTION_ROWS}) AS f(fraction)
), ranked AS (
  SELECT seed, client_id, pos, score, row_number() OVER (PARTITION BY seed, client_id ORDER BY score, pos) - 1 AS r, count(*) OVER (PARTITION BY seed, client_id) AS n FROM cal
), tails AS (SELECT *, greatest(1, CAST(floor(CAST(0.1 AS DOUBLE) * n) AS BIGINT)) AS t FROM ranked),
pools AS (
  SELECT 'random_benign' AS source, seed, client_id, pos, score, r AS pool_index, n AS pool_n FROM tails
  UNION ALL SELECT 'high_score_benign', seed, client_id, pos, score, r - n + t, t FROM tails WHERE r >= n - t
  UNION ALL SELECT 'low_score_benign', seed, client_id, pos, score, r, t FROM tails WHERE r < t
), hits AS (
  SELECT * FROM (
    SELECT c.*, k.pos, k.score AS clean_score, k.n, row_number() OVER (PARTITION BY c.seed, victim, source, objective, fraction ORDER BY (((k.pos + 1) * 7919 + (child + 1) * 104729 + (c.seed + 1) * 15485863) % 1000003), k.pos) AS k,
           greatest(1, CAST(round_even(fraction * n, 0) AS BIGINT)) AS m
    FROM cells c JOIN tails k ON c.seed = k.seed AND c.victim = k.client_id WHERE fraction > 0)
), donor_rank AS (
  SELECT v.seed, v.client_id AS victim, s.event_id, s.score, row_number() OVER (PARTITION BY v.seed, v.client_id ORDER BY s.score DESC, s.event_id) AS r, count(*) OVER (PARTITION BY v.seed, v.client_id) AS n
  FROM cl v JOIN scores s ON s.seed = v.seed AND s.client_id <> v.client_id AND s.stage = 'train'
), gifts AS (
  SELECT seed, victim, source, score, event_id, row_number() OVER (PARTITION BY seed, victim, source ORDER BY {_ORDER.format('event_id', 'stream')}, event_id) AS draw
  FROM donor_rank CROSS JOIN (VALUES {", ".join(f"('{s}', {SOURCES.index(s) * 2000 + 1000})" for s in ("random_train_feature_benign", "high_score_train_feature_benign"))}) AS p(source, stream)
  WHERE source = 'random_train_feature_benign' OR r <= greatest(1, floor(CAST(0.2 AS DOUBLE) * n))
), poisoned AS (
  SELECT h.seed, h.victim, h.source, h.objective, h.fraction, h.pos, h.clean_score, h.k <= h.m AS replaced,
         CASE WHEN h.k > h.m THEN h.clean_score ELSE coalesce(g.score, p.score) END AS score, g.event_id AS donor_id
  FROM hits h
  LEFT JOIN gifts g ON g.seed = h.seed AND g.victim = h.victim AND g.source = h.source AND g.draw = h.k AND h.k <= h.m
  LEFT JOIN (SELECT DISTINCT source, seed, client_id, pool_n FROM pools) z ON z.source = h.source AND z.seed = h.seed AND z.client_id = h.victim
  LEFT JOIN pools p ON p.source = h.source AND p.seed = h.seed AND p.client_id = h.victim AND p.pool_index = (h.k * 48271 + h.child * 13 + h.seed * 7) % z.pool_n AND h.k <= h.m
), moved AS (
  SELECT seed, victim, source, objective, fraction, quantile_cont(score, 0.95) AS tau_p, 1 - count(DISTINCT score) / count(*) AS dup_p, count(*) FILTER (replaced) AS n_replaced, count(DISTINCT donor_id) / nullif(count(donor_id), 0) AS donor_unique FROM poisoned GROUP BY ALL
), shifts AS (
  SELECT c.seed, c.victim, c.source, c.objective, c.fraction, f.tau AS tau_c, coalesce(m.tau_p, f.tau) AS tau_p, coalesce(m.n_replaced, 0) AS n_replaced, f.dup AS dup_c, coalesce(m.dup_p, f.dup) AS dup_p, f.cal_min, f.cal_max, m.donor_unique
  FROM cells c JOIN cf f ON c.seed = f.seed AND c.victim = f.client_id LEFT JOIN moved m ON m.seed = c.seed AND m.victim = c.victim AND m.source = c.source AND m.objective = c.objective AND m.fraction = c.fraction
)"""

FACTS = """
each AS (
  SELECT s.seed, s.victim, s.source, s.objective, s.fraction, l.client_id, l.tau AS lc, CASE WHEN l.client_id = s.victim THEN s.tau_p ELSE l.tau END AS lp, l.tau_global AS gc,
         iqr AS base, iqr_median, n_benign, n_attack, n_eligible, n_total
  FROM shifts s JOIN cl l ON s.seed = l.seed
), both_taus AS (
  SELECT *, CASE WHEN fraction = 0 THEN gc ELSE avg(lp) OVER (PARTITION BY seed, victim, source, objective, fraction) END AS gp FROM each
), ct AS (
  SELECT seed, victim, source, objective, fraction, client_id, base, iqr_median, n_benign, n_attack, n_eligible, n_total, 'global_threshold' AS policy, gc AS tc, gp AS tp FROM both_taus
  UNION ALL SELECT seed, victim, source, objective, fraction, client_id, base, iqr_median, n_benign, n_attack, n_eligible, n_total, 'local_threshold', lc, lp FROM both_taus
), wanted AS (SELECT DISTINCT seed, client_id, unnest([tc, tp]) AS tau FROM ct),
counted AS (
  SELECT w.seed, w.client_id, w.tau, count(*) FILTER (stage = 'test_benign' AND score > w.tau) AS fp, count(*) FILTER (stage = 'test_attack' AND score > w.tau) AS tp
  FROM wanted w JOIN scores s ON s.seed = w.seed AND s.client_id = w.client_id GROUP BY ALL
), eff AS (
  SELECT ct.*, a.fp AS fp_c, a.tp AS tp_c, b.fp AS fp_p, b.tp AS tp_p FROM ct
  JOIN counted a ON a.seed = ct.seed AND a.client_id = ct.client_id AND a.tau = ct.tc JOIN counted b ON b.seed = ct.seed AND b.client_id = ct.client_id AND b.tau = ct.tp
), er AS (
  SELECT *, client_id = victim AS is_v, tp - tc AS delta, fp_c / n_benign AS fpr_c, fp_p / n_benign AS fpr_p, tp_c / n_attack AS tpr_c, tp_p / n_attack AS tpr_p,
    (tp_c / n_attack + 1 - fp_c / n_benign) / 2 AS ba_c, (tp_p / n_attack + 1 - fp_p / n_benign) / 2 AS ba_p,
    (coalesce(2.0 * (n_benign - fp_c) / nullif(2 * (n_benign - fp_c) + n_attack - tp_c + fp_c, 0), 0) + coalesce(2.0 * tp_c / nullif(2 * tp_c + fp_c + n_attack - tp_c, 0), 0)) / 2 AS f1_c,
    (coalesce(2.0 * (n_benign - fp_p) / nullif(2 * (n_benign - fp_p) + n_attack - tp_p + fp_p, 0), 0) + coalesce(2.0 * tp_p / nullif(2 * tp_p + fp_p + n_attack - tp_p, 0), 0)) / 2 AS f1_p
  FROM eff
), em AS (
  SELECT *, abs(delta) >= greatest(0.1::DOUBLE * base, 0.01::DOUBLE * iqr_median) AS material,
    CASE WHEN objective = 'threshold_raise' THEN tpr_p < tpr_c OR ba_p - ba_c < 0 OR f1_p - f1_c < 0 ELSE fpr_p > fpr_c END AS worse FROM er
), facts AS (
  SELECT t.*, dup_c AS cal_duplicate_rate_clean, dup_p AS cal_duplicate_rate_poisoned, n_replaced,
    CASE WHEN t.objective = 'threshold_raise' THEN CASE WHEN cal_max - tau_clean > 0 THEN delta_tau / (cal_max - tau_clean) END ELSE CASE WHEN tau_clean - cal_min > 0 THEN -delta_tau / (tau_clean - cal_min) END END AS delta_tau_bound_utilization
  FROM (
    SELECT seed, victim, source, objective, fraction, policy, max(delta) FILTER (is_v) AS delta_tau, max(tc) FILTER (is_v) AS tau_clean, bool_or(material) FILTER (is_v) AS is_victim_significant,
      max(base) FILTER (is_v) AS scale_base, max(iqr_median) AS iqr_median, count(*) FILTER (NOT is_v AND material) AS n_blast_significant, count(*) FILTER (NOT is_v AND worse) AS n_spillover, count(*) FILTER (NOT is_v) AS n_non_victims,
      max(n_eligible) AS n_eligible, max(n_total) AS n_total,
      stddev_pop(fpr_c) / nullif(avg(fpr_c), 0) AS cv_c, stddev_pop(fpr_p) / nullif(avg(fpr_p), 0) AS cv_p, avg(fpr_c) AS mean_c, avg(fpr_p) AS mean_p,
      quantile_cont(fpr_c, 0.75) - quantile_cont(fpr_c, 0.25) AS iqr_c, quantile_cont(fpr_p, 0.75) - quantile_cont(fpr_p, 0.25) AS iqr_p, max(fpr_c) - min(fpr_c) AS mm_c, max(fpr_p) - min(fpr_p) AS mm_p, max(fpr_c) AS w_c, max(fpr_p) AS w_p,
      max(tpr_p - tpr_c) FILTER (is_v) AS victim_delta_tpr, max(fpr_p - fpr_c) FILTER (is_v) AS victim_delta_fpr, max(ba_p - ba_c) FILTER (is_v) AS victim_delta_ba, max(f1_p - f1_c) FILTER (is_v) AS victim_delta_macro_f1,
      max(fp_c) FILTER (is_v) AS victim_fp_clean, max(fp_p) FILTER (is_v) AS victim_fp_poisoned,
      avg(tpr_p - tpr_c) FILTER (NOT is_v) AS nonvictim_mean_delta_tpr, min(tpr_p - tpr_c) FILTER (NOT is_v) AS nonvictim_worst_delta_tpr, avg(fpr_p - fpr_c) FILTER (NOT is_v) AS nonvictim_mean_delta_fpr, max(fpr_p - fpr_c) FILTER (NOT is_v) AS nonvictim_worst_delta_fpr,
      avg(ba_p - ba_c) FILTER (NOT is_v) AS nonvictim_mean_delta_ba, avg(f1_p - f1_c) FILTER (NOT is_v) AS nonvictim_mean_delta_macro_f1, CAST(sum(fp_p - fp_c) FILTER (NOT is_v) AS BIGINT) AS nonvictim_delta_fp_total
    FROM em GROUP BY ALL) t JOIN shifts USING (seed, victim, source, objective, fraction)
), f AS (
  SELECT *, cv_p - cv_c AS delta_cv_fpr, mean_p - mean_c AS delta_mean_fpr, iqr_p - iqr_c AS delta_iqr_fpr, mm_p - mm_c AS delta_max_min_fpr, w_p - w_c AS delta_worst_client_fpr,
    CASE WHEN objective = 'threshold_raise' THEN delta_tau ELSE -delta_tau END AS signed
  FROM facts
)"""

CONTROLS = ", ".join(f"('{a}', '{b}')" for a, b in CONTROL_OF.items())
RANDOM = ", ".join(f"'{x}'" for x in RANDOM_CONTROLS)
K = "policy, objective, source, fraction"


def base(select: str) -> str:
    return f"WITH {BASE}\n{select}"


def cells(select: str) -> str:
    return f"WITH {BASE}, {CELLS}\n{select}"


def facts(select: str, more: str = "") -> str:
    return f"WITH {BASE}, {CELLS}, {FACTS}{', ' + more if more else ''}\n{select}"
