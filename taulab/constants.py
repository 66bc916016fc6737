"""Fixed values of the experiment: names that are sort keys, grids and parameters."""

GLOBAL, LOCAL, CLUSTER = "global_threshold", "local_threshold", "cluster_threshold"
POLICIES = (GLOBAL, LOCAL, CLUSTER)
RAISE, LOWER = "threshold_raise", "threshold_lower"
OBJECTIVES = (LOWER, RAISE)
SOURCES = (
    "high_score_benign",
    "high_score_train_feature_benign",
    "low_score_benign",
    "low_score_targeted_removal_diagnostic_only",
    "random_benign",
    "random_train_feature_benign",
)
#: Valid (source, objective) pairs of the sweep.
PAIRS = (
    ("random_benign", RAISE),
    ("random_benign", LOWER),
    ("high_score_benign", RAISE),
    ("low_score_benign", LOWER),
    ("random_train_feature_benign", RAISE),
    ("high_score_train_feature_benign", RAISE),
)
RANDOM_CONTROLS = ("random_benign", "random_train_feature_benign")
TRAIN_FEATURE_SOURCES = ("random_train_feature_benign", "high_score_train_feature_benign")
CONTROL_OF = {
    "high_score_benign": "random_benign",
    "low_score_benign": "random_benign",
    "high_score_train_feature_benign": "random_train_feature_benign",
}
FRACTIONS = (0.0, 0.1, 0.2, 0.4)
WITH_REPLACEMENT, WITHOUT_REPLACEMENT = "with_replacement", "without_replacement"
DISJOINT, INTERPOLATED = "disjoint_reservoir", "interpolated_tail"

#: Split ratios in order; the rest is the benign test part.
SPLIT = (("train", 0.60), ("gap1", 0.01), ("cal", 0.20), ("gap2", 0.01))
#: Splits of a prepared client.
PREPARED_SPLITS = ("train", "cal", "test_benign", "test_attack")
N_MIN = 100
QUANTILE = 0.95
TAIL_MASS = 0.1
FEATURE_TAIL_MASS = 0.2
MATERIALITY_FACTOR, IQR_FLOOR_FACTOR = 0.1, 0.01
MU_FLAG_DIVISOR = 8.0
SIGN_CONSISTENCY, VICTIM_MAJORITY = 16, 5
TRIM_PRIMARY, TRIM_APPENDIX = 0.05, 0.10
EPS = 1e-12
CLUSTER_K = 3
BOOTSTRAP_RESAMPLES, CI_LEVEL, ANALYSIS_SEED = 10_000, 0.95, 300
GATE_GRID = {"sign": (12, 14, 16, 18, 20), "majority": (3, 4, 5, 6, 7), "materiality": (0.05, 0.1, 0.2), "iqr_floor": (0.005, 0.01, 0.02)}
CONVERGENCE = {"rounds_initial": 40, "rounds_max": 150, "relative_threshold": 0.005, "window": 10}
