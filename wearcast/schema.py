"""Column names, feature order and the fixed values the results depend on."""

from __future__ import annotations

KEY = "obs_id"

# Feature groups, in the order features are used and saved.
SENSOR_FEATURES = ["volt", "rotate", "pressure", "vibration"]
OPERATIONAL_FEATURES = ["model", "age", "error_count"]
MAINTENANCE_FEATURES = [
    "days_since_comp1_maint",
    "days_since_comp2_maint",
    "days_since_comp3_maint",
    "days_since_comp4_maint",
]
FEATURE_ORDER = SENSOR_FEATURES + OPERATIONAL_FEATURES + MAINTENANCE_FEATURES
CATEGORICAL_FEATURES = ["model"]

# Targets, in order; columns present in the data but never used.
TARGETS = ["ttf_comp1_weeks", "ttf_comp2_weeks", "ttf_comp3_weeks", "ttf_comp4_weeks"]
EXCLUDED = ["machineID", "failure_within_48h"]

# Label of a missing or unseen category.
UNKNOWN = "unknown"

# Stratum parts (labels in bin order) and the placeholder texts.
TTF_RANGE_LABELS = ["very_short", "short", "medium", "long"]
AGE_GROUP_LABELS = ["new", "young", "mature", "old"]
ERROR_LEVEL_LABELS = ["low", "medium", "high"]
STRATUM_MISSING = "nan"
STRATUM_ABSENT = "default"

# Texts a CSV reader treats as missing (pandas defaults).
CSV_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
# Request texts that mean "missing" (compared lower-cased).
REQUEST_NA_TOKENS = ["nan", "null", "none"]

# Plain decimal or scientific number, the only texts accepted as numbers.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"

# Component status by floor weeks (first matching rule wins;
# the first rule is an equality, so a negative floor is URGENT).
STATUS_CRITICAL, STATUS_URGENT, STATUS_SOON, STATUS_NORMAL, STATUS_GOOD = (
    "CRITICAL", "URGENT", "SOON", "NORMAL", "GOOD")
URGENT_MAX_WEEKS = 2
SOON_MAX_WEEKS = 4
NORMAL_MAX_WEEKS = 8

# Maintenance recommendation (title, detail) by minimum floor.
RECOMMENDATIONS = {
    "critical": ("IMMEDIATE maintenance required!",
                 "Stop operations and inspect immediately"),
    "urgent": ("URGENT: Schedule maintenance within 2 weeks",
               "Prioritize this machine in maintenance schedule"),
    "soon": ("Schedule maintenance within 1 month",
             "Monitor closely and prepare maintenance"),
    "normal": ("Normal maintenance schedule (within 2 months)",
               "Continue regular monitoring"),
    "good": ("Machine in good condition",
             "Follow standard maintenance schedule"),
}

# Component priority.
PRIORITY_HIGH, PRIORITY_MEDIUM, PRIORITY_LOW = "HIGH", "MEDIUM", "LOW"

# Guidance text for numerical features in the feature catalog.
GUIDANCE = {
    "volt": "Voltage reading",
    "rotate": "Rotation speed",
    "pressure": "Pressure reading",
    "vibration": "Vibration level",
    "age": "Machine age in years",
    "error_count": "Recent error count",
}

# The example request and the value for any other feature.
EXAMPLE_VALUES = {
    "volt": 168.5, "rotate": 415.2, "pressure": 98.7, "vibration": 45.3,
    "age": 150, "error_count": 2,
    "days_since_comp1_maint": 15, "days_since_comp2_maint": 8,
    "days_since_comp3_maint": 22, "days_since_comp4_maint": 12,
}
EXAMPLE_DEFAULT = 100.0
EXAMPLE_MODEL_FALLBACK = "model1"

# Sampling and evaluation parameters.
SAMPLE_SIZE = 200_000
SEED = 42
TEST_FRACTION = 0.2
SHORT_TERM_WEEKS = 10
SAMPLE_SHOWN = 8
TOP_K_FEATURES = 5

# The boosted-tree hyperparameters of the reference model.
REFERENCE_PARAMS = {
    "n_estimators": 500,
    "learning_rate": 0.05,
    "max_depth": 8,
    "min_child_weight": 2,
    "subsample": 0.9,
    "colsample_bytree": 0.8,
    "colsample_bylevel": 0.8,
    "reg_alpha": 0.1,
    "reg_lambda": 1.0,
    "gamma": 0.1,
    "random_state": 42,
    "n_jobs": -1,
    "tree_method": "hist",
    "objective": "reg:squarederror",
    "eval_metric": "rmse",
}

MODEL_VERSION = "wearcast-1.0"

# Log column names.
LOG_SUMMARY_COLUMNS = ["min_ttf_weeks", "avg_ttf_weeks", "max_ttf_weeks", "critical_components"]


def floor_col(target: str) -> str:
    return f"{target}_floor"


def exact_col(target: str) -> str:
    return f"{target}_exact"


def pred_col(target: str) -> str:
    """Prediction column of a target, e.g. ``pred_comp1_weeks``."""
    return "pred_" + target[len("ttf_"):] if target.startswith("ttf_") else f"pred_{target}"


def component_name(target: str) -> str:
    """``ttf_comp1_weeks`` -> ``COMP1``."""
    return target.replace("ttf_", "").replace("_weeks", "").upper()


def available(columns, wanted):
    """Members of ``wanted`` present in ``columns``, in ``wanted`` order."""
    have = set(columns)
    return [c for c in wanted if c in have]
