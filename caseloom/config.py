"""Fixed values of the workflow and the small dimensions built from them."""

from __future__ import annotations

# --- Fixed values -------------------------------------------------------------------------
# Closed categorical domains of the applications table.
DOMAINS = {
    "payment_type": ["AA", "AB", "AC", "AD", "AE"],
    "employment_status": ["CA", "CB", "CC", "CD", "CE", "CF", "CG"],
    "housing_status": ["BA", "BB", "BC", "BD", "BE", "BF", "BG"],
    "source": ["INTERNET", "TELEAPP"],
    "device_os": ["linux", "macintosh", "other", "windows", "x11"],
}
LABEL = "fraud_bool"
TIMESTAMP = "month"
PROTECTED = "customer_age"
OLD_AGE = 50

# Half-open month spans of the alert model; the last two overlap on purpose.
MODEL_SPANS = {"train": (0, 3), "validation": (3, 4), "deployment": (3, 8)}
# Month spans of the alert table.
ALERT_SPANS = {"train": (3, 6), "validation": (6, 7), "test": (7, 8)}

COSTS = [0.0114, 0.057, 0.285]
SUBSAMPLE_COSTS = [0.057]
ALERT_RATES = [0.05, 0.15]
DATA_RATE = 0.05
SUBSAMPLES = [0.50, 0.25]
SAMPLE_SEED = 42
KEEP_WHOLE_MONTH = 7

# Offsets added to the training log-odds when the classifier is swept.
OFFSET_STEPS = 10
OFFSET_WIDTH = 0.2

# Search spaces: (low, high, log scale).
ALERT_SPACE = {
    "trials": 100,
    "max_depth": (2, 20, False),
    "learning_rate": (0.01, 0.5, True),
    "n_estimators": (50, 5000, True),
    "num_leaves": (10, 1000, True),
    "min_child_samples": (5, 500, True),
    "reg_alpha": (0.0001, 0.1, True),
    "reg_lambda": (0.0001, 0.1, True),
}
CLASSIFIER_SPACES = [
    {
        "trials": 300,
        "max_depth": (2, 5, False),
        "learning_rate": (0.001, 1.0, False),
        "n_estimators": (50, 250, False),
        "num_leaves": (100, 1000, False),
        "min_child_samples": (5, 200, False),
        "reg_alpha": (0.001, 2.0, False),
        "reg_lambda": (0.001, 2.0, False),
    },
    {
        "trials": 1700,
        "max_depth": (2, 2, False),
        "learning_rate": (0.001, 1.0, False),
        "n_estimators": (50, 250, False),
        "num_leaves": (100, 1000, False),
        "min_child_samples": (5, 200, False),
        "reg_alpha": (0.001, 2.0, False),
        "reg_lambda": (0.001, 2.0, False),
    },
]
EXPERT_SPACE = {
    "trials": 120,
    "max_depth": (2, 20, False),
    "learning_rate": (0.005, 0.5, True),
    "n_estimators": (50, 250, False),
    "num_leaves": (100, 1000, True),
    "min_child_samples": (5, 100, True),
    "reg_alpha": (0.0001, 0.1, True),
    "reg_lambda": (0.0001, 0.1, True),
}

# Attributes every evaluated run carries.
RUN_BATCH_SIZE = 4457
RUN_BATCH_SEED = 1
RUN_DEFERRAL_RATE = 0.9
RUN_POOL = "standard"
RUN_VARIABLE_STD = "0.2"
# ------------------------------------------------------------------------------------------


def scenario_name(alert_rate: float, sub: float | None = None) -> str:
    """``alert_0.15-data_0.05`` or, for a training share, ``alert_0.15-data_0.05-sub_0.50``."""
    name = f"alert_{alert_rate:.2f}-data_{DATA_RATE:.2f}"
    return name if sub is None else f"{name}-sub_{sub:.2f}"


def scenarios() -> list[tuple[str, float, float]]:
    """All (scenario, alert rate, training share) triples of the configured grid."""
    return [
        (scenario_name(rate, sub), rate, 1.0 if sub is None else sub)
        for rate in ALERT_RATES
        for sub in (None, *SUBSAMPLES)
    ]


def scenario_costs() -> list[tuple[str, float, float, float]]:
    """Scenarios joined to the costs they run under: shares below 1 run under few costs only."""
    return [
        (name, rate, sub, cost)
        for name, rate, sub in scenarios()
        for cost in COSTS
        if sub == 1.0 or cost in SUBSAMPLE_COSTS
    ]
