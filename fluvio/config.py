"""Parameters and fixed values.

Values in the "fixed values" block must equal the ones the original
forecast service uses, otherwise results differ. Everything else is a
parameter with a default.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# Fixed values (must match the original service for equal results)
# ---------------------------------------------------------------------------
METEO_COLUMNS = [
    "u2_min", "u2_max", "tmin_min", "tmin_max", "tmax_min", "tmax_max",
    "rs_min", "rs_max", "rh_min", "rh_max", "eto_min", "eto_max", "pr_min", "pr_max",
]
FEATURE_COLUMNS = METEO_COLUMNS + [
    "month_sin", "month_cos", "y_lag1", "y_lag2", "y_lag3", "y_rm3",
    "pr_lag1", "pr_lag2", "pr_lag3", "pr_sum3", "pr_api3",
]
REQUEST_FEATURES = METEO_COLUMNS + [
    "y_lag1", "y_lag2", "y_lag3", "y_rm3",
    "pr_lag1", "pr_lag2", "pr_lag3", "pr_sum3", "pr_api3",
]
LEGACY_FEATURE_COLUMNS = ["year", "month"] + METEO_COLUMNS + ["y_lag1", "y_lag2", "y_lag3"]
TARGET_A = "flow_next_month"
TARGET_B = "flow_next_month_max"
TARGET_MIN = "flow_next_month_min"
COMPLETE_CASE_COLUMNS = METEO_COLUMNS + [
    TARGET_A, TARGET_B, TARGET_MIN, "year", "month",
    "y_lag1", "y_lag2", "y_lag3", "y_rm3",
    "pr_mean", "pr_lag1", "pr_lag2", "pr_lag3", "pr_sum3", "pr_api3",
]

WET_MONTHS = (11, 12, 1, 2)
GATE_WET, GATE_DRY = 0.3, 0.7
DISAGREEMENT_WET, DISAGREEMENT_DRY = 0.22, 0.08
SEASON_FACTOR_WET, SEASON_FACTOR_DRY = 1.0, 0.75
API_WEIGHTS = (0.5, 0.3, 0.2)
LEARNER_WEIGHTS = (0.5, 0.5)
LEGACY_LEARNER_WEIGHTS = (0.6, 0.4)
MAD_SCALE = 1.4826
FENCE_K = 1.5
OBS_WIDTH_FLOOR = 1e-6
REL_WIDTH_EPS = 1e-6
TARGET_COVERAGE = 0.83
TARGET_REL_WIDTH = 1.10
REL_WIDTH_WEIGHT = 0.2
WIDTH_RATIO_CAP = 1.05
WIDTH_RATIO_PENALTY = 0.15
SCALE_FIXED = 1.258
SCALE_SERVING_DEFAULT = 1.2
SIGMA_DEFAULT = 15.0
SERVING_DISAGREEMENT = 10.0
LEGACY_SIGMA_WET, LEGACY_SIGMA_DRY = 15.0, 10.0
NOMINAL_CONFIDENCE = 0.83
REQUEST_YEAR_MIN, REQUEST_YEAR_MAX = 1998, 2030
RISK_LOW_COVERAGE, RISK_LOW_ABS_PBIAS, RISK_MEDIUM_COVERAGE = 0.8, 5.0, 0.7
RISK_LABELS = ("low", "medium", "high")
SCALE_GRID_MIN, SCALE_GRID_MAX, SCALE_GRID_STEP = 0.5, 3.0, 0.001
REFERENCE_SPLITS = {"train": (1998, 2017), "val": (2018, 2019), "test": (2020, 2023)}
# ---------------------------------------------------------------------------

#: Label of this library's own models in run rows.
MODEL_VERSION = "fluvio-2"

# The driver tables span 1995-01 .. 2001-11, so the fixture split is shifted.
FIXTURE_SPLITS = {"train": (1995, 1998), "val": (1999, 1999), "test": (2000, 2001)}


@dataclass(frozen=True)
class Splits:
    """Inclusive year ranges of the temporal split."""

    train: tuple[int, int] = FIXTURE_SPLITS["train"]
    val: tuple[int, int] = FIXTURE_SPLITS["val"]
    test: tuple[int, int] = FIXTURE_SPLITS["test"]

    @classmethod
    def reference(cls) -> "Splits":
        r = REFERENCE_SPLITS
        return cls(r["train"], r["val"], r["test"])


@dataclass(frozen=True)
class TreeParams:
    """Boosted-tree learner (I2). Defaults are the original's 900 rounds."""

    max_iter: int = 900
    learning_rate: float = 0.02
    max_depth: int = 5
    subsampling_rate: float = 0.9
    feature_subset: str = "0.9"
    seed_a: int = 42
    seed_b: int = 43
    segment: int = 50  # rounds that are fitted, saved and checkpointed together
    patience: int | None = None  # rounds without a better held-out error that end the fit; None = all rounds


@dataclass(frozen=True)
class NetParams:
    """Scaled learner (I3): linear regression with an L2 penalty."""

    reg_param: float = 2e-3
    max_iter: int = 3000


@dataclass(frozen=True)
class LegacyParams:
    """Legacy trainer (I8)."""

    reg_param: float = 1e-3
    net_max_iter: int = 1000
    tree_rounds: int = 200
    tree_depth: int = 6
    tree_rate: float = 0.1
    patience: int = 20
    partitions: int | None = None  # None = the cluster's parallelism
    subsampling_rate: float = 0.8
    holdout_pct: int = 80
    weights: tuple[float, float] = LEGACY_LEARNER_WEIGHTS


@dataclass(frozen=True)
class TrainConfig:
    splits: Splits = field(default_factory=Splits)
    tree: TreeParams | None = field(default_factory=TreeParams)  # None = the scaled learners alone
    partitions: int | None = None  # None = the cluster's parallelism
    net: NetParams = field(default_factory=NetParams)
    scale: float | None = None  # None = search (I10); a number = fixed (TS 1.258 / FM 1.2)
    calibration_split: str = "test"  # "test" = parity (in-sample), "val" = sound
