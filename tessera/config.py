"""Panel and model settings.

Every operator takes its column names and constants as parameters; the values
below are only the defaults. Names are matched case-insensitively against the
DataFrame (Spark resolves columns that way), and only columns present in the
input are used, so the same operators run on any panel schema.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# These must equal the reference pipeline's settings for the
# results to agree. Kept together, in the reference's natural order.
# ---------------------------------------------------------------------------

VITAL_SIGNS = ["HR", "Temp", "SBP", "DBP", "MAP", "Resp", "O2Sat"]

LAB_VALUES = ["WBC", "Lactate", "pH", "HCO3", "BaseExcess", "PaCO2",
              "Creatinine", "BUN", "Bilirubin_total", "Platelets"]

EXCLUDE_COLS = {"SepsisLabel", "Patient_ID", "Unit1", "Unit2", "Unnamed: 0", "Hour"}

CATEGORICAL_COLS = ["Gender"]

# Clip (winsorise) ranges per measure, (low, high).
NORMAL_RANGES = {
    "HR": (60.0, 100.0), "Temp": (36.0, 37.5), "SBP": (90.0, 140.0),
    "DBP": (60.0, 90.0), "Resp": (12.0, 20.0), "O2Sat": (95.0, 100.0),
    "pH": (7.35, 7.45), "Lactate": (0.5, 2.2), "WBC": (4.0, 11.0),
}

# Deterioration score: one point per measure outside (low, high), strict
# comparisons; None means that side is not checked.
DETERIORATION_RULES = [
    ("HR", 60.0, 90.0),
    ("Temp", 36.0, 38.0),
    ("Resp", None, 20.0),
    ("WBC", 4.0, 12.0),
]

# Constant lab defaults used by the advanced imputation; labs not listed fall
# back to their global median.
LAB_DEFAULTS = {
    "WBC": 7.0, "Lactate": 1.5, "pH": 7.4, "HCO3": 24.0,
    "Creatinine": 1.0, "BUN": 15.0, "Platelets": 250.0,
}

TIME_WINDOW = 6
CV_FOLDS = 5
TEST_SIZE = 0.2
RANDOM_STATE = 42

# Risk levels of a probability: >= 0.8 HIGH, >= 0.5 MEDIUM, else LOW.
RISK_HIGH = 0.8
RISK_MEDIUM = 0.5
# Confidence bands used by the report tables: < 0.3 low, > 0.7 high.
BAND_LOW = 0.3
BAND_HIGH = 0.7
# Thresholds of the evaluation and report tables.
EVAL_THRESHOLDS = [0.1, 0.2, 0.3, 0.5]
COMPARE_THRESHOLDS = [0.3, 0.5, 0.7]
# Sweep 0.10 .. 0.90 in steps of 0.05, as integer percents (exact doubles).
SWEEP_PERCENTS = list(range(10, 95, 5))
# Agreement level of an explanation: std < 0.1 High, < 0.2 Medium, else Low.
AGREEMENT_HIGH = 0.1
AGREEMENT_MEDIUM = 0.2
PREDICTION_LOG_CAP = 10_000
N_BASE_MODELS = 6
META_WIDTH = 51

# Learner settings of the reference (mapped onto Spark ML in learners.py).
XGBOOST_PARAMS = {
    "n_estimators": 500, "learning_rate": 0.01, "max_depth": 8,
    "subsample": 0.85, "colsample_bytree": 0.85, "reg_lambda": 3.0,
    "reg_alpha": 0.2, "scale_pos_weight": 4, "early_stopping_rounds": 50,
}


@dataclass(frozen=True)
class PanelSpec:
    """Column roles of a panel (entity x time) table."""

    entity: str = "patient_id"
    time: str = "hour"
    tie: str | None = "event_id"
    label: str | None = "label"
    vitals: tuple = tuple(VITAL_SIGNS)
    labs: tuple = tuple(LAB_VALUES)
    ranges: dict = field(default_factory=lambda: dict(NORMAL_RANGES))
    lab_defaults: dict = field(default_factory=lambda: dict(LAB_DEFAULTS))
    exclude: frozenset = frozenset(x.lower() for x in EXCLUDE_COLS)

    @property
    def measures(self) -> list:
        return list(self.vitals) + list(self.labs)

    def order_cols(self) -> list:
        return [self.time] + ([self.tie] if self.tie else [])


def present(df_columns, names) -> list:
    """Names from ``names`` that exist in ``df_columns`` (case-insensitive),
    returned with the DataFrame's own spelling, in ``names`` order."""
    lookup = {c.lower(): c for c in df_columns}
    out = []
    for n in names:
        c = lookup.get(n.lower())
        if c is not None and c not in out:
            out.append(c)
    return out


def lookup_ci(mapping: dict, name: str):
    """Case-insensitive dict lookup."""
    low = {k.lower(): v for k, v in mapping.items()}
    return low.get(name.lower())
