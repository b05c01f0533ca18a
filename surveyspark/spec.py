"""Configuration: one frozen dataclass, two presets, and fixed schemas.

Operators take a :class:`SurveySpec` instead of hard-coding column names, so
the child-survey layout and the driver-table layout are two instances of the
same code.  Column names are lower-case; Spark resolves them
case-insensitively, so upper-case input columns work unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the survey conventions the reference uses;
# they are stated here once, in natural order.
# ---------------------------------------------------------------------------

# Sentinel codes meaning "not applicable / missing / don't know".
MISSING_CODES: tuple[int, ...] = (9996, 9997, 9998, 9999, 99996, 99997, 99998, 99999)

# Growth-standard cut: z strictly below -2.0 is a positive label.
Z_THRESHOLD: float = -2.0
# Physiological z bounds, inclusive.
Z_MIN: float = -6.0
Z_MAX: float = 6.0
# Birth weight bounds in grams, inclusive.
BIRTH_WEIGHT_MIN: int = 500
BIRTH_WEIGHT_MAX: int = 5000
# Minimum acceptable rows after cleaning.
MIN_VALID_ROWS: int = 190_000
# Default split.
TEST_SIZE: float = 0.20
RANDOM_STATE: int = 42
CV_FOLDS: int = 5
# Fairness tolerance on the false-negative rate.
FNR_TOLERANCE: float = 0.15
# Duplicate tolerance of the soft/hard gate.
MAX_DUPLICATES: int = 100

# Codebook: column -> {code: label}.
CODEBOOK: dict[str, dict[int, str]] = {
    "b4": {1: "male", 2: "female"},
    "v025": {1: "urban", 2: "rural"},
    "v106": {0: "no_education", 1: "primary", 2: "secondary", 3: "higher"},
    "hv201": {
        10: "piped_on_premises", 11: "piped_on_premises",
        12: "piped_to_neighbour", 13: "public_tap",
        20: "tube_well", 21: "tube_well",
        30: "dug_well", 31: "protected_well", 32: "unprotected_well",
        40: "surface_water", 41: "surface_water",
        51: "rainwater", 61: "tanker", 71: "bottled_water",
        96: "other",
    },
    "hv205": {
        10: "flush_piped", 11: "flush_septic", 12: "flush_pit",
        13: "flush_open", 14: "flush_unknown",
        20: "pit_ventilated", 21: "pit_with_slab", 22: "pit_without_slab",
        30: "composting", 31: "composting",
        41: "hanging_toilet", 42: "bucket_toilet",
        96: "other", 99: "unknown",
    },
}

# Education text -> ordinal used by the deprivation index.
EDUCATION_ORDINAL: dict[str, int] = {"no_education": 0, "primary": 1, "secondary": 2, "higher": 3}
# Improved sanitation and water categories (anything else, or missing, is deprived).
IMPROVED_SANITATION: tuple[str, ...] = (
    "flush_piped", "flush_septic", "flush_pit", "pit_ventilated", "pit_with_slab", "composting",
)
IMPROVED_WATER: tuple[str, ...] = (
    "piped_on_premises", "piped_to_neighbour", "public_tap", "tube_well",
    "protected_well", "bottled_water", "rainwater",
)

# Display text of the caste/tribe group codes, and of a missing or unlisted code.
GROUP_CODE_LABELS: dict[int, str] = {
    1: "Scheduled Caste (SC)", 2: "Scheduled Tribe (ST)", 3: "OBC", 4: "None / Other",
}
MISSING_CODE_TEXT: str = "NaN (not collected)"
OTHER_CODE_TEXT: str = "Other code"

# Candidate names of the caste/tribe group column, first match wins.
GROUP_CANDIDATES: tuple[str, ...] = ("v131", "s116", "sh46", "v130")

# Prevalence bands: (label, lo, hi), inclusive.  Two published presets.
BANDS_STRICT: tuple[tuple[str, float, float], ...] = (
    ("stunted", 0.30, 0.42), ("underweight", 0.30, 0.35), ("wasted", 0.17, 0.22),
)
BANDS_BROAD: tuple[tuple[str, float, float], ...] = (
    ("stunted", 0.30, 0.42), ("underweight", 0.27, 0.38), ("wasted", 0.15, 0.25),
)

# Published national prevalence (for the measured-vs-published table).
PUBLISHED_PREVALENCE: dict[str, float] = {"stunted": 0.355, "underweight": 0.321, "wasted": 0.193}

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

AUDIT_LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("dataset", T.StringType(), False),
    T.StructField("step", T.StringType(), False),
    T.StructField("column_affected", T.StringType(), True),
    T.StructField("issue_found", T.StringType(), True),
    T.StructField("action_taken", T.StringType(), True),
    T.StructField("rows_affected", T.LongType(), False),
    T.StructField("validation_result", T.StringType(), False),
    T.StructField("analyst_notes", T.StringType(), True),
])

GATE_SCHEMA = T.StructType([
    T.StructField("section", T.StringType(), False),
    T.StructField("seq", T.IntegerType(), False),
    T.StructField("gate", T.StringType(), False),
    T.StructField("status", T.StringType(), False),       # PASS / FAIL / INFO
    T.StructField("actual", T.DoubleType(), True),
    T.StructField("lo", T.DoubleType(), True),            # inclusive bounds; null = unbounded
    T.StructField("hi", T.DoubleType(), True),
])

BENCHMARK_SCHEMA = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("label", T.StringType(), False),
    T.StructField("recall", T.DoubleType(), True),
    T.StructField("precision", T.DoubleType(), True),
    T.StructField("f1", T.DoubleType(), True),
    T.StructField("roc_auc", T.DoubleType(), True),
    T.StructField("n_test", T.LongType(), True),
])


@dataclass(frozen=True)
class SurveySpec:
    """All parameters of the cleaning / labelling / audit chain."""

    id_col: str = "id"
    raw_z: tuple[str, ...] = ("hw70", "hw71", "hw72")
    z_cols: tuple[str, ...] = ("haz", "waz", "whz")
    targets: tuple[str, ...] = ("stunted", "underweight", "wasted")
    missing_codes: tuple[int, ...] = MISSING_CODES
    z_scale: float = 100.0
    z_threshold: float = Z_THRESHOLD
    z_min: float = Z_MIN
    z_max: float = Z_MAX
    clip_col: str = "m19"
    clip_lo: float = BIRTH_WEIGHT_MIN
    clip_hi: float = BIRTH_WEIGHT_MAX
    codebook: dict = field(default_factory=lambda: CODEBOOK)
    wealth_col: str = "hv270"
    education_col: str = "v106"
    toilet_col: str = "hv205"
    water_col: str = "hv201"
    group_candidates: tuple[str, ...] = GROUP_CANDIDATES
    bands: tuple[tuple[str, float, float], ...] = BANDS_STRICT
    min_rows: int = MIN_VALID_ROWS
    max_duplicates: int = MAX_DUPLICATES
    test_size: float = TEST_SIZE
    seed: int = RANDOM_STATE
    stratify_col: str = "stunted"
    fnr_tolerance: float = FNR_TOLERANCE
    # Columns never imputed besides z, targets and the detected group column.
    protected: tuple[str, ...] = ()

    @property
    def z_map(self) -> dict[str, str]:
        return dict(zip(self.raw_z, self.z_cols))

    @property
    def label_map(self) -> dict[str, str]:
        return dict(zip(self.z_cols, self.targets))

    def with_(self, **kw) -> "SurveySpec":
        return replace(self, **kw)


CHILD_SURVEY = SurveySpec()
# The driver tables have no caste column; the customer segment stands in as the
# protected group column, and the row-count floor is a parameter of the gates.
DRIVER_TABLES = SurveySpec(group_candidates=("segment",), min_rows=10_000)
