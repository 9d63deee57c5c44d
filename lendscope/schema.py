"""Column catalogue of the applicant table and the fixed column lists the
operators default to. Every operator takes these as parameters; the lists
below are only the defaults.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# These lists must equal the behaviour being reproduced
# (column groups of the applicant pipeline), in their natural order.
# ---------------------------------------------------------------------------

# Type groups used by type coercion.
INT_COLS = [
    "age", "credit_score", "num_credit_lines", "num_late_payments",
    "loan_term_months", "months_employed", "num_dependents",
    "has_cosigner", "num_prev_loans",
]
FLOAT_COLS = [
    "annual_income", "monthly_income", "savings_balance",
    "investment_balance", "loan_amount", "interest_rate",
    "monthly_payment", "debt_to_income", "loan_to_income",
    "credit_util_rate", "employment_years",
]
STR_COLS = [
    "education_level", "marital_status", "region",
    "employment_type", "loan_purpose", "property_type",
]

# Imputation groups (median for numeric, mode for categorical).
IMPUTE_NUMERIC_COLS = [
    "age", "employment_years", "months_employed", "annual_income",
    "monthly_income", "savings_balance", "investment_balance",
    "credit_score", "num_credit_lines", "num_late_payments",
    "credit_util_rate", "loan_amount", "loan_term_months",
    "interest_rate", "monthly_payment", "debt_to_income",
    "loan_to_income", "num_dependents", "has_cosigner", "num_prev_loans",
]
IMPUTE_CATEGORICAL_COLS = list(STR_COLS)

# Profiling groups.
STATS_COLS = list(IMPUTE_NUMERIC_COLS)
CORR_COLS = [
    "age", "employment_years", "annual_income", "monthly_income",
    "savings_balance", "investment_balance", "credit_score",
    "num_credit_lines", "num_late_payments", "credit_util_rate",
    "loan_amount", "loan_term_months", "interest_rate",
    "monthly_payment", "debt_to_income", "loan_to_income",
    "num_dependents", "num_prev_loans", "has_cosigner",
]  # followed by the outcome column
DIST_COLS = [
    "age", "employment_years", "annual_income", "monthly_income",
    "savings_balance", "investment_balance", "credit_score",
    "num_credit_lines", "num_late_payments", "credit_util_rate",
    "loan_amount", "loan_term_months", "interest_rate",
    "monthly_payment", "debt_to_income", "loan_to_income",
    "num_dependents", "num_prev_loans",
]
OUTLIER_COLS = list(DIST_COLS)
TARGET_CATEGORICAL_COLS = list(STR_COLS)
TARGET_NUMERIC_COLS = [
    "age", "credit_score", "annual_income", "debt_to_income",
    "loan_amount", "interest_rate", "num_late_payments",
    "employment_years", "credit_util_rate", "loan_to_income",
]

# Feature building.
HIGH_CORRELATION_DROP = ["monthly_income", "months_employed", "monthly_payment"]
LOW_SIGNAL_DROP = [
    "employment_years", "num_dependents", "num_prev_loans",
    "credit_util_rate", "interest_rate", "num_credit_lines",
]
FEATURE_DROP_COLS = HIGH_CORRELATION_DROP + LOW_SIGNAL_DROP
ONE_HOT_COLS = ["education_level", "employment_type"]
LABEL_COLS = ["region", "marital_status", "property_type", "loan_purpose"]
SCALE_COLS = [
    "annual_income", "savings_balance", "investment_balance",
    "loan_amount", "debt_to_income", "loan_to_income",
]
# Guard added to divisors of the ratio features.
RATIO_EPSILON = 1e-9

# Histogram bin counts and IQR multiplier.
HIST_BINS = 50
CLASS_HIST_BINS = 40
IQR_MULTIPLIER = 1.5
SPARSE_COLUMN_THRESHOLD = 0.50

# Scoring: risk tier cut-offs and outcome texts.
TIER_HIGH = 0.70
TIER_MEDIUM = 0.40
TIER_NAMES = ("High", "Medium", "Low")
OUTCOME_TEXT = {0: "No Default", 1: "Default"}

# Split / sampling defaults.
SEED = 42
TEST_SIZE = 0.15
VAL_SIZE = 0.15
SMOTE_RATIO = 0.40
SMOTE_K = 5
BENCH_SAMPLE_FRAC = 0.20
HOLDOUT_TEST_SIZE = 0.20
CV_FOLDS = 5

# ---------------------------------------------------------------------------
# The applicant table as produced by the driver-table view (28 columns).
# The outcome column is ``is_default`` there (``default`` is a SQL keyword).
# ---------------------------------------------------------------------------
ID_COL = "application_id"
TARGET_COL = "is_default"

APPLICATION_COLUMNS = [
    "application_id", "age", "education_level", "marital_status",
    "num_dependents", "region", "employment_type", "employment_years",
    "months_employed", "monthly_income", "savings_balance",
    "investment_balance", "num_credit_lines", "num_late_payments",
    "credit_util_rate", "loan_purpose", "loan_amount", "loan_term_months",
    "interest_rate", "property_type", "has_cosigner", "num_prev_loans",
    "monthly_payment", "loan_to_income", "is_default", "annual_income",
    "credit_score", "debt_to_income",
]


def application_schema() -> T.StructType:
    """Explicit schema of the applicant table (no inference anywhere)."""
    fields = []
    for c in APPLICATION_COLUMNS:
        if c in STR_COLS:
            t = T.StringType()
        elif c in FLOAT_COLS:
            t = T.DoubleType()
        else:
            t = T.LongType()
        fields.append(T.StructField(c, t, True))
    return T.StructType(fields)
