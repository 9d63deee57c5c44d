"""Column expressions shared by the operators. All are built-in Spark
functions, so they stay inside whole-stage codegen."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import OUTCOME_TEXT, RATIO_EPSILON, TIER_HIGH, TIER_MEDIUM, TIER_NAMES

Rule = Callable[[Column], Column]

# The range rules of the cleaning step (value -> null when true).
DEFAULT_RULES: dict[str, Rule] = {
    "annual_income": lambda x: x < 0,
    "credit_score": lambda x: (x < 300) | (x > 850),
    "age": lambda x: x < 18,
}


def dbl(x: float) -> Column:
    return F.lit(float(x))


def null_count_expr(cols: list[str]) -> Column:
    """Number of null cells in a row over ``cols``."""
    if not cols:
        return F.lit(0)
    return sum((F.col(c).isNull().cast("int") for c in cols[1:]),
               F.col(cols[0]).isNull().cast("int"))


def coerce_int(c: str) -> Column:
    """Unparseable -> null -> 0, then truncate toward zero."""
    return F.coalesce(F.col(c).try_cast("double"), dbl(0)).cast("bigint")


def coerce_float(c: str) -> Column:
    return F.col(c).try_cast("double")


def coerce_string(c: str) -> Column:
    # NULL stays NULL (the text 'nan' is not reproduced on purpose).
    return F.col(c).cast("string")


def guarded_ratio(num: Column, den: Column) -> Column:
    return num / (den + dbl(RATIO_EPSILON))


# The seven interaction features (name -> expression).
def interaction_exprs() -> dict[str, Column]:
    c = F.col
    return {
        "debt_x_loan": c("debt_to_income") * c("loan_to_income"),
        "income_per_loan": guarded_ratio(c("annual_income"), c("loan_amount")),
        "score_x_dti": c("credit_score") * c("debt_to_income"),
        "savings_to_loan": guarded_ratio(c("savings_balance"), c("loan_amount")),
        "late_x_dti": c("num_late_payments") * c("debt_to_income"),
        "age_x_income": c("age") * c("annual_income"),
        "loan_burden": guarded_ratio(c("loan_amount"), c("annual_income") + c("savings_balance")),
    }


def risk_tier(prob: Column) -> Column:
    high, medium, low = TIER_NAMES
    return (F.when(prob >= dbl(TIER_HIGH), high)
            .when(prob >= dbl(TIER_MEDIUM), medium)
            .otherwise(low))


def outcome_text(pred: Column) -> Column:
    return F.when(pred == 1, OUTCOME_TEXT[1]).otherwise(OUTCOME_TEXT[0])


def decision(prob: Column, threshold: float) -> Column:
    return (prob >= dbl(threshold)).cast("int")


def safe_div(num: Column, den: Column) -> Column:
    """0 when the denominator is 0 (``zero_division=0``)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), dbl(0))


def hist_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin index of ``x`` for ``bins`` equal bins on [lo, hi], last bin
    closed, assigned exactly against the bin edges lo + i*(hi-lo)/bins (the
    edges a histogram plot draws). A constant column (hi == lo) uses the
    unit range [lo - 0.5, lo + 0.5]."""
    lo_ = F.when(hi == lo, lo - dbl(0.5)).otherwise(lo)
    hi_ = F.when(hi == lo, hi + dbl(0.5)).otherwise(hi)
    step = (hi_ - lo_) / dbl(bins)

    def edge(i: Column) -> Column:
        return F.when(i >= bins, hi_).otherwise(i.cast("double") * step + lo_)

    raw = ((x - lo_) * (dbl(bins) / (hi_ - lo_))).cast("int")
    raw = F.when(raw >= bins, F.lit(bins - 1)).otherwise(raw)
    fixed = F.when(x < edge(raw), raw - 1).otherwise(raw)
    fixed = F.when((x >= edge(fixed + 1)) & (fixed != bins - 1), fixed + 1).otherwise(fixed)
    return fixed


def bin_edge(i: Column, lo: Column, hi: Column, bins: int) -> Column:
    lo_ = F.when(hi == lo, lo - dbl(0.5)).otherwise(lo)
    hi_ = F.when(hi == lo, hi + dbl(0.5)).otherwise(hi)
    step = (hi_ - lo_) / dbl(bins)
    return F.when(i >= bins, hi_).otherwise(i.cast("double") * step + lo_)
