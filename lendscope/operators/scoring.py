"""Scoring: probability -> decision, risk tier, outcome text, rounded
probability and score stamp, plus the score report. One ``score_frame`` is
used for batch tables and for the stream (``streaming.scoring``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import dbl, decision, outcome_text, risk_tier
from ..schema import TIER_NAMES
from .profiling import np_round

# Coefficients of the rule-based baseline scorecard (a
# deterministic score used when no trained model is involved).
SCORECARD = {"num_late_payments": 0.05, "debt_to_income": 0.6, "score_pivot": 700.0,
             "score_scale": 1000.0, "intercept": 0.1}


def scorecard_probability() -> Column:
    c = SCORECARD
    raw = (dbl(c["num_late_payments"]) * F.col("num_late_payments")
           + dbl(c["debt_to_income"]) * F.col("debt_to_income")
           + (F.lit(int(c["score_pivot"])) - F.col("credit_score")).cast("double") / dbl(c["score_scale"])
           + dbl(c["intercept"]))
    return F.least(F.greatest(raw, dbl(0)), dbl(1))


def score_frame(df: DataFrame, prob: Column, threshold: float, stamp: bool = True) -> DataFrame:
    """Adds default_prob (4 digits, half to even), prediction (unrounded
    prob >= threshold), risk_tier and label (outcome text), scored_at."""
    out = df.withColumn("_p", prob).withColumns({
        "default_prob": np_round(F.col("_p"), 4),
        "prediction": decision(F.col("_p"), threshold),
        "risk_tier": risk_tier(F.col("_p")),
    })
    out = out.withColumn("label", outcome_text(F.col("prediction")))
    if stamp:
        out = out.withColumn("scored_at", F.current_timestamp())
    return out.drop("_p")


def score_report(scored: DataFrame) -> DataFrame:
    high, medium, low = TIER_NAMES
    t = F.col("risk_tier")
    return scored.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.col("prediction").cast("double")).alias("default_rate"),
        np_round(F.avg("default_prob"), 4).alias("avg_default_prob"),
        F.count_if(t == high).alias("n_high"),
        F.count_if(t == medium).alias("n_medium"),
        F.count_if(t == low).alias("n_low"),
    )


class ScorecardPlan:
    """The scorecard in the place of a trained plan, over the inputs as they come."""

    def __init__(self, threshold: float = 0.5):
        self.threshold = threshold

    def score(self, df: DataFrame, keep: list[str], stamp: bool = True) -> DataFrame:
        out = score_frame(df, scorecard_probability(), self.threshold, stamp)
        return out.select(*keep, "default_prob", "prediction", "risk_tier", "label", *(["scored_at"] if stamp else []))
