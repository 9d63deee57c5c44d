"""Classification metrics as aggregates: confusion cells, F1 / precision /
recall / accuracy (zero division -> 0), exact ROC AUC with ties counted
half, the decision-threshold sweep and the per-class report.

All of them reduce the scored rows with one aggregate; the sweep and AUC
reduce first to small bounded tables (one row per threshold bucket, one row
per distinct score inside a score bucket) before any window runs.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import dbl, safe_div
from ..session import stage
from .profiling import np_round


def sweep_thresholds(start: float = 0.10, stop: float = 0.90, step: float = 0.01) -> list[float]:
    """The cut-offs of an ``arange(start, stop, step)`` sweep, as the exact
    doubles numpy produces (they differ from their 2-digit labels)."""
    return [float(t) for t in np.arange(start, stop, step)]


def confusion_counts(df: DataFrame, label: str, pred: str) -> DataFrame:
    y, p = F.col(label), F.col(pred)
    return df.agg(F.count_if((y == 0) & (p == 0)).alias("tn"),
                  F.count_if((y == 0) & (p == 1)).alias("fp"),
                  F.count_if((y == 1) & (p == 0)).alias("fn"),
                  F.count_if((y == 1) & (p == 1)).alias("tp"))


def _prf(tp, fp, fn):
    precision = safe_div(tp, tp + fp)
    recall = safe_div(tp, tp + fn)
    f1 = safe_div(2 * tp, 2 * tp + fp + fn)
    return f1, precision, recall


def classification_metrics(df: DataFrame, label: str, pred: str, digits: int = 4) -> DataFrame:
    """f1, precision, recall, accuracy of 0/1 predictions."""
    return _metrics_of(confusion_counts(df, label, pred), digits)


def _metrics_of(c: DataFrame, digits: int) -> DataFrame:
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    f1, pr, rc = _prf(tp, fp, fn)
    acc = safe_div(tp + tn, tp + tn + fp + fn)
    return c.select(np_round(f1, digits).alias("f1"), np_round(pr, digits).alias("precision"),
                    np_round(rc, digits).alias("recall"), np_round(acc, digits).alias("accuracy"))


def classification_report(df: DataFrame, label: str, pred: str, names=("No Default", "Default"),
                          digits: int = 4) -> DataFrame:
    """Per class precision / recall / f1 / support, accuracy, macro and
    weighted averages -- built from the four confusion cells."""
    return _report_of(confusion_counts(df, label, pred), names, digits)


def _report_of(c: DataFrame, names, digits: int) -> DataFrame:
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    f1_1, p_1, r_1 = _prf(tp, fp, fn)
    f1_0, p_0, r_0 = _prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    tot = s0 + s1
    acc = safe_div(tp + tn, tot)

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), np_round(p, digits).alias("precision"),
                        np_round(r, digits).alias("recall"), np_round(f, digits).alias("f1"),
                        s.cast("bigint").alias("support"))

    wavg = lambda a, b: safe_div(a * s0 + b * s1, tot)
    rows = [
        row(names[0], p_0, r_0, f1_0, s0),
        row(names[1], p_1, r_1, f1_1, s1),
        row("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, tot),
        row("macro avg", (p_0 + p_1) / 2, (r_0 + r_1) / 2, (f1_0 + f1_1) / 2, tot),
        row("weighted avg", wavg(p_0, p_1), wavg(r_0, r_1), wavg(f1_0, f1_1), tot),
    ]
    return c.select(F.inline(F.array(*rows)))


def _reached(s, ts: list[float]):
    return F.size(F.filter(F.array(*[dbl(t) for t in ts]), lambda t: t <= s))


def threshold_sweep(df: DataFrame, label: str, score: str, thresholds: list[float] | None = None,
                    digits: int = 4) -> DataFrame:
    """(threshold, f1, precision, recall, is_best) per cut-off; prediction is
    score >= cut-off; the best row is the first maximum of rounded F1.

    Rows reduce to counts per bucket b = #cut-offs <= score (<= k+1 rows);
    cumulative sums over those few rows give every cut-off's confusion."""
    ts = sweep_thresholds() if thresholds is None else list(thresholds)
    b = _reached(F.col(score).cast("double"), ts)
    counts = (df.select(b.alias("b"), F.col(label).alias("_y"))
              .groupBy("b").agg(F.count_if(F.col("_y") == 1).alias("pos"),
                                F.count_if(F.col("_y") == 0).alias("neg")))
    return _sweep_of(counts, ts, digits)


def _sweep_of(counts: DataFrame, ts: list[float], digits: int) -> DataFrame:
    """The sweep from (b, pos, neg): rows by how many cut-offs their score reaches."""
    k, spark = len(ts), counts.sparkSession
    arr = F.array(*[dbl(t) for t in ts])
    frame = spark.range(0, k + 1).select(F.col("id").cast("int").alias("b"))
    full = frame.join(counts, "b", "left").fillna(0, ["pos", "neg"])
    # <= k+1 rows: a bounded single-task window
    suffix = Window.orderBy(F.desc("b")).rowsBetween(Window.unboundedPreceding, 0)
    tot = Window.partitionBy(F.lit(1))
    cum = full.select("b", F.sum("pos").over(suffix).alias("tp"), F.sum("neg").over(suffix).alias("fp"),
                      F.sum("pos").over(tot).alias("P"))
    tp, fp = F.col("tp"), F.col("fp")
    fn = F.col("P") - tp
    f1, pr, rc = _prf(tp, fp, fn)
    out = (cum.where(F.col("b") >= 1)
           .select((F.col("b") - 1).alias("i"),
                   np_round(F.element_at(arr, F.col("b")), 2).alias("threshold"),
                   np_round(f1, digits).alias("f1"), np_round(pr, digits).alias("precision"),
                   np_round(rc, digits).alias("recall")))
    best = Window.orderBy(F.desc("f1"), "i")
    return out.withColumn("is_best", F.row_number().over(best) == 1).drop("i")


def best_threshold(sweep: DataFrame) -> float:
    return sweep.where("is_best").first()["threshold"]


def roc_auc(df: DataFrame, label: str, score: str, max_bucket_distinct: int = 1_000_000) -> DataFrame:
    """Exact ROC AUC (Mann-Whitney, ties count half) without a global sort.

    1. combine rows per distinct score (map-side partial count);
    2. split distinct scores into B buckets at approximate quantiles (a
       bounded sketch); negatives of lower buckets come from a <= B row
       cumulative table;
    3. inside a bucket a window over its distinct scores (bounded) gives the
       negatives below each score."""
    return state_auc(score_state(df, label, score), max_bucket_distinct)


# ---------------------------------------------------------------- score-curve state
def score_state(df: DataFrame, label: str, score: str, by: str | None = None) -> DataFrame:
    """(s, pos, neg), written: positives and negatives of each distinct score, all
    that the sweep, the confusion cells, the report and the AUC need. With ``by`` one
    scan makes the states of all its values."""
    keys = [by] if by else []
    rows = df.select(*keys, F.col(score).cast("double").alias("s"), F.col(label).alias("_y"))
    return rows.groupBy(*keys, "s").agg(F.count_if(F.col("_y") == 1).alias("pos"), F.count_if(F.col("_y") == 0).alias("neg")).transform(stage)


def merge_states(one: DataFrame, other: DataFrame) -> DataFrame:
    """The state of both inputs' rows together; neither input is scanned again."""
    keys = [c for c in one.columns if c not in ("pos", "neg")]
    return one.unionByName(other).groupBy(*keys).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).transform(stage)


def state_sweep(state: DataFrame, thresholds: list[float] | None = None, digits: int = 4) -> DataFrame:
    ts = sweep_thresholds() if thresholds is None else list(thresholds)
    counts = state.groupBy(_reached(F.col("s"), ts).alias("b")).agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return _sweep_of(counts, ts, digits)


def state_confusion(state: DataFrame, threshold: float) -> DataFrame:
    """Confusion cells of ``score >= threshold``; rows without a score are in none."""
    hit = F.col("s") >= dbl(threshold)

    def cell(c, where):
        return F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0))
    return state.agg(cell("neg", ~hit).alias("tn"), cell("neg", hit).alias("fp"), cell("pos", ~hit).alias("fn"), cell("pos", hit).alias("tp"))


def state_metrics(state: DataFrame, threshold: float, digits: int = 4) -> DataFrame:
    return _metrics_of(state_confusion(state, threshold), digits)


def state_report(state: DataFrame, threshold: float, names=("No Default", "Default"), digits: int = 4) -> DataFrame:
    return _report_of(state_confusion(state, threshold), names, digits)


def state_auc(state: DataFrame, max_bucket_distinct: int = 1_000_000) -> DataFrame:
    """``roc_auc`` from a state."""
    per = state.where(F.col("s").isNotNull()).select("s", F.col("pos").cast("double").alias("pos"), F.col("neg").cast("double").alias("neg"))
    nd = per.count()
    nb = max(1, math.ceil(nd / max_bucket_distinct))
    if nb > 1:
        cuts = per.agg(F.percentile_approx("s", [i / nb for i in range(1, nb)], 10000)).first()[0]
        cuts = sorted(set(cuts))
        carr = F.array(*[dbl(c) for c in cuts])
        per_b = per.withColumn("bk", F.size(F.filter(carr, lambda c: c <= F.col("s"))))
    else:
        per_b = per.withColumn("bk", F.lit(0))
    btot = per_b.groupBy("bk").agg(F.sum("neg").alias("bneg"))
    boff = btot.select("bk", F.coalesce(F.sum("bneg").over(
        Window.orderBy("bk").rowsBetween(Window.unboundedPreceding, -1)), dbl(0)).alias("off"))
    w = Window.partitionBy("bk").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    within = per_b.withColumn("below", F.coalesce(F.sum("neg").over(w), dbl(0)))
    # boff has at most B rows (proven bound): broadcast it
    joined = within.join(F.broadcast(boff), "bk")
    contrib = F.col("pos") * (F.col("off") + F.col("below") + dbl(0.5) * F.col("neg"))
    res = joined.agg(F.sum(contrib).alias("u"), F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return res.select(F.try_divide(F.col("u"), F.col("P") * F.col("N")).alias("roc_auc"))
