import numpy as np
import pandas as pd
import pytest

from lendscope.operators import metrics as me


def _scores(seed=0, n=800):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    s = np.round(np.clip(rng.normal(0.35 + 0.3 * y, 0.2), 0, 1), 2)  # many ties
    return pd.DataFrame({"y": y, "s": s})


def _brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    gt = (pos[:, None] > neg[None, :]).sum()
    eq = (pos[:, None] == neg[None, :]).sum()
    return (gt + 0.5 * eq) / (len(pos) * len(neg))


@pytest.mark.parametrize("buckets", [1_000_000, 7])
def test_auc_ties_half(spark, buckets):
    d = _scores()
    df = spark.createDataFrame(d)
    got = me.roc_auc(df, "y", "s", max_bucket_distinct=buckets).first()[0]
    assert abs(got - _brute_auc(d.y.values, d.s.values)) < 1e-12


def test_sweep_matches_brute_force(spark):
    d = _scores(1)
    rows = {r.threshold: r for r in me.threshold_sweep(spark.createDataFrame(d), "y", "s").collect()}
    ts = me.sweep_thresholds()
    assert len(rows) == 80
    best = None
    for t in ts:
        p = (d.s.values >= t).astype(int)
        tp = int(((p == 1) & (d.y == 1)).sum()); fp = int(((p == 1) & (d.y == 0)).sum())
        fn = int(((p == 0) & (d.y == 1)).sum())
        f1 = round(2 * tp / (2 * tp + fp + fn), 4) if tp + fp + fn else 0.0
        r = rows[round(t, 2)]
        assert r.f1 == f1
        if best is None or f1 > best[1]:
            best = (round(t, 2), f1)
    assert me.best_threshold(me.threshold_sweep(spark.createDataFrame(d), "y", "s")) == best[0]


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, p int")
    r = me.classification_metrics(df, "y", "p").first()
    assert (r.f1, r.precision, r.recall, r.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_report_and_confusion(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)], "y int, p int")
    c = me.confusion_counts(df, "y", "p").first()
    assert (c.tn, c.fp, c.fn, c.tp) == (2, 1, 1, 1)
    rep = {r["class"]: r for r in me.classification_report(df, "y", "p").collect()}
    assert rep["Default"].precision == 0.5 and rep["No Default"].recall == round(2 / 3, 4)
    assert rep["accuracy"].f1 == 0.6 and rep["weighted avg"].support == 5


def test_states_of_two_halves_merge_to_the_whole(spark):
    from pyspark.sql import functions as F
    df = spark.range(4000).select(
        "id", F.when(F.col("id") % 97 != 5, F.round(F.abs(F.sin(F.col("id"))), 2)).alias("s"),
        (F.abs(F.sin(F.col("id"))) + F.abs(F.cos(F.col("id") * 3)) / 2 > 0.9).cast("int").alias("y")).persist()
    whole = me.score_state(df, "y", "s")
    merged = me.merge_states(me.score_state(df.where("id < 1500"), "y", "s"), me.score_state(df.where("id >= 1500"), "y", "s"))
    assert sorted(whole.collect(), key=str) == sorted(merged.collect(), key=str) and whole.count() <= 102
    assert me.state_sweep(merged).collect() == me.threshold_sweep(df, "y", "s").collect()
    known = df.where("s IS NOT NULL").withColumn("p", (F.col("s") >= 0.4).cast("int"))
    assert me.state_metrics(merged, 0.4).collect() == me.classification_metrics(known, "y", "p").collect()
    assert me.state_report(merged, 0.4).collect() == me.classification_report(known, "y", "p").collect()
    assert me.state_auc(merged, 7).first()[0] == me.roc_auc(df, "y", "s").first()[0]
    by = me.score_state(df.withColumn("half", F.col("id") < 1500), "y", "s", by="half")
    assert sorted(me.merge_states(by.where("half").drop("half"), by.where("NOT half").drop("half")).collect(), key=str) == sorted(whole.collect(), key=str)
    empty = me.score_state(df.limit(0), "y", "s")
    assert me.state_confusion(empty, 0.5).first() == (0, 0, 0, 0) and me.state_auc(empty).first()[0] is None
