import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lendscope.operators import profiling as pr


def _pdf(seed=0, n=500):
    rng = np.random.default_rng(seed)
    d = pd.DataFrame({"a": np.round(rng.normal(50, 10, n), 2), "b": rng.integers(0, 9, n).astype(float),
                      "c": np.round(rng.exponential(3, n), 3)})
    d.loc[::17, "c"] = np.nan
    return d


def test_statistics_match_pandas(spark):
    d = _pdf()
    df = spark.createDataFrame(d).withColumn("c", F.when(F.isnan("c"), None).otherwise(F.col("c")))
    rep = {r.column: r for r in pr.statistics_report(df, ["a", "b", "c"]).collect()}
    desc = d.describe().T
    for col in ("a", "b", "c"):
        r = rep[col]
        assert r["count"] == desc.loc[col, "count"]
        assert abs(r["mean"] - round(desc.loc[col, "mean"], 4)) < 1e-9
        assert abs(r["std"] - round(desc.loc[col, "std"], 4)) < 1e-9
        assert r["p25"] == round(desc.loc[col, "25%"], 4)
        assert r["p75"] == round(desc.loc[col, "75%"], 4)
        assert abs(r["skewness"] - round(d[col].skew(), 4)) <= 1e-4
        assert abs(r["kurtosis"] - round(d[col].kurt(), 4)) <= 1e-4
        assert r["missing"] == d[col].isna().sum()


def test_constant_column_moments(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (1.0,), (1.0,)], "x double")
    r = pr.statistics_report(df, ["x"]).first()
    assert r.skewness == 0.0 and r.kurtosis == 0.0 and r.std == 0.0


def test_histogram_matches_numpy(spark):
    d = _pdf(1)
    df = spark.createDataFrame(d[["a", "b"]])
    h = pr.histogram(df, ["a", "b"], bins=50).toPandas()
    for col in ("a", "b"):
        counts, edges = np.histogram(d[col], bins=50)
        got = h[h.column == col].sort_values("bin")
        assert list(got["count"]) == list(counts)
        assert np.allclose(got["bin_lo"], edges[:-1], rtol=0, atol=0)


def test_histogram_constant_column(spark):
    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    h = pr.histogram(df, ["x"], bins=4).toPandas().sort_values("bin")
    counts, _ = np.histogram([3.0, 3.0], bins=4)
    assert list(h["count"]) == list(counts)


def test_correlation_pairwise_complete(spark):
    d = _pdf(2)
    df = spark.createDataFrame(d).withColumn("c", F.when(F.isnan("c"), None).otherwise(F.col("c")))
    m = {(r.col_a, r.col_b): r.corr for r in pr.correlation_matrix(df, ["a", "b", "c"]).collect()}
    ref = d.corr().round(4)
    for a in "abc":
        for b in "abc":
            assert abs(m[(a, b)] - ref.loc[a, b]) <= 1e-4


def test_outliers_and_box(spark):
    v = np.concatenate([np.arange(100, dtype=float), [500.0, -300.0]])
    df = spark.createDataFrame(pd.DataFrame({"x": v}))
    r = pr.outlier_report(df, ["x"]).first()
    q1, q3 = np.quantile(v, [0.25, 0.75])
    assert r.outlier_count == 2 and r.q1 == round(q1, 4)
    b = pr.box_statistics(df, ["x"]).first()
    assert b.whisker_lo == 0.0 and b.whisker_hi == 99.0 and b.n_fliers == 2


def test_outcome_rate_drops_null_category(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), (None, 1), ("b", 1)], "region string, is_default int")
    got = {(r.column, r.value): r.default_rate for r in pr.outcome_rate_by_category(df, ["region"]).collect()}
    assert got == {("region", "a"): 0.5, ("region", "b"): 1.0}


def test_np_round_half_even(spark):
    vals = [0.12345, 2.5e-05, 1.00005, -0.00015, 0.9999500000000001]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r[0] for r in df.select(pr.np_round(F.col("x"), 4)).collect()]
    assert got == [float(np.round(v, 4)) for v in vals]


def test_correlations_of_many_columns_with_nulls_are_one_gramian(spark):
    rng = np.random.default_rng(4)
    n, p = 300, 400
    X = rng.normal(0, 1, (n, p)).cumsum(axis=1) + rng.normal(0, 1e4, p)  # neighbours go together, far from zero
    X[rng.random((n, p)) < 0.2] = np.nan
    X[:, 0] = 7.0  # constant
    X[:, 1] = np.where(np.arange(n) < 2, X[:, 2], np.nan)  # two rows
    X[:, 3] = np.where(np.arange(n) < 150, 5e6, rng.normal(0, 1, n))  # constant where column 4 is present
    X[:, 4] = np.where(np.arange(n) < 150, rng.normal(0, 1, n), np.nan)
    pdf = pd.DataFrame(X, columns=[f"c{i}" for i in range(p)])
    df = spark.createDataFrame([tuple(None if v != v else float(v) for v in r) for r in X], ", ".join(f"c{i} double" for i in range(p)))
    got = pr.correlation_matrix(df, list(pdf.columns), digits=6).toPandas().pivot(index="col_a", columns="col_b", values="corr")
    want = pdf.corr(min_periods=2)
    a, b = got.loc[pdf.columns, pdf.columns].to_numpy(float), want.to_numpy()
    np.fill_diagonal(a, 0), np.fill_diagonal(b, 0)
    free = np.ones((p, p), bool)
    free[3, 4] = free[4, 3] = False
    assert np.isnan(a[3, 4]) and np.isnan(a[0, 1:]).all()
    assert (np.isnan(a) == np.isnan(b))[free].all() and np.nanmax(np.abs(a - b)[free]) < 2e-6


def test_bin_indices_follow_the_column_expression(spark):
    from lendscope.functions.expressions import hist_bin
    rng = np.random.default_rng(2)
    for lo, hi, bins in ((0.1, 0.7, 7), (-3.0, 1e9, 50), (5.5, 6.5, 40), (1e-12, 3e-12, 50)):
        x = np.concatenate([[lo, hi], lo + (hi - lo) * np.arange(1, bins) / bins, rng.uniform(lo, hi, 500)])
        x = np.clip(np.concatenate([x, np.nextafter(x, lo), np.nextafter(x, hi)]), lo, hi)
        df = spark.createDataFrame(pd.DataFrame({"x": x}))
        want = df.select("x", hist_bin(F.col("x"), F.lit(lo), F.lit(hi), bins).alias("b")).toPandas()
        got = pr.bin_indices(want["x"].to_numpy(), np.full(len(x), lo), np.full(len(x), hi), bins)
        assert (got == want["b"].to_numpy()).all()


def test_histogram_counts_every_group_alike(spark, monkeypatch):
    rows = [(g, float(x), None if x % 3 else float(-x)) for g in (1, 2, None) for x in range(40)] + [(2, None, 7.0)]
    df = spark.createDataFrame(rows, "g long, a double, b double")
    key = ["column", "g", "bin"]
    sent = pr.histogram(df, ["a", "b"], 8, by="g").orderBy(*key).collect()
    monkeypatch.setattr(pr, "MAX_GROUPS", 1)
    assert sent == pr.histogram(df, ["a", "b"], 8, by="g").orderBy(*key).collect()
    assert sum(r["count"] for r in sent) == 2 * 40 + 2 * 14 + 1
