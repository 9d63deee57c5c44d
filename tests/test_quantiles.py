import numpy as np
import pandas as pd
import pytest

from lendscope.functions.quantiles import exact_quantiles


def _frame(spark, values):
    return spark.createDataFrame(pd.DataFrame({"x": values}))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101, 1000])
def test_linear_matches_numpy(spark, n):
    rng = np.random.default_rng(n)
    v = np.round(rng.normal(100, 30, n), 2)
    q = exact_quantiles(_frame(spark, v), ["x"], [0.25, 0.5, 0.75])
    for p in (0.25, 0.5, 0.75):
        assert q[("x", p)] == np.quantile(v, p)


def test_midpoint_matches_pandas_median(spark):
    v = np.array([1.0, 2.0, 4.0, 7.0, 11.0, 0.5])
    q = exact_quantiles(_frame(spark, v), ["x"], [0.5], mode="midpoint")
    assert q[("x", 0.5)] == pd.Series(v).median()


def test_nulls_skipped_and_all_null(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (3.0, None)], "x double, y double")
    q = exact_quantiles(df, ["x", "y"], [0.5])
    assert q[("x", 0.5)] == 2.0
    assert q[("y", 0.5)] is None


def test_bracketing_path_is_exact(spark):
    # force the sketch / narrowing rounds with a tiny distinct-value bound
    rng = np.random.default_rng(7)
    v = rng.exponential(1000, 20000)
    q = exact_quantiles(_frame(spark, v), ["x"], [0.1, 0.25, 0.5, 0.75, 0.99],
                        max_distinct=300, accuracy=200)
    for p in (0.1, 0.25, 0.5, 0.75, 0.99):
        assert q[("x", p)] == np.quantile(v, p)


def test_hot_value_third_of_rows(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([np.full(5000, 42.0), rng.normal(0, 100, 10000)])
    q = exact_quantiles(_frame(spark, v), ["x"], [0.25, 0.5, 0.75], max_distinct=500, accuracy=100)
    for p in (0.25, 0.5, 0.75):
        assert q[("x", p)] == np.quantile(v, p)


def test_repartition_invariance(spark):
    v = np.arange(1001, dtype=float) * 1.5
    df = _frame(spark, v)
    a = exact_quantiles(df, ["x"], [0.3])
    b = exact_quantiles(df.repartition(7), ["x"], [0.3])
    assert a == b


def test_fine_ranks_take_few_passes(spark):
    # sketches shrank a bracket to a twenty-fifth a round; bits cut it to its rows in two
    v = np.random.default_rng(11).exponential(1000, 200_000)
    q = exact_quantiles(_frame(spark, v), ["x"], [0.25, 0.5, 0.75], max_distinct=20, accuracy=100, max_rounds=2)
    for p in (0.25, 0.5, 0.75):
        assert q[("x", p)] == np.quantile(v, p)


def test_keys_keep_the_order_of_doubles():
    from lendscope.functions.quantiles import key_value, ordered_keys
    v = np.array([-np.inf, -1e300, -2.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1e300, np.inf, np.nan])
    k = ordered_keys(v)
    assert (np.diff(k) >= 0).all() and k[4] == k[5] and (np.diff(np.delete(k, 4)) > 0).all()
    assert all(key_value(int(a)) == b or b != b for a, b in zip(k, v))


def test_wide_spread_nulls_and_a_mode_for_each_rank(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([10.0 ** rng.uniform(-300, 300, 3000), -(10.0 ** rng.uniform(-300, 300, 2001))])
    df = spark.createDataFrame([(float(x), None) for x in v] + [(None, None)] * 50, "x double, y double")
    q = exact_quantiles(df, ["x", "y"], [0.25, 0.5], mode={0.25: "linear", 0.5: "midpoint"}, max_distinct=10)
    assert q[("x", 0.25)] == np.quantile(v, 0.25) and q[("x", 0.5)] == pd.Series(v).median()
    assert q[("y", 0.25)] is None
