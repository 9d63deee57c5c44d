import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lendscope.operators import forest as fo
from lendscope.operators import models as mo

COLS = ["a", "b", "c", "d"]


def _rows(spark, n=3000, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 24, (n, 4)).astype(float)
    y = (x[:, 0] + 0.7 * x[:, 1] + rng.normal(0, 6, n) > 28).astype(np.int64)
    pdf = pd.DataFrame(x, columns=COLS).assign(rid=np.arange(n), y=y)
    return mo._prepare(spark.createDataFrame(pdf), "y", COLS, "balanced")


def _shares(forest, df):
    got = forest.shares(df, "rid", vector_to_array(mo.FEATURES), [[t] for t in range(len(forest.tops))]).toPandas()
    return np.stack(got.set_index("rid").sort_index()["_s"])


def test_a_tree_equals_that_of_mllib(spark):
    df = _rows(spark).persist()
    got = fo.grow_forest(df, vector_to_array(mo.FEATURES), 4, mo.LABEL, mo.WEIGHT, 1, 4, 30, 1, bootstrap=False)
    model = DecisionTreeClassifier(featuresCol=mo.FEATURES, labelCol=mo.LABEL, weightCol=mo.WEIGHT, maxDepth=30, seed=1).fit(df)
    want = model.transform(df).select("rid", vector_to_array("probability")[1].alias("p")).toPandas().set_index("rid").sort_index()["p"]
    tree, = got.trees([0])
    assert len(tree[0]["feature"]) == model.numNodes > 300
    assert np.allclose(_shares(got, df)[:, 0], want)


def test_levels_by_sums_give_the_tree_of_one_task(spark):
    df = _rows(spark).repartition(3).transform(mo.stage)

    def grown(bootstrap, m, local_rows):
        return fo.grow_forest(df, vector_to_array(mo.FEATURES), 4, mo.LABEL, mo.WEIGHT, 3, m, 12, 7, bootstrap, local_rows=local_rows)
    for bootstrap in (False, True):
        whole, cut = grown(bootstrap, 4, 10**6), grown(bootstrap, 4, 300)
        assert all(len(t["feature"]) == 1 for t in whole.tops) and all(len(t["feature"]) > 8 for t in cut.tops)
        assert np.array_equal(_shares(whole, df), _shares(cut, df))
        sizes = [[sum(len(s["feature"]) for s in t.values()) for t in f.trees([0, 1, 2])] for f in (whole, cut)]
        assert (len(set(sizes[0])) > 1) == bootstrap
        # foot nodes are inside the tops: they count once
        assert sizes[0] == [n + sum(t["feature"] >= 0) for n, t in zip(sizes[1], cut.tops)]
    assert fo.grow_forest(df, vector_to_array(mo.FEATURES), 4, mo.LABEL, mo.WEIGHT, 2, 2, 12, 7, local_rows=300).table.count() > 4


def test_sorted_runs_find_the_split_of_dense_sums():
    rng = np.random.default_rng(3)
    for nodes in (1, 7, 60):
        node = np.append(np.arange(nodes), rng.integers(0, nodes, 400))
        x, w = rng.integers(0, 32, len(node)), rng.integers(1, 9, len(node)).astype(float)
        one = rng.random(len(node)) < 0.4
        w0, w1 = np.where(one, 0.0, w), np.where(one, w, 0.0)
        t0, t1 = np.bincount(node, w0), np.bincount(node, w1)
        a, b = (f(node * 32 + x, w0, w1, t0, t1, 32) for f in (fo._dense_best, fo._sparse_best))
        assert np.array_equal(a[0], b[0]) and np.array_equal(a[1][a[0] >= 0], b[1][b[0] >= 0])


def test_draws_are_poisson_and_apart():
    at = np.arange(200_000)
    one, two = fo.draws(42, 0, at), fo.draws(42, 1, at)
    assert abs(one.mean() - 1) < 0.01 and abs(one.var() - 1) < 0.02 and abs((one == 0).mean() - np.exp(-1)) < 0.005
    assert abs(np.corrcoef(one, two)[0, 1]) < 0.01 and np.array_equal(one, fo.draws(42, 0, at))


def test_cuts_lie_between_few_values_and_at_quantiles_of_many(spark):
    df = spark.range(5000).select(F.array((F.col("id") % 3).cast("double"), F.col("id").cast("double"), F.lit(1.0)).alias("x"))
    few, many, one = fo.quantile_cuts(df, F.col("x"), 3)
    assert few.tolist() == [0.5, 1.5] and len(many) == 31 and len(one) == 0
    assert np.allclose(np.diff(many), 5000 / 32, atol=15)
