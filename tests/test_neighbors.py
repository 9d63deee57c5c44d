import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lendscope.operators import neighbors as nb


def _points(spark, n=300, d=4, seed=0, rate=0.25):
    rng = np.random.default_rng(seed)
    X = np.round(rng.normal(0, 1, (n, d)), 3)
    pdf = pd.DataFrame(X, columns=[f"f{i}" for i in range(d)])
    pdf.insert(0, "pid", np.arange(n, dtype=np.int64))
    pdf["y"] = (rng.random(n) < rate).astype(np.int64)
    return spark.createDataFrame(pdf), pdf


def _brute(pdf, cols, k, self_ex=True):
    X = pdf[cols].to_numpy()
    ids = pdf.pid.to_numpy()
    out = {}
    for i in range(len(X)):
        d2 = ((X - X[i]) ** 2).sum(axis=1)
        if self_ex:
            d2[i] = np.inf
        order = np.lexsort((ids, d2))[:k]
        out[ids[i]] = list(ids[order])
    return out


def test_knn_exact_across_tiles(spark):
    df, pdf = _points(spark)
    cols = [c for c in pdf.columns if c.startswith("f")]
    got = nb.knn(df, df, "pid", cols, 5, exclude_self=True, block_rows=64).toPandas()
    ref = _brute(pdf, cols, 5)
    for qid, g in got.groupby("qid"):
        assert list(g.sort_values("rank").mid) == ref[qid]
    assert got.qid.nunique() == len(pdf)


def test_smote_quota_and_determinism(spark):
    df, pdf = _points(spark, 400, rate=0.15)
    cols = [c for c in pdf.columns if c.startswith("f")]
    counts = pdf.y.value_counts().to_dict()
    out = nb.smote(df, "pid", "y", cols, ratio=0.4, k=5, seed=42, block_rows=64)
    o = out.toPandas()
    maj = max(counts, key=counts.get)
    assert (o.y == 1 - maj).sum() == int(0.4 * counts[maj])
    assert (o.y == maj).sum() == counts[maj]
    syn = o[o.pid < 0]
    mino = pdf[pdf.y != maj][cols]
    assert (syn[cols].min() >= mino.min() - 1e-12).all() and (syn[cols].max() <= mino.max() + 1e-12).all()
    again = nb.smote(df.repartition(3), "pid", "y", cols, ratio=0.4, k=5, seed=42, block_rows=64).toPandas()
    a = syn.sort_values("pid").reset_index(drop=True)
    b = again[again.pid < 0].sort_values("pid").reset_index(drop=True)
    pd.testing.assert_frame_equal(a[["pid"] + cols], b[["pid"] + cols])


def test_knn_vote_probability(spark):
    df, pdf = _points(spark, 200)
    cols = [c for c in pdf.columns if c.startswith("f")]
    train, test = df.where("pid < 150"), df.where("pid >= 150")
    got = {r.pid: r.probability for r in nb.knn_vote(train, test, "pid", "y", cols, 5).collect()}
    tr = pdf[pdf.pid < 150]
    for _, row in pdf[pdf.pid >= 150].iterrows():
        d2 = ((tr[cols].to_numpy() - row[cols].to_numpy()) ** 2).sum(axis=1)
        idx = np.lexsort((tr.pid.to_numpy(), d2))[:5]
        assert got[row.pid] == tr.y.to_numpy()[idx].mean()


def test_balance_summary(spark):
    df = spark.createDataFrame([(0,)] * 10 + [(1,)] * 2, "y int")
    r = {x.label: x for x in nb.balance_summary(df, "y", 0.4).collect()}
    assert r[1].rows_after == 4 and r[0].rows_after == 10


def test_knn_slabs_with_ties_and_separate_sets(spark):
    rng = np.random.default_rng(11)
    X = np.round(rng.integers(0, 6, (240, 3)).astype(float), 1)  # many exact ties
    pdf = pd.DataFrame(X, columns=["a", "b", "c"])
    pdf.insert(0, "pid", np.arange(240, dtype=np.int64))
    df = spark.createDataFrame(pdf)
    queries, members = df.where("pid % 3 = 0"), df.where("pid % 3 <> 0")
    got = nb.knn(queries, members, "pid", ["a", "b", "c"], 4, block_rows=20).toPandas()
    mem = pdf[pdf.pid % 3 != 0]
    for _, q in pdf[pdf.pid % 3 == 0].iterrows():
        d2 = ((mem[["a", "b", "c"]].to_numpy() - q[["a", "b", "c"]].to_numpy()) ** 2).sum(axis=1)
        want = list(mem.pid.to_numpy()[np.lexsort((mem.pid.to_numpy(), d2))[:4]])
        g = got[got.qid == q.pid].sort_values("rank")
        assert list(g.mid) == want


def test_knn_with_a_value_shared_by_most_members(spark):
    rng = np.random.default_rng(5)
    X = np.round(rng.normal(0, 1, (500, 3)), 3)
    X[:, 0] = np.where(rng.random(500) < 0.8, 100.0, rng.normal(0, 300, 500).round(2))
    pdf = pd.DataFrame(X, columns=["f0", "f1", "f2"])
    pdf.insert(0, "pid", np.arange(500, dtype=np.int64))
    df = spark.createDataFrame(pdf)
    got = nb.knn(df, df, "pid", ["f0", "f1", "f2"], 4, exclude_self=True, block_rows=32).toPandas()
    ref = _brute(pdf, ["f0", "f1", "f2"], 4)
    assert {q: list(g.sort_values("rank").mid) for q, g in got.groupby("qid")} == ref


def test_pivots_prune_where_no_axis_dominates(spark):
    rng = np.random.default_rng(7)
    n, d = 4000, 8
    X = rng.normal(0, 10, (40, d))[rng.integers(0, 40, n)] + rng.normal(0, 0.5, (n, d))  # clusters, all axes alike
    pdf = pd.DataFrame(X, columns=[f"f{i}" for i in range(d)])
    pdf.insert(0, "pid", np.arange(n, dtype=np.int64))
    df, cols = spark.createDataFrame(pdf), [f"f{i}" for i in range(d)]
    found, routes = nb._search(df, df, "pid", cols, 5, True, 100, None, "fold")
    _, members = nb.pivot_index(df.select(F.col("pid").alias("_id"), F.array(*cols).alias("_v"), F.lit(-1).alias("_f")), 100, n)
    sizes = members.groupBy("_s").agg(F.count("*").alias("n"))
    pairs = routes.join(sizes, "_s").agg(F.sum("n")).first()[0]
    assert pairs < 0.15 * n * n, pairs / n / n
    got = found.toPandas().sort_values(["qid", "rank"]).groupby("qid")["mid"].apply(list).to_dict()
    ref = _brute(pdf, cols, 5)
    assert got == ref


@pytest.mark.parametrize("block_rows", [30, 8192])
def test_one_masked_search_equals_a_search_for_each_fold(spark, block_rows):
    df, pdf = _points(spark, 400, d=3, seed=9)
    df = df.withColumn("fold", F.pmod(F.xxhash64("pid"), F.lit(5)).cast("int")).where("fold <> 3 OR pid % 5 = 0")
    cols = ["f0", "f1", "f2"]
    found = nb.knn(df, df, "pid", cols, 4, True, block_rows, 5).toPandas()
    for i in range(5):
        part = df.where(F.col("fold") != i)
        want = nb.knn(df, part, "pid", cols, 4, True, block_rows).toPandas().sort_values(["qid", "rank"]).reset_index(drop=True)
        got = found[found["mask"] == i].drop(columns="mask").sort_values(["qid", "rank"]).reset_index(drop=True)
        pd.testing.assert_frame_equal(got, want)


def test_smote_of_folds_from_one_search(spark):
    df, _ = _points(spark, 300, d=2, rate=0.2)
    df = df.withColumn("fold", F.pmod(F.xxhash64("pid"), F.lit(3)).cast("int")).persist()
    nbrs = nb.fold_neighbours(df, "pid", "y", ["f0", "f1"], 3, 3, block_rows=16)
    for i in range(3):
        train = df.where(F.col("fold") != i).drop("fold")
        one = nb.smote(train, "pid", "y", ["f0", "f1"], 0.5, 3, block_rows=16).toPandas().sort_values("pid").reset_index(drop=True)
        two = nb.smote(train, "pid", "y", ["f0", "f1"], 0.5, 3, neighbours=nbrs.where(F.col("mask") == i)).toPandas()
        pd.testing.assert_frame_equal(one, two.sort_values("pid").reset_index(drop=True))


def test_knn_without_members(spark):
    df, _ = _points(spark, 5)
    assert nb.knn(df, df.limit(0), "pid", ["f0"], 3).count() == 0


def test_smote_rows_lie_between_minority_neighbours(spark):
    df, pdf = _points(spark, 200, d=2, rate=0.2)
    counts = pdf.y.value_counts().to_dict()
    mino = min(counts, key=counts.get)
    M = pdf[pdf.y == mino][["f0", "f1"]].to_numpy()
    out = nb.smote(df, "pid", "y", ["f0", "f1"], ratio=0.5, k=3, block_rows=16).toPandas()
    syn = out[out.pid < 0][["f0", "f1"]].to_numpy()
    assert len(syn) == int(0.5 * max(counts.values())) - counts[mino]
    for x in syn:
        a, b = M[:, None, :], M[None, :, :]
        cross = np.abs((b - a)[..., 0] * (x - a)[..., 1] - (b - a)[..., 1] * (x - a)[..., 0])
        dot = ((x - a) * (b - a)).sum(-1)
        assert ((cross < 1e-9) & (dot > -1e-9) & (dot < ((b - a) ** 2).sum(-1) + 1e-9)).any()


@pytest.mark.parametrize("minority", [0, 1, 5])
def test_smote_needs_more_rows_than_neighbours(spark, minority):
    df = spark.range(60).select(F.col("id").alias("pid"), (F.col("id") < minority).cast("int").alias("y"), F.col("id").cast("double").alias("f"))
    with pytest.raises(ValueError):
        nb.smote(df, "pid", "y", ["f"], 0.4, 5)
