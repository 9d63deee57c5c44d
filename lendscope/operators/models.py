"""Model comparison and tuning on Spark MLlib.

* every model is an MLlib estimator (or a small driver-side solve on
  aggregated statistics: discriminant analysis) applied to an assembled
  feature vector; class weights are a ``weightCol``;
* ``evaluate_models`` is the guarded fit/evaluate loop -- a failure or a fit
  beyond its time limit becomes a zero row that says so, never an aborted
  comparison.
"""

from __future__ import annotations

import math
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pandas as pd
from pyspark import InheritableThread
from pyspark.ml.classification import (
    DecisionTreeClassifier, LinearSVC, LogisticRegression,
    MultilayerPerceptronClassifier, NaiveBayes,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage
from .boosting import BoostedTrees
from .forest import grow_forest
from .metrics import classification_metrics, roc_auc

LABEL = "_label"
WEIGHT = "_w"
FEATURES = "_features"
SCORE = "_score"
PRED = "_pred"
# Labels become plan literals; a label column with more values is not a class label.
MAX_CLASSES = 100


def class_weight_table(df: DataFrame, target: str, fixed_positive: float = 6.0) -> DataFrame:
    """(label, count, balanced_weight = n / (2 n_c), fixed_weight 1 : 6)."""
    g = df.groupBy(F.col(target).cast("bigint").alias("label")).agg(F.count(F.lit(1)).alias("count"))
    tot = F.sum("count").over(Window.partitionBy(F.lit(1)))  # one row per class: bounded
    return g.select("label", "count",
                    (tot.cast("double") / (F.lit(2.0) * F.col("count").cast("double"))).alias("balanced_weight"),
                    F.when(F.col("label") == 1, F.lit(float(fixed_positive))).otherwise(F.lit(1.0))
                    .alias("fixed_weight"))


def with_weights(df: DataFrame, target: str, kind: str | None) -> DataFrame:
    """Adds the label (double) and a per-row weight: ``balanced``, ``fixed``
    (1 : 6) or none (1.0). Weights come from class counts (2 numbers)."""
    out = df.withColumn(LABEL, F.col(target).cast("double"))
    if kind is None:
        return out.withColumn(WEIGHT, F.lit(1.0))
    if kind == "fixed":
        return out.withColumn(WEIGHT, F.when(F.col(LABEL) == 1, F.lit(6.0)).otherwise(F.lit(1.0)))
    counts = {r[0]: r[1] for r in out.groupBy(LABEL).count().limit(MAX_CLASSES + 1).collect()}
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    n = sum(counts.values())
    w = {k: n / (len(counts) * v) for k, v in counts.items()}
    expr = F.lit(1.0)
    for k, v in w.items():
        expr = F.when(F.col(LABEL) == F.lit(k), F.lit(v)).otherwise(expr)
    return out.withColumn(WEIGHT, expr)


def assembler(feature_cols: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(feature_cols), outputCol=FEATURES, handleInvalid="keep")


# ---------------------------------------------------------------- models
@dataclass
class Spec:
    name: str
    build: Callable[[int], object]   # (n weighted rows) -> fitted-able object
    weights: str | None = None       # balanced | fixed | None
    score: str = "probability"       # probability | raw | custom


def _lr(n):
    # L2 logistic loss with C = 1 on weighted rows: regParam = 1 / sum(w)
    return LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, maxIter=1000,
                              regParam=1.0 / n, elasticNetParam=0.0, standardization=False)


class RidgeClassifier:
    """Least squares on +-1 targets with an L2 penalty (alpha = 1); the
    class is the sign of the prediction."""

    def __init__(self, n, alpha=1.0):
        self.est = LinearRegression(featuresCol=FEATURES, labelCol="_pm", weightCol=WEIGHT,
                                    regParam=alpha / n, elasticNetParam=0.0, standardization=False,
                                    solver="normal", predictionCol=SCORE)

    def fit(self, df):
        m = self.est.fit(df.withColumn("_pm", F.col(LABEL) * 2 - 1))
        return _Wrapped(m, lambda d: d.withColumn(PRED, (F.col(SCORE) > 0).cast("double")))


class _Wrapped:
    def __init__(self, model, post):
        self.model, self.post = model, post

    def transform(self, df):
        return self.post(self.model.transform(df))


def _svc(reg):
    def build(n):
        # Standardized inputs: on raw ones (1e0 to 1e7) the solver creeps.
        return LinearSVC(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, maxIter=2000, tol=1e-4,
                         regParam=reg(n), standardization=True, rawPredictionCol="_raw",
                         predictionCol=PRED)
    return build


def _tree(n):
    return DecisionTreeClassifier(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, maxDepth=30,
                                  seed=42)


def _forest(trees, strategy, depth=30):
    return lambda n: ForestByGroups(trees, strategy, depth)


class ForestByGroups:
    """Random forest (``forest.grow_forest``) scored by groups of trees.

    Rows are numbered in as few partitions as hold ``part_rows`` each, so draws don't
    follow the cores. A group is ``GROUP_TREES`` trees, or as many as make ``tree_rows``
    rows to grow on."""

    GROUP_TREES = 5

    def __init__(self, trees, strategy, depth=30, seed=42, part_rows=250_000, tree_rows=200_000):
        self.trees, self.strategy, self.depth, self.seed = trees, strategy, depth, seed
        self.part_rows, self.tree_rows = part_rows, tree_rows

    def sizes(self, n: int) -> list[int]:
        """Trees of each group on ``n`` rows."""
        most = min(self.trees, max(self.GROUP_TREES, math.ceil(self.tree_rows / max(n, 1))))
        return [min(most, self.trees - at) for at in range(0, self.trees, most)]

    def fit(self, df):
        n, first = df.count(), df.select(FEATURES).first()
        p = 0 if first is None else first[0].size
        rows = df.select(FEATURES, LABEL, WEIGHT).coalesce(max(1, math.ceil(n / self.part_rows)))
        m = p if self.strategy == "all" else math.ceil(math.sqrt(p))
        found = grow_forest(rows, vector_to_array(FEATURES), p, LABEL, WEIGHT, self.trees, m, self.depth, self.seed)
        return _ForestModel(found, self.sizes(n))


class _ForestModel:
    """Mean over all trees of the positive share in a row's leaf; the trees stay in the
    shared folder. ``models``: the groups, each a forest of its own."""

    def __init__(self, forest, sizes):
        self.forest = forest
        ends = np.cumsum(sizes).tolist()
        self.groups = [list(range(e - k, e)) for e, k in zip(ends, sizes)]
        self.models = [_TreeGroup(forest, mine, i) for i, mine in enumerate(self.groups)]

    def transform(self, df):
        # the groups' sums are added in order: the same in every run
        total = F.aggregate("_s", F.lit(0.0), lambda a, v: a + v) / F.lit(float(sum(map(len, self.groups))))
        out = _with_shares(df, self.forest, self.groups).withColumn(SCORE, total).drop("_s")
        return out.withColumn(PRED, (F.col(SCORE) > 0.5).cast("double"))


def _with_shares(df, forest, groups):
    held = df.withColumn("_row", F.monotonically_increasing_id()).transform(stage)
    return held.join(forest.shares(held, "_row", vector_to_array(FEATURES), groups), "_row").drop("_row")


class _TreeGroup:
    def __init__(self, forest, mine, i):
        self.forest, self.mine, self.i = forest, mine, i
        self.getNumTrees, self.treeWeights = len(mine), [1.0] * len(mine)

    def getProbabilityCol(self):
        return f"_p{self.i}"

    def transform(self, df):
        share = F.col("_s")[0] / F.lit(float(len(self.mine)))
        return _with_shares(df, self.forest, [self.mine]).withColumn(f"_p{self.i}", F.array(F.lit(1.0) - share, share)).drop("_s")

    @property
    def trees(self):
        return [_TreeText(t) for t in self.forest.trees(self.mine)]


class _TreeText:
    def __init__(self, parts):
        self.parts = parts

    @property
    def toDebugString(self):
        lines = [f"{sum(len(t['feature']) for t in self.parts.values())} nodes"]
        for foot, t in sorted(self.parts.items()):
            lines += [f"{foot}.{i}: " + (f"bin of feature {f} <= {c}: {at}" if f >= 0 else f"{one / (zero + one)!r}")
                      for i, (f, c, at, zero, one) in enumerate(zip(*(t[x].tolist() for x in ("feature", "cut", "left", "n0", "n1"))))]
        return "\n".join(lines)


def _gbt(iters=100, depth=3, bins=32, step=0.1):
    def build(n):
        return BoostedTrees(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, maxIter=iters,
                            maxDepth=depth, maxBins=bins, stepSize=step, seed=42)
    return build


def _nb(n):
    return NaiveBayes(featuresCol=FEATURES, labelCol=LABEL, modelType="gaussian")


def _scaled(est):
    """Standardize the assembled features before ``est`` (a perceptron on
    raw inputs spanning 1e0..1e7 saturates)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler
    return Pipeline(stages=[StandardScaler(inputCol=FEATURES, outputCol="_fs", withMean=True,
                                           withStd=True), est.setFeaturesCol("_fs")])


def _mlp(n_features):
    def build(n):
        return _scaled(MultilayerPerceptronClassifier(featuresCol=FEATURES, labelCol=LABEL,
                                                      layers=[n_features, 64, 32, 2], maxIter=200,
                                                      seed=42))
    return build


class AdaBoost:
    """SAMME with depth-1 trees, by replay. Rows are binned once (at most ``bins``
    bins a feature, cut at its quantiles) and written. A round is one job: tasks
    recompute each row's weight from the stumps so far and add up weights by
    feature, bin and class; the sums give the best stump (Gini), its error and its
    say. Nothing is cached, and a lost executor costs its tasks only."""

    def __init__(self, n, rounds=100, learning_rate=1.0, bins=256):
        self.rounds, self.lr, self.bins = rounds, learning_rate, bins

    def _cuts(self, df, p):
        at = [i / self.bins for i in range(1, self.bins)]
        x = vector_to_array(FEATURES)
        found = df.agg(*[F.percentile_approx(x[i], at, 10 * self.bins) for i in range(p)]).first()  # bins x features
        return [np.unique([c for c in (row or []) if c == c]) for row in found]

    def fit(self, df):
        first = df.select(FEATURES).first()
        p = 0 if first is None else first[0].size
        cuts = self._cuts(df, p)

        def binned(batches):
            for pdf in batches:
                x = np.stack(pdf["x"])
                b = np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)], axis=1).astype(np.int16)
                yield pd.DataFrame({"b": list(b), "y": pdf["y"].astype(np.int8)})

        rows = df.select(vector_to_array(FEATURES).alias("x"), F.col(LABEL).alias("y")).mapInPandas(
            binned, "b array<smallint>, y tinyint").transform(stage)
        stumps = []
        while len(stumps) < self.rounds:
            stump, err = best_stump(self._sums(rows, p, stumps), cuts)
            if err <= 0:
                stumps.append((*stump, 1.0))
                break
            if err >= 0.5:
                if not stumps:
                    stumps.append((*stump, 1e-10))
                break
            stumps.append((*stump, self.lr * math.log((1 - err) / err)))
        return _AdaModel([(f, float(cuts[f][k]) if k < len(cuts[f]) else math.inf, left, right, say) for f, k, left, right, say in stumps])

    def _sums(self, rows, p, stumps):
        """Weights by feature, bin and class: one grouped sum."""
        width = self.bins

        def sums(batches):
            total = np.zeros(p * width * 2)
            for pdf in batches:
                b, y = np.stack(pdf["b"]), pdf["y"].to_numpy(np.int64)
                w = replayed_weights(b, y, stumps)
                at = ((np.arange(p) * width + b) * 2 + y[:, None]).ravel()
                total += np.bincount(at, np.repeat(w, p), minlength=len(total))
            i = np.flatnonzero(total)
            yield pd.DataFrame({"i": i, "v": total[i]})

        out = np.zeros(p * width * 2)
        for i, v in rows.mapInPandas(sums, "i long, v double").groupBy("i").agg(F.sum("v")).collect():  # features x bins x 2
            out[i] = v
        return out.reshape(p, width, 2)


def replayed_weights(b: np.ndarray, y: np.ndarray, stumps: list[tuple]) -> np.ndarray:
    """Weight of each row (1 at first) after the stumps (feature, cut, left, right, say)."""
    power = np.zeros(len(b))
    for f, k, left, right, say in stumps:
        power += say * (np.where(b[:, f] <= k, left, right) != y)
    return np.exp(power)


def best_stump(sums: np.ndarray, cuts: list[np.ndarray]) -> tuple[tuple, float]:
    """(feature, cut, left class, right class) of the lowest weighted Gini impurity and
    its share of wrong weight; ties (to 12 digits) go to the first feature and cut."""
    total = sums[0].sum(axis=0)
    below = sums.cumsum(axis=1)
    above = total - below
    with np.errstate(invalid="ignore", divide="ignore"):
        impurity = sum(np.nan_to_num(2 * s[..., 0] * s[..., 1] / s.sum(axis=-1)) for s in (below, above)) / total.sum()
    for f, c in enumerate(cuts):
        impurity[f, max(len(c) - 1, 0) + 1:] = np.inf
    f, k = np.unravel_index(np.argmin(np.round(impurity, 12)), impurity.shape)
    left, right = (int(s[f, k, 1] > s[f, k, 0]) for s in (below, above))
    wrong = below[f, k, 1 - left] + above[f, k, 1 - right]
    return (int(f), int(k), left, right), float(wrong / total.sum())


class _AdaModel:
    """Scores with one expression: each stump's side, weighted by its say."""

    def __init__(self, stumps):
        self.stumps = stumps  # feature, threshold, left class, right class, say

    def transform(self, df):
        x, total = vector_to_array(FEATURES), sum(s[-1] for s in self.stumps)
        vote = F.lit(0.0)
        for f, cut, left, right, say in self.stumps:
            vote = vote + F.when(F.col("_x")[f] <= F.lit(cut), F.lit(say * (2 * left - 1))).otherwise(F.lit(say * (2 * right - 1)))
        out = df.withColumn("_x", x).withColumn(SCORE, vote / F.lit(total if total else 1.0)).drop("_x")
        return out.withColumn(PRED, (F.col(SCORE) > 0).cast("double"))


def _class_moments(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray, dict]:
    """(means, deviations, {label: (n, sums, products)}): sums and products of
    the rows centred and scaled by the means and deviations of all rows, so
    nothing cancels. A task adds up its rows by matrix products; the partial
    sums of all tasks meet in one grouped sum."""
    p = len(cols)
    x = [F.col(c).cast("double") for c in cols]
    row = df.agg(*[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first()
    mean, sd = np.array(row[:p], float), np.array(row[p:], float)
    sd[~(sd > 0)] = 1.0

    def partial(batches):
        held = {}
        for pdf in batches:
            z = (pdf[cols].to_numpy(float) - mean) / sd
            y = pdf["_y"].to_numpy()
            for k in np.unique(y):
                part = z[y == k]
                found = held.setdefault(k, np.zeros(1 + p + p * p))
                found += np.concatenate(([len(part)], part.sum(axis=0), (part.T @ part).ravel()))
        for k, v in held.items():
            yield pd.DataFrame({"y": k, "i": np.arange(len(v)), "v": v})

    sums = (df.select(F.col(LABEL).alias("_y"), *[c.alias(n) for c, n in zip(x, cols)])
            .mapInPandas(partial, "y double, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")))
    out: dict = {}
    for y, i, v in sums.collect():  # classes x (p * p + p + 1) rows
        out.setdefault(y, np.zeros(1 + p + p * p))[i] = v
    return mean, sd, {k: (v[0], v[1:p + 1], v[p + 1:].reshape(p, p)) for k, v in out.items()}


class Discriminant:
    """Linear (pooled covariance) or quadratic (per-class covariance)
    discriminant analysis on per-class moments; the p x p solve happens on
    the driver. Linear scoring is a column expression; the quadratic form is a
    vectorized pandas UDF over the features."""

    def __init__(self, n, feature_cols, quadratic=False, tol=1e-4):
        self.cols, self.quadratic, self.tol = list(feature_cols), quadratic, tol

    def fit(self, df):
        mean, scale, moments = _class_moments(df, self.cols)
        if len(moments) != 2:
            raise ValueError(f"two classes expected, got {sorted(moments)}")
        D = np.diag(scale)
        stats = {}
        n_all = sum(n for n, _, _ in moments.values())
        for k, (n, total, products) in moments.items():
            mu_z = total / n
            stats[k] = (n, mean + scale * mu_z, D @ (products - n * np.outer(mu_z, mu_z)) @ D)
        classes = sorted(stats)
        # solve in standardized coordinates (pooled standard deviations): the
        # features span many orders of magnitude, and a relative cut-off on
        # the raw covariance would drop almost every direction
        pooled = sum(stats[k][2] for k in classes) / max(n_all - len(classes), 1)
        sd = np.sqrt(np.clip(np.diag(pooled), 0, None))
        sd[sd == 0] = 1.0
        Dm = np.diag(1.0 / sd)
        params = []
        if self.quadratic:
            for k in classes:
                n, mu, sc = stats[k]
                cov_s = Dm @ (sc / max(n - 1, 1)) @ Dm
                ev = np.linalg.eigvalsh(cov_s)
                keep = ev > self.tol * ev.max()
                logdet = float(np.sum(np.log(ev[keep])) + 2 * np.sum(np.log(sd)))
                inv = Dm @ np.linalg.pinv(cov_s, rcond=self.tol, hermitian=True) @ Dm
                params.append((mu, inv, logdet, math.log(n / n_all)))
        else:
            inv = Dm @ np.linalg.pinv(Dm @ pooled @ Dm, rcond=self.tol, hermitian=True) @ Dm
            for k in classes:
                n, mu, _ = stats[k]
                params.append((mu, inv, 0.0, math.log(n / n_all)))
        return _DiscModel(params, self.cols, self.quadratic)


class _DiscModel:
    def __init__(self, params, cols, quadratic=True):
        self.params, self.cols, self.quadratic = params, cols, quadratic

    def transform(self, df):
        out = df.withColumn(SCORE, self._quadratic() if self.quadratic else self._linear())
        return out.withColumn(PRED, (F.col(SCORE) >= 0.5).cast("double"))

    def _linear(self):
        # equal covariances: the log odds are linear in the features
        (m0, inv, _, p0), (m1, _, _, p1) = self.params
        slope = inv @ (m1 - m0)
        odds = F.lit(float(p1 - p0))
        for c, w, mid in zip(self.cols, slope, (m0 + m1) / 2):
            odds = odds + F.lit(float(w)) * (F.col(c).cast("double") - F.lit(float(mid)))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-odds))

    def _quadratic(self):
        params = self.params

        @F.pandas_udf(T.DoubleType())
        def pos_prob(v: pd.Series) -> pd.Series:
            X = np.stack(v.to_numpy())
            ll = []
            for mu, inv, logdet, prior in params:
                d = X - mu
                ll.append(-0.5 * ((d @ inv) * d).sum(axis=1) - 0.5 * logdet + prior)
            ll = np.stack(ll, axis=1)
            ll -= ll.max(axis=1, keepdims=True)
            e = np.exp(ll)
            return pd.Series(e[:, -1] / e.sum(axis=1))

        return pos_prob(F.array(*[F.col(c).cast("double") for c in self.cols]))


class KnnVote:
    def __init__(self, n, feature_cols, id_col, k=5):
        self.cols, self.id_col, self.k = feature_cols, id_col, k

    def fit(self, df):
        return _KnnModel(df, self.cols, self.id_col, self.k)


class _KnnModel:
    def __init__(self, train, cols, id_col, k):
        self.train, self.cols, self.id_col, self.k = train, cols, id_col, k

    def transform(self, df):
        from .neighbors import knn_vote
        votes = knn_vote(self.train.withColumnRenamed(LABEL, "_y"), df, self.id_col, "_y",
                         self.cols, self.k).withColumnRenamed("probability", SCORE)
        # a row without neighbours (no training rows) gets probability 0
        out = df.join(votes, self.id_col, "left").withColumn(SCORE, F.coalesce(SCORE, F.lit(0.0)))
        return out.withColumn(PRED, (F.col(SCORE) >= 0.5).cast("double"))


def model_specs(feature_cols: list[str], id_col: str) -> list[Spec]:
    """The comparison set (MLlib counterparts of the reference's list)."""
    p = len(feature_cols)
    return [
        Spec("LogisticRegression", _lr, "balanced"),
        Spec("RidgeClassifier", lambda n: RidgeClassifier(n), "balanced", "custom"),
        Spec("LinearSVM", _svc(lambda n: 1.0 / n), "balanced", "raw"),
        Spec("HingeSGD", _svc(lambda n: 1e-4), "balanced", "raw"),
        Spec("KNeighbors", lambda n: KnnVote(n, feature_cols, id_col), None, "custom"),
        Spec("DecisionTree", _tree, "balanced"),
        Spec("RandomForest", _forest(100, "sqrt"), "balanced", "custom"),
        Spec("BaggedTrees", _forest(50, "all"), None, "custom"),
        Spec("GradientBoosting", _gbt(), None),
        Spec("HistGradientBoosting", _gbt(bins=255), None),
        Spec("BoostedTreesWeight6", _gbt(), "fixed"),
        Spec("BoostedTreesBalanced", _gbt(), "balanced"),
        Spec("BoostedTrees1to6", _gbt(depth=6), "fixed"),
        Spec("AdaBoost", lambda n: AdaBoost(n), None, "custom"),
        Spec("GaussianNB", _nb, None),
        Spec("LinearDiscriminant", lambda n: Discriminant(n, feature_cols), None, "custom"),
        Spec("QuadraticDiscriminant", lambda n: Discriminant(n, feature_cols, True), None, "custom"),
        Spec("MultilayerPerceptron", _mlp(p), None),
    ]


def _prepare(df, target, feature_cols, weights):
    return assembler(feature_cols).transform(with_weights(df, target, weights))


def fit_one(spec: Spec, train: DataFrame, target: str, feature_cols: list[str]):
    tr = _prepare(train, target, feature_cols, spec.weights).transform(stage)
    n = tr.agg(F.sum(WEIGHT)).first()[0]
    t0 = time.time()
    model = spec.build(n).fit(tr)
    return model, round(time.time() - t0, 2)


def score(model, spec: Spec, df: DataFrame, target: str, feature_cols: list[str]) -> DataFrame:
    """Adds SCORE (probability of class 1, or decision value) and PRED."""
    out = model.transform(_prepare(df, target, feature_cols, None))
    if spec.score == "probability":
        out = out.withColumn(SCORE, vector_to_array(F.col("probability")).getItem(1))
        pc = model.getPredictionCol() if hasattr(model, "getPredictionCol") else "prediction"
        out = out.withColumn(PRED, F.col(pc))
    elif spec.score == "raw":
        out = out.withColumn(SCORE, vector_to_array(F.col("_raw")).getItem(1))
    return out


def within_limit(sc, work: Callable, seconds: float | None, label: str):
    """Result of ``work`` run in a thread whose Spark jobs form a group (and, under
    the fair scheduler, a pool) of their own. Beyond ``seconds`` the group's jobs
    are cancelled until the thread has ended, then TimeoutError is raised."""
    group, held = f"{label}-{uuid.uuid4().hex[:8]}", {}

    def run():
        sc.setJobGroup(group, label, interruptOnCancel=True)
        sc.setLocalProperty("spark.scheduler.pool", label)
        try:
            held["value"] = work()
        except BaseException as e:  # noqa: BLE001 - raised again by the caller's thread
            held["error"] = e
    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    late = thread.is_alive()
    while thread.is_alive():  # a cancelled job may be followed by another
        sc.cancelJobGroup(group)
        thread.join(0.2)
    if late:
        raise TimeoutError(f"ended after its limit of {seconds:g} s")
    if "error" in held:
        raise held["error"]
    return held["value"]


def evaluate_one(spec: Spec, train: DataFrame, test: DataFrame, target: str,
                 feature_cols: list[str], limit: float | None = None) -> dict:
    """Guarded fit + evaluate: a failure, or a fit of more than ``limit`` seconds,
    gives a zero row with the error."""
    try:
        model, secs = within_limit(train.sparkSession.sparkContext, lambda: fit_one(spec, train, target, feature_cols),
                                   limit, spec.name)
        scored = score(model, spec, test, target, feature_cols).select(
            F.col(target).alias("_y"), SCORE, F.col(PRED).cast("int").alias("_p")).persist()
        m = classification_metrics(scored, "_y", "_p").first()
        auc = roc_auc(scored, "_y", SCORE).first()["roc_auc"]
        scored.unpersist()
        return {"model": spec.name, "f1": m["f1"], "roc_auc": None if auc is None else round(auc, 4),
                "accuracy": m["accuracy"], "precision": m["precision"], "recall": m["recall"],
                "fit_seconds": secs, "status": "OK"}
    except Exception as e:  # noqa: BLE001 - the comparison must survive one model
        status = f"{'TIMEOUT' if isinstance(e, TimeoutError) else 'FAILED'}: {e}"
        return {"model": spec.name, "f1": 0.0, "roc_auc": 0.0, "accuracy": 0.0, "precision": 0.0,
                "recall": 0.0, "fit_seconds": 0.0, "status": status}


LEADERBOARD_SCHEMA = ("model string, f1 double, roc_auc double, accuracy double, precision double, "
                      "recall double, fit_seconds double, status string")


def evaluate_models(specs: list[Spec], train: DataFrame, test: DataFrame, target: str,
                    feature_cols: list[str], parallelism: int = 4, limit: float | None = None) -> DataFrame:
    """Fit and evaluate every spec; up to ``parallelism`` fits run as
    concurrent Spark jobs (the scheduler shares the executors), each for at most
    ``limit`` seconds."""
    spark = train.sparkSession
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        rows = list(pool.map(lambda s: evaluate_one(s, train, test, target, feature_cols, limit), specs))
    return spark.createDataFrame([tuple(r.values()) for r in rows], LEADERBOARD_SCHEMA)


def leaderboard(results: DataFrame, top: int | None = None) -> DataFrame:
    ranked = results.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("f1"), "model")))
    return ranked.where(F.col("rank") <= top) if top else ranked
