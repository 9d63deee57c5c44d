"""Cross-validation and search of model settings (E19-E22).

* A boosted ensemble of m rounds is the first m trees of a longer one, so trials
  that differ in rounds only share one fit: running sums over its trees give
  the confusion counts at every length in one pass over the held-out rows.
* Trials and their results live in a ledger in the shared folder: a table of what
  is to be fitted and, for each finished fit, a folder that appears whole or not
  at all. A search that lost its driver, or whose time was up, goes on where it
  stopped by an anti-join of the two; a fit that is done is never done again.
* Refits and the best-of table take the ledger's winners.
"""

from __future__ import annotations

import json
import math
import random
import time
from concurrent.futures import ThreadPoolExecutor
from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stage, work_path
from .boosting import BoostedTrees
from .metrics import classification_metrics, roc_auc
from .models import FEATURES, LABEL, SCORE, WEIGHT, _prepare, _scaled

# Search ranges of the tuned families (trees, depth); callers may pass a
# smaller budget.
DEFAULT_BUDGET = {"iters": (100, 500), "depth": (3, 10), "mlp_iter": 200}
FAMILY_WEIGHTS = {"boosted": "balanced", "boosted_weighted": "fixed", "mlp": None}
BOOSTED = ("boosted", "boosted_weighted")


def search_space(family: str, rng: random.Random, n_features: int, budget: dict | None = None) -> dict:
    """One seeded draw (uniform / log-uniform / integer / choice), rounds left out."""
    b = {**DEFAULT_BUDGET, **(budget or {})}

    def logu(a, c):
        return math.exp(rng.uniform(math.log(a), math.log(c)))
    if family == "boosted":
        return {"maxDepth": rng.randint(*b["depth"]), "stepSize": logu(0.01, 0.3),
                "subsamplingRate": rng.uniform(0.5, 1.0),
                "featureSubsetStrategy": str(round(rng.uniform(0.5, 1.0), 3)),
                "minInstancesPerNode": rng.randint(10, 100)}
    if family == "boosted_weighted":
        return {"maxDepth": rng.randint(*b["depth"]), "stepSize": logu(0.01, 0.3),
                "minInfoGain": logu(1e-3, 10.0) * 1e-3, "subsamplingRate": rng.uniform(0.5, 1.0)}
    if family == "mlp":
        layers = [rng.randint(32, 256) for _ in range(rng.randint(1, 3))]
        return {"layers": [n_features, *layers, 2], "stepSize": logu(1e-4, 1e-1),
                "solver": rng.choice(["l-bfgs", "gd"]), "maxIter": b["mlp_iter"]}
    raise ValueError(family)


def estimator(family: str, params: dict):
    if family in BOOSTED:
        est = BoostedTrees(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, seed=42)
        return est.copy({est.getParam(k): v for k, v in params.items()})
    est = MultilayerPerceptronClassifier(featuresCol=FEATURES, labelCol=LABEL, maxIter=200, seed=42)
    return _scaled(est.copy({est.getParam(k): v for k, v in params.items()}))


# ---------------------------------------------------------------- lengths of an ensemble
def flat_trees(spark: SparkSession, model: GBTClassificationModel) -> dict:
    """Node arrays of all trees, end to end, read from the written model: feature
    (-1: leaf), threshold, left, right, value, and each tree's root and weight.
    Their size depends on rounds and depth, not on the data."""
    path = work_path(spark, "trees")
    model.write().save(path)
    held = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild",
        F.col("nodeData.split.featureIndex").alias("feature"), F.col("nodeData.split.numCategories").alias("categories"),
        F.col("nodeData.split.leftCategoriesOrThreshold").alias("split")).toPandas().sort_values(["treeID", "id"])
    tree, leaf = held["treeID"].to_numpy(), held["leftChild"].to_numpy() < 0
    if (held["categories"].to_numpy()[~leaf] >= 0).any():
        raise ValueError("splits on categories are not expected: all features are numbers")
    root = np.searchsorted(tree, np.arange(len(model.treeWeights)))
    return {"feature": np.where(leaf, -1, held["feature"]).astype(np.int32), "root": root, "weight": np.array(model.treeWeights),
            "threshold": np.array([s[0] if len(s) else 0.0 for s in held["split"]]),
            "left": (root[tree] + held["leftChild"].to_numpy()).astype(np.int32),
            "right": (root[tree] + held["rightChild"].to_numpy()).astype(np.int32), "value": held["prediction"].to_numpy(float)}


def leaf_values(trees: dict, x: np.ndarray) -> Iterator[np.ndarray]:
    """Weighted value of each row in tree after tree."""
    rows = np.arange(len(x))
    for root, weight in zip(trees["root"], trees["weight"]):
        at = np.full(len(x), root)
        while (inner := (f := trees["feature"][at]) >= 0).any():
            left = x[rows, np.maximum(f, 0)] <= trees["threshold"][at]
            at = np.where(inner, np.where(left, trees["left"][at], trees["right"][at]), at)
        yield weight * trees["value"][at]


def prefix_counts(model: GBTClassificationModel, held: DataFrame) -> DataFrame:
    """(rounds, tp, fp, fn, tn, f1) of every length of the ensemble on ``held``
    (LABEL, FEATURES): one pass, in which tasks add up four counts a length."""
    sent = held.sparkSession.sparkContext.broadcast(flat_trees(held.sparkSession, model))
    rounds = len(model.treeWeights)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((rounds, 4), np.int64)
        for pdf in batches:
            y, x = pdf["y"].to_numpy() > 0, np.stack(pdf["x"])
            margin = np.zeros(len(x))
            for r, v in enumerate(leaf_values(sent.value, x)):
                margin += v
                p = margin > 0
                counts[r] += ((p & y).sum(), (p & ~y).sum(), (~p & y).sum(), (~p & ~y).sum())
        yield pd.DataFrame(counts, columns=["tp", "fp", "fn", "tn"]).assign(rounds=np.arange(1, rounds + 1))

    cells = ("tp", "fp", "fn", "tn")
    found = held.select(F.col(LABEL).alias("y"), vector_to_array(FEATURES).alias("x")).mapInPandas(
        run, "tp long, fp long, fn long, tn long, rounds int").groupBy("rounds").agg(*[F.sum(c).alias(c) for c in cells])
    hit = F.col("tp") * 2
    return found.withColumn("f1", F.when(hit > 0, hit / (hit + F.col("fp") + F.col("fn"))).otherwise(F.lit(0.0)))


# ---------------------------------------------------------------- folds
def fold_sets(folded: DataFrame, target: str, feature_cols: list[str], family: str, k: int = 5,
              fold_col: str = "fold", balance: Callable[[DataFrame, int], DataFrame] | None = None) -> list[tuple]:
    """(training, held-out) pairs of the precomputed folds, assembled and written
    once for all trials of a family. ``balance(train, fold)`` (oversampling) sees the
    training part only."""
    def pair(i):
        train = folded.where(F.col(fold_col) != i).drop(fold_col)
        held = folded.where(F.col(fold_col) == i).drop(fold_col)
        train = balance(train, i) if balance else train
        keep = [FEATURES, LABEL, WEIGHT]
        return (_prepare(train, target, feature_cols, FAMILY_WEIGHTS[family]).select(*keep).transform(stage),
                _prepare(held, target, feature_cols, None).select(*keep).transform(stage))
    with ThreadPoolExecutor(max_workers=max(1, k)) as pool:
        return list(pool.map(pair, range(k)))


def fold_f1(family: str, params: dict, lengths: list[int | None], pair: tuple) -> list[float]:
    """F1 (class 1) on the held-out part at each of ``lengths`` rounds, from one fit."""
    train, held = pair
    if family in BOOSTED:
        model = estimator(family, {**params, "maxIter": max(lengths)}).fit(train)
        f1 = {r["rounds"]: r["f1"] for r in prefix_counts(model, held).where(F.col("rounds").isin(list(lengths))).collect()}
        return [f1[n] for n in lengths]
    model = estimator(family, params).fit(train)
    return [MulticlassClassificationEvaluator(labelCol=LABEL, metricName="fMeasureByLabel", metricLabel=1.0)
            .evaluate(model.transform(held))] * len(lengths)


def cv_f1(family: str, params: dict, folded: DataFrame, target: str, feature_cols: list[str],
          fold_col: str = "fold", parallelism: int = 5, k: int = 5,
          balance: Callable[[DataFrame, int], DataFrame] | None = None) -> float:
    """Mean F1 (class 1) over precomputed stratified folds: k fits, run side by side."""
    sets = fold_sets(folded, target, feature_cols, family, k, fold_col, balance)
    params = dict(params)
    rounds = [params.pop("maxIter")] if family in BOOSTED else [None]
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        found = list(pool.map(lambda pair: fold_f1(family, params, rounds, pair)[0], sets))
    return float(np.mean(found))


# ---------------------------------------------------------------- ledger
PLAN_SCHEMA = "family string, trial int, setting int, rounds int, params string"
DONE_SCHEMA = "family string, trial int, setting int, rounds int, params string, fold int, f1 double, seconds double"


def draw_trials(families: list[str], n_features: int, n_trials: int = 30, lengths: int = 5, seed: int = 42,
                budget: dict | None = None) -> list[tuple]:
    """Rows of PLAN_SCHEMA: ``n_trials`` a family. Boosted families draw a setting for
    every ``lengths`` trials, which differ in rounds (1: all settings of their own)."""
    rows = []
    for family in families:
        rng = random.Random(f"{seed}:{family}")
        share = lengths if family in BOOSTED else 1
        for t in range(n_trials):
            if t % share == 0:
                setting = json.dumps(search_space(family, rng, n_features, budget), sort_keys=True)
            rounds = rng.randint(*{**DEFAULT_BUDGET, **(budget or {})}["iters"]) if family in BOOSTED else None
            rows.append((family, t, t // share, rounds, setting))
    return rows


class Ledger:
    """Trials to fit and finished fits under one shared folder. ``open`` keeps what
    is there, so any later session can go on."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def open(self, trials: list[tuple]) -> "Ledger":
        try:
            known = self.plan().take(1)
        except AnalysisException:  # no folder yet
            known = []
        if not known:
            self.spark.createDataFrame([], DONE_SCHEMA).write.mode("overwrite").parquet(f"{self.path}/done/start")
            self.spark.createDataFrame(trials, PLAN_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/plan")
        return self

    def plan(self) -> DataFrame:
        return self.spark.read.schema(PLAN_SCHEMA).parquet(f"{self.path}/plan")

    def done(self) -> DataFrame:
        return self.spark.read.schema(DONE_SCHEMA).option("recursiveFileLookup", True).parquet(f"{self.path}/done")

    def pending(self, k: int) -> list[tuple]:
        """(family, setting, fold, [(trial, rounds, params)]) still to fit."""
        units = self.plan().withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        units = units.join(self.done(), ["family", "setting", "fold"], "left_anti")
        found: dict = {}
        for r in units.orderBy("family", "setting", "fold", "trial").collect():  # trials x folds
            found.setdefault((r["family"], r["setting"], r["fold"]), []).append((r["trial"], r["rounds"], r["params"]))
        return [(*key, trials) for key, trials in found.items()]

    def write(self, family: str, setting: int, fold: int, rows: list[tuple]) -> None:
        """One folder a fit: readers see it when it is whole, a repeated write replaces it."""
        out = self.spark.createDataFrame(rows, DONE_SCHEMA).coalesce(1)
        out.write.mode("overwrite").parquet(f"{self.path}/done/{family}-{setting}-{fold}")

    def trials(self, k: int) -> DataFrame:
        """(family, trial, rounds, params, cv_f1, seconds) of the trials with all folds."""
        by = self.done().groupBy("family", "trial", "rounds", "params").agg(
            F.count(F.lit(1)).alias("n"), F.avg("f1").alias("cv_f1"), F.sum("seconds").alias("seconds"))
        return by.where(F.col("n") == k).drop("n")

    def winners(self, k: int) -> DataFrame:
        """Each family's trial with the highest mean F1 (ties: the first)."""
        first = Window.partitionBy("family").orderBy(F.desc("cv_f1"), "trial")
        return self.trials(k).withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")


def run_search(ledger: Ledger, sets: dict[str, list[tuple]], k: int = 5, parallelism: int = 8,
               seconds: float | None = None) -> int:
    """Fit what the ledger still lacks, ``parallelism`` fits at a time; no fit starts
    after ``seconds``. ``sets`` holds each family's ``fold_sets``. Returns how many
    fits are still pending."""
    ends = math.inf if seconds is None else time.time() + seconds

    def one(unit):
        family, setting, fold, trials = unit
        if time.time() >= ends:
            return
        began = time.time()
        f1 = fold_f1(family, json.loads(trials[0][2]), [t[1] for t in trials], sets[family][fold])
        spent = (time.time() - began) / len(trials)
        ledger.write(family, setting, fold, [(family, t, setting, rounds, params, fold, float(v), spent)
                                             for (t, rounds, params), v in zip(trials, f1)])
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        for found in [pool.submit(one, unit) for unit in ledger.pending(k)]:
            found.result()
    return len(ledger.pending(k))


# ---------------------------------------------------------------- refit
def refit_and_validate(family: str, params: dict, train: DataFrame, val: DataFrame, target: str,
                       feature_cols: list[str], balance: Callable[[DataFrame], DataFrame] | None = None) -> dict:
    """Fit on all of ``train``, after ``balance`` (oversampling); F1 and AUC on
    ``val`` as it is."""
    tr = _prepare(balance(train) if balance else train, target, feature_cols, FAMILY_WEIGHTS[family])
    model = estimator(family, params).fit(tr)
    scored = model.transform(_prepare(val, target, feature_cols, None)).select(
        F.col(target).alias("_y"), vector_to_array("probability").getItem(1).alias(SCORE),
        F.col("prediction").cast("int").alias("_p")).transform(stage)
    m = classification_metrics(scored, "_y", "_p").first()
    auc = roc_auc(scored, "_y", SCORE).first()["roc_auc"]
    return {"model": model, "f1": m["f1"], "auc": None if auc is None else round(auc, 4)}


def winner_params(row) -> dict:
    held = json.loads(row["params"])
    return held if row["rounds"] is None else {**held, "maxIter": row["rounds"]}


def tuned_models(ledger: Ledger, k: int, train: DataFrame, val: DataFrame, target: str,
                 feature_cols: list[str], parallelism: int = 3) -> tuple[DataFrame, dict]:
    """Refit every family's winner on all of ``train`` (balanced by the caller) and
    validate it: the best-of table and the fitted models by family."""
    rows = ledger.winners(k).orderBy("family").collect()  # a row a family
    if not rows:
        raise ValueError("no trial of the ledger has all its folds")
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        fits = list(pool.map(lambda r: refit_and_validate(r["family"], winner_params(r), train, val, target, feature_cols), rows))
    report = ledger.spark.createDataFrame(
        [(r["family"], json.dumps(winner_params(r), sort_keys=True), r["cv_f1"], f["f1"], f["auc"]) for r, f in zip(rows, fits)],
        "family string, params string, cv_f1 double, f1 double, roc_auc double")
    return best_of(report), {r["family"]: f["model"] for r, f in zip(rows, fits)}


def best_of(report: DataFrame) -> DataFrame:
    """Marks the row with the highest F1 (ties: first family). One row a
    family, so the window without partitions holds a handful of rows."""
    return report.withColumn("is_best", F.row_number().over(Window.orderBy(F.desc("f1"), "family")) == 1)
