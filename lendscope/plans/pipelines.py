"""End-to-end plans: train (clean -> split -> features -> model -> threshold)
and score (impute -> features -> model -> decision). The same
``ScoringPlan.score`` serves batch tables and the request stream."""

from __future__ import annotations

import os
from dataclasses import dataclass
from typing import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranking as rk
from ..functions.expressions import dbl
from ..operators import cleaning as cl
from ..operators import features as fe
from ..operators import metrics as me
from ..operators import models as mo
from ..operators import neighbors as nb
from ..operators import scoring as scr
from ..operators import search as se
from ..schema import ID_COL, SEED, SMOTE_K, SMOTE_RATIO, TARGET_COL, TEST_SIZE, VAL_SIZE
from ..session import stage
from ..sources import io as sio
from ..sources.runs import RunStore


@dataclass
class ScoringPlan:
    imputer: cl.MissingImputerModel
    features: fe.FeatureModel
    model: PipelineModel
    threshold: float
    model_type: str = "LogisticRegression"
    oversampled: bool = False

    def prepare(self, df: DataFrame, keep: list[str]) -> DataFrame:
        """Impute and coerce (no dedup: scoring input is taken as is), then
        the fitted feature chain with column alignment."""
        clean = cl.TypeEnforcer().transform(self.imputer.transform(cl.ErrorCorrector().transform(df)))
        return self.features.transform(clean, keep=keep)

    def probability(self, df: DataFrame, keep: list[str]) -> DataFrame:
        scored = self.model.transform(self.prepare(df, keep))
        return scored.withColumn("_p", vector_to_array(F.col("probability")).getItem(1))

    def score(self, df: DataFrame, keep: list[str], stamp: bool = True) -> DataFrame:
        p = self.probability(df, keep)
        out = scr.score_frame(p, F.col("_p"), self.threshold, stamp=stamp)
        return out.select(*keep, "default_prob", "prediction", "risk_tier", "label",
                          *(["scored_at"] if stamp else []))

    def describe(self, spark: SparkSession) -> DataFrame:
        feats = self.features.feature_cols
        return spark.createDataFrame(
            [(self.model_type, float(self.threshold), self.size(), len(feats), ",".join(feats))],
            "model_type string, threshold double, n_estimators int, n_features int, features string")

    def size(self) -> int:
        """Trees of an ensemble; 1 for any other model."""
        return int(getattr(self.model.stages[-1], "getNumTrees", 1))


# ---------------------------------------------------------------- state on disk
def save_plan(spark: SparkSession, plan: ScoringPlan, path: str) -> str:
    """Everything scoring needs, under one folder: the fitted state table
    (imputer, encoder, scaler, feature list, threshold, kind) and the model."""
    rows = (plan.imputer.state_rows() + plan.features.state_rows()
            + [("", "threshold", "", float(plan.threshold)), ("", "model_type", "", plan.model_type),
               ("", "oversampled", "", int(plan.oversampled))])
    sio.save_state(spark, rows, os.path.join(path, "state"))
    sio.save_model(plan.model, os.path.join(path, "model"))
    return path


def load_plan(spark: SparkSession, path: str) -> ScoringPlan:
    """The plan of ``save_plan``, in any later session."""
    held: dict[str, list] = {}
    for r in sio.load_state(spark, os.path.join(path, "state")).collect():  # a row a column or category
        held.setdefault(r["kind"], []).append((r["column"], r["key"], r["num_value"], r["str_value"]))

    def numbers(kind):
        return {c: n for c, _, n, _ in held.get(kind, [])}

    def keyed(kind):
        out: dict[str, dict] = {}
        for c, k, n, _ in held.get(kind, []):
            out.setdefault(c, {})[k] = int(n)
        return out

    imputer = cl.MissingImputerModel(numbers("median"), {c: v for c, _, _, v in held.get("mode", [])})
    categories = {c: sorted(m, key=m.get) for c, m in keyed("category").items()}
    feats = sorted(held.get("feature", []), key=lambda x: x[2])
    features = fe.FeatureModel(fe.EncoderModel(categories, keyed("label")),
                               fe.RobustScalerModel(numbers("center"), numbers("scale")),
                               [c for c, *_ in held.get("drop", [])], [c for c, *_ in feats])
    return ScoringPlan(imputer, features, sio.load_model(os.path.join(path, "model")),
                       numbers("threshold")[""], held["model_type"][0][3], bool(numbers("oversampled")[""]))


@dataclass
class TrainingData:
    """Everything before the model: the deduplicated raw rows, fitted imputer and features,
    all parts' features, and the train part as models see it (balanced if asked for)."""
    rows: DataFrame
    imputer: cl.MissingImputerModel
    features: fe.FeatureModel
    parts: DataFrame
    train: DataFrame
    oversampled: bool

    def part(self, name: str) -> DataFrame:
        return self.parts.where(F.col("part") == name)


def training_data(applications: DataFrame, oversample: bool = False) -> TrainingData:
    """Clean, split, fit imputer and features on the train part; ``oversample`` raises
    the minority of the train part by SMOTE."""
    rows = cl.DuplicateRemover().transform(applications).transform(stage)
    sp0 = rk.stratified_split(cl.ErrorCorrector().transform(rows), ID_COL, TARGET_COL, TEST_SIZE, VAL_SIZE, seed=SEED, salt="split")
    sp0 = sp0.transform(stage)
    train_raw = sp0.where(F.col("part") == "train")
    imputer = cl.MissingImputer().fit(train_raw)
    cleaned = cl.TypeEnforcer().transform(imputer.transform(sp0))
    fm = fe.fit_features(cleaned.where(F.col("part") == "train"), exclude=(ID_COL, TARGET_COL, "part"))
    feats = fm.transform(cleaned, keep=[ID_COL, TARGET_COL, "part"]).transform(stage)
    train = feats.where(F.col("part") == "train").drop("part")
    if oversample:
        train = nb.smote(train, ID_COL, TARGET_COL, fm.feature_cols, SMOTE_RATIO, SMOTE_K, SEED).transform(stage)
    return TrainingData(rows, imputer, fm, feats, train, oversample)


def _logistic(n: float):
    return LogisticRegression(featuresCol=mo.FEATURES, labelCol=mo.LABEL, weightCol=mo.WEIGHT, maxIter=1000,
                              regParam=1.0 / n, standardization=False)


#: name -> (estimator over ``mo.FEATURES`` given the sum of weights, class weights)
Candidates = dict[str, tuple[Callable, str | None]]
DEFAULT_CANDIDATES: Candidates = {"LogisticRegression": (_logistic, "balanced")}


def fit_plan(data: TrainingData, name: str, candidate: tuple[Callable, str | None]) -> tuple[ScoringPlan, float]:
    """Fit one candidate on the train part; the plan at cut-off 0.5 and its F1 on val."""
    build, weights = candidate
    train = mo.with_weights(data.train, TARGET_COL, weights)
    n = train.agg(F.sum(mo.WEIGHT)).first()[0]
    pipe = Pipeline(stages=[mo.assembler(data.features.feature_cols), build(n)]).fit(train)
    plan = ScoringPlan(data.imputer, data.features, pipe, 0.5, name, data.oversampled)
    val = pipe.transform(data.part("val")).select(TARGET_COL, F.col("prediction").cast("int").alias("pred"))
    return plan, me.classification_metrics(val, TARGET_COL, "pred").first()["f1"]


def train_best(applications: DataFrame, candidates: Candidates | None = None,
               oversample: bool = False) -> tuple[ScoringPlan, TrainingData, DataFrame]:
    """Balance, fit every candidate on the train part, pick the one with the highest
    F1 on val (ties: the first name), tune its cut-off on val. Returns the plan, the
    data and the candidates' table (family, f1, is_best)."""
    data = training_data(applications, oversample)
    fits = {name: fit_plan(data, name, c) for name, c in (candidates or DEFAULT_CANDIDATES).items()}
    table = se.best_of(applications.sparkSession.createDataFrame([(n, f1) for n, (_, f1) in fits.items()], "family string, f1 double"))
    plan = fits[min(fits, key=lambda n: (-fits[n][1], n))][0]
    val = plan.model.transform(data.part("val")).withColumn("_p", vector_to_array(F.col("probability")).getItem(1))
    plan.threshold = me.best_threshold(me.threshold_sweep(val, TARGET_COL, "_p"))
    return plan, data, table


def train_plan(applications: DataFrame, estimator=None, oversample: bool = False) -> tuple[ScoringPlan, DataFrame]:
    """``train_best`` of one estimator (default: weighted logistic regression): the plan
    and the split features."""
    one = {type(estimator).__name__: (lambda n: estimator, "balanced")} if estimator else None
    plan, data, _ = train_best(applications, one, oversample)
    return plan, data.parts


def publish_plan(store: RunStore, plan: ScoringPlan, data: TrainingData, table: DataFrame, tags: dict | None = None) -> str:
    """Evaluate the plan on the test part and publish the run: parameters, metrics, and
    as artifacts the plan itself, its threshold, the report by class and the candidates.
    Then serve it. Returns the run's id."""
    spark = store.spark
    test = plan.model.transform(data.part("test")).withColumn("_p", vector_to_array(F.col("probability")).getItem(1)).select(
        TARGET_COL, "_p", (F.col("_p") >= dbl(plan.threshold)).cast("int").alias("pred")).transform(stage)
    metrics = me.classification_metrics(test, TARGET_COL, "pred").first().asDict()
    metrics["roc_auc"] = me.roc_auc(test, TARGET_COL, "_p").first()["roc_auc"]
    run_id = store.publish(
        {"model_type": plan.model_type, "threshold": plan.threshold, "n_features": len(plan.features.feature_cols),
         "n_estimators": plan.size(), "smote": plan.oversampled}, metrics, tags, {
            "plan": lambda path: save_plan(spark, plan, path),
            "threshold": lambda path: sio.write_report(spark.createDataFrame([(float(plan.threshold),)], "threshold double"), path),
            "report": lambda path: sio.write_report(me.classification_report(test, TARGET_COL, "pred"), path),
            "candidates": lambda path: sio.write_report(table, path)})
    store.promote(run_id)
    return run_id


def served_plan(store: RunStore) -> ScoringPlan:
    """The plan that is served now, from disk."""
    return load_plan(store.spark, store.artifact(store.serving(), "plan"))
