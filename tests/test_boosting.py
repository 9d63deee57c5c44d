import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from test_forest import _rows

from lendscope.operators import boosting as bo
from lendscope.operators import models as mo

SETTING = {"featuresCol": mo.FEATURES, "labelCol": mo.LABEL, "weightCol": mo.WEIGHT, "stepSize": 0.2, "seed": 42}


def _scored(model, df):
    got = model.transform(df).select("rid", vector_to_array("probability")[1].alias("p"), "prediction").toPandas()
    return got.set_index("rid").sort_index()


@pytest.mark.parametrize("depth, rounds", [(3, 12), (5, 4)])
def test_boosted_trees_equal_those_of_mllib(spark, depth, rounds):
    df = _rows(spark, 1500).persist()
    ours = bo.BoostedTrees(**SETTING, maxDepth=depth, maxIter=rounds).fit(df)
    theirs = GBTClassifier(**SETTING, maxDepth=depth, maxIter=rounds).fit(df)
    assert [t.numNodes for t in ours.trees] == [t.numNodes for t in theirs.trees] and ours.treeWeights == theirs.treeWeights
    a, b = _scored(ours, df), _scored(theirs, df)
    assert np.allclose(a["p"], b["p"], atol=1e-6) and (a["prediction"] == b["prediction"]).all()
    assert np.allclose(ours.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-6)
    assert ours.getMaxIter() == rounds and ours.getNumTrees == rounds and ours.numFeatures == 4


def test_rows_of_several_tasks_give_the_trees_of_one(spark):
    df = _rows(spark, 1500).repartition(3).transform(mo.stage)
    one, three = (bo.BoostedTrees(**SETTING, maxDepth=3, maxIter=5) for _ in range(2))
    three.task_rows = 500
    a, b = one.fit(df), three.fit(df)
    assert [t.toDebugString.split("\n", 1)[1] for t in a.trees] == [t.toDebugString.split("\n", 1)[1] for t in b.trees]


def test_unknown_settings_are_fitted_by_mllib(spark):
    df = _rows(spark, 300)
    est = bo.BoostedTrees(**SETTING, maxDepth=2, maxIter=3, subsamplingRate=0.5)
    assert not est._known(df) and bo.BoostedTrees(**SETTING)._known(df) and est.fit(df).getNumTrees == 3


def test_packs_hold_every_feature_once():
    bins = [2, 2, 2, 32, 32, 32, 7, 1, 255]
    found = bo.packs(bins, 4096)
    assert sorted(f for g in found for f in g) == list(range(9)) and all(np.prod([bins[f] for f in g]) <= 4096 for g in found) and len(found) < 6
