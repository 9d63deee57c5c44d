import numpy as np
from pyspark.sql import functions as F

from lendscope.functions.expressions import risk_tier
from lendscope.operators import features as fe
from lendscope.operators import scoring as scr


def test_encoder_unseen_and_null(spark):
    train = spark.createDataFrame([("x", "u"), ("y", "v")], "education_level string, region string")
    enc = fe.Encoder(one_hot_cols=["education_level"], label_cols=["region"]).fit(train)
    test = spark.createDataFrame([(None, "w"), ("y", "v")], "education_level string, region string")
    rows = enc.transform(test).orderBy("region").collect()
    # unseen region 'w' -> -1, null category -> all one-hot columns 0
    assert rows[0]["region"] == -1
    assert rows[0]["education_level_x"] == 0 and rows[0]["education_level_y"] == 0
    assert rows[1]["region"] == 1
    assert rows[1]["education_level_x"] == 0 and rows[1]["education_level_y"] == 1


def test_scaler_zero_range_divides_by_one(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, 3.0), (5.0, 4.0)], "a double, b double")
    m = fe.RobustScaler(["a", "b"]).fit(df)
    assert m.scale["a"] == 1.0 and m.center["a"] == 5.0
    assert m.scale["b"] == np.quantile([1, 2, 3, 4], 0.75) - np.quantile([1, 2, 3, 4], 0.25)


def test_align_zero_fills(spark):
    df = spark.createDataFrame([(1, 2.0)], "id int, a double")
    out, filled = fe.align_columns(df, ["a", "b"], keep=["id"])
    assert out.columns == ["id", "a", "b"] and filled == ["b"] and out.first().b == 0


def test_tiers_and_decision(spark):
    df = spark.createDataFrame([(0.7,), (0.6999,), (0.4,), (0.39,)], "p double")
    out = scr.score_frame(df, F.col("p"), 0.43, stamp=False).collect()
    assert [r.risk_tier for r in out] == ["High", "Medium", "Medium", "Low"]
    assert [r.prediction for r in out] == [1, 1, 0, 0]
    assert [r.label for r in out] == ["Default", "Default", "No Default", "No Default"]
