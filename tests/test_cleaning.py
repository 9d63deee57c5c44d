import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lendscope.operators import cleaning as cl


def test_dedup_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    assert cl.DuplicateRemover().transform(df).count() == 2
    r = cl.dedup_counts(df).first()
    assert (r.rows_before, r.rows_after, r.removed) == (3, 2, 1)


def test_rules_null_out_and_count(spark):
    df = spark.createDataFrame([(-5.0, 250, 17), (100.0, 900, 30), (None, 600, None)],
                               "annual_income double, credit_score bigint, age bigint")
    out = cl.ErrorCorrector().transform(df).collect()
    assert out[0].annual_income is None and out[0].credit_score is None and out[0].age is None
    assert out[1].credit_score is None and out[1].annual_income == 100.0
    counts = {r.column: r.violations for r in cl.rule_violation_counts(df).collect()}
    assert counts == {"annual_income": 1, "credit_score": 2, "age": 1}


def test_column_dropper_strictly_above(spark):
    df = spark.createDataFrame([(1, None, None), (2, 3, None)], "a int, b int, c int")
    m = cl.ColumnDropper(0.5).fit(df)
    assert m.drop_cols == ["c"]  # b has exactly 0.5 -> kept


def test_mode_ties_to_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",), (None,)], "region string")
    m = {r.column: r.mode for r in cl.distributed_modes(df, ["region"]).collect()}
    assert m == {"region": "a"}


def test_impute_keeps_fraction_then_coerce_truncates(spark):
    df = spark.createDataFrame([(45,), (46,), (None,), (10,), (50,)], "age bigint")
    imp = cl.MissingImputer(numeric_cols=["age"], categorical_cols=[]).fit(df)
    assert imp.num_fill["age"] == pd.Series([45, 46, 10, 50]).median() == 45.5
    filled = imp.transform(df).collect()
    assert filled[2].age == 45.5
    coerced = cl.TypeEnforcer(int_cols=["age"], float_cols=[], str_cols=[]).transform(imp.transform(df))
    assert coerced.collect()[2].age == 45


def test_coerce_unparseable(spark):
    df = spark.createDataFrame([("12.9",), ("x",), (None,), ("-3.7",)], "v string")
    enf = cl.TypeEnforcer(int_cols=["v"], float_cols=[], str_cols=[])
    assert [r.v for r in enf.transform(df).collect()] == [12, 0, 0, -3]
    enf = cl.TypeEnforcer(int_cols=[], float_cols=["v"], str_cols=[])
    assert [r.v for r in enf.transform(df).collect()] == [12.9, None, None, -3.7]


def test_quality_summary(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    r = cl.quality_summary(df).first()
    assert (r.rows, r.columns, r.nulls, r.duplicates) == (3, 2, 2, 1)


def test_imputation_null_counts(spark):
    df = spark.createDataFrame([(None, None, "a"), (1.0, None, None)], "x double, y double, z string")
    m = cl.MissingImputer(numeric_cols=["x"], categorical_cols=["z"]).fit(df)
    r = cl.imputation_null_counts(df, m).first()
    assert (r.nulls_before, r.nulls_after, r.filled) == (4, 2, 2)
