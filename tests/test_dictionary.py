import numpy as np
import pytest
from pyspark.sql import functions as F

from lendscope.operators import dictionary as di
from lendscope.operators import features as fe
from lendscope.operators import profiling as pr

N = 50_000


@pytest.fixture(scope="module")
def labels(spark):
    """50,000 values, one of which a third of the rows hold; a small column; NULLs."""
    hot = F.when(F.col("id") % 3 == 0, F.lit("v00000")).otherwise(F.format_string("v%05d", F.col("id") % N))
    return spark.range(150_000).select(
        "id", F.when(F.col("id") == 7, F.lit(None)).otherwise(hot).alias("big"),
        F.element_at(F.array(F.lit("b"), F.lit("é"), F.lit("a")), (F.col("id") % 3 + 1).cast("int")).alias("small")).persist()


def test_codes_are_dense_ranks_in_sorted_order(spark, labels):
    table = di.build_dictionary(labels, ["big", "small"])
    rows = table.orderBy("column", "value").collect()
    big = [r for r in rows if r["column"] == "big"]
    want = sorted({f"v{i % N:05d}" for i in range(150_000) if i % 3 and i != 7} | {"v00000"})
    assert [r["value"] for r in big] == want and [r["code"] for r in big] == list(range(len(want)))
    assert [(r["value"], r["code"]) for r in rows if r["column"] == "small"] == [("a", 0), ("b", 1), ("é", 2)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_more_labels_than_literals_are_joined(spark, labels, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(di, "MOST_BROADCAST", 0)
    model = fe.Encoder(one_hot_cols=["small"], label_cols=["big", "small"]).fit(labels)
    assert set(model.large_labels) == {"big"} and model.label_maps["small"] == {"a": 0, "b": 1, "é": 2}
    new = labels.unionByName(spark.createDataFrame([(-1, "never seen", "a")], "id long, big string, small string"))
    out = fe.EncoderModel({}, {}, model.table, {}, model.large_labels).transform(new)
    assert out.columns == new.columns
    got = {r["id"]: r["big"] for r in out.where("id IN (-1, 0, 1, 7, 49999)").collect()}
    codes = {r["value"]: r["code"] for r in model.table.where("column = 'big'").collect()}
    assert got == {-1: -1, 0: 0, 1: codes["v00001"], 7: -1, 49999: codes["v49999"]} and out.count() == 150_001


def test_one_hot_of_very_many_values_is_a_sparse_vector(spark, labels):
    model = fe.Encoder(one_hot_cols=["big"], label_cols=[]).fit(labels)
    new = labels.where("id < 100").unionByName(spark.createDataFrame([(-1, "never seen", "a")], "id long, big string, small string"))
    n = model.large_one_hot["big"][0]
    codes = {r["value"]: r["code"] for r in model.table.collect()}
    for r in model.transform(new).join(new.select("id", F.col("big").alias("v")), "id").collect():
        assert r["big"].size == n
        assert list(r["big"].indices) == ([codes[r["v"]]] if r["v"] in codes else [])


def test_no_columns_and_no_values(spark):
    df = spark.createDataFrame([(1, None)], "id long, c string")
    model = fe.Encoder(one_hot_cols=["c"], label_cols=["c"]).fit(df)
    assert model.categories == {"c": []} and model.label_maps == {"c": {}}
    assert fe.Encoder(one_hot_cols=["x"], label_cols=[]).fit(df).transform(df).columns == ["id", "c"]


def test_histogram_of_more_groups_than_literals(spark, monkeypatch):
    df = spark.range(20_000).select((F.col("id") % 2000).alias("g"), F.sin(F.col("id")).alias("x"),
                                    F.when(F.col("id") % 5 > 0, F.col("id").cast("double")).alias("y"))
    joined = pr.histogram(df, ["x", "y"], 7, by="g")
    monkeypatch.setattr(pr, "MAX_GROUPS", 3000)
    literal = pr.histogram(df.where("g < 40"), ["x", "y"], 7, by="g")
    keys = ["column", "g", "bin"]
    a = joined.where("g < 40").orderBy(*keys).collect()
    assert a == literal.orderBy(*keys).collect() and len(a) > 0
    assert joined.select("g").distinct().count() == 2000 and joined.where("column = 'x'").agg(F.sum("count")).first()[0] == 20_000
    assert np.isfinite([r["bin_lo"] for r in a]).all()
