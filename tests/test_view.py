from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lendscope.operators.cleaning import DuplicateRemover
from lendscope.sources import tables as ta


@pytest.fixture()
def tables(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    put("region", [(0, "ASIA")], "r_regionkey long, r_name string")
    put("nation", [(3, 0)], "n_nationkey long, n_regionkey long")
    put("customer", [(i, 3, 10.5 * i, "AUTO") for i in range(1, 5)], "c_custkey long, c_nationkey long, c_acctbal double, c_mktsegment string")
    put("orders", [(i, 1 + i % 4, "O", 100.25 * i, "1-URGENT") for i in range(1, 41)] + [(7, 4, "F", 1.0, "2-HIGH"), (None, 1, "F", 2.0, "2-HIGH")],
        "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")
    lines = [(i % 30, "R" if i % 5 else "N", 901.37 * i, 0.01 * (i % 11), 0.01 * (i % 9)) for i in range(1, 300)]
    put("lineitem", lines + [(3, "N", 8.7e11, 0.07, 0.1), (3, "N", 9.1e12, 0.03, None), (None, "R", 5.0, 0.1, 0.1)],
        "l_orderkey long, l_returnflag string, l_extendedprice double, l_discount double, l_tax double")
    return str(tmp_path)


def test_line_sums_are_those_of_decimals(spark, tables):
    held = ta.load(spark, tables, "lineitem")
    want = held.groupBy("l_orderkey").agg(*[
        F.sum((F.col("l_extendedprice") * F.col(c)).cast("decimal(18,4)")).cast("double").alias(n) for c, n in (("l_discount", "disc"), ("l_tax", "tax"))])
    got = ta.order_lines(spark, tables)
    assert sorted(map(repr, got.select("l_orderkey", "disc", "tax").collect())) == sorted(map(repr, want.collect()))


def test_amounts_are_the_nearest_doubles(spark, tables):
    big = ta._amount("x")
    rows = spark.createDataFrame([(v,) for v in (0, 1, -(1 << 53), (1 << 53) + 1, 9 * 10 ** 18 + 7, None)], "x long").select("x", big.alias("y")).collect()
    assert [r.y for r in rows] == [None if r.x is None else float(Decimal(r.x) / 10000) for r in rows]


def test_dedup_moves_no_row_of_the_view_again(spark, tables):
    """The view ends with the join on the order key, which its rows hold."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        view = ta.applications(spark, tables)
        plans = [d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
                 for d in (view, DuplicateRemover().transform(view))]
        assert plans[0] == plans[1]
        assert view.count() == 42 and DuplicateRemover().transform(view).count() == 42
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
