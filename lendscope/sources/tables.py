"""Driver tables and the applicant view built from them.

The applicant view follows FIXTURES.md section 3: orders joined to customer,
nation and region, left-joined to a per-order lineitem aggregate, then four
layers of derived columns and a 0.5 % duplicate block. It is the test input
of every applicant operator; its work grows with orders and lineitem.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import APPLICATION_COLUMNS

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _d(x) -> F.Column:
    """A double literal (keeps float arithmetic identical to the SQL text)."""
    return F.lit(float(x))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order lineitem aggregate: one shuffle on l_orderkey with a
    map-side partial aggregate, so a hot order key is pre-combined."""
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_extendedprice", "l_discount", "l_tax"
    )
    return li.groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).cast("bigint").alias("returned"),
        F.sum(_units(F.col("l_extendedprice") * F.col("l_discount"))).alias("disc"),
        F.sum(_units(F.col("l_extendedprice") * F.col("l_tax"))).alias("tax"),
    ).withColumns({"disc": _amount("disc"), "tax": _amount("tax")})


def _units(x: F.Column) -> F.Column:
    """``x`` rounded to decimal(18,4), as a whole number of ten-thousandths: sums of
    longs are exact like those of decimals, and several times as fast."""
    return (x.cast("decimal(18,4)") * F.lit(10000).cast("decimal(5,0)")).cast("bigint")


def _amount(c: str) -> F.Column:
    """The double nearest to a number of ten-thousandths; up to 2 ** 53 a division of doubles is that."""
    exact = F.abs(F.col(c)) <= F.lit(1 << 53)
    return F.when(exact, F.col(c).cast("double") / _d(10000)).otherwise(
        (F.col(c).cast("decimal(20,0)") / F.lit(10000).cast("decimal(5,0)")).cast("double"))


def applications_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 28-column applicant view without the duplicate block."""
    orders = load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"
    )
    customer = load(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"
    )
    # nation and region are fixed-size dimensions; Catalyst broadcasts them
    # from file statistics (autoBroadcastJoinThreshold is the size check).
    geo = (
        load(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
        .join(load(spark, sf_dir, "region").select("r_regionkey", "r_name"),
              F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "r_name")
    )
    lines = order_lines(spark, sf_dir)
    # The join with the lineitem aggregate comes last: both sides are then
    # hash-partitioned on the order key, and so is the view, whose whole rows
    # include it -- a dedup of the view moves no row again.
    base = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(geo, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    )
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    l1 = base.select(
        ok.alias("application_id"),
        (F.lit(15) + (ck * 31 + ok) % 60).cast("bigint").alias("age"),
        F.col("o_orderpriority").alias("education_level"),
        F.col("o_orderstatus").alias("marital_status"),
        (ok % 6).cast("bigint").alias("num_dependents"),
        F.col("r_name").alias("region"),
        F.col("c_mktsegment").alias("employment_type"),
        ((ck % 401).cast("double") / _d(10)).alias("employment_years"),
        ((ck % 401) * 6).cast("bigint").alias("months_employed"),
        F.col("c_acctbal").alias("monthly_income"),
        F.col("disc").alias("savings_balance"),
        F.col("tax").alias("investment_balance"),
        (F.lit(300) + (ok * 37) % 600).cast("bigint").alias("raw_score"),
        F.col("lines").cast("bigint").alias("num_credit_lines"),
        F.coalesce(F.col("returned"), F.lit(0)).cast("bigint").alias("num_late_payments"),
        (((ok * 17) % 1000).cast("double") / _d(1000)).alias("credit_util_rate"),
        F.concat(F.lit("P"), (ok % 7).cast("string")).alias("loan_purpose"),
        F.col("o_totalprice").alias("loan_amount"),
        F.element_at(F.array(*[F.lit(v) for v in (12, 24, 36, 48, 60, 84, 120)]),
                     (ok % 7 + 1).cast("int")).cast("bigint").alias("loan_term_months"),
        (_d(1.5) + ((ck * 13) % 265).cast("double") / _d(10)).alias("interest_rate"),
        F.concat(F.lit("T"), (ck % 4).cast("string")).alias("property_type"),
        F.when(ck % 5 == 0, 1).otherwise(0).cast("bigint").alias("has_cosigner"),
        (ck % 8).cast("bigint").alias("num_prev_loans"),
    )
    l2 = l1.withColumn(
        "monthly_payment",
        F.col("loan_amount") * (_d(1) + F.col("interest_rate") / _d(100))
        / F.col("loan_term_months").cast("double"),
    )
    l3 = l2.withColumns({
        "raw_dti": F.least(F.greatest(
            F.col("monthly_payment") / F.greatest(F.col("monthly_income"), _d(1)), _d(0)), _d(1)),
        "loan_to_income": F.least(F.greatest(
            F.col("loan_amount") / F.greatest(F.col("monthly_income") * _d(12), _d(1)), _d(0)), _d(10)),
    })
    aid = F.col("application_id")
    l4 = l3.withColumns({
        "is_default": F.when(
            _d(0.9) * F.col("num_late_payments") + _d(2) * F.col("raw_dti")
            - _d(0.004) * (F.col("raw_score") - 575)
            + ((aid * 7919) % 1000).cast("double") / _d(500) > _d(5), 1
        ).otherwise(0).cast("bigint"),
        "annual_income": F.when((aid * 11 + 3) % 100 < 3, F.lit(None).cast("double"))
        .otherwise(F.col("monthly_income") * _d(12)),
        "credit_score": F.when((aid * 13 + 5) % 100 < 3, F.lit(None).cast("bigint"))
        .otherwise(F.col("raw_score")),
        "debt_to_income": F.when((aid * 17 + 7) % 100 < 3, F.lit(None).cast("double"))
        .otherwise(F.col("raw_dti")),
    })
    return l4.select(*APPLICATION_COLUMNS)


def applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applicant view with its duplicate block (every 200th id twice).

    The copies come from exploding a one- or two-element array per row, so
    the joins and the lineitem scan run once (a UNION ALL of a filtered twin
    would push the filter down, defeat exchange reuse and scan twice)."""
    base = applications_base(spark, sf_dir)
    copies = F.when(F.col("application_id") % 200 == 0, F.array(F.lit(1), F.lit(2))) \
        .otherwise(F.array(F.lit(1)))
    return base.select("*", F.explode(copies).alias("_copy")).drop("_copy")
