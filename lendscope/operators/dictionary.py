"""Dictionaries of any size: dense codes of a column's distinct values as a table.

Values are numbered in sorted order without a global sort in one task: ranges of
the sorted distinct values are numbered where they lie, and the counts of the ranges
before are added. Columns are encoded by a join, which Spark broadcasts only if
the dictionary is small."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage

# Bytes of a dictionary that every executor may hold.
MOST_BROADCAST = 64 << 20


def build_dictionary(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, code): the distinct non-null values of each column as text, in
    sorted order from 0. One shuffle of the values, combined before it."""
    stacked = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])))
    found = stacked.where(F.col("value").isNotNull()).distinct().transform(stage)
    ranges = found.repartitionByRange("column", "value").sortWithinPartitions("column", "value")
    rows = ranges.select("column", "value", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")).transform(stage)
    starts = rows.groupBy("column", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("column").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = starts.select("column", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    # columns x partitions rows at most
    return rows.join(F.broadcast(starts), ["column", "part"]).select("column", "value", (F.col("at") + F.col("shift")).alias("code")).transform(stage)


def dictionary_sizes(dictionary: DataFrame) -> dict[str, tuple[int, int]]:
    """{column: (values, bytes)}."""
    by = dictionary.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("value") + 48).alias("b"))
    return {r["column"]: (r["n"], r["b"]) for r in by.collect()}  # a row a column


def encode(df: DataFrame, dictionary: DataFrame, column: str, size: tuple[int, int], out: str, unseen: int = -1) -> DataFrame:
    """``df`` with the value's code in ``out``; unseen and NULL values get ``unseen``."""
    codes = dictionary.where(F.col("column") == column).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    codes = F.broadcast(codes) if size[1] <= MOST_BROADCAST else codes
    found = df.join(codes, F.col(column).cast("string") == F.col("_value"), "left").drop("_value")
    return found.withColumn(out, F.coalesce(F.col("_code"), F.lit(unseen))).drop("_code")


def one_hot_vector(df: DataFrame, dictionary: DataFrame, column: str, size: tuple[int, int]) -> DataFrame:
    """``df`` with ``column`` replaced by a sparse 0/1 vector of a place for each
    value; unseen and NULL values have no 1."""
    n = size[0]
    coded = encode(df, dictionary, column, size, "_at", n)
    # the number of places is known, so nothing is scanned for it; the last place, for unseen, is dropped
    nominal = {"ml_attr": {"type": "nominal", "num_vals": n + 1}}
    coded = coded.withColumn("_at", F.col("_at").cast("double").alias("_at", metadata=nominal)).drop(column)
    made = OneHotEncoder(inputCol="_at", outputCol=column, dropLast=True).fit(coded).transform(coded).drop("_at")
    return made.select(*df.columns)
