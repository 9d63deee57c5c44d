"""Connected components by alternating large-star and small-star steps.

Links stay in tables; each step keeps the components and brings every node
nearer to the smallest node of its own, until all links are stars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import stage


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: u > v. Large: each node's larger neighbours, small: its smaller
    ones and itself, are tied to the smallest of its neighbours and itself."""
    near = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else links
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    near = near.where(F.col("v") > F.col("u")) if large else near
    tied = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        tied = tied.unionByName(least.select("u", F.col("m").alias("v")))
    return tied.where(F.col("u") != F.col("v"))


def nearer(links: DataFrame) -> DataFrame:
    """One pass over links (u, v): other links with the same components, whose
    ends are nearer to the smallest nodes, each once. Written to the shared folder."""
    ordered = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") != F.col("v"))
    return stage(_star(_star(ordered, True), False).distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """links (u long, v long) -> node, root (the smallest node of its
    component), a row for each node with a link other than to itself."""
    now, state = links, None
    while True:
        after = nearer(now)
        found = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if found == state:
            return after.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                after.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        now, state = after, found
