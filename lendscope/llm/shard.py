"""Shuffled shards by a Feistel permutation of global row numbers.

Every row has a global number (0 to n - 1) that its doc_id and text alone
decide. A keyed Feistel network permutes the numbers; the permuted number
gives shard and slot, so anyone who knows n and the key can compute where a
row went, with no table of places.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendscope.llm.common import stage

#: Numbering buckets: a bucket holds n / 4096 rows, and their counts are the only thing that is summed in one place.
BUCKETS = 4096
#: Round keys of the network (fixed values; an even number of rounds).
KEYS = (2654435761, 40503, 2246822519, 3266489917, 668265263, 374761393, 1597334677, 3812015801)
PRIME = 2147483647


def _half_round(v: str, k: str) -> str:
    t = f"(({v} * 48271 + {k}) % {PRIME})"
    return f"(({t} * {t}) % {PRIME})"


def feistel(x: str, a: int, b: int, keys: tuple[int, ...]) -> str:
    """SQL of one pass: a permutation of 0 to a * b - 1. The halves live modulo
    ``a`` and ``b``; every round changes one half by a function of the other."""
    listed = ", ".join(f"{k}L" for k in keys)
    return (f"aggregate(array({listed}), "
            f"named_struct('x', {x} div {b}L, 'y', {x} % {b}L, 'mx', {a}L, 'my', {b}L), "
            f"(s, k) -> named_struct('x', s.y, 'y', (s.x + {_half_round('s.y', 'k')}) % s.mx, 'mx', s.my, 'my', s.mx), "
            f"s -> s.x * {b}L + s.y)")


def permuted(x: str, n: int, keys: tuple[int, ...] = KEYS) -> str:
    """SQL of a permutation of 0 to n - 1, by cycle walking: results of n or
    more go through the network again. The square has fewer than 2 sqrt(n) + 2
    cells over, and a walk passes each once at most, so as many steps always
    end it; only about 2 rows of sqrt(n) walk at all."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1)
    b = max(1, -(-n // a))
    once = feistel(x, a, b, keys)
    if a * b == n:
        return once
    again = feistel("v", a, b, keys)
    return (f"transform(array({once}), p -> CASE WHEN p < {n}L THEN p ELSE "
            f"aggregate(sequence(1, {a * b - n}), p, (v, i) -> CASE WHEN v < {n}L THEN v ELSE {again} END) END)[0]")


def shuffled_shards(docs: DataFrame, shards: int = 8, keys: tuple[int, ...] = KEYS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size (UTF-8 bytes
    plus 1), text_crc32, law ``rows`` (counts at most one apart), shard, slot
    (gapless from 0), grown_shard (NULL under this law), row_number.

    NULL text has size 1 and the checksum of no bytes. NULL and repeated
    doc_ids are numbered like others, equal rows in any order among themselves.
    An empty table gives no rows. Other columns are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
        .withColumn("bucket", F.expr(
            f"conv(substr(md5(coalesce(cast(doc_id AS string), '')), 1, 8), 16, 10) % {BUCKETS}L").cast("int")), "sizes")
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    n = rows.count()
    inside = Window.partitionBy("bucket").orderBy("doc_id", "size", "text_crc32")
    numbered = (rows.withColumn("r", F.row_number().over(inside) - 1)
                .join(F.broadcast(starts), "bucket")  # BUCKETS rows at most
                .withColumn("row_number", F.col("start") + F.col("r")))
    placed = numbered.withColumn("place", F.expr(permuted("row_number", n, keys)))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("place") % shards).cast("int").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number")
