"""Document fingerprints: one-permutation MinHash with optimal densification.

Each shingle is hashed once; its high bits name a bin, and a bin keeps its
smallest hash. Empty bins borrow from bins that a fixed hash sequence of
(bin, attempt) points to, the same for all documents, until a filled one is
found. The low bits of the bins' values are packed; the share of equal values,
corrected for chance equality, estimates the Jaccard likeness.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import byte_slices, inner_id, outer_id
from lendscope.llm.shingles import Shingler, mix

BINS = 256  # a power of two
BITS = 8
SHINGLE = 5
SLICE_CHARS = 1_000_000
#: Documents a range of doc_ids, and ranges at most (their bounds are gathered).
RANGE_ROWS = 4_000
RANGES = 8192


def bin_minima(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest hash of each bin (n x BINS) and which bins are filled."""
    low = np.full(n * BINS, np.iinfo(np.uint64).max, np.uint64)
    at = owner * BINS + (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    np.minimum.at(low, at, h)
    filled = np.zeros(n * BINS, bool)
    filled[at] = True
    return low.reshape(n, BINS), filled.reshape(n, BINS)


def densify(low: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Fill the empty bins of rows that have a filled one."""
    out = low.copy()
    single = filled.sum(axis=1) == 1
    out[single] = low[single].min(axis=1)[:, None]
    row, col = np.nonzero(~filled & (filled.any(axis=1) & ~single)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        to = (mix(col.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
        hit = filled[row, to]
        out[row[hit], col[hit]] = low[row[hit], to[hit]]
        row, col = row[~hit], col[~hit]
    return out


def sketch(shingler: Shingler, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed bins (n x BINS, uint8) and which texts have any word."""
    h, owner = shingler(texts)
    low, filled = bin_minima(h, owner, len(texts))
    return (densify(low, filled) & np.uint64((1 << BITS) - 1)).astype(np.uint8), filled.any(axis=1)


def likeness(a: np.ndarray, b: np.ndarray, has_a: np.ndarray, has_b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness by rows; two texts without words are alike, one without is unlike any other."""
    chance = 2.0 ** -BITS
    est = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(has_a & has_b, est, (has_a == has_b).astype(float))


def edited(text: str, following: str) -> str:
    """The last third (rounded down) of the code points replaced by the first as many of ``following``."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


def _encode(rows: np.ndarray, has: np.ndarray) -> list[str]:
    return [base64.b64encode(r.tobytes()).decode() if x else "" for r, x in zip(rows, has)]


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by range, in each by falling doc_id, then the document that
    follows the range. Only the last row of a slice is held back."""
    shingler, held = Shingler(SHINGLE), []
    for batch in batches:
        for part in byte_slices(batch, "text", SLICE_CHARS):
            rows = held + list(zip(part["range"], part["extra"], part["doc_id"], part["text"]))
            done = [i for i, (r, extra, *_) in enumerate(rows[:-1]) if not extra and rows[i + 1][0] == r]
            if len(done) != sum(not x[1] for x in rows[:-1]):
                raise RuntimeError("a document came without the one that follows it")
            held = [rows[-1]]
            if not done:
                continue
            own, has = sketch(shingler, [x[3].encode() for x in rows])
            texts = [edited(rows[i][3], rows[i + 1][3]).encode() for i in done]
            new, new_has = sketch(shingler, texts)
            i = np.array(done)
            yield pd.DataFrame({
                "doc_id": [rows[k][2] for k in done], "n_chars": [len(rows[k][3]) for k in done],
                "edited_sha256": [hashlib.sha256(t).hexdigest() for t in texts],
                "fingerprint": _encode(own[i], has[i]), "edited_fingerprint": _encode(new, new_has),
                "near_edited": likeness(own[i], new, has[i], new_has),
                "near_next": likeness(own[i], own[i + 1], has[i], has[i + 1])})
    if held and not held[0][1]:
        raise RuntimeError("a document came without the one that follows it")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_chars,
    edited_sha256, fingerprint and edited_fingerprint (base64 of BINS values),
    near_edited, near_next.

    The next document is the one with the next smaller doc_id; after the last
    comes the first. Rows with the same doc_id follow each other by the text's
    hash; rows without a doc_id count as the largest. NULL text is empty; texts
    without words have an empty fingerprint. An empty table gives no rows.
    Other columns are not looked at.
    """
    spark = docs.sparkSession
    rows = docs.select(inner_id().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    ranges = max(1, min(RANGES, n // RANGE_ROWS))
    rows = rows.withColumn("range", F.lit(0))
    if ranges > 1:
        cuts = rows.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0]
        splits = [-float("inf"), *sorted({float(x) for x in cuts}), float("inf")]
        rows = Bucketizer(splits=splits, inputCol="id", outputCol="cut").transform(
            rows.withColumn("id", F.col("doc_id").cast("double"))).select("doc_id", "text", F.col("cut").cast("int").alias("range"))
    tops = sorted(tuple(x) for x in rows.groupBy("range").agg(F.max("doc_id")).collect())  # RANGES rows at most
    # The largest doc_id of a range follows the smallest of the range above, and that of the last the smallest of all.
    follows = spark.createDataFrame([(tops[k][1], tops[(k + 1) % len(tops)][0]) for k in range(len(tops))],
                                    "doc_id long, range int")
    extra = rows.drop("range").join(F.broadcast(follows), "doc_id").withColumn("extra", F.lit(True))
    both = rows.withColumn("extra", F.lit(False)).unionByName(extra)
    tasks = max(ranges, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = both.repartition(tasks, "range").sortWithinPartitions("range", "extra", F.desc("doc_id"), F.xxhash64("text"), "text")
    out = dealt.mapInPandas(_run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                            "edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("doc_id", outer_id(F.col("doc_id")))
