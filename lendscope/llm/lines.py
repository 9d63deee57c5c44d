"""Line dedup through a sharded minimal perfect hash.

Line keys are counted by document; a shard of the distinct keys becomes a
minimal perfect hash with two flat arrays, a 16-bit fingerprint and a count
for each key (about five bytes a key instead of a row). Documents then probe
the arrays: a shard's rows stream past its arrays in tasks of bounded size,
and only hits go back to the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import byte_slices, inner_id, outer_id, stage
from lendscope.llm.mphf import PerfectHash

SPACE = b" \t\n\x0b\x0c\r"
#: Distinct keys a shard, and rows that probe one copy of a shard.
SHARD_KEYS = 100_000
PROBE_ROWS = 200_000
SLICE_CHARS = 8_000_000
TOP = 65535  # counts are kept as 16 bits and stay here


def line_key(line: bytes) -> bytes:
    """The line without white space at both ends, A-Z lower-cased."""
    return line.strip(SPACE).lower()


def _key_hash(key: bytes) -> tuple[int, int]:
    x = xxhash.xxh3_128_intdigest(key)
    return x >> 64, x & (1 << 64) - 1


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in byte_slices(batch, "text", SLICE_CHARS):
            ids, high, low = [], [], []
            for i, text in zip(part["doc_id"], part["text"]):
                keys = {line_key(x) for x in (text or "").encode().split(b"\n")} - {b""}
                ids += [i] * len(keys)
                for a, b in map(_key_hash, keys):
                    high.append(a)
                    low.append(b)
            yield pd.DataFrame({"doc_id": np.array(ids, np.int64), "high": np.array(high, np.uint64).view(np.int64),
                                "low": np.array(low, np.uint64).view(np.int64)})


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard: its perfect hash, and fingerprint and count by key number."""
    high, low = (pdf[c].to_numpy(np.int64).view(np.uint64) for c in ("high", "low"))
    ph = PerfectHash.build(high, low)
    at = ph.lookup(high, low)
    prints, counts = np.empty(len(at), "<u2"), np.empty(len(at), "<u2")
    prints[at] = low.astype("<u2")
    counts[at] = np.minimum(pdf["n"].to_numpy(), TOP)
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "n_rows": [int(pdf["n"].sum())], "hash": [ph.to_bytes()],
                         "prints": [prints.tobytes()], "counts": [counts.tobytes()]})


def _probe(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = ph = prints = counts = None
        for batch in batches:
            out = []
            first = batch["hash"].notna().to_numpy()
            cuts = [0, *np.flatnonzero(first).tolist(), len(batch)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part = batch.iloc[lo:hi]
                if first[lo]:
                    row = part.iloc[0]
                    shard, ph = row["shard"], PerfectHash.from_bytes(row["hash"])
                    prints, counts = np.frombuffer(row["prints"], "<u2"), np.frombuffer(row["counts"], "<u2")
                    part = part.iloc[1:]
                if not len(part):
                    continue
                if ph is None or not (part["shard"] == shard).all():
                    raise RuntimeError("rows came without the arrays of their shard")
                high, low = (part[c].to_numpy(np.int64).view(np.uint64) for c in ("high", "low"))
                at = ph.lookup(high, low)
                found = (at >= 0) & (prints[at] == low.astype("<u2")) & (counts[at] >= least)
                out.append(part.loc[found, ["doc_id", "high"]])
            if out:
                yield pd.concat(out)
    return run


def _drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text, hits in zip(batch["text"], batch["hits"]):
            lines = (text or "").encode().split(b"\n")
            kept = lines
            if hits is not None and len(hits):
                gone = set(np.asarray(hits, np.int64).view(np.uint64).tolist())
                kept = [x for x in lines if not (k := line_key(x)) or _key_hash(k)[0] not in gone]
            rows.append((len(lines), len(lines) - len(kept), b"\n".join(kept).decode()))
        n, dropped, text = zip(*rows) if rows else ((), (), ())
        yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(np.int64), "n_lines": n, "n_dropped": dropped, "kept_text": text})


def drop_common_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_lines (before
    dropping), n_dropped, kept_text.

    Texts are split at newlines; a line whose key occurs in ``least`` or more
    rows goes, everywhere. Lines with an empty key stay. NULL and empty texts
    have one empty line. Rows with the same (or no) doc_id are documents of
    their own. An empty table gives no rows; other columns are not looked at.
    """
    if not 1 <= least <= TOP:
        raise ValueError(f"least must be from 1 to {TOP}")
    base = docs.select(inner_id().alias("doc_id"), "text")
    rows = stage(base.mapInPandas(_keys, "doc_id long, high long, low long"), "line-keys")
    counted = stage(rows.groupBy("high", "low").agg(F.count("*").alias("n")), "line-counts")
    shards = max(1, -(-counted.count() // SHARD_KEYS))
    shard = F.pmod(F.shiftright("high", 8), F.lit(shards)).cast("int")
    built = stage(counted.withColumn("shard", shard).groupBy("shard").applyInPandas(
        _build, "shard int, n_rows long, hash binary, prints binary, counts binary"), "line-arrays")
    # A shard that many rows probe (it holds a very common line) has copies, each for a part of the rows.
    parts = built.withColumn("parts", F.ceil(F.col("n_rows") / PROBE_ROWS).cast("int"))
    arrays = parts.withColumn("part", F.explode(F.expr("sequence(0, greatest(parts, 1) - 1)")))
    probes = (rows.withColumn("shard", shard).join(parts.select("shard", "parts"), "shard")
              .withColumn("part", F.pmod(F.xxhash64("doc_id", "high"), F.greatest("parts", F.lit(1))).cast("int")))
    nothing = F.lit(None)
    both = probes.select("shard", "part", F.lit(1).alias("kind"), "doc_id", "high", "low", nothing.cast("binary").alias("hash"),
                         nothing.cast("binary").alias("prints"), nothing.cast("binary").alias("counts")).unionByName(
        arrays.select("shard", "part", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("high"),
                      F.lit(0).cast("long").alias("low"), "hash", "prints", "counts"))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), shards)
    hits = (both.repartition(tasks, "shard", "part").sortWithinPartitions("shard", "part", "kind")
            .mapInPandas(_probe(least), "doc_id long, high long"))
    found = hits.groupBy("doc_id").agg(F.collect_set("high").alias("hits"))
    out = base.join(found, "doc_id", "left").mapInPandas(
        _drop, "doc_id long, n_lines long, n_dropped long, kept_text string")
    return out.withColumn("doc_id", outer_id(F.col("doc_id")))
