"""Removal of every byte that lies in a substring of 200 bytes found elsewhere.

Where two places hold the same 200 bytes, the smallest 32-byte hash inside
(the anchor) is the same at the same distance. So each document is cut into
segments, runs of windows with one anchor; anchors that occur once in the
whole corpus cannot lie in a repeat and drop out, losslessly. Equal segments
are one row with a count. The segments of an anchor bucket go to one task,
which builds the Burrows-Wheeler transform of each shard of rows and merges
them by interleave refinement; intervals of suffixes with a common prefix of
200 bytes are the repeats. Aligning suffixes at their anchors makes one pass
over the columns do what 200 refinements of all suffixes would.

An anchor with very many different segments (a passage that a great part of
the corpus holds in different surroundings) would not fit a task; its windows
are counted by a 128-bit hash instead, in as many tasks as needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendscope.llm.bwt import repeated_starts
from lendscope.llm.common import bucketed, byte_slices, inner_id, outer_id, stage
from lendscope.llm.shingles import mix

LENGTH = 200
GRAM = 32  # a power of two
CHUNK = 1 << 18  # windows at a time, in very long texts
BUCKET_BYTES = 6_000_000
#: Segments of one anchor beyond which its windows are counted instead: as many as fill a bucket (about 300 bytes each).
ANCHOR_SEGMENTS = BUCKET_BYTES // 300
SLICE_CHARS = 4_000_000
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)


class Cutter:
    """Anchors and segments of byte strings."""

    def __init__(self, length: int):
        self.length = length
        n = CHUNK + length
        self.power, self.inverse = [], []
        for base in _BASES:
            for tables, b in ((self.power, base), (self.inverse, pow(base, -1, 1 << 64))):
                t = np.full(n, b, np.uint64)
                t[0] = 1
                tables.append(np.cumprod(t))
        self.byte = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASES[0]))

    def substring_ids(self, values: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """Two 64-bit hashes of substrings; equal for equal substrings anywhere."""
        out = []
        for power, inverse in zip(self.power, self.inverse):
            total = np.zeros(len(values) + 1, np.uint64)
            np.cumsum(values * power[: len(values)], out=total[1:])
            out.append(mix((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)).view(np.int64))
        return out

    def _grams(self, values: np.ndarray) -> np.ndarray:
        h, k = values, 1
        while k < GRAM:
            h = h[: len(h) - k] * np.uint64(pow(_BASES[1], k, 1 << 64)) + h[k:]
            k *= 2
        return mix(h)

    def segments(self, text: bytes):
        """Arrays (anchor, id_a, id_b, start, run, offset): ``run`` windows
        from ``start`` on have the anchor ``offset`` bytes after ``start``."""
        n = len(text) - self.length + 1
        for first in range(0, n, CHUNK):
            windows = min(CHUNK, n - first)
            values = self.byte[np.frombuffer(text, np.uint8, windows + self.length - 1, first)]
            grams = self._grams(values)
            low = np.uint64((1 << 20) - 1)  # the later of equal hashes wins
            best = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64))
            span, want = 1, self.length - GRAM + 1
            while 2 * span <= want:
                best = np.minimum(best[:-span], best[span:])
                span *= 2
            if span < want:
                best = np.minimum(best[: len(best) - (want - span)], best[want - span:])
            at = (low - (best & low)).astype(np.int64)
            start = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            run = np.diff(np.append(start, windows))
            offset = at[start] - start
            a, b = self.substring_ids(values, start, start + run + self.length - 1)
            yield grams[at[start]].view(np.int64), a ^ mix(offset.astype(np.uint64)).view(np.int64), b, start + first, run, offset


def _segments(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter = Cutter(length)
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_CHARS):
                found = [(i, r, *s) for i, r, t in zip(part["doc_id"], part["row"], part["text"])
                         for s in cutter.segments((t or "").encode())]
                if found:
                    ids, rows, *cols = zip(*found)
                    sizes = [len(c) for c in cols[0]]
                    yield pd.DataFrame({"doc_id": np.repeat(np.array(ids, np.int64), sizes), "row": np.repeat(np.array(rows, np.int64), sizes)} | {
                        k: np.concatenate(c) for k, c in zip(("anchor", "a", "b", "start", "run", "offset"), cols)})
    return run


def _texts(length: int):
    """The text of each segment that a document stands for."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, wanted in zip(batch["text"], batch["stands"]):
                raw = text.encode()
                for s in wanted:
                    out.append((s["anchor"], s["a"], s["b"], s["n"], s["run"], s["offset"], raw[s["start"]:s["start"] + s["run"] + length - 1]))
            yield pd.DataFrame(out, columns=["anchor", "a", "b", "n", "run", "offset", "text"])
    return run


def _ranges(starts: np.ndarray) -> list[int]:
    """first, last, first, last, ... of runs of consecutive numbers."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return np.stack((np.concatenate((starts[:1], starts[cut + 1])), np.concatenate((starts[cut], starts[-1:])))).T.ravel().tolist()


def _merge(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        starts = repeated_starts(pdf["text"].tolist(), pdf["offset"].to_numpy(np.int64), length)
        whole = pdf["n"].to_numpy() > 1
        ranges = [[0, r - 1] if w else _ranges(s) for s, w, r in zip(starts, whole, pdf["run"])]
        out = pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "ranges": ranges})
        return out[[bool(r) for r in ranges]]
    return run


def _windows(length: int):
    """Two 64-bit hashes of each window of each segment."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter = Cutter(length)
        for batch in batches:
            runs = batch["run"].to_numpy()
            ids = [cutter.substring_ids(cutter.byte[np.frombuffer(t, np.uint8)], np.arange(r), np.arange(r) + length)
                   for t, r in zip(batch["text"], runs)]
            if ids:
                yield pd.DataFrame({k: np.repeat(batch[k].to_numpy(), runs) for k in ("a", "b", "n")} | {
                    "x": np.concatenate([i[0] for i in ids]), "y": np.concatenate([i[1] for i in ids]),
                    "at": np.concatenate([np.arange(r) for r in runs])})
    return run


def _cut(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, sha, n, found in zip(batch["text"], batch["sha"], batch["n_bytes"], batch["found"]):
                spans: list[list[int]] = []
                for start, end in sorted((s["start"] + int(x), s["start"] + int(y) + length) for s in (found if found is not None else ())
                                         for x, y in zip(s["ranges"][::2], s["ranges"][1::2])):
                    if spans and start <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], end)
                    else:
                        spans.append([start, end])
                if spans:
                    raw, h, at = text.encode(), hashlib.sha256(), 0
                    for start, end in spans:
                        h.update(raw[at:start])
                        at = end
                    h.update(raw[at:])
                    sha = h.hexdigest()
                rows.append((sum(e - s for s, e in spans), len(spans), [x for s in spans for x in s], sha))
            removed, n_spans, flat, shas = zip(*rows) if rows else ((), (), (), ())
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy(np.int64), "row": batch["row"].to_numpy(np.int64), "n_bytes": batch["n_bytes"].to_numpy(np.int64),
                                "n_removed": removed, "n_spans": n_spans, "spans": flat, "kept_sha256": shas})
    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor_segments: int = ANCHOR_SEGMENTS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, row (a hash of
    doc_id and text), n_bytes, n_removed, n_spans, spans (start, end, start,
    ... in bytes, maximal) and kept_sha256 of the bytes outside the spans.

    A span is a maximal run of bytes covered by strings of ``length`` bytes
    that also start anywhere else, in this or another row. NULL text is empty;
    texts under ``length`` bytes keep all. Rows with the same doc_id are
    documents of their own; equal rows of ``length`` bytes or more lose all.
    An empty table gives no rows. Other columns are not looked at.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    spark = docs.sparkSession
    rows = docs.select(inner_id().alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "row", F.xxhash64("doc_id", "text"))
    segments = stage(rows.mapInPandas(
        _segments(length), "doc_id long, row long, anchor long, a long, b long, start int, run int, offset int"), "segments")
    # Sums are written before they are joined: then both sides of the join come straight from a shuffle, whose
    # large partitions (a very common anchor) Spark splits.
    twice = stage(segments.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors")
    places = stage(segments.join(twice, "anchor"), "places")
    unit = places.groupBy("anchor", "a", "b").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "row", "start", "run", "offset")).alias("p"))
    unit = stage(unit.select("anchor", "a", "b", "n", "p.*"), "units")
    crowded = unit.groupBy("anchor").agg(F.count("*").alias("k")).where(F.col("k") > anchor_segments).select("anchor", F.lit(True).alias("crowded"))
    unit = unit.join(stage(crowded, "crowded"), "anchor", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    stands = unit.groupBy("doc_id", "row").agg(F.collect_list(F.struct(
        "anchor", "a", "b", "n", "start", "run", "offset", "crowded")).alias("stands"))
    touched = places.select("doc_id", "row").distinct().join(stands, ["doc_id", "row"], "left").withColumn("touched", F.lit(True))
    # Texts are dealt out by document once; only those with a candidate are kept for the two later uses.
    held = rows.join(touched, ["doc_id", "row"], "left").select(
        "doc_id", "row", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha"),
        F.when(F.col("touched"), F.col("text")).alias("text"), "stands")
    held = bucketed(held, "repeats", ["doc_id", "row"], max(8, int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def texts(of: str) -> DataFrame:
        wanted = held.select("text", F.expr(f"filter(stands, s -> {of})").alias("stands")).where("size(stands) > 0")
        return wanted.mapInPandas(_texts(length), "anchor long, a long, b long, n long, run int, offset int, text binary")

    total = unit.where("NOT crowded").agg(F.sum(F.col("run") + length)).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    merged = texts("NOT s.crowded").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).groupBy("bucket").applyInPandas(
        _merge(length), "a long, b long, ranges array<int>")
    windows = stage(texts("s.crowded").mapInPandas(
        _windows(length), "x long, y long, a long, b long, n long, at int"), "windows")
    repeated = stage(windows.groupBy("x", "y").agg(F.sum("n").alias("k")).where("k > 1").select("x", "y"), "repeated")
    counted = windows.where("n = 1").join(repeated, ["x", "y"]).groupBy("a", "b").agg(
        F.flatten(F.collect_list(F.array("at", "at"))).alias("ranges")).unionByName(
        unit.where("crowded AND n > 1").select("a", "b", F.array(F.lit(0), F.col("run") - 1).alias("ranges")))
    ranges = stage(merged.unionByName(counted), "ranges")
    found = places.select("a", "b", "doc_id", "row", "start").join(ranges, ["a", "b"]).groupBy("doc_id", "row").agg(
        F.collect_list(F.struct("start", "ranges")).alias("found"))
    out = held.drop("stands").join(found, ["doc_id", "row"], "left").select(
        "doc_id", "row", "n_bytes", "sha", "text", "found").mapInPandas(
        _cut(length), "doc_id long, row long, n_bytes long, n_removed long, n_spans long, spans array<int>, kept_sha256 string")
    return out.withColumn("doc_id", outer_id(F.col("doc_id")))
