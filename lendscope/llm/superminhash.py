"""Near-duplicate documents: SuperMinHash signatures, banding, verification on
full shingle sets, and grouping by connected components.

SuperMinHash walks a random permutation for each element: in step j it offers
j plus a random fraction to one signature place that no earlier step of this
element used. Places thus get values of different steps and are correlated,
which lowers the variance, and once all places of a document are below j + 1
no later step can change them. Steps run for all elements of a batch at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendscope.llm.common import byte_slices, inner_id, outer_id, sized, small_batches, stage
from lendscope.llm.components import components, nearer
from lendscope.llm.shingles import Shingler, distinct, mix
from lendscope.session import work_path

#: 32 bands of 5 places: documents with a likeness of 0.8 share a band with probability 1 - 3e-6.
BANDS, ROWS = 32, 5
PLACES = BANDS * ROWS
#: Pivots of a bucket grow by this factor from round to round, up to what Spark still picks before it shuffles.
PIVOTS_GROW, MOST_PIVOTS = 32, 1000
#: Bytes of a round's table that goes whole to the rows it is joined with; larger ones meet them in a shuffle.
SMALL = 8 << 20
SLICE_CHARS = 1_000_000
#: Words of 64 bits that hold the parities of a set.
PARITY_WORDS = 16
PARITIES = [f"parity{i}" for i in range(PARITY_WORDS)]
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def signatures(h: np.ndarray, owner: np.ndarray, n: int, places: int = PLACES) -> np.ndarray:
    """n x places; ``h`` holds each owner's distinct element hashes. A value is
    the step in the high and the fraction in the low 32 bits."""
    sig = np.full((n, places), np.iinfo(np.uint64).max, np.uint64)
    flat = sig.reshape(-1)
    perm = None
    for j in range(places):
        draw = mix(h + np.uint64(0x9E3779B97F4A7C15 * (j + 1) & (1 << 64) - 1))
        k = j + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(places - j)) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            place = k
        else:
            i = np.arange(len(h))
            place = perm[i, k].astype(np.int64)
            perm[i, k] = perm[i, j]
            perm[i, j] = place
        np.minimum.at(flat, owner * places + place, (np.uint64(j) << np.uint64(32)) | (draw >> np.uint64(32)))
        open_docs = sig.max(axis=1) >= np.uint64((j + 1) << 32)
        rest = open_docs[owner]
        if not rest.any():
            break
        if perm is None:
            h, owner, k = h[rest], owner[rest], k[rest]
            perm = np.tile(np.arange(places, dtype=np.uint8), (len(h), 1))
            i = np.arange(len(h))
            perm[i, k], perm[:, 0] = 0, k
        elif rest.sum() < 0.7 * len(rest):
            h, owner, perm = h[rest], owner[rest], perm[rest]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for r in range(ROWS):
        key = mix(key * _GOLD + parts[:, :, r])
    return key.view(np.int64)


def set_ids(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit id of each owner's set of distinct hashes."""
    count = np.bincount(owner, minlength=n)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(h ^ _GOLD))))
    end = np.cumsum(count)
    return count, mix(total[end] - total[end - count] + count.astype(np.uint64) * _GOLD).view(np.int64)


def parities(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """n x PARITY_WORDS: elements are hashed to bits, a bit is the parity of its
    elements. Two sets differ in at least as many elements as bits."""
    bit = mix(h * _GOLD + np.uint64(PARITY_WORDS)) % np.uint64(64 * PARITY_WORDS)
    out = np.zeros(n * PARITY_WORDS, np.uint64)
    np.bitwise_xor.at(out, owner * PARITY_WORDS + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(n, PARITY_WORDS).view(np.int64)


def _describe(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(k)
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_CHARS):
                texts = [(t or "").encode() for t in part["text"]]
                h, owner = distinct(*shingler(texts))
                count, node = set_ids(h, owner, len(texts))
                bands = band_keys(signatures(h, owner, len(texts)))
                yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(np.int64),
                                    "digest": [hashlib.sha256(t).digest() for t in texts], "n_shingles": count, "node": node,
                                    "bands": [b if c else [] for b, c in zip(bands, count)]})
    return run


def _sets(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(k)
        for batch in batches:
            for part in byte_slices(batch, "text", SLICE_CHARS):
                texts = [(t or "").encode() for t in part["text"]]
                h, owner = distinct(*shingler(texts))
                count, node = set_ids(h, owner, len(texts))
                cuts = np.cumsum(count)[:-1]
                rows = pd.DataFrame({"node": node, "shingles": np.split(h.view(np.int64), cuts)}).join(
                    pd.DataFrame(parities(h, owner, len(texts)), columns=PARITIES))
                yield rows[rows["node"].to_numpy() == part["node"].to_numpy(np.int64)]
    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are alike enough."""
    a = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = sized(pairs, 16, SMALL).join(a, "u").join(b, "v").where(
        100 * F.least(F.size("a"), F.size("b")) >= percent * F.greatest(F.size("a"), F.size("b")))
    shared = F.size(F.array_intersect("a", "b"))
    return both.where(100 * shared >= percent * (F.size("a") + F.size("b") - shared)).select("u", "v")


def _may_link(percent: int) -> Column:
    """False only where (size, PARITIES) and the pivot's can't be of sets alike
    enough: those differ in (100 - percent) / (100 + percent) of their sizes' sum at most,
    and in no fewer elements than their sizes or parities do."""
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"pivot_{c}"))) for c in PARITIES), F.lit(0))
    both = (100 - percent) * (F.col("size") + F.col("pivot_size"))
    return (100 * F.least("size", "pivot_size") >= percent * F.greatest("size", "pivot_size")) & ((100 + percent) * differ <= both)


def linked_sets(described: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """node, root of all sets that are linked to another.

    In every bucket (documents that agree in a band) pivots are compared with
    the members of other components, and leave the bucket; they come from the
    bucket's smallest components, one in the first round and PIVOTS_GROW times
    as many in each further one. A bucket whose members have met in one
    component is done. So a bucket of n copies of a text costs about n pairs,
    not their square. Of two sets in different components only those are not compared
    whose sizes or parities prove that they can't be alike enough, so members
    that are linked with nothing don't cost a pair with each of the others.
    """
    sets_of = described.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"),
                                                                   F.first("n_shingles").alias("size"))
    sets_of = stage(sets_of, "sets-of")
    members = sets_of.select("node", "size", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = stage(members.join(shared, "bucket").select("bucket", "node", "size").distinct(), "buckets")
    wanted = members.select("node").distinct().join(sets_of.select("node", "doc_id"), "node")
    text = docs.select(inner_id().alias("doc_id"), "text").join(wanted, "doc_id").select("node", "text")
    sets = stage(text.mapInPandas(_sets(k), "node long, shingles array<long>, " + ", ".join(f"{c} long" for c in PARITIES))
                 .dropDuplicates(["node"]), "sets")
    parity = sized(sets.select("node", *PARITIES), 8 + 8 * PARITY_WORDS, SMALL)
    spark, links, pivots, paths = docs.sparkSession, None, 1, []
    # In the first round every set is a component of its own, so all buckets are live.
    now = members.select("bucket", F.col("node").alias("root"), "node", "size", F.lit(1).cast("long").alias("n"))
    while not now.isEmpty():
        smallest = Window.partitionBy("bucket").orderBy("n", "root", "node")
        chosen = now.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= pivots).select(
            "bucket", F.col("node").alias("pivot"), F.col("root").alias("pivot_root"), F.col("size").alias("pivot_size"))
        chosen = stage(chosen, "pivots")
        held = sized(chosen, 24, SMALL).join(parity.select(F.col("node").alias("pivot"), *(F.col(c).alias(f"pivot_{c}") for c in PARITIES)), "pivot")
        held = sized(stage(held, "held"), 24 + 8 * PARITY_WORDS, SMALL)
        pairs = now.join(parity, "node").join(held, "bucket").where((F.col("root") != F.col("pivot_root")) & _may_link(percent)).select(
            F.greatest("node", "pivot").alias("u"), F.least("node", "pivot").alias("v")).distinct()
        if paths:  # Pairs of all earlier rounds are one scan, so plans don't grow with the rounds.
            pairs = pairs.join(sized(spark.read.schema("u long, v long").parquet(*paths), 16, SMALL), ["u", "v"], "left_anti")
        paths.append(work_path(spark, "pairs"))
        pairs.write.parquet(paths[-1])
        found = stage(_verified(spark.read.schema("u long, v long").parquet(paths[-1]), sets, percent), "verified")
        links = nearer(found if links is None else found.unionByName(links))
        now = _live(now, chosen, links)
        pivots = min(PIVOTS_GROW * pivots, MOST_PIVOTS)
    return components(links) if links is not None else members.select("node", F.col("node").alias("root")).limit(0)


def _live(now: DataFrame, chosen: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of ``now`` but the pivots, with their components after ``links`` and n, what these
    have in the bucket; only of buckets with several components. Written to the shared folder."""
    left = now.join(sized(chosen.select("bucket", F.col("pivot").alias("node")), 16, SMALL), ["bucket", "node"], "left_anti").select("bucket", "node", "size")
    # Labels on the way to the components: equal ones mean one component, and that is all this needs.
    roots = stage(links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")), "roots")
    left = left.join(sized(roots, 16, SMALL), "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = stage(left.groupBy("bucket", "root").agg(F.count("*").alias("n")), "parts")
    live = stage(parts.groupBy("bucket").agg(F.count("*").alias("parts")).where("parts > 1").select("bucket"), "live")
    parts = parts.join(sized(live, 8, SMALL), "bucket", "left_semi")
    return stage(left.join(sized(stage(parts, "live-parts"), 24, SMALL), ["bucket", "root"]), "rounds")


def _grouped(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest of the text, n_shingles, root) of each row, root shared by
    the rows of a component, and (root, component_id)."""
    small_batches(docs.sparkSession)
    rows = docs.select(inner_id().alias("doc_id"), "text")
    described = stage(rows.mapInPandas(_describe(k), "doc_id long, digest binary, n_shingles long, node long, bands array<long>"), "described")
    roots = linked_sets(described, docs, k, percent)
    found = described.select("doc_id", "digest", "n_shingles", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = stage(found, "found")
    least = found.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return found, stage(least, "least")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles,
    component_id, kept.

    A document's set holds its distinct shingles of ``k`` words (A-Z
    lower-cased, cut at white space; with fewer words the whole sequence).
    Documents with 100 * intersection >= ``percent`` * union are linked;
    component_id is the smallest doc_id that links reach, kept whether it is the
    row's own. Equal sets are one node (by a 64-bit hash) and never make pairs.

    NULL, empty and wordless texts have no set, no links and are kept. Rows
    with the same doc_id share one fate if their texts are equal. A NULL doc_id
    counts as the largest; if it is the only one reached, component_id is NULL
    and the row is kept. An empty table gives no rows. Other columns are not
    looked at.
    """
    found, least = _grouped(docs, k, percent)
    grouped = found.join(least, "root", "left").withColumn(
        "component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return grouped.select(outer_id(F.col("doc_id")).alias("doc_id"), "n_shingles",
                          outer_id(F.col("component_id")).alias("component_id"),
                          (F.col("doc_id") == F.col("component_id")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the one with the
    smallest doc_id (a NULL one counts as the largest) and, among several texts
    of that id, the smallest digest; of repeated rows one. All columns stay.

    Rows are told apart by id and text, so a row that shares its id, or the lack
    of one, with a near copy goes only if its own text is one. Texts without
    words are linked with nothing and stay, repeated or not; so does a text of
    any length without a near copy. An empty table gives no rows."""
    found, _ = _grouped(docs, k, percent)
    found = found.where("n_shingles > 0").select("root", F.col("doc_id").alias("id"), "digest")
    texts = found.groupBy("root", "id", "digest").agg(F.count(F.lit(1)).alias("copies"))
    stays = texts.groupBy("root").agg(F.min(F.struct("id", "digest")).alias("stays"))
    marked = texts.join(stays, "root").withColumn("gone", F.col("stays") != F.struct("id", "digest")).where("gone OR copies > 1")
    marked = stage(marked.select("id", "digest", "gone"), "marked")
    rows = docs.select(F.struct("*").alias("whole"), inner_id().alias("id"), F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"))
    # The texts move only if the table of marked rows is too large to go to them.
    repeated = rows.join(sized(marked.where("NOT gone"), 64), ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])
    return rows.join(sized(marked, 64), ["id", "digest"], "left_anti").unionByName(repeated).select("whole.*")
