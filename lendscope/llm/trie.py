"""Prefix trie of conversations, rolled up in depth bands.

A node is a sequence of first turns. Its id is a digest; so that neither a
conversation of any length nor a trie of any depth needs one task or one round
a turn, ids and sums are built in bands of ``height`` turns:

* turns are grouped into blocks of ``height``; digests of full blocks form a
  sequence that is shorter by that factor and is treated alike, so the ids of
  the block starts (the band roots) come from a logarithmic number of passes,
  and the ids inside a block from its band root and its own digests;
* for sums over subtrees a node explodes to its ancestors inside its band only.
  Band roots with their bands' sums form a trie of ``1/height`` of the depth that
  is rolled up alike; completed totals of band roots then go to the ancestors
  inside the band above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lendscope.llm.common import stage
from lendscope.llm.digests import NOTHING, joined_sha256, key128

#: Turns of a band: a node has at most this many ancestors in it.
HEIGHT = 4
#: Id of the node without turns.
ROOT = bytes(16)
SPACES = r"[\x20\x09-\x0D]+"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, i (from 1), digest of role and text, words of the text.

    Rows are dealt by ranges of (conv_id, turn) and numbered in their range; the
    counts of the earlier ranges of a conversation are added, so a conversation
    with a third of all rows is spread like any other."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        key128(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("digest"),
        F.size(F.array_remove(F.split(text, SPACES), "")).cast("long").alias("words"))
    ranges = rows.repartitionByRange("conv_id", F.col("turn").asc_nulls_first()).sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
    rows = stage(ranges.select("conv_id", "digest", "words", F.spark_partition_id().alias("part"),
                               F.monotonically_increasing_id().alias("at")), "turns")
    starts = rows.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) + 1 - F.col("first")).alias("shift"))
    return rows.join(starts, ["conv_id", "part"]).select("conv_id", (F.col("at") + F.col("shift")).alias("i"), "digest", "words")


def with_shared_starts(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversation c takes the first h = crc32(c) % ``most`` turns of c - c % ``every``
    and its own turns after its first h. Returns (conv_id, i, digest, words) and
    (conv_id, n: turns) of the rebuilt conversations, turnless ones included."""
    base = F.col("conv_id") - F.col("conv_id") % every
    h = F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % most
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("had")).select("conv_id", "had", base.alias("base"), h.alias("h"))
    lenders = convs.where("conv_id = base").select("base", F.col("had").alias("base_had"))
    convs = stage(convs.join(lenders, "base", "left").withColumn("lent", F.least("h", F.coalesce("base_had", F.lit(0)))), "convs")
    own = turns.join(convs.select("conv_id", "h", "lent"), "conv_id").where("i > h").select(
        "conv_id", (F.col("i") - F.col("h") + F.col("lent")).alias("i"), "digest", "words")
    heads = turns.where((F.col("conv_id") == base) & (F.col("i") < most)).withColumnRenamed("conv_id", "base")
    lent = heads.join(convs.select("conv_id", "base", "h"), "base").where("i <= h").select("conv_id", "i", "digest", "words")
    return own.unionByName(lent), convs.select("conv_id", (F.col("lent") + F.greatest(F.col("had") - F.col("h"), F.lit(0))).alias("n"))


def _id(start: Column, digests: Column, level: int) -> Column:
    return key128(F.concat(F.lit(bytes([level])), start, F.aggregate(digests, F.lit(b""), lambda a, d: F.concat(a, d))))


def prefixes(seq: DataFrame, longest: int, height: int = HEIGHT, level: int = 0) -> DataFrame:
    """seq: conv_id, i (from 1, no gaps), digest. A row each: conv_id, i, id of
    the node of the first i entries, chains: for each level at which the node
    closes a band, its ancestors in that band from the band root to its parent."""
    block = ((F.col("i") - 1) / height).cast("long")
    blocks = seq.groupBy("conv_id", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("i", "digest"))).alias("d"))
    blocks = blocks.withColumn("d", F.transform("d", lambda x: x["digest"]))
    if longest >= height:
        full = blocks.where(F.size("d") == height).select("conv_id", (F.col("block") + 1).alias("i"), _id(F.lit(b""), F.col("d"), level).alias("digest"))
        upper = stage(prefixes(full, longest // height, height, level + 1), "prefixes")
        starts = upper.select("conv_id", F.col("i").alias("block"), F.col("id").alias("start"))
        ends = upper.select("conv_id", (F.col("i") - 1).alias("block"), F.col("id").alias("end"), F.col("chains").alias("up"))
        blocks = blocks.join(starts, ["conv_id", "block"], "left").join(ends, ["conv_id", "block"], "left")
        blocks = blocks.withColumn("start", F.coalesce("start", F.lit(ROOT)))
    else:
        blocks = blocks.select("*", F.lit(ROOT).alias("start"), F.lit(None).cast("binary").alias("end"),
                               F.lit(None).cast("array<array<binary>>").alias("up"))
    inner = F.transform(F.sequence(F.lit(1), F.size("d")), lambda j: F.when((j == height) & F.col("end").isNotNull(), F.col("end"))
                        .otherwise(_id(F.col("start"), F.slice(F.col("d"), 1, j), level)))
    blocks = blocks.withColumn("ids", inner)
    rows = blocks.select("conv_id", "block", "start", "end", "up", "ids", F.posexplode("ids").alias("j", "id"))
    chain = F.concat(F.array("start"), F.slice("ids", 1, F.col("j")))
    chains = F.when((F.col("j") == height - 1) & F.col("end").isNotNull(), F.concat(F.array(chain), F.col("up"))).otherwise(F.array(chain))
    return rows.select("conv_id", (F.col("block") * height + F.col("j") + 1).alias("i"), "id", chains.alias("chains"))


def roll_up(nodes: DataFrame, sums: list[str], deepest: int, height: int = HEIGHT, level: int = 0) -> DataFrame:
    """nodes: id, at (depth in units of this level's bands), chains, numbers
    ``sums``. Returns id and the numbers summed over each node's subtree, the node
    included."""
    totals = [F.sum(c).alias(c) for c in sums]
    chain, root = F.get("chains", F.lit(level)), F.col("at") % height == 0
    up = F.when(root, F.array("id")).otherwise(F.concat(chain, F.array("id")))
    own = nodes.select(F.explode(up).alias("id"), *sums).groupBy("id").agg(*totals)
    if deepest < height:
        return own
    own = stage(own, "band-sums")
    roots = nodes.where(root).select("id", (F.col("at") / height).cast("long").alias("at"), "chains").join(own, "id")
    done = stage(roll_up(roots, sums, deepest // height, height, level + 1), "band-roots")
    # The band root above has its total already; the nodes between take it on.
    passed = nodes.where(root & (F.col("at") > 0)).select("id", F.slice(chain, 2, height).alias("above")).join(done, "id").select(
        F.explode("above").alias("id"), *sums)
    inner = own.join(done.select("id"), "id", "left_anti")
    return inner.unionByName(passed).groupBy("id").agg(*totals).unionByName(done)


def prefix_trie(conversations: DataFrame, height: int = HEIGHT, every: int = 20, most: int = 4) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations: id, conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    Turns are ordered by turn, NULL first; ties by role, then by a digest of role
    and text, so repeated rows stay, as turns of their own. NULL role or text
    becomes empty, a text of any length counts whole. Rows without conv_id belong
    to no conversation and are left out; every other conversation is a member of
    the root, also when nothing of it is left by the rebuilding. An empty table
    has no members and gives no rows, not even the root. Other columns are not
    looked at. Turns and nodes are told apart by 128 bits of SHA-256."""
    turns, ends = with_shared_starts(numbered_turns(conversations), every, most)
    turns = stage(turns, "rebuilt")
    everyone, deepest, first = ends.agg(F.count(F.lit(1)), F.max("n"), F.min("conv_id")).first()
    rows = stage(prefixes(turns.select("conv_id", "i", "digest"), max(1, deepest or 0), height).join(
        turns.select("conv_id", "i", "words"), ["conv_id", "i"]), "members")
    nodes = rows.groupBy("id").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("i").alias("at"),
                                   F.first("chains").alias("chains"), F.first("words").alias("words"))
    spark = conversations.sparkSession
    root = spark.createDataFrame([(bytearray(ROOT), first, everyone, 0, [], 0)] if everyone else [], nodes.schema)
    nodes = stage(nodes.unionByName(root).withColumn("parent", F.when(F.col("at") > 0, F.element_at(F.get("chains", F.lit(0)), -1))), "nodes")
    children = nodes.where("at > 0").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stage(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"),
                                     "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}), "family")
    sums = ["n_leaves", "saved_tokens"]
    totals = roll_up(nodes.select("id", "at", "chains", *sums), sums, deepest or 0, height)
    last = rows.join(ends.withColumnRenamed("n", "i"), ["conv_id", "i"]).select(F.col("id").alias("key"), F.col("conv_id").alias("value"))
    none = ends.where("n = 0").select(F.lit(ROOT).alias("key"), F.col("conv_id").alias("value"))
    ended = joined_sha256(last.unionByName(none)).select(F.col("key").alias("id"), F.col("sha256").alias("ends_sha256"))
    known = stage(nodes.drop(*sums).join(totals, "id").join(ended, "id", "left").select(
        "id", "conv_id", F.col("at").alias("depth"), "parent", "n_convs", "n_children", *sums,
        F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256")), "known")
    # A parent of very many children is one key: the join comes last, so that Spark may split it.
    parents = known.select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return known.join(parents, "parent", "left").select("id", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *sums, "ends_sha256")
