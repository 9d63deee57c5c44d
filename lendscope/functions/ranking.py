"""Exact, seeded, partition-independent ranks for splits, samples and folds.

Every row gets a key ``md5(id:seed:salt)``. A row's rank within its stratum
is its position in key order. With only two strata a ``row_number`` over the
stratum would put half of the table in one task, so ranks are never
computed that way:

* per (stratum, key-prefix bucket) counts are aggregated (map-side combined;
  at most strata x 16**digits rows) and turned into bucket start offsets;
* for a cut at rank c only the one bucket holding c needs in-bucket ranks;
  rows of other buckets are decided by comparing their bucket with the cut
  bucket -- a narrow projection, no shuffle of the table;
* full ranks (fold ids) rank rows inside their bucket: one shuffle on a
  uniform hash bucket, never on the stratum.

Sizes follow the stratified shuffle-split rules: test = ceil(f * n), class
allocation by largest remainder, ties to the lower class.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET_BUCKET_ROWS = 10_000


def hash_key(id_col: str, seed: int, salt: str) -> Column:
    return F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)), F.lit(salt)))


def prefix_digits(n: int) -> int:
    """Hex digits of the bucket prefix so a bucket holds about TARGET_BUCKET_ROWS rows."""
    if n <= TARGET_BUCKET_ROWS:
        return 1
    return min(8, max(1, math.ceil(math.log(n / TARGET_BUCKET_ROWS, 16))))


def approximate_mode(counts: list[int], n_draws: int) -> list[int]:
    """Largest-remainder allocation of ``n_draws`` over classes in
    proportion to ``counts``; ties go to the lower class index."""
    tot = sum(counts)
    cont = [c / tot * n_draws for c in counts]
    fl = [math.floor(x) for x in cont]
    need = int(n_draws - sum(fl))
    order = sorted(range(len(counts)), key=lambda i: (-(cont[i] - fl[i]), i))
    for i in order[:max(need, 0)]:
        fl[i] += 1
    return fl


def stratified_sizes(counts: list[int], test_size: float) -> list[int]:
    """Per-class test counts of one stratified shuffle split."""
    n = sum(counts)
    n_test = math.ceil(test_size * n)
    n_train = n - n_test
    train = approximate_mode(counts, n_train)
    rest = [c - t for c, t in zip(counts, train)]
    return approximate_mode(rest, n_test)


def _label_expr(label_col: str | None) -> Column:
    return F.col(label_col) if label_col else F.lit(0)


def class_counts(df: DataFrame, label_col: str | None, max_classes: int = 1000) -> dict:
    """Rows per stratum; a NULL label is a stratum of its own. Strata become
    plan literals, so their number is bounded, and no more than the bound is read."""
    lab = _label_expr(label_col)
    rows = df.groupBy(lab.alias("_lab")).agg(F.count(F.lit(1)).alias("n")).limit(max_classes + 1).collect()
    if len(rows) > max_classes:
        raise ValueError(f"more strata than the bound of {max_classes}")
    return {r["_lab"]: r["n"] for r in rows}


def _sorted_labels(counts: dict) -> list:
    return sorted(counts, key=lambda v: (v is None, 0 if v is None else v))


def _is(label) -> Column:
    return F.col("_lab").eqNullSafe(F.lit(label))


def _tie_break(df: DataFrame) -> Column:
    """Orders rows that share an id by what they hold, the same in every evaluation."""
    return F.xxhash64(*[F.col(c) for c in df.columns])


def assign_by_cuts(df: DataFrame, id_col: str, label_col: str | None, seed: int, salt: str,
                   cuts: dict, names: list[str], out_col: str = "part",
                   n_rows: int | None = None) -> DataFrame:
    """Label each row with ``names[j]`` where j = number of cuts <= its rank
    within its stratum; ``cuts[label]`` is an ascending list of ranks."""
    lab = _label_expr(label_col)
    d = prefix_digits(n_rows if n_rows is not None else sum(class_counts(df, label_col).values()))
    keyed = df.withColumns({"_k": hash_key(id_col, seed, salt), "_lab": lab}) \
        .withColumn("_b", F.substring("_k", 1, d))
    # bucket starts per stratum: bounded table (strata x 16**d rows)
    bc = keyed.groupBy("_lab", "_b").agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.partitionBy("_lab").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bstart = bc.withColumn("_s", F.coalesce(F.sum("_n").over(wb), F.lit(0)))
    # find the bucket holding each cut
    cond = F.lit(False)
    for lv, cl in cuts.items():
        for c in cl:
            cond = cond | (_is(lv) & (F.col("_s") <= c) & (F.col("_s") + F.col("_n") > c))
    hits = bstart.where(cond).select("_lab", "_b", "_s", "_n").collect()
    cut_b, ends = {}, {}
    for h in hits:
        cut_b.setdefault(h["_lab"], {})[h["_b"]] = h["_s"]
        ends[h["_lab"], h["_b"]] = h["_s"] + h["_n"]
    # decided rows: bucket strictly between cut buckets
    part = F.lit(None).cast("int")
    straddle = F.lit(False)
    for lv, cl in cuts.items():
        bs = cut_b.get(lv, {})
        # part index for a whole bucket b = number of cuts whose bucket < b
        # (cuts whose bucket == b make b a straddling bucket)
        idx = F.lit(0)
        for c in cl:
            cb = next((b for b, s in bs.items() if s <= c < ends[lv, b]), None)
            if cb is None:  # a cut at the stratum's size or beyond: no row's rank reaches it
                continue
            idx = idx + (F.col("_b") > F.lit(cb)).cast("int")
        part = F.when(_is(lv), idx).otherwise(part)
        if bs:
            straddle = straddle | (_is(lv) & F.col("_b").isin(list(bs)))
    decided = keyed.where(~straddle).withColumn(out_col, part)
    # straddling buckets: rank inside the bucket only
    w = Window.partitionBy("_lab", "_b").orderBy("_k", id_col, _tie_break(df))
    starts = F.lit(None).cast("bigint")
    for lv, bs in cut_b.items():
        for b, s in bs.items():
            starts = F.when(_is(lv) & (F.col("_b") == b), F.lit(s)).otherwise(starts)
    ranked = keyed.where(straddle).withColumn("_r", starts + F.row_number().over(w) - 1)
    ridx = F.lit(None).cast("int")
    for lv, cl in cuts.items():
        e = sum(((F.col("_r") >= F.lit(c)).cast("int") for c in cl), F.lit(0))
        ridx = F.when(_is(lv), e).otherwise(ridx)
    ranked = ranked.withColumn(out_col, ridx).drop("_r")
    both = decided.unionByName(ranked)
    mapping = F.element_at(F.array(*[F.lit(x) for x in names]), F.col(out_col) + 1)
    return both.withColumn(out_col, mapping).drop("_k", "_lab", "_b")


def stratified_split(df: DataFrame, id_col: str, label_col: str | None, test_size: float,
                     val_size: float | None = None, seed: int = 42, salt: str = "split",
                     out_col: str = "part") -> DataFrame:
    """Exact stratified split into test / (val) / train parts.

    Two-way: ``test_size`` of the rows. Three-way: test first, then val is
    ``val_size / (1 - test_size)`` of the remainder (the two-step shuffle
    split)."""
    cc = class_counts(df, label_col)
    labels = _sorted_labels(cc)
    counts = [cc[lv] for lv in labels]
    test = stratified_sizes(counts, test_size)
    if val_size is None:
        cuts = {lv: [t] for lv, t in zip(labels, test)}
        names = ["test", "train"]
    else:
        rest = [c - t for c, t in zip(counts, test)]
        val = stratified_sizes(rest, val_size / (1 - test_size))
        cuts = {lv: [t, t + v] for lv, t, v in zip(labels, test, val)}
        names = ["test", "val", "train"]
    return assign_by_cuts(df, id_col, label_col, seed, salt, cuts, names, out_col, sum(counts))


def exact_sample(df: DataFrame, id_col: str, frac: float, seed: int = 42,
                 salt: str = "sample") -> DataFrame:
    """Sample of exactly round(frac * n) rows without replacement."""
    n = df.count()
    k = round(frac * n)
    out = assign_by_cuts(df, id_col, None, seed, salt, {0: [k]}, ["in", "out"], "_sample", n)
    return out.where(F.col("_sample") == "in").drop("_sample")


def fold_ids(df: DataFrame, id_col: str, label_col: str, k: int = 5, seed: int = 42,
             salt: str = "fold", out_col: str = "fold") -> DataFrame:
    """Stratified fold id per row: position (class offset + rank in class)
    modulo k, so per-class fold sizes follow the stratified k-fold rule."""
    cc = class_counts(df, label_col)
    labels = _sorted_labels(cc)
    offset, acc = {}, 0
    for lv in labels:
        offset[lv] = acc
        acc += cc[lv]
    d = prefix_digits(acc)
    keyed = df.withColumns({"_k": hash_key(id_col, seed, salt), "_lab": F.col(label_col)}) \
        .withColumn("_b", F.substring("_k", 1, d))
    bc = keyed.groupBy("_lab", "_b").agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.partitionBy("_lab").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bstart = bc.withColumn("_s", F.coalesce(F.sum("_n").over(wb), F.lit(0))).drop("_n")
    w = Window.partitionBy("_lab", "_b").orderBy("_k", id_col, _tie_break(df))
    off = F.lit(0).cast("bigint")
    for lv in labels:
        off = F.when(_is(lv), F.lit(offset[lv])).otherwise(off)
    ranked = keyed.withColumn("_rb", F.row_number().over(w) - 1).join(
        bstart.select(F.col("_lab").alias("_l"), F.col("_b").alias("_p"), "_s"),
        F.col("_lab").eqNullSafe(F.col("_l")) & (F.col("_b") == F.col("_p"))).drop("_l", "_p")
    return (ranked.withColumn(out_col, ((off + F.col("_s") + F.col("_rb")) % k).cast("int"))
            .drop("_k", "_lab", "_b", "_s", "_rb"))
