"""Exact k-nearest neighbours on a pivot index, SMOTE oversampling and the
k-NN vote classifier.

Neighbour search (exact, Euclidean):

* a bounded number of members are pivots; every member belongs to the cell of its
  nearest pivot, and a cell is cut by a hash of the id into parts of about
  ``block_rows`` members -- a value that a great many members share is cut
  like any other;
* round 1 searches one part of each query's own cell, giving a bound d_k;
  round 2 routes the query to the other parts of the cells that may hold a
  nearer member. By the triangle inequality a member of a cell lies no nearer
  than the query's distance D to the pivot is outside the cell's radii
  [lo, hi], and, as members are nearest to their own pivot, no nearer than half
  of what D exceeds the query's distance to its nearest pivot by;
* the queries of a part are dealt to as many tiles as needed, so a tile holds
  about ``block_rows`` queries and members in both rounds, whatever the data;
* a tile finds candidates by a matrix product and settles them by exact
  distances; a window per query keeps the final k.

With ``masks`` members carry a fold, and one search gives each query its k
nearest members outside every fold: what five folds' oversampling needs.

SMOTE draws are derived from ``md5(seed:i)``, so the synthetic rows do not
depend on partitioning and a rerun gives the same rows.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import dbl
from ..functions.ranking import prefix_digits
from ..session import stage

DEFAULT_BLOCK_ROWS = 8192
CHUNK_ELEMS = 4_000_000
# Pivots at most, and as many for each full block of members: their vectors are
# gathered, and tables of one row a cell are broadcast.
MAX_PIVOTS, PIVOTS_PER_BLOCK = 4096, 4


# ---------------------------------------------------------------- D15
def smote_quota(counts: dict, ratio: float) -> tuple:
    """(majority label, minority label, rows to synthesize) for a float
    sampling strategy: minority raised to int(ratio * majority)."""
    if len(counts) != 2:
        raise ValueError(f"binary outcome expected, got classes {sorted(counts)}")
    maj = sorted(counts, key=lambda k: (-counts[k], k))[0]
    mino = [k for k in counts if k != maj][0]
    n_new = int(ratio * counts[maj] - counts[mino])
    if n_new < 0:
        raise ValueError("sampling ratio below the current minority share")
    return maj, mino, n_new


def _two_classes(df: DataFrame, target: str) -> dict:
    """Rows per class; reads no more than three classes (two are expected)."""
    return {r[0]: r[1] for r in df.groupBy(target).count().limit(3).collect()}


def balance_summary(df: DataFrame, target: str, ratio: float) -> DataFrame:
    """(label, rows_before, rows_after) of oversampling ``df``."""
    counts = _two_classes(df, target)
    maj, mino, n_new = smote_quota(counts, ratio)
    rows = [(int(k), int(v), int(v + (n_new if k == mino else 0))) for k, v in counts.items()]
    return df.sparkSession.createDataFrame(rows, "label bigint, rows_before bigint, rows_after bigint")


# ---------------------------------------------------------------- k-NN
def _tile_topk_fn(kk: int, exclude_self: bool, masks: int | None):
    """Candidates of a tile's queries: for every mask the kk nearest members whose
    fold is another (one mask that hides nothing where ``masks`` is None)."""
    def tile_topk(pdf: pd.DataFrame) -> pd.DataFrame:
        qs, ms = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if qs.empty or ms.empty:
            return pd.DataFrame({"qid": [], "mid": [], "mfold": [], "dist": []}).astype(
                {"qid": "int64", "mid": "int64", "mfold": "int32"})
        mv = np.stack(ms["_v"].to_numpy()).astype(np.float64)
        qv_all = np.stack(qs["_v"].to_numpy()).astype(np.float64)
        mid, fold, qid_all = ms["_id"].to_numpy(), ms["_f"].to_numpy(np.int32), qs["_id"].to_numpy()
        centre = mv.mean(axis=0)  # less cancellation in the product form
        mc = mv - centre
        m2 = (mc ** 2).sum(axis=1)
        step = max(1, CHUNK_ELEMS // len(mv))
        found = []
        for s in range(0, len(qs), step):
            qv, qid = qv_all[s:s + step], qid_all[s:s + step]
            qc = qv - centre
            q2 = (qc ** 2).sum(axis=1)
            near = q2[:, None] + m2[None, :] - 2.0 * (qc @ mc.T)
            if exclude_self:
                near[qid[:, None] == mid[None, :]] = np.inf
            # the product form is off by some 1e-16 of the squared norms: take
            # all that may be among the k, then settle by exact differences
            slack = 1e-9 * (q2 + m2.max()) + 1e-300
            taken = set()
            for mask in range(masks or 1):
                seen = near if masks is None else near[:, fold != mask]
                at = np.arange(len(mid)) if masks is None else np.flatnonzero(fold != mask)
                if not len(at):
                    continue
                last = min(kk, len(at)) - 1
                kth = np.partition(seen, last, axis=1)[:, last]
                with np.errstate(invalid="ignore"):
                    r, c = np.nonzero((seen <= (kth + slack)[:, None]) & np.isfinite(seen))
                c = at[c]
                d2 = ((qv[r] - mv[c]) ** 2).sum(axis=1)
                order = np.lexsort((mid[c], d2, r))
                r, c = r[order], c[order]
                first = np.searchsorted(r, np.arange(len(qv)))
                keep = np.arange(len(r)) - first[r] < kk
                taken.update(zip(r[keep].tolist(), c[keep].tolist()))
            r, c = np.array(sorted(taken), np.int64).reshape(-1, 2).T
            found.append((qid[r], mid[c], fold[c], np.sqrt(((qv[r] - mv[c]) ** 2).sum(axis=1))))
        q, m, f, d = (np.concatenate(x) for x in zip(*found))
        return pd.DataFrame({"qid": q, "mid": m, "mfold": f, "dist": d})
    return tile_topk


def _tiles(queries: DataFrame, members: DataFrame, kk: int, exclude_self: bool, id_type: str,
           block_rows: int, masks: int | None) -> DataFrame:
    """Nearest members of each query within its (cell, part); both sides have
    _id, _v, _s, _p. Members are copied to as many tiles as their queries fill."""
    tiles_of = queries.groupBy("_s", "_p").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_tiles"))
    q = queries.join(tiles_of, ["_s", "_p"]).withColumn("_c", F.pmod(F.xxhash64("_id"), F.col("_tiles")).cast("int"))
    m = members.join(tiles_of, ["_s", "_p"]).withColumn("_c", F.explode(F.expr("sequence(0, _tiles - 1)")))
    cols = ["_s", "_p", "_c", "_id", "_v"]
    both = q.select(*cols, F.lit(-1).alias("_f"), F.lit(0).alias("side")).unionByName(m.select(*cols, "_f", F.lit(1).alias("side")))
    return both.groupBy("_s", "_p", "_c").applyInPandas(
        _tile_topk_fn(kk, exclude_self, masks), f"qid {id_type}, mid {id_type}, mfold int, dist double")


def _by_mask(cand: DataFrame, masks: int | None) -> tuple[DataFrame, list[str]]:
    """Candidates once for each mask that does not hide them."""
    if masks is None:
        return cand, ["qid"]
    open_to = F.filter(F.sequence(F.lit(0), F.lit(masks - 1)), lambda i: i != F.col("mfold"))
    return cand.withColumn("mask", F.explode(open_to)), ["qid", "mask"]


def _topk(cand: DataFrame, kk: int, masks: int | None) -> DataFrame:
    # each query holds a bounded number of candidates: a window per query,
    # evaluated in the JVM
    cand, keys = _by_mask(cand, masks)
    w = Window.partitionBy(*keys).orderBy("dist", "mid")
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= kk)
            .select(*keys, "mid", "dist", F.col("rank").cast("int").alias("rank")))


def _pivot_distances(pivots: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distances of rows and pivots; off by no more than ``_slack`` of them."""
    centre = pivots.mean(axis=0)
    xc, pc = x - centre, pivots - centre
    d2 = (xc ** 2).sum(axis=1)[:, None] + (pc ** 2).sum(axis=1)[None, :] - 2.0 * (xc @ pc.T)
    return np.sqrt(np.maximum(d2, 0.0))


def _slack(pivots: np.ndarray, x: np.ndarray) -> np.ndarray:
    size = np.sqrt(((x - pivots.mean(axis=0)) ** 2).sum(axis=1).max() + ((pivots - pivots.mean(axis=0)) ** 2).sum(axis=1).max())
    return 2e-7 * size + 1e-150  # the root of what rounding leaves of the squares


def _cells_fn(pivots: np.ndarray):
    """Rows (_id, _v, _f) with their cell and exact distance to its pivot."""
    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, CHUNK_ELEMS // len(pivots))
        for pdf in batches:
            for s in range(0, len(pdf), step):
                part = pdf.iloc[s:s + step]
                x = np.stack(part["_v"].to_numpy()).astype(np.float64)
                cell = _pivot_distances(pivots, x).argmin(axis=1)
                yield part.assign(_s=cell.astype(np.int32), _d=np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1)))
    return cells


def _routes_fn(pivots: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Queries (_id, _v, _s, _p, _r: how near a better member must be) to a row for
    each cell that may hold one; cells without members have no radii."""
    def routes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, CHUNK_ELEMS // (8 * len(pivots)))
        for pdf in batches:
            for s in range(0, len(pdf), step):
                part = pdf.iloc[s:s + step]
                x = np.stack(part["_v"].to_numpy()).astype(np.float64)
                d, reach = _pivot_distances(pivots, x), part["_r"].to_numpy()[:, None] + 4 * _slack(pivots, x)
                with np.errstate(invalid="ignore"):
                    needed = (d <= high + reach) & (d >= low - reach) & (d - d.min(axis=1, keepdims=True) <= 2 * reach)
                r, c = np.nonzero(needed & np.isfinite(high))
                yield pd.DataFrame({"_id": part["_id"].to_numpy()[r], "_v": part["_v"].to_numpy()[r], "_s": c.astype(np.int32),
                                    "_os": part["_s"].to_numpy()[r], "_op": part["_p"].to_numpy()[r]})
    return routes


def pivot_index(members: DataFrame, block_rows: int, n: int) -> tuple[np.ndarray, DataFrame]:
    """(pivots, members with _s and _d): pivots are the members of the smallest id
    hashes, MAX_PIVOTS at most; the members are written with their cells."""
    wanted = 1 if n <= block_rows else min(MAX_PIVOTS, math.ceil(PIVOTS_PER_BLOCK * n / block_rows))
    picked = members.select("_v", F.xxhash64("_id", F.lit(7)).alias("_h"), "_id").orderBy("_h", "_id").limit(wanted).collect()
    pivots = np.unique(np.array([r["_v"] for r in picked], float), axis=0)
    kinds = ", ".join(f"{c} {t}" for c, t in members.dtypes)
    return pivots, members.mapInPandas(_cells_fn(pivots), f"{kinds}, _s int, _d double").transform(stage)


def knn(queries: DataFrame, members: DataFrame, id_col: str, feature_cols: list[str], k: int,
        exclude_self: bool = False, block_rows: int = DEFAULT_BLOCK_ROWS, masks: int | None = None,
        fold_col: str = "fold") -> DataFrame:
    """Exact k nearest ``members`` of every query row: (qid, mid, dist, rank).

    ``exclude_self`` drops a member with the query's id. Ties on distance are
    broken by member id. A query gets fewer than k rows only if there are
    fewer members. With ``masks`` folds (``fold_col`` of the members, from 0) the result is
    (qid, mask, mid, dist, rank): the k nearest members outside each fold."""
    found, _ = _search(queries, members, id_col, feature_cols, k, exclude_self, block_rows, masks, fold_col)
    return found


def _search(queries, members, id_col, feature_cols, k, exclude_self, block_rows, masks, fold_col) -> tuple[DataFrame, DataFrame | None]:
    """``knn`` and the routes of its second round (_id, _s, _p), for tests."""
    kk, id_type = int(k), dict(queries.dtypes)[id_col]
    vec = F.array(*[F.col(c).cast("double") for c in feature_cols])
    fold = F.lit(-1) if masks is None else F.col(fold_col).cast("int")
    m = members.select(F.col(id_col).alias("_id"), vec.alias("_v"), fold.alias("_f"))
    q = queries.select(F.col(id_col).alias("_id"), vec.alias("_v"), F.lit(-1).alias("_f"))
    n = m.count()
    if not n:
        empty = f"qid {id_type}, " + ("" if masks is None else "mask int, ") + f"mid {id_type}, dist double, rank int"
        return queries.sparkSession.createDataFrame([], empty), None
    pivots, m = pivot_index(m, block_rows, n)
    cells = m.groupBy("_s").agg(F.count(F.lit(1)).alias("_n"), F.min("_d").alias("lo"), F.max("_d").alias("hi")).collect()  # a row a pivot
    low, high = np.full(len(pivots), np.inf), np.full(len(pivots), np.nan)
    for r in cells:
        low[r["_s"]], high[r["_s"]] = r["lo"], r["hi"]
    parts = F.broadcast(queries.sparkSession.createDataFrame(
        [(r["_s"], math.ceil(r["_n"] / block_rows)) for r in cells], "_s int, _parts int"))
    m = m.join(parts, "_s").withColumn("_p", F.pmod(F.xxhash64("_id"), F.col("_parts")).cast("int")).drop("_parts")
    q = q.mapInPandas(_cells_fn(pivots), f"_id {id_type}, _v array<double>, _f int, _s int, _d double")
    own = q.join(parts, "_s", "left").withColumn(
        "_p", F.pmod(F.xxhash64("_id", F.lit(1)), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts").transform(stage)
    r1 = _tiles(own, m, kk, exclude_self, id_type, block_rows, masks).transform(stage)
    if len(cells) == 1 and cells[0]["_n"] <= block_rows:  # every query met every member
        return _topk(r1, kk, masks), None
    met, keys = _by_mask(r1, masks)
    dk = met.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("dist", "mid"))).where(F.col("r") == kk)
    # the farthest k-th over all masks; none found for a mask leaves the query without a bound
    dk = dk.groupBy(F.col("qid").alias("_id")).agg(F.count(F.lit(1)).alias("_n"), F.max("dist").alias("_k"))
    reach = F.when(F.col("_n") >= (masks or 1), F.col("_k") * dbl(1 + 1e-9) + dbl(1e-12)).otherwise(F.lit(float("inf")))
    bound = own.join(dk, "_id", "left").select("_id", "_v", "_s", "_p", reach.alias("_r"))
    routed = bound.mapInPandas(_routes_fn(pivots, low, high), f"_id {id_type}, _v array<double>, _s int, _os int, _op int")
    routed = (routed.join(parts, "_s").withColumn("_p", F.explode(F.expr("sequence(0, _parts - 1)")))
              .where((F.col("_s") != F.col("_os")) | (F.col("_p") != F.col("_op"))).select("_id", "_v", "_s", "_p").transform(stage))
    r2 = _tiles(routed, m, kk, exclude_self, id_type, block_rows, masks)
    return _topk(r1.unionByName(r2), kk, masks), routed.select("_id", "_s", "_p")


# ---------------------------------------------------------------- D14
def _unit(seed: int, i: F.Column, salt: str) -> F.Column:
    """Uniform [0, 1) from md5(seed:salt:i) (first 13 hex digits)."""
    h = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(salt), i.cast("string"))), 1, 13)
    return F.conv(h, 16, 10).cast("double") / F.lit(float(16 ** 13))


def smote(df: DataFrame, id_col: str, target: str, feature_cols: list[str],
          ratio: float = 0.40, k: int = 5, seed: int = 42, int_cols: list[str] | None = None,
          block_rows: int = DEFAULT_BLOCK_ROWS, neighbours: DataFrame | None = None) -> DataFrame:
    """Oversample the minority class to int(ratio * majority) rows. ``neighbours``
    (qid, rank, mid) are those of a search made before, if there was one.

    Synthetic row i: base = minority row number floor(u1 * n_min) (by id
    order of a hash rank), neighbour = its floor(u2 * k)-th nearest
    minority neighbour, x = base + u3 * (neighbour - base). Integer columns
    are truncated back to integers. Synthetic ids are negative."""
    counts = _two_classes(df, target)
    maj, mino, n_new = smote_quota(counts, ratio)
    base_cols = [id_col, target] + list(feature_cols)
    out = df.select(*base_cols)
    if n_new == 0:
        return out
    minority = df.where(F.col(target) == F.lit(mino)).select(id_col, *feature_cols)
    n_min = counts[mino]
    if n_min <= k:
        raise ValueError(f"{n_min} minority rows: more than {k} are needed for {k} neighbours")
    # dense index of minority rows by hash rank: a uniform bucket shuffle
    keyed = minority.withColumn("_k", F.md5(F.concat_ws(":", F.col(id_col).cast("string"),
                                                        F.lit(str(seed)), F.lit("smote"))))
    keyed = keyed.withColumn("_b", F.substring("_k", 1, prefix_digits(n_min)))
    bc = keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    bstart = bc.withColumn("_s", F.coalesce(F.sum("_n").over(
        Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    idx = (keyed.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_k", id_col)) - 1)
           .join(bstart, "_b").select(id_col, *feature_cols, (F.col("_s") + F.col("_r")).alias("_idx")).transform(stage))
    nbrs = neighbours if neighbours is not None else knn(minority, minority, id_col, feature_cols, k, exclude_self=True,
                                                         block_rows=block_rows)
    spark = df.sparkSession
    draws = spark.range(n_new).select(
        F.col("id").alias("_i"),
        F.least((_unit(seed, F.col("id"), "base") * n_min).cast("bigint"), F.lit(n_min - 1)).alias("_idx"),
        (F.least((_unit(seed, F.col("id"), "nbr") * k).cast("int"), F.lit(k - 1)) + 1).alias("rank"),
        _unit(seed, F.col("id"), "gap").alias("_u"))
    base = draws.join(idx, "_idx")
    nb = base.join(nbrs.select(F.col("qid").alias(id_col), "rank", F.col("mid").alias("_nid")),
                   [id_col, "rank"])
    other = idx.select(F.col(id_col).alias("_nid"),
                       *[F.col(c).alias(f"_n_{c}") for c in feature_cols])
    syn = nb.join(other, "_nid")
    ints = set(int_cols or [])
    cols = []
    for c in feature_cols:
        v = F.col(c).cast("double") + F.col("_u") * (F.col(f"_n_{c}").cast("double") - F.col(c).cast("double"))
        cols.append((v.cast("bigint") if c in ints else v).cast(dict(df.dtypes)[c]).alias(c))
    synthetic = syn.select((-(F.col("_i") + 1)).cast(dict(df.dtypes)[id_col]).alias(id_col),
                           F.lit(mino).cast(dict(df.dtypes)[target]).alias(target), *cols)
    return out.unionByName(synthetic)


def fold_neighbours(folded: DataFrame, id_col: str, target: str, feature_cols: list[str], folds: int, k: int = 5,
                    fold_col: str = "fold", block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """(qid, mask, mid, dist, rank): the k nearest minority rows of each minority row
    outside each fold, from one search over all folds. ``smote`` of the training part of
    fold i takes the rows of mask i (those of queries in fold i find no base row)."""
    counts = _two_classes(folded, target)
    mino = sorted(counts, key=lambda c: (counts[c], c))[0]
    minority = folded.where(F.col(target) == F.lit(mino)).select(id_col, fold_col, *feature_cols)
    return knn(minority, minority, id_col, feature_cols, k, True, block_rows, folds, fold_col).transform(stage)


# ---------------------------------------------------------------- E7
def knn_vote(train: DataFrame, test: DataFrame, id_col: str, target: str,
             feature_cols: list[str], k: int = 5, block_rows: int = DEFAULT_BLOCK_ROWS) -> DataFrame:
    """k-NN classifier: (id, probability = share of positive neighbours)."""
    nb = knn(test, train, id_col, feature_cols, k, block_rows=block_rows)
    lab = train.select(F.col(id_col).alias("mid"), F.col(target).cast("double").alias("_y"))
    return (nb.join(lab, "mid").groupBy(F.col("qid").alias(id_col))
            .agg(F.avg("_y").alias("probability")))
