"""Deep trees and forests of them over binned rows.

* Features are cut into at most ``BINS`` bins at quantiles of all rows (at the middles
  between values where a feature has no more of them), and the rows are written in
  chunks: bins, label, weight and the row's number. Which rows a tree draws, and how
  often (Poisson, mean 1), is a hash of seed, tree and row number.
* While a node holds more than ``local_rows`` drawn rows, its split comes from sums by
  feature, bin and class that tasks add up over their chunks, one job a level for all
  trees. Every smaller node goes to one task with its rows, and that task grows the rest
  of its tree in memory, level by level: dense sums while rows outnumber the cells of
  the nodes, sorted runs of bins below that.
* Weights are whole numbers of a common small unit, so every sum is exact: given the
  cuts, no tree depends on the order of rows, tasks or partial sums.
* Trees stay in a written table, a row a subtree. Scoring brings chunks of rows and
  groups of trees together and adds the groups' sums up in order.

Splits are those of MLlib: highest gain in Gini impurity among a random subset of
features a node, no split without gain, sibling leaves of the same class joined."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage

BINS = 32
LOCAL_ROWS = 1_000_000
MIN_GAIN = 1e-14  # what rounding leaves of a gain of zero
QUANTILES, PIECE_ROWS = 1024, 250_000
CHUNK_ROWS = 65_536
# share of draws below each count of a Poisson variable of mean 1
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(17)])


# ---------------------------------------------------------------- rows
def quantile_cuts(df: DataFrame, x, p: int, bins: int = BINS) -> list[np.ndarray]:
    """Ascending cuts of each feature (``x``: array column of ``p``), ``bins`` - 1 at most:
    a row is in bin b if its value is above b cuts. Tasks sum up pieces of their rows,
    and the pieces of a feature meet in one group."""
    def pieces(batches):
        held, n = [], 0
        for pdf in batches:
            held.append(np.stack(pdf["x"]))
            n += len(pdf)
            if n >= PIECE_ROWS:
                yield _summaries(np.concatenate(held))
                held, n = [], 0
        if n:
            yield _summaries(np.concatenate(held))

    def cuts(pdf):
        v, w = (np.concatenate([np.frombuffer(a, float) for a in pdf[c]]) for c in ("v", "w"))
        return pd.DataFrame({"f": [pdf["f"].iloc[0]], "c": [_feature_cuts(v, w, bins).tolist()]})

    found = (df.select(x.alias("x")).mapInPandas(pieces, "f int, v binary, w binary").groupBy("f")
             .applyInPandas(cuts, "f int, c array<double>").collect())  # a row a feature
    held = {r["f"]: np.array(r["c"], float) for r in found}
    return [held[f] for f in range(p)]


def _summaries(x: np.ndarray) -> pd.DataFrame:
    """Values of each feature with the rows they stand for: all values if there are few."""
    out = []
    for f in range(x.shape[1]):
        col = np.sort(x[:, f])
        col = col[:len(col) - int(np.isnan(col).sum())]  # NaN is last
        v, first = np.unique(col, return_index=True)
        w = np.diff(np.append(first, len(col))).astype(float)
        if len(v) > QUANTILES:
            v = col[np.linspace(0, len(col) - 1, QUANTILES).round().astype(int)]
            w = np.full(QUANTILES, len(col) / QUANTILES)
        out.append((f, v.tobytes(), w.tobytes()))
    return pd.DataFrame(out, columns=["f", "v", "w"])


def _feature_cuts(v: np.ndarray, w: np.ndarray, bins: int) -> np.ndarray:
    values, at = np.unique(v, return_inverse=True)
    if len(values) <= bins:
        return np.unique((values[1:] + values[:-1]) / 2)
    below = np.bincount(at, w).cumsum()
    found = values[np.searchsorted(below, below[-1] * np.arange(1, bins) / bins)]
    return np.setdiff1d(found, values[-1:])


def _bin(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """(features, rows) of bin numbers."""
    return np.stack([np.searchsorted(c, x[:, i]) for i, c in enumerate(cuts)]).astype(np.uint8)


CHUNKS = "at binary, b binary, y binary, w binary, n int"


def binned_chunks(df: DataFrame, x, label: str, weight: str, cuts: list[np.ndarray]) -> DataFrame:
    """Rows numbered, binned and written by the chunk. Labels are 0 and 1."""
    def chunks(batches):
        for pdf in batches:
            for s in range(0, len(pdf), CHUNK_ROWS):
                part = pdf.iloc[s:s + CHUNK_ROWS]
                y = part["y"].to_numpy(float)
                if not np.isin(y, (0, 1)).all():
                    raise ValueError("labels 0 and 1 expected")
                yield pd.DataFrame({"at": [part["at"].to_numpy(np.int64).tobytes()], "b": [_bin(np.stack(part["x"]), cuts).tobytes()],
                                    "y": [y.astype(np.uint8).tobytes()], "w": [part["w"].to_numpy(float).tobytes()], "n": [len(part)]})
    rows = df.select(F.monotonically_increasing_id().alias("at"), x.alias("x"), F.col(label).alias("y"), F.col(weight).alias("w"))
    return rows.mapInPandas(chunks, CHUNKS).transform(stage)


def _chunk(r, p: int) -> tuple:
    return (np.frombuffer(r.at, np.int64), np.frombuffer(r.b, np.uint8).reshape(p, r.n),
            np.frombuffer(r.y, np.uint8), np.frombuffer(r.w, float))


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def draws(seed: int, tree: int, at: np.ndarray) -> np.ndarray:
    """How often ``tree`` draws each row."""
    start = _mix(np.array([seed * 1_000_003 + tree], np.uint64))
    z = _mix(_mix(at.astype(np.uint64) + start) + start)
    return np.searchsorted(_POISSON, (z >> np.uint64(11)) * 2.0 ** -53, side="right")


# ---------------------------------------------------------------- splits
def _gains(l0, l1, t0, t1):
    """Gain in Gini impurity of each split; -1 where a side is empty."""
    r0, r1 = t0 - l0, t1 - l1
    left, right, total = l0 + l1, r0 + r1, t0 + t1
    with np.errstate(invalid="ignore", divide="ignore"):
        gain = ((l0 * l0 + l1 * l1) / left + (r0 * r0 + r1 * r1) / right - (t0 * t0 + t1 * t1) / total) / total
    return np.where((left > 0) & (right > 0), gain, -1.0)


def _subsets(rng, nodes: int, p: int, m: int) -> np.ndarray:
    """``m`` features of each node, ascending."""
    if m >= p:
        return np.broadcast_to(np.arange(p), (nodes, p))
    return np.sort(np.argpartition(rng.random((nodes, p), dtype=np.float32), m, axis=1)[:, :m], axis=1)


def _dense_best(key, w0, w1, t0, t1, bins):
    """(gain, cut) of each node's best split of one feature, from sums by node and bin."""
    k = len(t0)
    l0 = np.bincount(key, w0, k * bins).reshape(k, bins).cumsum(axis=1)
    l1 = np.bincount(key, w1, k * bins).reshape(k, bins).cumsum(axis=1)
    gain = _gains(l0, l1, t0[:, None], t1[:, None])
    cut = gain.argmax(axis=1)
    return gain[np.arange(k), cut], cut


def _sparse_best(key, w0, w1, t0, t1, bins):
    """The same from sorted runs: work goes with rows, not with nodes."""
    bits = np.int64(max(1, (len(key) - 1).bit_length()))
    packed = np.sort((key << bits) | np.arange(len(key)))
    order, key = packed & ((np.int64(1) << bits) - 1), packed >> bits
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]), len(key) - 1)
    node = key[ends] // bins
    c0, c1 = w0[order].cumsum()[ends], w1[order].cumsum()[ends]  # whole numbers: exact
    first = np.searchsorted(node, np.arange(len(t0)))
    base0, base1 = np.append(0.0, c0)[first], np.append(0.0, c1)[first]
    gain = _gains(c0 - base0[node], c1 - base1[node], t0[node], t1[node])
    best = np.maximum.reduceat(gain, first)
    at = np.minimum.reduceat(np.where(gain == best[node], np.arange(len(gain)), len(gain)), first)
    return best, key[ends][at] % bins


def grow_tree(b: np.ndarray, w0: np.ndarray, w1: np.ndarray, m: int, depth: int, rng, bins: int = BINS) -> dict:
    """Node arrays of a tree over binned rows: feature (-1: leaf), cut (bins up to it go
    left), left child (the right one follows it), weights n0 and n1 of the classes.
    ``w0`` and ``w1`` are whole numbers, one of them 0 in each row."""
    p, n = b.shape
    node = np.zeros(n, np.int64)
    t0, t1 = np.array([w0.sum()]), np.array([w1.sum()])
    levels, alive = [], np.array([0])  # alive: the nodes of this level that still have rows here
    for d in range(depth + 1):
        size = len(t0)
        level = {"feature": np.full(size, -1, np.int16), "cut": np.zeros(size, np.uint8), "left": np.full(size, -1, np.int64), "n0": t0, "n1": t1}
        levels.append(level)
        open_ = np.flatnonzero((t0 > 0) & (t1 > 0)) if d < depth else np.array([], np.int64)
        if not len(open_):
            break
        # rows of the open nodes only, nodes numbered from 0
        number = np.full(size, -1, np.int64)
        number[open_] = np.arange(len(open_))
        node = number[node]
        held = node >= 0
        if not held.all():
            b, node, w0, w1 = b[:, held], node[held], w0[held], w1[held]
        k, rows = len(open_), np.arange(len(node))
        o0, o1 = t0[open_], t1[open_]
        chosen = _subsets(rng, k, p, m)
        best, feature, cut = np.full(k, MIN_GAIN), np.full(k, -1, np.int64), np.zeros(k, np.int64)
        find = _dense_best if k * bins <= len(node) else _sparse_best
        for j in range(chosen.shape[1]):
            x = b[j] if m >= p else b[chosen[:, j][node], rows]
            gain, at = find(node * bins + x, w0, w1, o0, o1, bins)
            better = gain > best
            best[better], feature[better], cut[better] = gain[better], chosen[better, j], at[better]
        split = feature >= 0
        if not split.any():
            break
        parent = open_[split]
        level["feature"][parent], level["cut"][parent] = feature[split], cut[split]
        level["left"][parent] = 2 * np.arange(len(parent))
        child = np.where(split, 2 * (split.cumsum() - 1), -1)
        right = b[np.maximum(feature, 0)[node], rows] > cut[node]
        node = np.where(split[node], child[node] + right, -1)
        held = node >= 0
        if not held.all():
            b, node, w0, w1 = b[:, held], node[held], w0[held], w1[held]
        t0, t1 = np.bincount(node, w0, 2 * len(parent)), np.bincount(node, w1, 2 * len(parent))
    return _joined(levels)


def _joined(levels: list[dict]) -> dict:
    """The levels' arrays end to end; sibling leaves of the same class become one leaf."""
    for at in range(len(levels) - 2, -1, -1):
        here, below = levels[at], levels[at + 1]
        inner = np.flatnonzero(here["feature"] >= 0)
        left = here["left"][inner]
        one = below["n1"] > below["n0"]
        same = (below["feature"][left] < 0) & (below["feature"][left + 1] < 0) & (one[left] == one[left + 1])
        here["feature"][inner[same]] = -1
    kept, live = [], np.array([0])
    for at, level in enumerate(levels):  # nodes that are still reached
        feature = level["feature"][live]
        inner = feature >= 0
        rank = np.where(inner, 2 * (inner.cumsum() - 1), 0)
        kept.append({"feature": feature, "cut": level["cut"][live], "left": rank, "n0": level["n0"][live], "n1": level["n1"][live]})
        if not inner.any():
            break
        left = level["left"][live][inner]
        live = np.stack([left, left + 1], axis=1).ravel()
    start = np.cumsum([0] + [len(k["feature"]) for k in kept])
    for k, nxt in zip(kept, start[1:]):
        k["left"] = np.where(k["feature"] >= 0, k["left"] + nxt, -1).astype(np.int32)
    return {c: np.concatenate([k[c] for k in kept]) for c in ("feature", "cut", "left", "n0", "n1")}


def leaves(tree: dict, b: np.ndarray) -> np.ndarray:
    """Number of the leaf of each row; ``b``: (features, rows)."""
    at, rows = np.zeros(b.shape[1], np.int64), np.arange(b.shape[1])
    while len(rows):
        f = tree["feature"][at[rows]]
        rows, f = rows[f >= 0], f[f >= 0]
        here = at[rows]
        at[rows] = tree["left"][here] + (b[f, rows] > tree["cut"][here])
    return at


# ---------------------------------------------------------------- top of the trees
class Top:
    """The nodes of one tree that are too large for a task. Nodes are numbered as they
    come; node i's children are ``left[i]`` and ``left[i] + 1``."""

    def __init__(self):
        self.feature, self.cut, self.left, self.depth = [-1], [0], [-1], [0]

    def split(self, node: int, feature: int, cut: int) -> int:
        self.feature[node], self.cut[node], self.left[node] = feature, cut, len(self.feature)
        for _ in range(2):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(-1)
            self.depth.append(self.depth[node] + 1)
        return self.left[node]

    def arrays(self) -> dict:
        return {"feature": np.array(self.feature, np.int16), "cut": np.array(self.cut, np.uint8), "left": np.array(self.left, np.int64)}


def _drawn(r, p, tree, seed, bootstrap, unit, top):
    """A chunk's rows that ``tree`` draws: bins, whole weights, label, node at the top's foot."""
    at, b, y, w = _chunk(r, p)
    count = draws(seed, tree, at) if bootstrap else np.ones(len(at), np.int64)
    got = np.flatnonzero((count > 0) & (w > 0))
    b = b[:, got]
    node = leaves(top, b) if len(top["feature"]) > 1 else np.zeros(len(got), np.int64)
    return b, count[got] * np.maximum(np.round(w[got] * unit), 1.0), y[got], node


def _level_splits(chunks: DataFrame, open_: dict, tops: list[Top], p, m, seed, bootstrap, unit, bins) -> list:
    """(tree, node, feature, cut, drawn rows left and right) of the open nodes; feature -1: no split."""
    tops_now = {t: tops[t].arrays() for t in open_}

    def sums(batches):
        held = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                for t, nodes in open_.items():
                    b, w, y, node = _drawn(r, p, t, seed, bootstrap, unit, tops_now[t])
                    for v in nodes:
                        mine = node == v
                        key = (np.arange(p)[:, None] * bins + b[:, mine]).ravel()
                        part = np.stack([np.bincount(key, np.tile(x, p), p * bins) for x in (w[mine] * (y[mine] == 0), w[mine] * y[mine], np.ones(mine.sum()))])
                        held[t, v] = held.get((t, v), 0.0) + part
        for (t, v), x in held.items():
            yield pd.DataFrame({"tree": [t], "node": [v], "h": [x.tobytes()]})

    def best(pdf):
        t, v = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
        h = sum(np.frombuffer(x, float) for x in pdf["h"]).reshape(3, p, bins)
        total = h[:, 0].sum(axis=1)
        found = (t, v, -1, 0, 0, 0)
        if total[0] > 0 and total[1] > 0:
            left = h.cumsum(axis=2)
            gain = _gains(left[0], left[1], total[0], total[1])
            mine = _subsets(np.random.default_rng([seed, t, v, 1]), 1, p, m)[0]
            f = int(mine[gain[mine].max(axis=1).argmax()])
            cut = int(gain[f].argmax())
            if gain[f, cut] > MIN_GAIN:
                found = (t, v, f, cut, int(left[2, f, cut]), int(total[2] - left[2, f, cut]))
        return pd.DataFrame([found], columns=["tree", "node", "feature", "cut", "nl", "nr"])

    return (chunks.mapInPandas(sums, "tree int, node int, h binary").groupBy("tree", "node")
            .applyInPandas(best, "tree int, node int, feature int, cut int, nl long, nr long").collect())  # a row an open node


# ---------------------------------------------------------------- forest
TREES = "tree int, node int, feature binary, cut binary, left binary, n0 binary, n1 binary"


def grow_forest(df: DataFrame, x, p: int, label: str, weight: str, trees: int, m: int, depth: int, seed: int, bootstrap: bool = True,
                bins: int = BINS, local_rows: int = LOCAL_ROWS) -> "Forest":
    """``trees`` trees of ``m`` features a node over the rows of ``df``."""
    cuts = quantile_cuts(df, x, p, bins)
    chunks = binned_chunks(df, x, label, weight, cuts)
    n, total = df.agg(F.count(F.lit(1)), F.sum(F.greatest(F.col(weight), F.lit(0.0)))).first()
    if not n or not total:
        raise ValueError("no rows to grow trees on")
    # all sums of whole weights stay below 2 ** 53: a tree draws some n rows, 16 of each at the very most
    unit = 2.0 ** math.floor(math.log2(2.0 ** (51 if not bootstrap else 49) / total))
    tops = [Top() for _ in range(trees)]
    open_ = {t: [0] for t in range(trees)} if n > local_rows else {}
    while open_:
        found, later = _level_splits(chunks, open_, tops, p, m, seed, bootstrap, unit, bins), {}
        for t, v, f, cut, nl, nr in sorted(tuple(r) for r in found):
            if f < 0:
                continue
            left = tops[t].split(v, f, cut)
            later.setdefault(t, []).extend(c for c, rows in ((left, nl), (left + 1, nr)) if rows > local_rows and tops[t].depth[c] < depth)
        open_ = {t: nodes for t, nodes in later.items() if nodes}
    feet, reached = [t.arrays() for t in tops], [t.depth for t in tops]

    def deal(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                out = []
                for t in range(trees):
                    b, w, y, node = _drawn(r, p, t, seed, bootstrap, unit, feet[t])
                    for v in np.unique(node):
                        mine = node == v if len(feet[t]["feature"]) > 1 else slice(None)
                        out.append((t, v, np.ascontiguousarray(b[:, mine]).tobytes(), np.where(y[mine] > 0, w[mine], -w[mine]).tobytes()))
                    if len(out) >= 20:
                        yield pd.DataFrame(out, columns=["tree", "node", "b", "w"])
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=["tree", "node", "b", "w"])

    def grow(pdf):
        t, v = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
        w = [np.frombuffer(x, float) for x in pdf["w"]]
        b = np.concatenate([np.frombuffer(x, np.uint8).reshape(p, len(y)) for x, y in zip(pdf["b"], w)], axis=1)
        w = np.concatenate(w)
        got = grow_tree(b, np.maximum(-w, 0.0), np.maximum(w, 0.0), m, depth - reached[t][v], np.random.default_rng([seed, t, v]), bins)
        return pd.DataFrame([(t, v, *(got[c].tobytes() for c in ("feature", "cut", "left", "n0", "n1")))],
                            columns=["tree", "node", "feature", "cut", "left", "n0", "n1"])

    units = sum(f["feature"].tolist().count(-1) for f in feet)
    dealt = chunks.mapInPandas(deal, "tree int, node int, b binary, w binary").repartition(min(units, 2000), "tree", "node")
    return Forest(dealt.groupBy("tree", "node").applyInPandas(grow, TREES).transform(stage), feet, cuts)


class Forest:
    """Trees as a written table, the tops of large ones, and the features' cuts."""

    BLOCK_ROWS = 250_000

    def __init__(self, table: DataFrame, tops: list[dict], cuts: list[np.ndarray]):
        self.table, self.tops, self.cuts = table, tops, cuts

    def shares(self, df: DataFrame, row: str, x, groups: list[list[int]]) -> DataFrame:
        """(``row``, _s): the sums over each group of trees of the class 1's share in the
        row's leaf, an array in the order of ``groups``. ``row`` is a long, one of its own for each row."""
        cuts, tops, p = self.cuts, self.tops, len(self.cuts)
        of = {t: i for i, mine in enumerate(groups) for t in mine}

        def chunks(batches):
            for pdf in batches:
                for s in range(0, len(pdf), CHUNK_ROWS):
                    part = pdf.iloc[s:s + CHUNK_ROWS]
                    yield pd.DataFrame({"c": [int(part["at"].iloc[0])], "at": [part["at"].to_numpy(np.int64).tobytes()],
                                        "b": [_bin(np.stack(part["x"]), cuts).tobytes()], "n": [len(part)]})

        def score(key, trees, rows):
            g, found = int(key[0]), {int(c): np.zeros(n) for c, n in zip(rows["c"], rows["n"])}
            held = {(r.tree, r.node): _tree(r) for r in trees.itertuples(index=False)}
            for r in rows.itertuples(index=False):
                b = np.frombuffer(r.b, np.uint8).reshape(p, r.n)
                for t in groups[g]:
                    foot = leaves(tops[t], b)
                    for v in np.unique(foot):
                        mine, tree = foot == v, held[t, v]
                        leaf = leaves(tree, b[:, mine])
                        found[int(r.c)][mine] += (tree["n1"] / (tree["n0"] + tree["n1"]))[leaf]
            return pd.DataFrame({"c": rows["c"], "g": g, "at": rows["at"], "s": [found[int(c)].tobytes() for c in rows["c"]]})

        def gathered(pdf):
            pdf = pdf.sort_values("g")
            sums = np.stack([np.frombuffer(s, float) for s in pdf["s"]], axis=1)
            return pd.DataFrame({row: np.frombuffer(pdf["at"].iloc[0], np.int64), "_s": list(sums)})

        blocks = max(1, math.ceil(df.count() / self.BLOCK_ROWS))
        number = F.element_at(F.create_map(*[F.lit(v) for t, g in of.items() for v in (t, g)]), F.col("tree"))
        keys, parts = ["g", "k"], min(2000, len(groups) * blocks)
        trees = (self.table.where(F.col("tree").isin(list(of))).withColumn("g", number)
                 .withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(parts, *keys))
        rows = (df.select(F.col(row).alias("at"), x.alias("x")).mapInPandas(chunks, "c long, at binary, b binary, n int")
                .withColumn("k", F.pmod(F.xxhash64("c"), F.lit(blocks)).cast("int"))
                .withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(len(groups) - 1)))).repartition(parts, *keys))
        sums = trees.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInPandas(score, "c long, g int, at binary, s binary")
        return sums.groupBy("c").applyInPandas(gathered, T.StructType([T.StructField(row, T.LongType()), T.StructField("_s", T.ArrayType(T.DoubleType()))]))

    def trees(self, mine: list[int]) -> list[dict]:
        """Node arrays by foot node of each tree, read to the driver: for a look at single trees."""
        held: dict = {t: {} for t in mine}
        for r in self.table.where(F.col("tree").isin(mine)).toLocalIterator():
            held[r["tree"]][r["node"]] = _tree(r)
        return [held[t] for t in mine]


def _tree(r) -> dict:
    return {"feature": np.frombuffer(r.feature, np.int16), "cut": np.frombuffer(r.cut, np.uint8), "left": np.frombuffer(r.left, np.int32),
            "n0": np.frombuffer(r.n0, float), "n1": np.frombuffer(r.n1, float)}
