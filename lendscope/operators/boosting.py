"""Boosted trees (logistic loss) over binned rows that stay in memory for all rounds.

MLlib runs several jobs a round. Here one job is the whole fit: each of its tasks holds
up to ``TASK_ROWS`` rows as bins, and the tasks (a barrier stage, where there is more than
one) tell each other their sums by node, feature and bin at every level, so all choose the
same splits. Features of few bins share a cell number, so that a sum over cells serves
several; of two sibling nodes only the lighter one is summed, the other is what is left
of the parent. Sums are of whole numbers of a small unit: exact, and the same however
rows are dealt to tasks.

Rounds, loss, gain (variance) and leaf values are MLlib's, and so is the model that comes
out: it is written in MLlib's layout and loaded."""

from __future__ import annotations

import base64
import json
import math
import time

import numpy as np
import pandas as pd
from pyspark import BarrierTaskContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import work_path
from .forest import _chunk, binned_chunks, quantile_cuts

TASK_ROWS = 8_000_000  # some 90 bytes each; a barrier takes a second, so few tasks are better than many
BLOCK_ROWS = 131_072  # what a sum works on at a time
CELLS = 4096
MAX_DEPTH = 8
MIN_GAIN = 1e-13  # what rounding leaves of a gain of zero
NODES = "tree int, id int, value double, n long, w double, s double, q double, gain double, left int, feature int, cut int"


def packs(bins: list[int], cells: int) -> list[list[int]]:
    """Features grouped so that the product of their bins stays within ``cells``."""
    out: list = []
    for f in sorted(range(len(bins)), key=lambda f: bins[f]):
        if out and math.prod(bins[g] for g in out[-1]) * bins[f] <= cells:
            out[-1].append(f)
        else:
            out.append([f])
    return out


class _Block:
    """Some rows: bins by feature, cell by pack, label -1 or 1, whole weight, margin, node."""

    def __init__(self, b, y, w, groups, bins):
        self.b, self.y, self.w = b, np.where(y > 0, 1.0, -1.0), w
        self.margin, self.node, self.r = np.zeros(len(y)), None, None
        self.cells = []
        for g in groups:
            cell = np.zeros(len(y), np.int64)
            for f in g:
                cell = cell * bins[f] + b[f]
            self.cells.append(cell.astype(np.uint16))


class Rounds:
    """The rounds of a fit as one task sees them; ``share`` adds up an array over all tasks."""

    def __init__(self, blocks: list[tuple], bins: list[int], depth: int, unit: float, share=lambda x: x):
        self.bins, self.depth, self.unit, self.share, self.kept = bins, depth, unit, share, []
        self.wide = max(bins)
        self.groups = packs(bins, max(self.wide, min(CELLS, 2 ** 17 >> depth)))
        self.blocks = [_Block(b, y, w, self.groups, bins) for b, y, w in blocks]

    def _sums(self, chosen: np.ndarray | None, k: int) -> np.ndarray:
        """(node, feature, bin, weight or residual) over the rows of the nodes that ``chosen``
        numbers 0 to k - 1 (-1: left out; None: all rows are of node 0)."""
        held = [np.zeros((k * math.prod(self.bins[f] for f in g), 2)) for g in self.groups]
        for block in self.blocks:
            rows = None if chosen is None else np.flatnonzero((at := chosen[np.maximum(block.node, -1)]) >= 0)  # -1 and below: finished leaves
            w, r = (block.w, block.r) if rows is None else (block.w[rows], block.r[rows])
            node = None if rows is None else at[rows]
            for cell, out in zip(block.cells, held):
                key = cell.astype(np.int64) if rows is None else cell[rows] + node * (len(out) // k)
                out[:, 0] += np.bincount(key, w, len(out))
                out[:, 1] += np.bincount(key, r, len(out))
        sums = np.zeros((k, len(self.bins), self.wide, 2))
        for g, out in zip(self.groups, held):
            out = out.reshape(k, *[self.bins[f] for f in g], 2)
            for i, f in enumerate(g):
                sums[:, f, :self.bins[f]] = out.sum(axis=tuple(j + 1 for j in range(len(g)) if j != i))
        return self.share(sums)

    def _splits(self, sums):
        """(gain, feature, cut) of each node's best split, and the sums left of it and of the node."""
        k = len(sums)
        left = sums.cumsum(axis=2)
        total = left[:, :1, -1:]
        right = total - left
        with np.errstate(invalid="ignore", divide="ignore"):
            gain = (left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0]
                    - total[..., 1] ** 2 / total[..., 0]) / total[..., 0]
        gain = np.where((left[..., 0] > 0) & (right[..., 0] > 0), gain, -1.0).reshape(k, -1)
        at = gain.argmax(axis=1)
        f, cut = at // self.wide, at % self.wide
        return gain[np.arange(k), at], f, cut, left[np.arange(k), f, cut], total[:, 0, 0]

    def round(self, first: bool, step: float) -> list[list]:
        """Grows one tree and adds it to the margins. Its nodes: id, gain, left child, feature,
        cut, weight and residual; this task's rows and squares of each are kept for ``trees``."""
        for block in self.blocks:
            grad = block.y if first else 4.0 * block.y / (1.0 + np.exp(2.0 * block.y * block.margin))
            block.r = np.round(block.w * grad)
            block.node = np.zeros(len(block.y), np.int64)
        sums, nodes = self._sums(None, 1), []
        ids = np.array([0])
        nodes.append([0, -1.0, -1, -1, -1, *sums[0, 0].sum(axis=0)])
        # rows in a finished leaf keep the leaf's number, below 0
        for d in range(self.depth):
            gain, f, cut, low, total = self._splits(sums)
            split = gain > MIN_GAIN
            if not split.any():
                break
            goes = np.where(split, 2 * (split.cumsum() - 1), 0)
            for i in np.flatnonzero(split):
                at = len(nodes)
                nodes[ids[i]][1:5] = float(gain[i]), at, int(f[i]), int(cut[i])
                nodes += [[at, -1.0, -1, -1, -1, *low[i]], [at + 1, -1.0, -1, -1, -1, *(total[i] - low[i])]]
            self._move(split, goes, f, cut, ids)
            below = np.array([c for i in np.flatnonzero(split) for c in (nodes[ids[i]][2], nodes[ids[i]][2] + 1)])
            ids = below
            if d + 1 < self.depth:
                right_lighter = (2 * low[:, 0] > total[:, 0])[split]
                chosen = np.full(len(ids) + 1, -1)
                few = 2 * np.arange(len(right_lighter)) + right_lighter
                chosen[few] = np.arange(len(few))
                part, whole = self._sums(chosen, len(few)), sums[split]
                sums = np.empty((len(ids), *part.shape[1:]))
                sums[few], sums[few ^ 1] = part, whole - part
        self._add(nodes, ids, step)
        return nodes

    def _move(self, split, goes, f, cut, ids):
        for block in self.blocks:
            if len(split) == 1:
                node = (block.b[f[0]] > cut[0]).astype(np.int64)
            else:
                now = block.node
                live = now >= 0
                at = np.where(live, now, 0)
                right = block.b[f[at], np.arange(len(at))] > cut[at]
                node = np.where(live & split[at], goes[at] + right, np.where(live, -2 - ids[at], now))
            block.node = node

    def _add(self, nodes, ids, step):
        """Adds the tree to the margins; rows and squares by leaf, parents as their children's sums."""
        value, got = np.array([n[6] / n[5] for n in nodes]), np.zeros((len(nodes), 2))
        for block in self.blocks:
            at = np.where(block.node >= 0, ids[np.maximum(block.node, 0)], -2 - block.node)
            block.margin += step * value[at]
            with np.errstate(invalid="ignore", divide="ignore"):
                q = np.where(block.w > 0, block.r * block.r / block.w, 0.0)
            got[:, 0] += np.bincount(at, minlength=len(nodes))
            got[:, 1] += np.bincount(at, q, len(nodes))
        for i in range(len(nodes) - 1, -1, -1):
            if nodes[i][2] >= 0:
                got[i] = got[nodes[i][2]] + got[nodes[i][2] + 1]
        self.kept.append(got)

    def trees(self, rounds: int, step: float) -> list[tuple]:
        """Rows of NODES of every round's tree."""
        self.kept = []
        grown = [self.round(t == 0, 1.0 if t == 0 else step) for t in range(rounds)]
        kept = iter(self.share(np.concatenate(self.kept)))
        out = []
        for t, nodes in enumerate(grown):
            for (i, gain, left, f, cut, w, s), (n, q) in zip(nodes, kept):
                out.append((t, i, float(s / w), int(n), float(w) / self.unit, float(s) / self.unit, float(q) / self.unit, gain, left, f, cut))
        return out


def _gathered(x: np.ndarray) -> np.ndarray:
    """The sum of all tasks' arrays."""
    said = BarrierTaskContext.get().allGather(base64.b64encode(x.tobytes()).decode())
    return sum(np.frombuffer(base64.b64decode(s), x.dtype).reshape(x.shape) for s in said)


def boost(chunks: DataFrame, bins: list[int], n: int, total: float, rounds: int, depth: int, step: float, task_rows: int = TASK_ROWS) -> list:
    """Rows of NODES of every tree."""
    p = len(bins)
    unit = 2.0 ** math.floor(math.log2(2.0 ** 50 / total))  # residuals are below 4: sums below 2 ** 53
    tasks = max(1, min(math.ceil(n / task_rows), chunks.sparkSession.sparkContext.defaultParallelism))

    def run(batches):
        blocks = []
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                _, b, y, w = _chunk(r, p)
                w = np.where(w > 0, np.maximum(np.round(w * unit), 1.0), 0.0)
                blocks += [(b[:, s:s + BLOCK_ROWS], y[s:s + BLOCK_ROWS], w[s:s + BLOCK_ROWS]) for s in range(0, len(y), BLOCK_ROWS)]
        fit = Rounds(blocks, bins, depth, unit, _gathered if tasks > 1 else lambda x: x)
        del blocks
        found = fit.trees(rounds, step)
        if tasks == 1 or BarrierTaskContext.get().partitionId() == 0:
            yield pd.DataFrame(found, columns=[c.split()[0] for c in NODES.split(", ")])

    rows = chunks.coalesce(1) if tasks == 1 else chunks.repartition(tasks)
    return rows.mapInPandas(run, NODES, barrier=tasks > 1).collect()  # rounds x nodes of a tree


class BoostedTrees(GBTClassifier):
    """``GBTClassifier`` fitted by ``boost``. Settings that it doesn't know (drawn rows or
    features, floors of rows or gain, deeper trees) are MLlib's own fit."""

    task_rows = TASK_ROWS

    def _known(self, dataset: DataFrame) -> bool:
        dynamic = dataset.sparkSession.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false") == "true"
        return (not dynamic and self.getSubsamplingRate() == 1.0 and self.getFeatureSubsetStrategy() in ("all", "auto", "1", "1.0")
                and self.getMinInstancesPerNode() == 1 and self.getMinInfoGain() == 0.0 and self.getMinWeightFractionPerNode() == 0.0
                and 0 < self.getMaxDepth() <= MAX_DEPTH and self.getMaxBins() <= 256 and not self.isSet(self.validationIndicatorCol)
                and not self.isSet(self.thresholds) and self.getLeafCol() == "")

    def _fit(self, dataset: DataFrame) -> GBTClassificationModel:
        first = dataset.select(self.getFeaturesCol()).first()
        if first is None or not self._known(dataset):
            return super()._fit(dataset)
        p, x = first[0].size, vector_to_array(F.col(self.getFeaturesCol()))
        weight = F.col(self.getWeightCol()) if self.isSet(self.weightCol) else F.lit(1.0)
        rows = dataset.select(self.getFeaturesCol(), F.col(self.getLabelCol()).cast("double").alias("y"), weight.cast("double").alias("w"))
        cuts = quantile_cuts(rows, x, p, self.getMaxBins())
        chunks = binned_chunks(rows, x, "y", "w", cuts)
        n, total = rows.agg(F.count(F.lit(1)), F.sum(F.greatest("w", F.lit(0.0)))).first()
        nodes = boost(chunks, [len(c) + 1 for c in cuts], n, total, self.getMaxIter(), self.getMaxDepth(), self.getStepSize(), self.task_rows)
        return self._copyValues(self._model(dataset.sparkSession, nodes, cuts, p))

    def _model(self, spark, nodes, cuts, p) -> GBTClassificationModel:
        """The trees in MLlib's layout, loaded."""
        path = work_path(spark, "boosted")
        about = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}

        def params(held, names=None):
            return {k.name: v for k, v in held.items() if names is None or k.name in names}
        own = ("maxDepth", "maxBins", "seed", "featuresCol", "minInstancesPerNode", "minInfoGain", "maxMemoryInMB", "cacheNodeIds",
               "checkpointInterval", "impurity", "leafCol", "minWeightFractionPerNode", "predictionCol")
        rounds = self.getMaxIter()
        head = {"class": "org.apache.spark.ml.classification.GBTClassificationModel", **about, "uid": self.uid, "paramMap": params(self._paramMap),
                "defaultParamMap": params(self._defaultParamMap), "numFeatures": p, "numTrees": rounds}
        spark.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        trees = [(t, json.dumps({"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", **about, "uid": f"dtr_{self.uid[-8:]}_{t}",
                                 "paramMap": {}, "defaultParamMap": params({**self._defaultParamMap, **self._paramMap}, own) | {"predictionCol": "prediction"}}),
                  1.0 if t == 0 else float(self.getStepSize())) for t in range(rounds)]
        spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        data = [(r["tree"], (r["id"], r["value"], max(r["q"] / r["w"] - r["value"] ** 2, 0.0), [r["w"], r["s"], r["q"]], r["n"], r["gain"],
                             r["left"], r["left"] + 1 if r["left"] >= 0 else -1,
                             (r["feature"], [float(cuts[r["feature"]][r["cut"]])] if r["left"] >= 0 else [], -1))) for r in nodes]
        spark.createDataFrame(data, "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount long, "
                              "gain double, leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, "
                              "numCategories int>>").coalesce(1).write.parquet(f"{path}/data")
        return GBTClassificationModel.load(path)
