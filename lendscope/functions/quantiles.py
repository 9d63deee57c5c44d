"""Exact quantiles without collecting a column into one task.

Spark's exact ``percentile`` keeps a value->count map per group; a global
percentile of a continuous column merges that map in one task, unbounded in
the number of distinct values. Instead a double is mapped to a 64-bit integer
of the same order, and the wanted ranks are found digit by digit:

1. one pass counts the rows in each cell of the integers' leading bits (about
   2 ** 20 of them, for all columns at once: tasks sort and count batches, a
   grouped sum brings the counts together) and keeps each cell's least and
   largest value; a cumulative count finds the cells that hold a wanted rank;
2. such a cell is cut by its next bits in a further pass, or, if it holds
   no more rows than the limit, into its single values. A cell of one value, a
   hot one say, is done at once, whatever the number of its rows.

Two passes are the rule and four the most at 20 bits a pass, whatever the data.
The input is read once a pass, so a costly one should be written before.

The interpolation is numpy's (``linear``) or the midpoint of the two middle
values (``midpoint``, pandas ``median``), computed from the exact order
statistics, so results do not depend on partitioning.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rows of all columns that a task holds at once.
HELD_ROWS = 1 << 18


@dataclass
class _Bracket:
    """Rows of column ``col`` whose keys are ``lo`` to ``hi``, to be cut in cells of 2 ** shift keys."""
    col: int
    lo: int
    hi: int
    below: int
    shift: int


def lerp(x0: float, x1: float, t: float) -> float:
    """numpy's two-sided linear interpolation."""
    d = x1 - x0
    return x1 - d * (1.0 - t) if t >= 0.5 else x0 + d * t


def ordered_keys(x: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles; NaN is the largest, the zeros are equal."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    k = x.view(np.int64)
    return np.where(k < 0, k ^ np.int64(0x7FFFFFFFFFFFFFFF), k)


def key_value(k: int) -> float:
    """The double of a key."""
    return float(np.array([k if k >= 0 else k ^ 0x7FFFFFFFFFFFFFFF], np.int64).view(np.float64)[0])


def exact_quantiles(
    df: DataFrame,
    cols: list[str],
    probs: list[float],
    mode: str | dict[float, str] = "linear",
    accuracy: int = 10000,
    max_distinct: int = 200_000,
    max_rounds: int = 8,
) -> dict[tuple[str, float], float | None]:
    """Exact quantiles ``{(col, p): value}``; nulls skipped, empty -> None. ``mode`` may
    name one for each of ``probs``. A pass makes some 100 x ``accuracy`` cells; cells of up to
    ``max_distinct`` rows are cut into their values."""
    if not cols:
        return {}
    src = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    bits = max(10, math.ceil(math.log2(max(accuracy, 1))) + 6)
    every = [_Bracket(i, -(1 << 63), (1 << 63) - 1, 0, 64 - bits) for i in range(len(cols))]
    ranks: dict[int, dict[float, tuple]] = {}
    wanted: dict[int, set] = {}

    def at(n):  # the ranks of one column, in Spark
        pos = [F.lit(float(p)) * (n - 1).cast("double") for p in probs]
        return F.array(*[e.cast("bigint") for x in pos for e in (F.floor(x), F.ceil(x))])

    hits = _hits(src, every, lambda: at(F.col("total")))
    known: dict[tuple[int, int], float] = {}
    for h in hits:
        ranks[h["g"]] = {p: _ranks(h["total"], p) for p in probs}
        wanted[h["g"]] = {r for k0, k1, _ in ranks[h["g"]].values() for r in (k0, k1)}
    todo = _settle(every, hits, wanted, known, bits, max_distinct)
    rounds = 0
    while todo:
        rounds += 1
        if rounds > max_rounds:
            raise RuntimeError(f"ranks not found after {max_rounds} rounds: {sorted({cols[b.col] for b in todo})}")
        inner = [sorted(r - b.below for r in wanted[b.col] if (b.col, r) not in known) for b in todo]
        lists = F.create_map(*[e for j, rs in enumerate(inner) for e in (F.lit(j), F.array(*[F.lit(r).cast("bigint") for r in rs]))])
        todo = _settle(todo, _hits(src, todo, lambda: F.element_at(lists, F.col("g"))), wanted, known, bits, max_distinct)
    result: dict = {}
    for i, c in enumerate(cols):
        for p in probs:
            if i not in ranks:
                result[(c, p)] = None
                continue
            k0, k1, t = ranks[i][p]
            x0, x1 = known[i, k0], known[i, k1]
            how = mode[p] if isinstance(mode, dict) else mode
            if how == "midpoint":
                result[(c, p)] = x0 if k0 == k1 else (x0 + x1) / 2.0
            else:
                result[(c, p)] = lerp(x0, x1, t)
    return result


def _ranks(n: int, p: float):
    pos = p * float(n - 1)
    k0 = math.floor(pos)
    return k0, math.ceil(pos), pos - k0


def _cells_fn(brackets: list[_Bracket]):
    """Batches to (g: bracket, cell, n, lo, hi: least and largest key); a cell comes
    once for each HELD_ROWS rows of a task."""
    by_col: dict[int, list] = {}
    for g, b in enumerate(brackets):
        by_col.setdefault(b.col, []).append((g, b))

    def cells(held: list[pa.RecordBatch]):
        for col, mine in by_col.items():
            keys = ordered_keys(np.concatenate([h.column(col).drop_null().to_numpy(zero_copy_only=False) for h in held]))
            for g, b in mine:
                k = np.sort(keys[(keys >= b.lo) & (keys <= b.hi)])
                if not len(k):
                    continue
                first = np.flatnonzero(np.concatenate(([True], np.diff(k >> b.shift) != 0)))
                last = np.append(first[1:], len(k))
                yield pa.RecordBatch.from_pandas(pd.DataFrame({
                    "g": np.full(len(first), g, np.int32), "cell": k[first] >> b.shift, "n": last - first,
                    "lo": k[first], "hi": k[last - 1]}), preserve_index=False)

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= HELD_ROWS:
                yield from cells(held)
                held, rows = [], 0
        if rows:
            yield from cells(held)
    return run


def _hits(src: DataFrame, brackets: list[_Bracket], ranks) -> list:
    """The cells (g, n, upto, lo, hi, total) that hold one of the ``ranks`` (an array
    column over g and total, the bracket's rows)."""
    found = src.mapInArrow(_cells_fn(brackets), "g int, cell long, n long, lo long, hi long")
    found = found.groupBy("g", "cell").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    by = Window.partitionBy("g")  # a bracket's cells are bounded by the bits of a pass or by max_distinct
    found = found.withColumns({"upto": F.sum("n").over(by.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)),
                               "total": F.sum("n").over(by)})
    inside = F.exists(ranks(), lambda r: (F.col("upto") - F.col("n") <= r) & (F.col("upto") > r))
    return found.where(inside).select("g", "n", "upto", "lo", "hi", "total").collect()  # two a rank at most


def _settle(brackets, hits, wanted, known, bits, max_distinct) -> list[_Bracket]:
    """Enters the values of the ranks found into ``known``; the cells still to be cut."""
    todo = []
    for h in hits:
        b = brackets[h["g"]]
        below = b.below + h["upto"] - h["n"]
        open_ranks = False
        for r in wanted[b.col]:
            if not below <= r < below + h["n"]:
                continue
            if h["lo"] == h["hi"] or r == below:
                known[b.col, r] = key_value(h["lo"])
            elif r == below + h["n"] - 1:
                known[b.col, r] = key_value(h["hi"])
            else:
                open_ranks = True
        if open_ranks:
            width = (h["hi"] - h["lo"]).bit_length()
            todo.append(_Bracket(b.col, h["lo"], h["hi"], below, 0 if h["n"] <= max_distinct else max(0, width - bits)))
    return todo
