"""Profiling operators: descriptive statistics, moments, correlation,
outliers, outcome rates, histograms and box statistics.

Every report is a small DataFrame computed from one or two aggregate passes
over all columns at once (never a scan per column). Quantiles come from the
exact distributed quantile primitive. Values are rounded like the reports
they reproduce: numpy's round-half-even of ``x * 10**d``.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import bin_edge, dbl, hist_bin
from ..functions.quantiles import exact_quantiles
from ..schema import (
    CLASS_HIST_BINS, CORR_COLS, DIST_COLS, HIST_BINS, IQR_MULTIPLIER, OUTLIER_COLS,
    STATS_COLS, TARGET_CATEGORICAL_COLS, TARGET_COL, TARGET_NUMERIC_COLS,
)
from ..session import stage


def np_round(x: Column, digits: int = 4) -> Column:
    """numpy.round: rint(x * 10**d) / 10**d (half to even on the product)."""
    p = dbl(10.0 ** digits)
    return F.bround(x * p, 0) / p


def _present(df: DataFrame, cols) -> list[str]:
    have = set(df.columns)
    return [c for c in cols if c in have]


def _stack(agg: DataFrame, fields: list[tuple[str, list[Column]]], names: list[str]) -> DataFrame:
    """Turn a one-row wide aggregate into one row per column name."""
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(col).alias("column"), *[e.alias(n) for e, n in zip(exprs, names)])
        for col, exprs in fields])))


# ---------------------------------------------------------------- C1-C4
def _adjusted_skew(n: Column, g1: Column, sd_pop: Column) -> Column:
    """Bias-adjusted sample skewness G1 = g1 * sqrt(n(n-1)) / (n-2);
    0 for a constant column, null below 3 values."""
    nd = n.cast("double")
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(sd_pop == 0, dbl(0))
            .otherwise(g1 * F.sqrt(nd * (nd - 1)) / (nd - 2)))


def _adjusted_kurt(n: Column, g2: Column, sd_pop: Column) -> Column:
    """Bias-adjusted excess kurtosis G2 = (n-1)/((n-2)(n-3)) ((n+1) g2 + 6)."""
    nd = n.cast("double")
    return (F.when(n < 4, F.lit(None).cast("double"))
            .when(sd_pop == 0, dbl(0))
            .otherwise((nd - 1) / ((nd - 2) * (nd - 3)) * ((nd + 1) * g2 + 6)))


def statistics_report(df: DataFrame, cols=None, digits: int = 4,
                      with_quantiles: bool = True) -> DataFrame:
    """count, mean, std, min, 25/50/75 %, max, skewness, kurtosis, missing,
    missing % per column: one moment pass plus the quantile passes (the
    quantile columns are null when ``with_quantiles`` is False).

    The moment pass stacks the columns to (column, x) and groups by column:
    a handful of aggregate functions per group instead of hundreds in one
    row, and map-side partial aggregation keeps one row per column per task."""
    cols = _present(df, STATS_COLS if cols is None else cols)
    stacked = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in cols])))
    x = F.col("x")
    mom = stacked.groupBy("column").agg(
        F.count(F.lit(1)).alias("_rows"), F.count(x).alias("n"), F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
        F.skewness(x).alias("g1"), F.kurtosis(x).alias("g2"), F.stddev_pop(x).alias("sdp"))
    q = (exact_quantiles(df, cols, [0.25, 0.5, 0.75]) if with_quantiles
         else {(c, p): None for c in cols for p in (0.25, 0.5, 0.75)})

    def qcol(p):
        m = F.create_map(*[e for c in cols for e in (F.lit(c), F.lit(q[(c, p)]).cast("double"))])
        return F.element_at(m, F.col("column"))

    n, sdp = F.col("n"), F.col("sdp")
    miss = F.col("_rows") - n
    return mom.select(
        "column", n.alias("count"),
        np_round(F.col("mean"), digits).alias("mean"),
        np_round(F.col("std"), digits).alias("std"),
        np_round(F.col("min"), digits).alias("min"),
        np_round(qcol(0.25), digits).alias("p25"),
        np_round(qcol(0.5), digits).alias("p50"),
        np_round(qcol(0.75), digits).alias("p75"),
        np_round(F.col("max"), digits).alias("max"),
        np_round(_adjusted_skew(n, F.col("g1"), sdp), digits).alias("skewness"),
        np_round(_adjusted_kurt(n, F.col("g2"), sdp), digits).alias("kurtosis"),
        miss.alias("missing"),
        np_round(miss / F.col("_rows").cast("double") * dbl(100), 2).alias("missing_pct"),
    )


# ---------------------------------------------------------------- C5 / C6
def _corr_expr(a: str, b: str) -> Column:
    """Pearson correlation over pairwise-complete rows; null (not an ANSI
    error) when either side has zero variance."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    xs, ys = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(xs, ys), F.stddev_samp(xs) * F.stddev_samp(ys))


def masked_correlations(df: DataFrame, cols: list[str], mean: np.ndarray, sd: np.ndarray) -> tuple[np.ndarray, list]:
    """Pairwise-complete correlations of columns with nulls, and the pairs that rounding
    may have spoiled. Tasks add up four matrix products of the centred, scaled values Z,
    their squares and the presence mask M (Z'Z, Z'M, (ZZ)'M, M'M); a grouped sum by row
    brings them together, so the work is one job whatever the number of pairs."""
    p = len(cols)

    def partial(batches):
        total = np.zeros((4, p, p))
        for pdf in batches:
            z = (pdf.to_numpy(np.float64) - mean) / sd
            m = ~np.isnan(z)
            z, m = np.where(m, z, 0.0), m.astype(np.float64)
            total += (z.T @ z, z.T @ m, (z * z).T @ m, m.T @ m)
        yield pd.DataFrame({"r": np.arange(4 * p), "v": list(total.reshape(4 * p, p))})

    # NaN is a value to Pearson's formula and a NULL is not: a column with NaN has no correlation
    nan = df.agg(*[F.count_if(F.isnan(F.col(c).cast("double"))).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    rows = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).mapInPandas(partial, "r int, v array<double>")
    summed = rows.select("r", F.posexplode("v").alias("j", "x")).groupBy("r", "j").agg(F.sum("x").alias("x"))
    total = np.zeros((4 * p, p))
    got = summed.toPandas()  # four matrices
    total[got["r"], got["j"]] = got["x"]
    zz, s, q, n = total.reshape(4, p, p)
    with np.errstate(invalid="ignore", divide="ignore"):
        cov, var = zz - s * s.T / n, q - s * s / n
        corr = cov / np.sqrt(var * var.T)
        doubtful = (n > 1) & ((var <= 1e-9 * q) | (var.T <= 1e-9 * q.T)) & (q > 0) & (q.T > 0)
    corr[(n < 2) | (var <= 0) | (var.T <= 0)] = np.nan
    gone = np.array([nan[i] > 0 for i in range(p)])
    corr[gone, :] = corr[:, gone] = np.nan
    return corr, [(cols[i], cols[j]) for i, j in zip(*np.nonzero(np.triu(doubtful, 1)))]


def correlation_matrix(df: DataFrame, cols=None, target: str = TARGET_COL,
                       digits: int = 4) -> DataFrame:
    """Long-format Pearson matrix (col_a, col_b, corr), pairwise-complete.

    Without nulls MLlib ``Correlation`` does it (one pass that tree-aggregates a
    p x p Gramian: bounded state, whatever the row count); with nulls a masked
    Gramian, also one pass. Pairs that are nearly constant where both are present
    are settled by an aggregate of their own."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    spark = df.sparkSession
    cols = _present(df, (CORR_COLS + [target]) if cols is None else cols)
    prof = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"z{i}") for i, c in enumerate(cols)],
                  *[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                  *[F.stddev_samp(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]
                  ).first()
    sd = [prof[f"s{i}"] for i in range(len(cols))]
    if any(prof[f"z{i}"] > 0 for i in range(len(cols))):
        mat, again = masked_correlations(
            df, cols, np.array([prof[f"m{i}"] or 0.0 for i in range(len(cols))]), np.array([v if v and v == v else 1.0 for v in sd]))
        if again:
            row = df.agg(*[_corr_expr(a, b).alias(f"r{k}") for k, (a, b) in enumerate(again)]).first()
            at = {c: i for i, c in enumerate(cols)}
            for k, (a, b) in enumerate(again):
                mat[at[a], at[b]] = mat[at[b], at[a]] = np.nan if row[f"r{k}"] is None else row[f"r{k}"]
    elif len(cols) > 1:
        vec = VectorAssembler(inputCols=cols, outputCol="_v").transform(
            df.select(*[F.col(c).cast("double").alias(c) for c in cols])).select("_v")
        mat = Correlation.corr(vec, "_v").first()[0].toArray()
    else:
        mat = np.ones((len(cols), len(cols)))
    rows = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            v = (1.0 if sd[i] else None) if i == j else float(mat[i, j])
            rows.append((a, b, None if v is None or v != v else v))
    out = spark.createDataFrame(rows, "col_a string, col_b string, corr double")
    return out.withColumn("corr", np_round(F.col("corr"), digits))


def top_outcome_correlations(df: DataFrame, cols=None, target: str = TARGET_COL) -> DataFrame:
    """(column, abs_corr, rank) of |corr with the outcome|, descending."""
    m = correlation_matrix(df, cols, target)
    out = (m.where((F.col("col_b") == target) & (F.col("col_a") != target))
           .select(F.col("col_a").alias("column"), F.abs("corr").alias("abs_corr")))
    # at most a few dozen rows: a global window is a bounded, single-task sort
    from pyspark.sql import Window
    return out.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc_nulls_last("abs_corr"), "column")))


# ---------------------------------------------------------------- C7
def outlier_report(df: DataFrame, cols=None, k: float = IQR_MULTIPLIER,
                   digits: int = 4) -> DataFrame:
    """IQR fences per column; strict outside count; % over all rows."""
    from pyspark.sql import Window
    cols = _present(df, OUTLIER_COLS if cols is None else cols)
    q = exact_quantiles(df, cols, [0.25, 0.75])
    bounds = {}
    for c in cols:
        q1, q3 = q[(c, 0.25)], q[(c, 0.75)]
        if q1 is None:
            bounds[c] = (None, None, None, None, None)
            continue
        iqr = q3 - q1
        bounds[c] = (q1, q3, iqr, q1 - k * iqr, q3 + k * iqr)
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *[
        F.count_if((F.col(c) < dbl(bounds[c][3])) | (F.col(c) > dbl(bounds[c][4])))
        .alias(f"o{i}") if bounds[c][0] is not None else F.lit(0).cast("bigint").alias(f"o{i}")
        for i, c in enumerate(cols)])
    fields = []
    for i, c in enumerate(cols):
        b = bounds[c]
        fields.append((c, [np_round(F.lit(v).cast("double"), digits) for v in b] + [
            F.col(f"o{i}"),
            np_round(F.col(f"o{i}") / F.col("_rows").cast("double") * dbl(100), digits)]))
    names = ["q1", "q3", "iqr", "lower_bound", "upper_bound", "outlier_count", "outlier_pct"]
    rep = _stack(wide, fields, names)
    return rep.withColumn("rank", F.row_number().over(
        Window.orderBy(F.desc("outlier_count"), "column")))


# ---------------------------------------------------------------- C8 / C9
def outcome_rate_by_category(df: DataFrame, cols=None, target: str = TARGET_COL,
                             digits: int = 4) -> DataFrame:
    """(column, value, default_rate): all columns stacked, one shuffle with
    a map-side partial average; the null category is dropped."""
    cols = _present(df, TARGET_CATEGORICAL_COLS if cols is None else cols)
    stacked = df.select(F.col(target).cast("double").alias("_y"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for c in cols])))
    return (stacked.where(F.col("value").isNotNull())
            .groupBy("column", "value")
            .agg(np_round(F.avg("_y"), digits).alias("default_rate")))


def outcome_summary(df: DataFrame, target: str = TARGET_COL) -> DataFrame:
    y = F.col(target)
    return df.agg(F.avg(y.cast("double")).alias("default_rate"),
                  F.count_if(y == 1).alias("n_default"),
                  F.count_if(y == 0).alias("n_no_default"))


# ---------------------------------------------------------------- C10 / C12
# Groups whose ranges go to the tasks; ranges of more are joined.
MAX_GROUPS = 1000


def _bounds(lo: float, hi: float) -> tuple[float, float]:
    return (lo - 0.5, hi + 0.5) if lo == hi else (lo, hi)


def _plain_range(lo: float, hi: float, bins: int) -> bool:
    lo, hi = _bounds(lo, hi)
    return math.isfinite(lo) and math.isfinite(hi) and math.isfinite(hi - lo) and hi - lo > bins / sys.float_info.max


def bin_indices(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, bins: int) -> np.ndarray:
    """``expressions.hist_bin`` of arrays, the same arithmetic; ``lo`` < ``hi``."""
    step = (hi - lo) / float(bins)

    def edge(i):
        return np.where(i >= bins, hi, i * step + lo)

    raw = np.minimum(((x - lo) * (float(bins) / (hi - lo))).astype(np.int64), bins - 1)
    fixed = np.where(x < edge(raw), raw - 1, raw)
    return np.where((x >= edge(fixed + 1)) & (fixed != bins - 1), fixed + 1, fixed)


def _bin_counts_fn(cols: list[str], ranges: list[tuple], bins: int):
    """Rows (grp, columns) to a task's counts (c: place of the column, grp, bin, n)."""
    groups = np.array(sorted({g for _, g, _, _ in ranges}), np.int64)
    at, where = {c: i for i, c in enumerate(cols)}, {g: i for i, g in enumerate(groups)}
    lo, hi = np.zeros(len(groups) * len(cols)), np.ones(len(groups) * len(cols))
    for c, g, least, most in ranges:
        lo[where[g] * len(cols) + at[c]], hi[where[g] * len(cols) + at[c]] = _bounds(least, most)

    def run(batches):
        total = np.zeros(len(lo) * bins, np.int64)
        for pdf in batches:
            x = pdf[cols].to_numpy(np.float64)
            cell = np.searchsorted(groups, pdf["grp"].to_numpy(np.int64))[:, None] * len(cols) + np.arange(len(cols))
            given = ~np.isnan(x)
            x, cell = x[given], cell[given]
            total += np.bincount(cell * bins + bin_indices(x, lo[cell], hi[cell], bins), minlength=len(total))
        i = np.flatnonzero(total)
        cell = i // bins
        yield pd.DataFrame({"c": cell % len(cols), "grp": groups[cell // len(cols)], "bin": i % bins, "n": total[i]})
    return run


def histogram(df: DataFrame, cols=None, bins: int = HIST_BINS,
              by: str | None = None) -> DataFrame:
    """Equal-width bins between each column's (group's) own min and max.

    Pass 1: min and max of all columns in one wide aggregate (a row a group).
    Pass 2: tasks count their rows by group, column and bin and a grouped sum follows;
    for more than MAX_GROUPS groups (or ranges that are not finite) every row finds its
    bins from a join with the ranges' table, and one grouped count follows.
    Empty bins come from the ranges, which are as many as columns x groups."""
    cols = _present(df, DIST_COLS if cols is None else cols)
    grp = (F.col(by) if by else F.lit(0)).cast("bigint")
    rows = df.select(grp.alias("grp"), *[F.col(c).cast("double").alias(c) for c in cols])
    if by:
        rows = rows.where(F.col("grp").isNotNull())
    wide = rows.groupBy("grp").agg(*[e for i, c in enumerate(cols) for e in (
        F.min(c).alias(f"lo{i}"), F.max(c).alias(f"hi{i}"))])
    held = wide.limit(MAX_GROUPS + 1).collect()
    ranges = [(c, r["grp"], r[f"lo{i}"], r[f"hi{i}"]) for r in held for i, c in enumerate(cols) if r[f"lo{i}"] is not None]
    if len(held) > MAX_GROUPS or not all(_plain_range(lo, hi, bins) for *_, lo, hi in ranges):
        wide = wide.transform(stage)
        frame = wide.select("grp", F.inline(F.array(*[F.struct(
            F.lit(c).alias("column"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi")) for i, c in enumerate(cols)])))
        frame = frame.where(F.col("lo").isNotNull()).select("column", "grp", "lo", "hi")
        found = [F.struct(F.lit(c).alias("column"), F.col(c).alias("x"), F.col(f"lo{i}").alias("lo"), F.col(f"hi{i}").alias("hi"))
                 for i, c in enumerate(cols)]
        binned = (rows.join(wide, "grp").select("grp", F.inline(F.array(*found))).where(F.col("x").isNotNull())
                  .groupBy("column", "grp", hist_bin(F.col("x"), F.col("lo"), F.col("hi"), bins).cast("int").alias("bin"))
                  .agg(F.count(F.lit(1)).alias("count")))
    else:
        frame = df.sparkSession.createDataFrame(ranges, "column string, grp bigint, lo double, hi double")
        counts = rows.mapInPandas(_bin_counts_fn(cols, ranges, bins), "c int, grp bigint, bin int, n bigint")
        names = F.array(*[F.lit(c) for c in cols])
        binned = counts.groupBy("c", "grp", "bin").agg(F.sum("n").alias("count")).select(
            F.element_at(names, F.col("c") + 1).alias("column"), "grp", "bin", "count")
    frame = frame.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = (frame.join(binned, ["column", "grp", "bin"], "left")
           .select("column", "grp", "bin",
                   bin_edge(F.col("bin"), F.col("lo"), F.col("hi"), bins).alias("bin_lo"),
                   bin_edge(F.col("bin") + 1, F.col("lo"), F.col("hi"), bins).alias("bin_hi"),
                   F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count")))
    if by:
        return out.withColumnRenamed("grp", by)
    return out.drop("grp")


def class_histogram(df: DataFrame, cols=None, target: str = TARGET_COL,
                    bins: int = CLASS_HIST_BINS) -> DataFrame:
    cols = _present(df, TARGET_NUMERIC_COLS if cols is None else cols)
    return histogram(df, cols, bins, by=target)


# ---------------------------------------------------------------- C11
def box_statistics(df: DataFrame, cols=None, whis: float = IQR_MULTIPLIER) -> DataFrame:
    """Quartiles, whiskers at the last datum inside q -/+ whis*IQR, fliers."""
    cols = _present(df, DIST_COLS if cols is None else cols)
    q = exact_quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        q1, q3 = q[(c, 0.25)], q[(c, 0.75)]
        if q1 is None:
            aggs += [F.lit(None).cast("double").alias(f"lo{i}"),
                     F.lit(None).cast("double").alias(f"hi{i}")]
            continue
        iqr = q3 - q1
        aggs += [F.min(F.when(x >= dbl(q1 - whis * iqr), x)).alias(f"lo{i}"),
                 F.max(F.when(x <= dbl(q3 + whis * iqr), x)).alias(f"hi{i}")]
    wide = df.agg(*aggs)
    # whiskers fall back to the quartile when no datum is inside the fence
    whisk = []
    for i, c in enumerate(cols):
        q1, q3 = q[(c, 0.25)], q[(c, 0.75)]
        lo = F.when(F.col(f"lo{i}").isNull() | (F.col(f"lo{i}") > dbl(q1 or 0)), dbl(q1 or 0)) \
            .otherwise(F.col(f"lo{i}")) if q1 is not None else F.lit(None).cast("double")
        hi = F.when(F.col(f"hi{i}").isNull() | (F.col(f"hi{i}") < dbl(q3 or 0)), dbl(q3 or 0)) \
            .otherwise(F.col(f"hi{i}")) if q3 is not None else F.lit(None).cast("double")
        whisk.append((lo.alias(f"wlo{i}"), hi.alias(f"whi{i}")))
    wl = wide.select(*[e for pair in whisk for e in pair]).first()
    fl = df.agg(*[F.count_if((F.col(c) < dbl(wl[f"wlo{i}"])) | (F.col(c) > dbl(wl[f"whi{i}"])))
                  .alias(f"f{i}") if wl[f"wlo{i}"] is not None else F.lit(0).cast("bigint").alias(f"f{i}")
                  for i, c in enumerate(cols)])
    fields = [(c, [F.lit(q[(c, 0.25)]).cast("double"), F.lit(q[(c, 0.5)]).cast("double"),
                   F.lit(q[(c, 0.75)]).cast("double"), F.lit(wl[f"wlo{i}"]).cast("double"),
                   F.lit(wl[f"whi{i}"]).cast("double"), F.col(f"f{i}")])
              for i, c in enumerate(cols)]
    return _stack(fl, fields, ["q1", "median", "q3", "whisker_lo", "whisker_hi", "n_fliers"])


# ---------------------------------------------------------------- C13
def dataset_overview(df: DataFrame) -> DataFrame:
    """(metric, value): rows, columns, nulls, duplicates and the number of
    columns per data type (from the schema, no data pass)."""
    from .cleaning import quality_summary
    qs = quality_summary(df)
    counts: dict[str, int] = {}
    for _, t in df.dtypes:
        counts[t] = counts.get(t, 0) + 1
    items = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
             for m in ("rows", "columns", "nulls", "duplicates")]
    items += [F.struct(F.lit(f"dtype:{t}").alias("metric"), F.lit(n).cast("bigint").alias("value"))
              for t, n in sorted(counts.items())]
    return qs.select(F.inline(F.array(*items)))


__all__ = [
    "np_round", "statistics_report", "correlation_matrix", "top_outcome_correlations",
    "outlier_report", "outcome_rate_by_category", "outcome_summary", "histogram",
    "class_histogram", "box_statistics", "dataset_overview",
]
