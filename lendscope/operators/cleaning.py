"""Cleaning operators (dedup, range rules, sparse-column drop, imputation,
type coercion) as ML pipeline stages, plus their count reports.

Fitting touches the data only through aggregates; transforms are lazy
column expressions.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Pipeline, Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import (
    DEFAULT_RULES, Rule, coerce_float, coerce_int, coerce_string, dbl, null_count_expr,
)
from ..functions.quantiles import exact_quantiles
from ..session import stage
from ..schema import (
    FLOAT_COLS, IMPUTE_CATEGORICAL_COLS, IMPUTE_NUMERIC_COLS, INT_COLS,
    SPARSE_COLUMN_THRESHOLD, STR_COLS,
)


def _present(df: DataFrame, cols) -> list[str]:
    have = set(df.columns)
    return [c for c in cols if c in have]


# ---------------------------------------------------------------- B1 / B2
class DuplicateRemover(Transformer):
    """Exact row dedup over all columns (nulls compare equal)."""

    def _transform(self, df: DataFrame) -> DataFrame:
        # Aggregate on all columns: partial aggregation combines copies
        # map-side, so a group holding a third of the rows never reaches a
        # single reducer as a third of the rows.
        return df.dropDuplicates()


def dedup_counts(df: DataFrame) -> DataFrame:
    """Rows before, after and removed by dedup, in one shuffle."""
    g = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_cnt"))
    return g.agg(
        F.sum("_cnt").cast("bigint").alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        F.sum(F.col("_cnt") - 1).cast("bigint").alias("removed"),
    )


# ---------------------------------------------------------------- B3 / B4
class ErrorCorrector(Transformer):
    """Sets a value to null where its column's rule is true."""

    def __init__(self, rules: dict[str, Rule] | None = None):
        super().__init__()
        self.rules = dict(DEFAULT_RULES if rules is None else rules)

    def _transform(self, df: DataFrame) -> DataFrame:
        todo = {c: F.when(r(F.col(c)), F.lit(None)).otherwise(F.col(c))
                for c, r in self.rules.items() if c in df.columns}
        return df.withColumns(todo) if todo else df


def rule_violation_counts(df: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """(column, violations) for every rule whose column is present."""
    rules = DEFAULT_RULES if rules is None else rules
    cols = [c for c in rules if c in df.columns]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, violations bigint")
    agg = df.agg(*[F.count_if(F.coalesce(rules[c](F.col(c)), F.lit(False))).alias(f"v{i}")
                   for i, c in enumerate(cols)])
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("violations"))
        for i, c in enumerate(cols)])))


# ---------------------------------------------------------------- B5
def null_shares(df: DataFrame) -> DataFrame:
    """(column, null_share) for every column, one aggregate pass."""
    cols = df.columns
    agg = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"s{i}")
                   for i, c in enumerate(cols)])
    return agg.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"s{i}").alias("null_share"))
        for i, c in enumerate(cols)])))


class ColumnDropper(Estimator):
    """Drops columns whose null share is strictly above ``threshold``."""

    def __init__(self, threshold: float = SPARSE_COLUMN_THRESHOLD):
        super().__init__()
        self.threshold = threshold

    def _fit(self, df: DataFrame) -> "ColumnDropperModel":
        shares = {r["column"]: r["null_share"] for r in null_shares(df).collect()}
        drop = [c for c in df.columns if (shares.get(c) or 0.0) > self.threshold]
        return ColumnDropperModel(drop, shares)


class ColumnDropperModel(Model):
    def __init__(self, drop_cols: list[str], shares: dict | None = None):
        super().__init__()
        self.drop_cols = list(drop_cols)
        self.shares = shares or {}

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*[c for c in self.drop_cols if c in df.columns])


def sparse_column_report(df: DataFrame, threshold: float = SPARSE_COLUMN_THRESHOLD) -> DataFrame:
    return null_shares(df).withColumn("dropped", F.col("null_share") > dbl(threshold))


# ---------------------------------------------------------------- B6-B9
def distributed_modes(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, mode): most frequent non-null value, ties to the smallest.

    One scan stacks the columns, one shuffle counts (column, value) with a
    map-side combine, and the per-column pick is an algebraic min -- no
    value->count map is ever merged in one task."""
    stacked = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        for c in cols]))).where(F.col("value").isNotNull())
    counts = stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))
    best = counts.groupBy("column").agg(
        F.min(F.struct((-F.col("cnt")).alias("neg"), F.col("value").alias("value"))).alias("m"))
    return best.select("column", F.col("m.value").alias("mode"))


def median_fills(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    q = exact_quantiles(df, cols, [0.5], mode="midpoint")
    return {c: q[(c, 0.5)] for c in cols}


class MissingImputer(Estimator):
    """Median for numeric columns, mode for categorical ones."""

    def __init__(self, numeric_cols=None, categorical_cols=None):
        super().__init__()
        self.numeric_cols = list(IMPUTE_NUMERIC_COLS if numeric_cols is None else numeric_cols)
        self.categorical_cols = list(
            IMPUTE_CATEGORICAL_COLS if categorical_cols is None else categorical_cols)

    def _fit(self, df: DataFrame) -> "MissingImputerModel":
        num = _present(df, self.numeric_cols)
        cat = _present(df, self.categorical_cols)
        num_fill = median_fills(df, num) if num else {}
        cat_fill = ({r["column"]: r["mode"] for r in distributed_modes(df, cat).collect()}
                    if cat else {})
        return MissingImputerModel(num_fill, cat_fill)


class MissingImputerModel(Model):
    def __init__(self, num_fill: dict, cat_fill: dict):
        super().__init__()
        self.num_fill = dict(num_fill)
        self.cat_fill = dict(cat_fill)

    def _transform(self, df: DataFrame) -> DataFrame:
        todo = {}
        for c, v in self.num_fill.items():
            if c in df.columns and v is not None:
                # double keeps a fractional median; coercion truncates later
                todo[c] = F.coalesce(F.col(c).cast("double"), dbl(v))
        for c, v in self.cat_fill.items():
            if c in df.columns and v is not None:
                todo[c] = F.coalesce(F.col(c), F.lit(v))
        return df.withColumns(todo) if todo else df

    def state_rows(self) -> list[tuple]:
        rows = [(c, "median", "", v) for c, v in self.num_fill.items()]
        rows += [(c, "mode", "", v) for c, v in self.cat_fill.items()]
        return rows


def null_total(df: DataFrame) -> DataFrame:
    return df.agg(F.sum(null_count_expr(df.columns)).cast("bigint").alias("nulls"))


def imputation_null_counts(df: DataFrame, model: "MissingImputerModel") -> DataFrame:
    """Nulls before imputation, remaining after, and filled -- one pass
    over the input (a cell stays null only where no fill value exists)."""
    filled = {c for c, v in {**model.num_fill, **model.cat_fill}.items() if v is not None}
    rest = [c for c in df.columns if c not in filled]
    before = F.sum(null_count_expr(df.columns)).cast("bigint")
    after = F.sum(null_count_expr(rest)).cast("bigint")
    return df.agg(before.alias("nulls_before"), after.alias("nulls_after")).withColumn(
        "filled", F.col("nulls_before") - F.col("nulls_after"))


# ---------------------------------------------------------------- B10-B12
class TypeEnforcer(Transformer):
    def __init__(self, int_cols=None, float_cols=None, str_cols=None):
        super().__init__()
        self.int_cols = list(INT_COLS if int_cols is None else int_cols)
        self.float_cols = list(FLOAT_COLS if float_cols is None else float_cols)
        self.str_cols = list(STR_COLS if str_cols is None else str_cols)

    def _transform(self, df: DataFrame) -> DataFrame:
        todo = {c: coerce_int(c) for c in _present(df, self.int_cols)}
        todo.update({c: coerce_float(c) for c in _present(df, self.float_cols)})
        todo.update({c: coerce_string(c) for c in _present(df, self.str_cols)})
        return df.withColumns(todo) if todo else df


# ---------------------------------------------------------------- B13 / C13
def quality_summary(df: DataFrame) -> DataFrame:
    """rows, columns, nulls, duplicate rows -- one shuffle."""
    cols = df.columns
    g = (df.withColumn("_nn", null_count_expr(cols))
         .groupBy(*cols).agg(F.count(F.lit(1)).alias("_cnt"), F.max("_nn").alias("_nn")))
    return g.agg(
        F.sum("_cnt").cast("bigint").alias("rows"),
        F.lit(len(cols)).cast("bigint").alias("columns"),
        F.coalesce(F.sum(F.col("_cnt") * F.col("_nn")), F.lit(0)).cast("bigint").alias("nulls"),
        F.coalesce(F.sum(F.col("_cnt") - 1), F.lit(0)).cast("bigint").alias("duplicates"),
    )


# ---------------------------------------------------------------- B14
def cleaning_pipeline(rules=None, threshold: float = SPARSE_COLUMN_THRESHOLD) -> Pipeline:
    """dedup -> rules -> sparse drop -> impute -> coerce; each estimator is
    fitted on the output of the steps before it."""
    return Pipeline(stages=[
        DuplicateRemover(),
        ErrorCorrector(rules),
        ColumnDropper(threshold),
        MissingImputer(),
        TypeEnforcer(),
    ])


def clean(df: DataFrame, rules=None) -> DataFrame:
    """Fit and apply the cleaning chain. The deduplicated, rule-corrected
    frame is checkpointed once to the shared checkpoint folder: every fit
    pass re-reads it, and its lineage (joins + dedup shuffle) is cut, so a
    lost executor recomputes from the checkpoint, not from the sources."""
    pre = ErrorCorrector(rules).transform(DuplicateRemover().transform(df)).transform(stage)
    model = Pipeline(stages=[ColumnDropper(), MissingImputer(), TypeEnforcer()]).fit(pre)
    return model.transform(pre)
