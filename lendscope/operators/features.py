"""Feature building: selection, interactions, encodings, robust scaling,
column alignment, the feature chain and its fitted-state table.

Fitted state (categories, label maps, medians, quartile ranges) is kept as a long
table ``(column, kind, key, value)`` so it can be written and read back. Columns
of up to ``max_categories`` values become literal maps and 0/1 columns; one with
more keeps its values in a dictionary table, is encoded by a join, and its
one-hot form is a sparse vector.
"""

from __future__ import annotations

from pyspark.ml import Estimator, Model, Transformer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import dbl, interaction_exprs
from ..functions.quantiles import exact_quantiles
from . import dictionary as di
from ..schema import FEATURE_DROP_COLS, ONE_HOT_COLS, LABEL_COLS, SCALE_COLS

# Values of a column that become literals of the plan; more are joined.
MAX_CATEGORIES = 10_000


def _present(df, cols):
    have = set(df.columns)
    return [c for c in cols if c in have]


# ---------------------------------------------------------------- D1
class FeatureSelector(Transformer):
    def __init__(self, drop_cols=None):
        super().__init__()
        self.drop_cols = list(FEATURE_DROP_COLS if drop_cols is None else drop_cols)

    def _transform(self, df):
        return df.drop(*_present(df, self.drop_cols))


# ---------------------------------------------------------------- D2-D8
class InteractionFeatures(Transformer):
    """Adds the seven interaction/ratio columns; their inputs are required."""

    def __init__(self, names=None):
        super().__init__()
        self.names = names

    def _transform(self, df):
        exprs = interaction_exprs()
        needed = {"debt_to_income", "loan_to_income", "annual_income", "loan_amount",
                  "credit_score", "savings_balance", "num_late_payments", "age"}
        missing = sorted(needed - set(df.columns))
        if missing:
            raise ValueError(f"interaction inputs missing: {missing}")
        if self.names is not None:
            exprs = {k: v for k, v in exprs.items() if k in self.names}
        return df.withColumns(exprs)


# ---------------------------------------------------------------- D9 / D10
class Encoder(Estimator):
    """One-hot for ``one_hot_cols`` (categories fitted, no drop-first, null
    -> all zero) and ordinal label maps for ``label_cols`` (sorted distinct
    -> 0..k-1, unseen or null -> -1)."""

    def __init__(self, one_hot_cols=None, label_cols=None, max_categories: int = MAX_CATEGORIES):
        super().__init__()
        self.one_hot_cols = list(ONE_HOT_COLS if one_hot_cols is None else one_hot_cols)
        self.label_cols = list(LABEL_COLS if label_cols is None else label_cols)
        self.max_categories = max_categories

    def _fit(self, df):
        oh = _present(df, self.one_hot_cols)
        lc = _present(df, self.label_cols)
        if not oh + lc:
            return EncoderModel({}, {})
        table = di.build_dictionary(df, sorted(set(oh + lc)))
        sizes = di.dictionary_sizes(table)
        large = {c: sizes[c] for c in oh + lc if sizes.get(c, (0, 0))[0] > self.max_categories}
        vals = {c: [] for c in oh + lc if c not in large}
        # max_categories rows a column at most
        for r in table.where(~F.col("column").isin(list(large)) if large else F.lit(True)).orderBy("column", "code").collect():
            vals[r["column"]].append(r["value"])
        return EncoderModel({c: vals[c] for c in oh if c in vals},
                            {c: {v: i for i, v in enumerate(vals[c])} for c in lc if c in vals},
                            table if large else None, {c: large[c] for c in oh if c in large}, {c: large[c] for c in lc if c in large})


class EncoderModel(Model):
    """``large_one_hot`` and ``large_labels`` hold the columns (with their numbers
    of values and bytes) that are encoded from ``table`` (column, value, code)."""

    def __init__(self, categories: dict, label_maps: dict, table: DataFrame | None = None,
                 large_one_hot: dict | None = None, large_labels: dict | None = None):
        super().__init__()
        self.categories = categories
        self.label_maps = label_maps
        self.table, self.large_one_hot, self.large_labels = table, large_one_hot or {}, large_labels or {}

    def one_hot_names(self) -> list[str]:
        return [f"{c}_{v}" for c, vs in self.categories.items() for v in vs]

    def _transform(self, df):
        cols = [c for c in df.columns if c not in self.categories]
        dummies = []
        for c, vs in self.categories.items():
            if c not in df.columns:
                continue
            dummies += [F.coalesce((F.col(c) == F.lit(v)).cast("int"), F.lit(0)).alias(f"{c}_{v}")
                        for v in vs]
        out = df.select(*cols, *dummies)
        todo = {}
        for c, m in self.label_maps.items():
            if c in out.columns:
                lit_map = F.create_map(*[x for k, i in m.items() for x in (F.lit(k), F.lit(i))]) \
                    if m else F.create_map().cast("map<string,int>")
                todo[c] = F.coalesce(F.try_element_at(lit_map, F.col(c).cast("string")),
                                     F.lit(-1)).cast("int")
        out = out.withColumns(todo) if todo else out
        for c, size in self.large_labels.items():
            if c in out.columns:
                columns = out.columns
                out = di.encode(out, self.table, c, size, "_label").drop(c).withColumnRenamed("_label", c).select(*columns)
                out = out.withColumn(c, F.col(c).cast("int"))
        for c, size in self.large_one_hot.items():
            if c in out.columns:
                out = di.one_hot_vector(out, self.table, c, size)
        return out

    def state_rows(self):
        """Of the columns with literals; ``table`` is a state table of its own."""
        rows = [(c, "category", v, i) for c, vs in self.categories.items()
                for i, v in enumerate(vs)]
        rows += [(c, "label", k, i) for c, m in self.label_maps.items() for k, i in m.items()]
        return rows


# ---------------------------------------------------------------- D11
class RobustScaler(Estimator):
    """(x - median) / (q75 - q25); a zero range divides by 1."""

    def __init__(self, cols=None):
        super().__init__()
        self.cols = list(SCALE_COLS if cols is None else cols)

    def _fit(self, df):
        cols = _present(df, self.cols)
        q = exact_quantiles(df, cols, [0.25, 0.5, 0.75], mode={0.25: "linear", 0.5: "midpoint", 0.75: "linear"})
        center, scale = {}, {}
        for c in cols:
            center[c] = q[(c, 0.5)]
            rng = None if q[(c, 0.25)] is None else q[(c, 0.75)] - q[(c, 0.25)]
            scale[c] = 1.0 if not rng else rng
        return RobustScalerModel(center, scale)


class RobustScalerModel(Model):
    def __init__(self, center: dict, scale: dict):
        super().__init__()
        self.center = center
        self.scale = scale

    def _transform(self, df):
        todo = {c: (F.col(c).cast("double") - dbl(self.center[c])) / dbl(self.scale[c])
                for c in self.center if c in df.columns and self.center[c] is not None}
        return df.withColumns(todo) if todo else df

    def state_rows(self):
        return ([(c, "center", "", v) for c, v in self.center.items()]
                + [(c, "scale", "", v) for c, v in self.scale.items()])


# ---------------------------------------------------------------- D16
def align_columns(df: DataFrame, expected: list[str], keep: list[str] | None = None):
    """Select ``expected`` in order, adding absent ones as 0 and dropping
    extras. Returns (frame, zero-filled column names)."""
    have = set(df.columns)
    filled = [c for c in expected if c not in have]
    cols = [F.col(c) if c in have else F.lit(0).alias(c) for c in expected]
    extra = [F.col(k) for k in (keep or []) if k in have and k not in expected]
    return df.select(*extra, *cols), filled


# ---------------------------------------------------------------- D17
class FeatureModel:
    """Fitted feature chain: select -> interact -> encode -> scale."""

    def __init__(self, encoder: EncoderModel, scaler: RobustScalerModel,
                 drop_cols: list[str], feature_cols: list[str]):
        self.encoder = encoder
        self.scaler = scaler
        self.drop_cols = drop_cols
        self.feature_cols = feature_cols

    def transform(self, df: DataFrame, keep: list[str] | None = None) -> DataFrame:
        out = FeatureSelector(self.drop_cols).transform(df)
        out = InteractionFeatures().transform(out)
        out = self.encoder.transform(out)
        out = self.scaler.transform(out)
        aligned, _ = align_columns(out, self.feature_cols, keep)
        return aligned

    def state_rows(self):
        return (self.encoder.state_rows() + self.scaler.state_rows()
                + [(c, "feature", "", i) for i, c in enumerate(self.feature_cols)]
                + [(c, "drop", "", None) for c in self.drop_cols])


def fit_features(train: DataFrame, drop_cols=None, exclude=()) -> FeatureModel:
    """Fit the encoder and scaler on ``train`` (the train part only)."""
    drop_cols = list(FEATURE_DROP_COLS if drop_cols is None else drop_cols)
    base = InteractionFeatures().transform(FeatureSelector(drop_cols).transform(train))
    enc = Encoder().fit(base)
    encoded = enc.transform(base)
    scaler = RobustScaler().fit(encoded)
    feats = [c for c in encoded.columns if c not in set(exclude)]
    return FeatureModel(enc, scaler, drop_cols, feats)
