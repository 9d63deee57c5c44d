"""Query registry: one Spark query per operator of the inventory, each with
the DuckDB SQL that must give the same rows (where SQL can express it).

Every query reads the driver tables through the applicant view (or, for the
stream and metric twins, data Spark derives from it) over whole tables.
"""

from __future__ import annotations

from typing import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import DEFAULT_RULES, dbl
from ..operators import cleaning as cl
from ..schema import (
    APPLICATION_COLUMNS, FLOAT_COLS, IMPUTE_CATEGORICAL_COLS, IMPUTE_NUMERIC_COLS,
    INT_COLS, STR_COLS,
)
from ..session import stage
from ..sources.tables import applications
from . import oracle as O

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _union(selects: list[str]) -> str:
    return "\nUNION ALL\n".join(selects)


# ======================================================================
# Shared stages
# ======================================================================

def ruled(spark, sf):
    return cl.ErrorCorrector().transform(cl.DuplicateRemover().transform(applications(spark, sf)))


def imputed(spark, sf):
    pre = ruled(spark, sf).transform(stage)
    return cl.MissingImputer().fit(pre).transform(pre)


def cleaned(spark, sf):
    return cl.clean(applications(spark, sf))


CLEAN = O.cleaning_ctes()


# ======================================================================
# B: cleaning
# ======================================================================

@query("b01_dedup", O.with_ctes(*CLEAN[:1]) + "SELECT * FROM dedup")
def b01(spark, sf):
    return cl.DuplicateRemover().transform(applications(spark, sf))


@query("b02_dedup_count")
def b02(spark, sf):
    return cl.dedup_counts(applications(spark, sf))


ORACLE["b02_dedup_count"] = O.with_ctes() + (
    "SELECT cast(count(*) AS bigint) AS rows_before, "
    "(SELECT count(*) FROM (SELECT DISTINCT * FROM applications)) AS rows_after, "
    "cast(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM applications)) AS bigint) AS removed "
    "FROM applications")


@query("b03_rule_nulling", O.with_ctes(*CLEAN[:2]) + "SELECT * FROM ruled")
def b03(spark, sf):
    return ruled(spark, sf)


ORACLE["b04_rule_counts"] = O.with_ctes(*CLEAN[:1]) + _union([
    f"SELECT '{c}' AS column, cast(count(*) FILTER (WHERE {O.RULES_SQL[c]}) AS bigint) AS violations FROM dedup"
    for c in DEFAULT_RULES])


@query("b04_rule_counts")
def b04(spark, sf):
    return cl.rule_violation_counts(cl.DuplicateRemover().transform(applications(spark, sf)))


ORACLE["b05_sparse_drop"] = O.with_ctes(*CLEAN[:2]) + _union([
    f"SELECT '{c}' AS column, avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END)::double AS null_share, "
    f"avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END) > 0.5 AS dropped FROM ruled"
    for c in APPLICATION_COLUMNS])


@query("b05_sparse_drop")
def b05(spark, sf):
    return cl.sparse_column_report(ruled(spark, sf))


ORACLE["b06_median_fit"] = O.with_ctes(*CLEAN[:3]) + _union([
    f"SELECT '{c}' AS column, f_{c} AS median FROM fill" for c in IMPUTE_NUMERIC_COLS])


@query("b06_median_fit")
def b06(spark, sf):
    fills = cl.median_fills(ruled(spark, sf).select(IMPUTE_NUMERIC_COLS).transform(stage), IMPUTE_NUMERIC_COLS)
    return spark.createDataFrame([(c, fills[c]) for c in IMPUTE_NUMERIC_COLS],
                                 "column string, median double")


ORACLE["b07_mode_fit"] = O.with_ctes(*CLEAN[:3]) + _union([
    f"SELECT '{c}' AS column, f_{c} AS mode FROM fill" for c in IMPUTE_CATEGORICAL_COLS])


@query("b07_mode_fit")
def b07(spark, sf):
    return cl.distributed_modes(ruled(spark, sf), IMPUTE_CATEGORICAL_COLS)


ORACLE["b08_impute"] = O.with_ctes(*CLEAN[:4]) + "SELECT * FROM imputed"


@query("b08_impute")
def b08(spark, sf):
    return imputed(spark, sf)


ORACLE["b09_null_counts"] = O.with_ctes(*CLEAN[:4]) + (
    "SELECT b.nulls AS nulls_before, a.nulls AS nulls_after, b.nulls - a.nulls AS filled FROM "
    f"(SELECT cast(sum({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in APPLICATION_COLUMNS)}) AS bigint) AS nulls FROM ruled) b, "
    f"(SELECT cast(sum({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in APPLICATION_COLUMNS)}) AS bigint) AS nulls FROM imputed) a")


@query("b09_null_counts")
def b09(spark, sf):
    pre = ruled(spark, sf).transform(stage)
    return cl.imputation_null_counts(pre, cl.MissingImputer().fit(pre))


def _coerce_sql(cols, kind):
    out = []
    for c in cols:
        if kind == "int":
            out.append(f"cast(trunc(coalesce(try_cast({c} AS double), 0)) AS bigint) AS {c}")
        elif kind == "float":
            out.append(f"try_cast({c} AS double) AS {c}")
        else:
            out.append(f"cast({c} AS varchar) AS {c}")
    return ", ".join(out)


for _key, _cols, _kind in (("b10_coerce_int", INT_COLS, "int"),
                           ("b11_coerce_float", FLOAT_COLS, "float"),
                           ("b12_coerce_string", STR_COLS, "str")):
    ORACLE[_key] = O.with_ctes(*CLEAN[:4]) + (
        f"SELECT application_id, {_coerce_sql(_cols, _kind)} FROM imputed")

    def _mk(cols, kind):
        def fn(spark, sf):
            enf = cl.TypeEnforcer(int_cols=cols if kind == "int" else [],
                                  float_cols=cols if kind == "float" else [],
                                  str_cols=cols if kind == "str" else [])
            return enf.transform(imputed(spark, sf)).select("application_id", *cols)
        return fn

    QUERIES[_key] = _mk(_cols, _kind)


ORACLE["b13_quality_summary"] = O.with_ctes(*CLEAN) + _union([
    f"SELECT '{stage}' AS stage, cast(count(*) AS bigint) AS rows, cast({len(APPLICATION_COLUMNS)} AS bigint) AS columns, "
    f"cast(sum({' + '.join(f'CASE WHEN {c} IS NULL THEN 1 ELSE 0 END' for c in APPLICATION_COLUMNS)}) AS bigint) AS nulls, "
    f"cast(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {tbl})) AS bigint) AS duplicates FROM {tbl}"
    for stage, tbl in (("before", "applications"), ("after", "clean"))])


@query("b13_quality_summary")
def b13(spark, sf):
    before = cl.quality_summary(applications(spark, sf)).withColumn("stage", F.lit("before"))
    after = cl.quality_summary(cleaned(spark, sf)).withColumn("stage", F.lit("after"))
    return before.unionByName(after)


ORACLE["b14_clean_chain"] = O.with_ctes(*CLEAN) + "SELECT * FROM clean"


@query("b14_clean_chain")
def b14(spark, sf):
    return cleaned(spark, sf)


# ======================================================================
# C: profiling (on the cleaned table, like the reports it reproduces)
# ======================================================================
from ..operators import profiling as pr  # noqa: E402
from ..schema import (  # noqa: E402
    CLASS_HIST_BINS, CORR_COLS, DIST_COLS, HIST_BINS, OUTLIER_COLS, STATS_COLS,
    TARGET_CATEGORICAL_COLS, TARGET_COL, TARGET_NUMERIC_COLS,
)

R4 = O.np_round_sql


def _moment_sql(c: str) -> str:
    """count, m2, m3, m4 central sums of one column from ``clean``."""
    return (f"(SELECT count(x) AS n, sum(power(x - m, 2)) AS m2, sum(power(x - m, 3)) AS m3, "
            f"sum(power(x - m, 4)) AS m4 FROM (SELECT cast({c} AS double) AS x FROM clean) v, "
            f"(SELECT avg(cast({c} AS double)) AS m FROM clean) mm)")


def _skew_sql(c):
    g1 = "sqrt(cast(n AS double)) * m3 / power(m2, 1.5)"
    return (f"(SELECT CASE WHEN n < 3 THEN NULL WHEN m2 = 0 THEN 0.0 ELSE "
            f"{g1} * sqrt(cast(n AS double) * (n - 1)) / (n - 2) END FROM {_moment_sql(c)} s)")


def _kurt_sql(c):
    g2 = "cast(n AS double) * m4 / (m2 * m2) - 3"
    return (f"(SELECT CASE WHEN n < 4 THEN NULL WHEN m2 = 0 THEN 0.0 ELSE "
            f"(cast(n AS double) - 1) / ((cast(n AS double) - 2) * (cast(n AS double) - 3)) "
            f"* ((cast(n AS double) + 1) * ({g2}) + 6) END FROM {_moment_sql(c)} s)")


ORACLE["c01_describe"] = O.with_ctes(*CLEAN) + _union([
    f"SELECT '{c}' AS column, count({c}) AS count, {R4(f'avg(cast({c} AS double))')} AS mean, "
    f"{R4(f'stddev_samp(cast({c} AS double))')} AS std, {R4(f'min(cast({c} AS double))')} AS min, "
    f"{R4(O.quantile_sql('clean', c, 0.25))} AS p25, {R4(O.quantile_sql('clean', c, 0.5))} AS p50, "
    f"{R4(O.quantile_sql('clean', c, 0.75))} AS p75, {R4(f'max(cast({c} AS double))')} AS max FROM clean"
    for c in STATS_COLS])


@query("c01_describe")
def c01(spark, sf):
    return pr.statistics_report(cleaned(spark, sf)).select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


ORACLE["c02_skewness"] = O.with_ctes(*CLEAN) + _union([
    f"SELECT '{c}' AS column, {R4(_skew_sql(c))} AS skewness" for c in STATS_COLS])


@query("c02_skewness")
def c02(spark, sf):
    return pr.statistics_report(cleaned(spark, sf), with_quantiles=False).select("column", "skewness")


ORACLE["c03_kurtosis"] = O.with_ctes(*CLEAN) + _union([
    f"SELECT '{c}' AS column, {R4(_kurt_sql(c))} AS kurtosis" for c in STATS_COLS])


@query("c03_kurtosis")
def c03(spark, sf):
    return pr.statistics_report(cleaned(spark, sf), with_quantiles=False).select("column", "kurtosis")


ORACLE["c04_missing"] = O.with_ctes(*CLEAN[:2]) + _union([
    f"SELECT '{c}' AS column, count(*) - count({c}) AS missing, "
    f"{O.np_round_sql(f'cast(count(*) - count({c}) AS double) / cast(count(*) AS double) * cast(100 AS double)', 2)} AS missing_pct FROM ruled"
    for c in STATS_COLS])


@query("c04_missing")
def c04(spark, sf):
    # missing values are reported on the rule-corrected table (the cleaned
    # one has none left)
    return pr.statistics_report(ruled(spark, sf), with_quantiles=False).select(
        "column", "missing", "missing_pct")


_CORR = CORR_COLS + [TARGET_COL]


def _corr_cell(a, b):
    if a == b:
        return f"CASE WHEN stddev_samp(cast({a} AS double)) > 0 THEN cast(1.0 AS double) END"
    return f"corr(cast({a} AS double), cast({b} AS double))"


ORACLE["c05_correlation"] = O.with_ctes(*CLEAN) + _union([
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R4(_corr_cell(a, b))} AS corr FROM clean"
    for a in _CORR for b in _CORR])


@query("c05_correlation")
def c05(spark, sf):
    return pr.correlation_matrix(cleaned(spark, sf))


ORACLE["c06_top_outcome_corr"] = O.with_ctes(*CLEAN) + (
    "SELECT \"column\", abs_corr, row_number() OVER (ORDER BY abs_corr DESC NULLS LAST, \"column\") AS rank FROM ("
    + _union([f"SELECT '{a}' AS column, abs({R4(_corr_cell(a, TARGET_COL))}) AS abs_corr FROM clean"
              for a in CORR_COLS]) + ")")


@query("c06_top_outcome_corr")
def c06(spark, sf):
    return pr.top_outcome_correlations(cleaned(spark, sf))


def _outlier_sql(c):
    q1, q3 = O.quantile_sql("clean", c, 0.25), O.quantile_sql("clean", c, 0.75)
    return (f"SELECT '{c}' AS column, {R4('q1')} AS q1, {R4('q3')} AS q3, {R4('q3 - q1')} AS iqr, "
            f"{R4('q1 - 1.5 * (q3 - q1)')} AS lower_bound, {R4('q3 + 1.5 * (q3 - q1)')} AS upper_bound, "
            f"(SELECT count(*) FROM clean WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS outlier_count, "
            f"{R4('cast((SELECT count(*) FROM clean WHERE ' + c + ' < q1 - 1.5 * (q3 - q1) OR ' + c + ' > q3 + 1.5 * (q3 - q1)) AS double) / cast((SELECT count(*) FROM clean) AS double) * cast(100 AS double)')} AS outlier_pct "
            f"FROM (SELECT {q1} AS q1, {q3} AS q3) qq")


ORACLE["c07_outliers"] = O.with_ctes(*CLEAN) + (
    "SELECT *, row_number() OVER (ORDER BY outlier_count DESC, \"column\") AS rank FROM ("
    + _union([_outlier_sql(c) for c in OUTLIER_COLS]) + ")")


@query("c07_outliers")
def c07(spark, sf):
    return pr.outlier_report(cleaned(spark, sf))


ORACLE["c08_outcome_rate"] = O.with_ctes(*CLEAN) + _union([
    f"SELECT '{c}' AS column, cast({c} AS varchar) AS value, {R4(f'avg(cast({TARGET_COL} AS double))')} AS default_rate "
    f"FROM clean WHERE {c} IS NOT NULL GROUP BY {c}" for c in TARGET_CATEGORICAL_COLS])


@query("c08_outcome_rate")
def c08(spark, sf):
    return pr.outcome_rate_by_category(cleaned(spark, sf))


def flagship(spark, sf):
    return c08(spark, sf)


ORACLE["c09_outcome_summary"] = O.with_ctes(*CLEAN) + (
    f"SELECT avg(cast({TARGET_COL} AS double)) AS default_rate, count(*) FILTER (WHERE {TARGET_COL} = 1) AS n_default, "
    f"count(*) FILTER (WHERE {TARGET_COL} = 0) AS n_no_default FROM clean")


@query("c09_outcome_summary")
def c09(spark, sf):
    return pr.outcome_summary(cleaned(spark, sf))


def _hist_oracle(cols, bins, by=None):
    body = O.histogram_sql("clean", cols, bins, by)
    head, sel = body.split("\nSELECT hf.column", 1)
    return O.with_ctes(*CLEAN, head.strip().rstrip(",")) + "SELECT hf.column" + sel


ORACLE["c10_histogram"] = _hist_oracle(DIST_COLS, HIST_BINS)


@query("c10_histogram")
def c10(spark, sf):
    return pr.histogram(cleaned(spark, sf))


def _box_sql(c):
    q1, q2, q3 = (O.quantile_sql("clean", c, p) for p in (0.25, 0.5, 0.75))
    lo = f"(SELECT min(cast({c} AS double)) FROM clean WHERE {c} >= q1 - 1.5 * (q3 - q1))"
    hi = f"(SELECT max(cast({c} AS double)) FROM clean WHERE {c} <= q3 + 1.5 * (q3 - q1))"
    wlo = f"(CASE WHEN {lo} IS NULL OR {lo} > q1 THEN q1 ELSE {lo} END)"
    whi = f"(CASE WHEN {hi} IS NULL OR {hi} < q3 THEN q3 ELSE {hi} END)"
    return (f"SELECT '{c}' AS column, q1, q2 AS median, q3, wlo AS whisker_lo, whi AS whisker_hi, "
            f"(SELECT count(*) FROM clean WHERE {c} < wlo OR {c} > whi) AS n_fliers "
            f"FROM (SELECT q1, q2, q3, {wlo} AS wlo, {whi} AS whi FROM "
            f"(SELECT {q1} AS q1, {q2} AS q2, {q3} AS q3) a) b")


ORACLE["c11_box_stats"] = O.with_ctes(*CLEAN) + _union([_box_sql(c) for c in DIST_COLS])


@query("c11_box_stats")
def c11(spark, sf):
    return pr.box_statistics(cleaned(spark, sf))


ORACLE["c12_class_histogram"] = _hist_oracle(TARGET_NUMERIC_COLS, CLASS_HIST_BINS, TARGET_COL)


@query("c12_class_histogram")
def c12(spark, sf):
    return pr.class_histogram(cleaned(spark, sf))


def _overview_sql():
    from ..schema import APPLICATION_COLUMNS as AC
    nulls = " + ".join(f"CASE WHEN {c} IS NULL THEN 1 ELSE 0 END" for c in AC)
    types = ", ".join(f"typeof({c})" for c in AC)
    return O.with_ctes(*CLEAN) + f"""
SELECT 'rows' AS metric, cast(count(*) AS bigint) AS value FROM clean
UNION ALL SELECT 'columns', cast({len(AC)} AS bigint)
UNION ALL SELECT 'nulls', cast(coalesce(sum({nulls}), 0) AS bigint) FROM clean
UNION ALL SELECT 'duplicates', cast((SELECT count(*) FROM clean) - (SELECT count(*) FROM (SELECT DISTINCT * FROM clean)) AS bigint)
UNION ALL SELECT 'dtype:' || CASE t WHEN 'BIGINT' THEN 'bigint' WHEN 'DOUBLE' THEN 'double'
                             WHEN 'VARCHAR' THEN 'string' ELSE lower(t) END, cast(count(*) AS bigint)
  FROM (SELECT unnest([{types}]) AS t FROM (SELECT * FROM clean LIMIT 1)) GROUP BY t"""


ORACLE["c13_overview"] = _overview_sql()


@query("c13_overview")
def c13(spark, sf):
    return pr.dataset_overview(cleaned(spark, sf))


# ======================================================================
# D: features, split, balance summary, alignment
# ======================================================================
from ..functions import ranking as rk  # noqa: E402
from ..operators import features as fe  # noqa: E402
from ..schema import (  # noqa: E402
    FEATURE_DROP_COLS, ID_COL, LABEL_COLS, ONE_HOT_COLS, SCALE_COLS, SEED, SMOTE_RATIO,
    TEST_SIZE, VAL_SIZE,
)

# The seven ratio formulas, as SQL text.
INTERACTION_SQL = {
    "debt_x_loan": "debt_to_income * loan_to_income",
    "income_per_loan": "annual_income / (loan_amount + cast(1e-09 AS double))",
    "score_x_dti": "credit_score * debt_to_income",
    "savings_to_loan": "savings_balance / (loan_amount + cast(1e-09 AS double))",
    "late_x_dti": "num_late_payments * debt_to_income",
    "age_x_income": "age * annual_income",
    "loan_burden": "loan_amount / (annual_income + savings_balance + cast(1e-09 AS double))",
}
SELECTED = [c for c in APPLICATION_COLUMNS if c not in FEATURE_DROP_COLS]
PLAIN_FEATURES = [c for c in SELECTED if c not in (ID_COL, TARGET_COL) and c not in ONE_HOT_COLS
                  and c not in LABEL_COLS and c not in SCALE_COLS]
SPLIT = O.split_sql("sp", "clean", ID_COL, TARGET_COL, TEST_SIZE, VAL_SIZE, SEED, "split")


def split_frame(spark, sf):
    """Cleaned table with an exact stratified test/val/train part column."""
    return rk.stratified_split(cleaned(spark, sf), ID_COL, TARGET_COL, TEST_SIZE, VAL_SIZE,
                               seed=SEED, salt="split")


def fitted_split(spark, sf):
    """The split table, written, and the feature chain fitted on its train part."""
    sp = split_frame(spark, sf).transform(stage)
    return sp, fe.fit_features(sp.where(F.col("part") == "train"), exclude=(ID_COL, TARGET_COL, "part"))


def features_frame(spark, sf):
    """Feature chain fitted on the train part, applied to all parts."""
    sp, fm = fitted_split(spark, sf)
    return fm.transform(sp, keep=[ID_COL, TARGET_COL, "part"]), fm


def _long(df, id_cols, feats):
    return df.select(*id_cols, F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in feats])))


ORACLE["d01_feature_drop"] = O.with_ctes(*CLEAN) + f"SELECT {', '.join(SELECTED)} FROM clean"


@query("d01_feature_drop")
def d01(spark, sf):
    return fe.FeatureSelector().transform(cleaned(spark, sf))


for _i, (_name, _sql) in enumerate(INTERACTION_SQL.items(), start=2):
    _key = f"d{_i:02d}_{_name}"
    ORACLE[_key] = O.with_ctes(*CLEAN) + f"SELECT {ID_COL}, {_sql} AS {_name} FROM clean"

    def _mk(name):
        def fn(spark, sf):
            return fe.InteractionFeatures([name]).transform(cleaned(spark, sf)).select(ID_COL, name)
        return fn

    QUERIES[_key] = _mk(_name)


def _one_hot_long_sql(src, fit_src):
    parts = []
    for c in ONE_HOT_COLS:
        parts.append(
            f"SELECT s.{ID_COL}, '{c}_' || o.v AS feature, CASE WHEN s.{c} = o.v THEN 1.0 ELSE 0.0 END::double AS value "
            f"FROM {src} s, (SELECT DISTINCT cast({c} AS varchar) AS v FROM {fit_src} WHERE {c} IS NOT NULL) o")
    return _union(parts)


ORACLE["d09_one_hot"] = O.with_ctes(*CLEAN) + _one_hot_long_sql("clean", "clean")


@query("d09_one_hot")
def d09(spark, sf):
    c = cleaned(spark, sf)
    enc = fe.Encoder(label_cols=[]).fit(c)
    return _long(enc.transform(c), [ID_COL], enc.one_hot_names())


def _label_sql(c, fit_src):
    return (f"coalesce((SELECT cast(idx AS integer) FROM (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS idx FROM "
            f"(SELECT DISTINCT cast({c} AS varchar) AS v FROM {fit_src} WHERE {c} IS NOT NULL)) m "
            f"WHERE m.v = cast(s.{c} AS varchar)), -1)")


ORACLE["d10_label_map"] = O.with_ctes(*CLEAN) + (
    f"SELECT {ID_COL}, " + ", ".join(f"{_label_sql(c, 'clean')} AS {c}" for c in LABEL_COLS)
    + " FROM clean s")


@query("d10_label_map")
def d10(spark, sf):
    c = cleaned(spark, sf)
    return fe.Encoder(one_hot_cols=[]).fit(c).transform(c).select(ID_COL, *LABEL_COLS)


def _scale_sql(c, fit_src, x=None):
    x = x or f"s.{c}"
    med = O.quantile_sql(fit_src, c, 0.5, "midpoint")
    q1, q3 = O.quantile_sql(fit_src, c, 0.25), O.quantile_sql(fit_src, c, 0.75)
    return (f"((cast({x} AS double) - {med}) / (CASE WHEN ({q3} - {q1}) = 0 OR ({q3} - {q1}) IS NULL "
            f"THEN cast(1 AS double) ELSE {q3} - {q1} END))")


ORACLE["d11_robust_scale"] = O.with_ctes(*CLEAN) + (
    f"SELECT {ID_COL}, " + ", ".join(f"{_scale_sql(c, 'clean')} AS {c}" for c in SCALE_COLS)
    + " FROM clean s")


@query("d11_robust_scale")
def d11(spark, sf):
    c = cleaned(spark, sf).transform(stage)
    return fe.RobustScaler().fit(c).transform(c).select(ID_COL, *SCALE_COLS)


ORACLE["d12_stratified_split"] = O.with_ctes(*CLEAN, *SPLIT) + f"SELECT {ID_COL}, part FROM sp"


@query("d12_stratified_split")
def d12(spark, sf):
    return split_frame(spark, sf).select(ID_COL, "part")


ORACLE["d13_split_summary"] = O.with_ctes(*CLEAN, *SPLIT) + (
    f"SELECT part, count(*) AS rows, avg(cast({TARGET_COL} AS double)) AS default_rate FROM sp GROUP BY part")


@query("d13_split_summary")
def d13(spark, sf):
    return (split_frame(spark, sf).groupBy("part")
            .agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col(TARGET_COL).cast("double")).alias("default_rate")))


ORACLE["d15_balance_summary"] = O.with_ctes(*CLEAN, *SPLIT) + f"""
SELECT cast({TARGET_COL} AS bigint) AS label, count(*) AS rows_before,
       CASE WHEN {TARGET_COL} = (SELECT {TARGET_COL} FROM sp WHERE part = 'train' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
            THEN count(*)
            ELSE cast(trunc(cast({SMOTE_RATIO!r} AS double) * cast((SELECT max(n) FROM (SELECT count(*) AS n FROM sp WHERE part = 'train' GROUP BY {TARGET_COL})) AS double)) AS bigint) END AS rows_after
FROM sp WHERE part = 'train' GROUP BY {TARGET_COL}"""


@query("d15_balance_summary")
def d15(spark, sf):
    from ..operators.neighbors import balance_summary
    return balance_summary(split_frame(spark, sf).where(F.col("part") == "train"), TARGET_COL, SMOTE_RATIO)


ALIGN_EXPECTED = ["age", "annual_income", "credit_score", "debt_x_loan", "loan_burden",
                  "region", "has_cosigner"]
ORACLE["d16_align"] = O.with_ctes(*CLEAN) + (
    f"SELECT {ID_COL}, " + ", ".join(
        (c if c in SELECTED else f"0 AS {c}") for c in ALIGN_EXPECTED)
    + f", '{','.join(c for c in ALIGN_EXPECTED if c not in SELECTED)}' AS zero_filled FROM clean")


@query("d16_align")
def d16(spark, sf):
    sel = fe.FeatureSelector().transform(cleaned(spark, sf))
    out, filled = fe.align_columns(sel, ALIGN_EXPECTED, keep=[ID_COL])
    return out.withColumn("zero_filled", F.lit(",".join(filled)))


def _feature_chain_sql(where: str = ""):
    fit = "(SELECT * FROM sp WHERE part = 'train')"
    parts = [f"SELECT {ID_COL}, part, '{c}' AS feature, cast({c} AS double) AS value FROM sp"
             for c in PLAIN_FEATURES]
    parts += [f"SELECT {ID_COL}, part, '{c}' AS feature, {_scale_sql(c, 'sp_train')} AS value FROM sp s"
              for c in SCALE_COLS]
    parts += [f"SELECT {ID_COL}, part, '{n}' AS feature, cast({e} AS double) AS value FROM sp"
              for n, e in INTERACTION_SQL.items()]
    parts += [f"SELECT {ID_COL}, part, '{c}' AS feature, cast({_label_sql(c, 'sp_train')} AS double) AS value FROM sp s"
              for c in LABEL_COLS]
    for c in ONE_HOT_COLS:
        parts.append(
            f"SELECT s.{ID_COL}, s.part, '{c}_' || o.v AS feature, CASE WHEN s.{c} = o.v THEN 1.0 ELSE 0.0 END::double AS value "
            f"FROM sp s, (SELECT DISTINCT cast({c} AS varchar) AS v FROM sp_train WHERE {c} IS NOT NULL) o")
    body = _union(parts)
    if where:
        body = f"SELECT * FROM ({body}) WHERE {where}"
    return O.with_ctes(*CLEAN, *SPLIT, f"sp_train AS {fit}") + body


ORACLE["d17_feature_chain"] = _feature_chain_sql()


@query("d17_feature_chain")
def d17(spark, sf):
    feats, fm = features_frame(spark, sf)
    return _long(feats, [ID_COL, "part"], fm.feature_cols)


# ======================================================================
# E: sampling, holdout, weights, folds, metrics (model-free parts)
# F: decision, tier, text, rounding, report
# A deterministic rule scorecard stands in for a model where SQL parity is
# checked; the model-based twins are registered further below.
# ======================================================================
from ..operators import metrics as me  # noqa: E402
from ..operators import scoring as scr  # noqa: E402
from ..schema import BENCH_SAMPLE_FRAC, CV_FOLDS, HOLDOUT_TEST_SIZE  # noqa: E402

SCORE_SQL = ("least(greatest(cast(0.05 AS double) * num_late_payments + cast(0.6 AS double) * debt_to_income "
             "+ cast(700 - credit_score AS double) / cast(1000.0 AS double) + cast(0.1 AS double), "
             "cast(0 AS double)), cast(1 AS double))")
TRAIN_SQL = ["tr AS (SELECT * EXCLUDE (part) FROM sp WHERE part = 'train')"]
SAMPLE = O.sample_sql("smp", "tr", ID_COL, BENCH_SAMPLE_FRAC, SEED, "sample")
HOLD = O.split_sql("ho", "smp", ID_COL, TARGET_COL, HOLDOUT_TEST_SIZE, None, SEED, "holdout")


def train_part(spark, sf):
    return split_frame(spark, sf).where(F.col("part") == "train").drop("part")


def bench_sample(spark, sf):
    tr = train_part(spark, sf).transform(stage)
    return rk.exact_sample(tr, ID_COL, BENCH_SAMPLE_FRAC, seed=SEED, salt="sample")


def holdout_frame(spark, sf):
    smp = bench_sample(spark, sf).transform(stage)
    return rk.stratified_split(smp, ID_COL, TARGET_COL, HOLDOUT_TEST_SIZE, None, seed=SEED, salt="holdout")


ORACLE["e01_row_sample"] = O.with_ctes(*CLEAN, *SPLIT, *TRAIN_SQL, *SAMPLE) + f"SELECT {ID_COL} FROM smp"


@query("e01_row_sample")
def e01(spark, sf):
    return bench_sample(spark, sf).select(ID_COL)


ORACLE["e02_holdout"] = O.with_ctes(*CLEAN, *SPLIT, *TRAIN_SQL, *SAMPLE, *HOLD) + f"SELECT {ID_COL}, part FROM ho"


@query("e02_holdout")
def e02(spark, sf):
    return holdout_frame(spark, sf).select(ID_COL, "part")


ORACLE["e03_class_weights"] = O.with_ctes(*CLEAN, *SPLIT, *TRAIN_SQL, *SAMPLE, *HOLD) + f"""
SELECT cast({TARGET_COL} AS bigint) AS label, count(*) AS count,
       cast(sum(count(*)) OVER () AS double) / (cast(2 AS double) * cast(count(*) AS double)) AS balanced_weight,
       CASE WHEN {TARGET_COL} = 1 THEN cast(6 AS double) ELSE cast(1 AS double) END AS fixed_weight
FROM ho WHERE part = 'train' GROUP BY {TARGET_COL}"""


@query("e03_class_weights")
def e03(spark, sf):
    from ..operators.models import class_weight_table
    return class_weight_table(holdout_frame(spark, sf).where(F.col("part") == "train"), TARGET_COL)


ORACLE["e19_fold_ids"] = O.with_ctes(*CLEAN, *SPLIT, *TRAIN_SQL, *O.fold_sql("fo", "tr", ID_COL, TARGET_COL, CV_FOLDS, SEED, "fold")) + (
    f"SELECT {ID_COL}, fold FROM fo")


@query("e19_fold_ids")
def e19(spark, sf):
    return rk.fold_ids(train_part(spark, sf), ID_COL, TARGET_COL, CV_FOLDS, seed=SEED, salt="fold").select(ID_COL, "fold")


THRESHOLDS = me.sweep_thresholds()


def _prf_sql(tp, fp, fn):
    f1 = f"coalesce(cast(2 * {tp} AS double) / cast(nullif(2 * {tp} + {fp} + {fn}, 0) AS double), cast(0 AS double))"
    pr = f"coalesce(cast({tp} AS double) / cast(nullif({tp} + {fp}, 0) AS double), cast(0 AS double))"
    rc = f"coalesce(cast({tp} AS double) / cast(nullif({tp} + {fn}, 0) AS double), cast(0 AS double))"
    return f1, pr, rc


def _sweep_ctes():
    vals = ", ".join(f"({i}, {O.dbl(t)})" for i, t in enumerate(THRESHOLDS))
    f1, pr, rc = _prf_sql("tp", "fp", "fn")
    return [
        f"th AS (SELECT * FROM (VALUES {vals}) t(i, t))",
        f"vs AS (SELECT {TARGET_COL} AS y, {SCORE_SQL} AS p FROM sp WHERE part = 'val')",
        "sw AS (SELECT i, t, count(*) FILTER (WHERE y = 1 AND p >= t) AS tp, count(*) FILTER (WHERE y = 0 AND p >= t) AS fp, "
        "count(*) FILTER (WHERE y = 1 AND p < t) AS fn FROM th, vs GROUP BY i, t)",
        f"sweep AS (SELECT i, {O.np_round_sql('t', 2)} AS threshold, {R4(f1)} AS f1, {R4(pr)} AS precision, "
        f"{R4(rc)} AS recall FROM sw)",
        "best AS (SELECT threshold FROM sweep ORDER BY f1 DESC, i LIMIT 1)",
    ]


SWEEP = _sweep_ctes()


def _val_test(spark, sf):
    sp = split_frame(spark, sf).withColumn("_score", scr.scorecard_probability()).transform(stage)
    thr = me.best_threshold(me.threshold_sweep(sp.where(F.col("part") == "val"), TARGET_COL, "_score"))
    return sp, thr


ORACLE["e23_threshold_sweep"] = O.with_ctes(*CLEAN, *SPLIT, *SWEEP) + (
    "SELECT threshold, f1, precision, recall, row_number() OVER (ORDER BY f1 DESC, i) = 1 AS is_best FROM sweep")


@query("e23_threshold_sweep")
def e23(spark, sf):
    sp = split_frame(spark, sf).withColumn("_score", scr.scorecard_probability())
    return me.threshold_sweep(sp.where(F.col("part") == "val"), TARGET_COL, "_score")


TEST_PRED = ["tp_rows AS (SELECT *, CASE WHEN " + SCORE_SQL + " >= (SELECT threshold FROM best) THEN 1 ELSE 0 END AS pred, "
             + SCORE_SQL + " AS p FROM sp WHERE part = 'test')"]


def _test_pred(spark, sf):
    sp, thr = _val_test(spark, sf)
    test = sp.where(F.col("part") == "test")
    return test.withColumn("pred", (F.col("_score") >= dbl(thr)).cast("int"))


_f1, _pr, _rc = _prf_sql("tp", "fp", "fn")
_CONF = ("(SELECT count(*) FILTER (WHERE is_default = 0 AND pred = 0) AS tn, count(*) FILTER (WHERE is_default = 0 AND pred = 1) AS fp, "
         "count(*) FILTER (WHERE is_default = 1 AND pred = 0) AS fn, count(*) FILTER (WHERE is_default = 1 AND pred = 1) AS tp FROM tp_rows) c")
ORACLE["e24_metrics"] = O.with_ctes(*CLEAN, *SPLIT, *SWEEP, *TEST_PRED) + (
    f"SELECT {R4(_f1)} AS f1, {R4(_pr)} AS precision, {R4(_rc)} AS recall, "
    f"{R4('coalesce(cast(tp + tn AS double) / cast(nullif(tp + tn + fp + fn, 0) AS double), 0)')} AS accuracy FROM {_CONF}")


@query("e24_metrics")
def e24(spark, sf):
    return me.classification_metrics(_test_pred(spark, sf), TARGET_COL, "pred")


ORACLE["e25_confusion"] = O.with_ctes(*CLEAN, *SPLIT, *SWEEP, *TEST_PRED) + f"SELECT * FROM {_CONF}"


@query("e25_confusion")
def e25(spark, sf):
    return me.confusion_counts(_test_pred(spark, sf), TARGET_COL, "pred")


ORACLE["e26_roc_auc"] = O.with_ctes(*CLEAN, *SPLIT, *SWEEP, *TEST_PRED) + """
SELECT sum(pos * (below + 0.5 * neg)) / (sum(pos) * sum(neg)) AS roc_auc FROM (
  SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT p, cast(count(*) FILTER (WHERE is_default = 1) AS double) AS pos,
               cast(count(*) FILTER (WHERE is_default = 0) AS double) AS neg FROM tp_rows GROUP BY p))"""


@query("e26_roc_auc")
def e26(spark, sf):
    sp = split_frame(spark, sf).withColumn("_score", scr.scorecard_probability())
    return me.roc_auc(sp.where(F.col("part") == "test"), TARGET_COL, "_score")


def _report_sql():
    f1_0, p_0, r_0 = _prf_sql("tn", "fn", "fp")
    s0, s1, tot = "(tn + fp)", "(tp + fn)", "(tn + fp + tp + fn)"
    acc = f"coalesce(cast(tp + tn AS double) / cast(nullif({tot}, 0) AS double), 0)"

    def w(a, b):
        return f"coalesce(cast(({a}) * {s0} + ({b}) * {s1} AS double) / cast(nullif({tot}, 0) AS double), 0)"
    rows = [
        f"SELECT 'No Default' AS class, {R4(p_0)} AS precision, {R4(r_0)} AS recall, {R4(f1_0)} AS f1, {s0} AS support FROM {_CONF}",
        f"SELECT 'Default', {R4(_pr)}, {R4(_rc)}, {R4(_f1)}, {s1} FROM {_CONF}",
        f"SELECT 'accuracy', NULL::double, NULL::double, {R4(acc)}, {tot} FROM {_CONF}",
        f"SELECT 'macro avg', {R4(f'({p_0} + {_pr}) / 2')}, {R4(f'({r_0} + {_rc}) / 2')}, {R4(f'({f1_0} + {_f1}) / 2')}, {tot} FROM {_CONF}",
        f"SELECT 'weighted avg', {R4(w(p_0, _pr))}, {R4(w(r_0, _rc))}, {R4(w(f1_0, _f1))}, {tot} FROM {_CONF}",
    ]
    return O.with_ctes(*CLEAN, *SPLIT, *SWEEP, *TEST_PRED) + _union(rows)


ORACLE["e27_class_report"] = _report_sql()


@query("e27_class_report")
def e27(spark, sf):
    return me.classification_report(_test_pred(spark, sf), TARGET_COL, "pred")


def _evaluation_sql():
    def part(section, name, value, key):
        return f"SELECT '{section}' AS section, {name} AS name, cast({value} AS double) AS value FROM ({ORACLE[key]})"
    rows = [part("sweep", "cast(threshold AS varchar)", "f1", "e23_threshold_sweep"), part("auc", "'roc_auc'", "roc_auc", "e26_roc_auc")]
    rows += [part("confusion", f"'{c}'", c, "e25_confusion") for c in ("tn", "fp", "fn", "tp")]
    rows += [part("metric", f"'{c}'", c, "e24_metrics") for c in ("f1", "precision", "recall", "accuracy")]
    return _union(rows + [part("report", "class", "f1", "e27_class_report")])


ORACLE["e23_score_state"] = _evaluation_sql()


@query("e23_score_state")
def e23s(spark, sf):
    """Sweep, metrics, cells, AUC and report from one scan: a state of the val and one of the test part."""
    sp = split_frame(spark, sf).withColumn("_score", scr.scorecard_probability())
    states = me.score_state(sp.where(F.col("part") != "train"), TARGET_COL, "_score", by="part")
    val, test = (states.where(F.col("part") == p).drop("part") for p in ("val", "test"))
    sweep = me.state_sweep(val)
    thr = me.best_threshold(sweep)

    def cells(section, df):
        return df.select(F.inline(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value"))
                                            for c in df.columns])))
    report = me.state_report(test, thr)
    return (sweep.select(F.lit("sweep").alias("section"), F.col("threshold").cast("string").alias("name"), F.col("f1").alias("value"))
            .unionByName(cells("metric", me.state_metrics(test, thr))).unionByName(cells("confusion", me.state_confusion(test, thr)))
            .unionByName(cells("auc", me.state_auc(test)))
            .unionByName(report.select(F.lit("report").alias("section"), F.col("class").alias("name"), F.col("f1").alias("value"))))


# ---- E18 / E22 on fixed rules in the place of models: what is ranked has an SQL twin
RULES = {"late_payments": "num_late_payments >= 2", "debt": "debt_to_income >= 0.4", "low_score": "credit_score < 600",
         "scorecard": f"({SCORE_SQL}) >= cast(0.5 AS double)", "strict_scorecard": f"({SCORE_SQL}) >= cast(0.7 AS double)"}


def _rules_sql():
    rows = [f"SELECT '{name}' AS model, {TARGET_COL} AS is_default, CASE WHEN {rule} THEN 1 ELSE 0 END AS pred FROM sp WHERE part = 'test'"
            for name, rule in RULES.items()]
    cells = ("count(*) FILTER (WHERE is_default = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE is_default = 1 AND pred = 0) AS fn, "
             "count(*) FILTER (WHERE is_default = 1 AND pred = 1) AS tp")
    return [f"ruled_rows AS ({_union(rows)})", f"cells AS (SELECT model, {cells} FROM ruled_rows GROUP BY model)",
            f"board AS (SELECT model, {R4(_f1)} AS f1, {R4(_pr)} AS precision, {R4(_rc)} AS recall FROM cells)"]


def _rules_board(spark, sf):
    """(model, f1, precision, recall) of every rule, from one scan of the test part."""
    test = split_frame(spark, sf).where(F.col("part") == "test").transform(stage)
    rows = [me.classification_metrics(test.withColumn("pred", F.expr(f"CAST(coalesce({rule}, false) AS int)")), TARGET_COL, "pred")
            .select(F.lit(name).alias("model"), "f1", "precision", "recall") for name, rule in RULES.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


ORACLE["e18_top3_rules"] = O.with_ctes(*CLEAN, *SPLIT, *_rules_sql()) + (
    "SELECT * FROM (SELECT *, row_number() OVER (ORDER BY f1 DESC, model)::INT AS rank FROM board) WHERE rank <= 3")


@query("e18_top3_rules")
def e18r(spark, sf):
    from ..operators.models import leaderboard
    return leaderboard(_rules_board(spark, sf), 3)


ORACLE["e22_best_rule"] = O.with_ctes(*CLEAN, *SPLIT, *_rules_sql()) + (
    "SELECT model AS family, f1, precision, recall, row_number() OVER (ORDER BY f1 DESC, model) = 1 AS is_best FROM board")


@query("e22_best_rule")
def e22r(spark, sf):
    from ..operators.search import best_of
    return best_of(_rules_board(spark, sf).withColumnRenamed("model", "family"))


# ---- F: scoring the whole cleaned table with the tuned cut-off
SCORED_SQL = [f"sc AS (SELECT {ID_COL}, {SCORE_SQL} AS p FROM clean)"]


def _scored(spark, sf):
    sp, thr = _val_test(spark, sf)
    return scr.score_frame(sp.select(ID_COL, "_score"), F.col("_score"), thr, stamp=False)


ORACLE["f03_decision"] = O.with_ctes(*CLEAN, *SPLIT, *SWEEP, *SCORED_SQL) + (
    f"SELECT {ID_COL}, CASE WHEN p >= (SELECT threshold FROM best) THEN 1 ELSE 0 END AS prediction FROM sc")


@query("f03_decision")
def f03(spark, sf):
    return _scored(spark, sf).select(ID_COL, "prediction")


ORACLE["f04_risk_tier"] = O.with_ctes(*CLEAN, *SCORED_SQL) + (
    f"SELECT {ID_COL}, CASE WHEN p >= cast(0.7 AS double) THEN 'High' WHEN p >= cast(0.4 AS double) THEN 'Medium' "
    f"ELSE 'Low' END AS risk_tier FROM sc")


@query("f04_risk_tier")
def f04(spark, sf):
    c = cleaned(spark, sf)
    return scr.score_frame(c.select(ID_COL, scr.scorecard_probability().alias("_s")), F.col("_s"), 0.5,
                           stamp=False).select(ID_COL, "risk_tier")


ORACLE["f05_outcome_text"] = O.with_ctes(*CLEAN, *SPLIT, *SWEEP, *SCORED_SQL) + (
    f"SELECT {ID_COL}, CASE WHEN p >= (SELECT threshold FROM best) THEN 'Default' ELSE 'No Default' END AS label FROM sc")


@query("f05_outcome_text")
def f05(spark, sf):
    return _scored(spark, sf).select(ID_COL, "label")


ORACLE["f06_rounded_prob"] = O.with_ctes(*CLEAN, *SCORED_SQL) + f"SELECT {ID_COL}, {R4('p')} AS default_prob FROM sc"


@query("f06_rounded_prob")
def f06(spark, sf):
    c = cleaned(spark, sf)
    return c.select(ID_COL, np_round_col(scr.scorecard_probability()).alias("default_prob"))


def np_round_col(c):
    return pr.np_round(c, 4)


ORACLE["f08_score_report"] = O.with_ctes(*CLEAN, *SPLIT, *SWEEP, *SCORED_SQL) + f"""
SELECT count(*) AS n, avg(CASE WHEN p >= (SELECT threshold FROM best) THEN 1.0 ELSE 0.0 END)::double AS default_rate,
       {R4(f"avg({R4('p')})")} AS avg_default_prob,
       count(*) FILTER (WHERE p >= cast(0.7 AS double)) AS n_high,
       count(*) FILTER (WHERE p >= cast(0.4 AS double) AND p < cast(0.7 AS double)) AS n_medium,
       count(*) FILTER (WHERE p < cast(0.4 AS double)) AS n_low
FROM sc"""


@query("f08_score_report")
def f08(spark, sf):
    return scr.score_report(_scored(spark, sf))


# ======================================================================
# D14 / E4-E22: oversampling and models (rows-only checks: no SQL twin)
# ======================================================================
from ..operators import models as mo  # noqa: E402
from ..operators import neighbors as nb  # noqa: E402
from ..operators import search as se  # noqa: E402
from ..schema import SMOTE_K  # noqa: E402


def feature_parts(spark, sf):
    """Feature table (fitted on the train part) with its part column."""
    feats, fm = features_frame(spark, sf)
    return feats.transform(stage), fm.feature_cols


def bench_data(spark, sf):
    """Comparison data: 20 % sample of the train part, 80/20 holdout. The chain is fitted
    on the whole train part; features are computed of the rows that are drawn."""
    sp, fm = fitted_split(spark, sf)
    tr = sp.where(F.col("part") == "train").drop("part")
    smp = rk.exact_sample(tr, ID_COL, BENCH_SAMPLE_FRAC, seed=SEED, salt="sample").transform(stage)
    ho = rk.stratified_split(smp, ID_COL, TARGET_COL, HOLDOUT_TEST_SIZE, None, seed=SEED, salt="holdout")
    feats = fm.transform(ho, keep=[ID_COL, TARGET_COL, "part"]).transform(stage)
    return (feats.where(F.col("part") == "train").drop("part"),
            feats.where(F.col("part") == "test").drop("part"), fm.feature_cols)


def int_feature_cols(cols):
    ints = {"age", "num_late_payments", "loan_term_months", "has_cosigner", "credit_score"}
    return [c for c in cols if c in ints or c in LABEL_COLS
            or any(c.startswith(f"{o}_") for o in ONE_HOT_COLS)]


def _with_features(body: str, *ctes: str) -> str:
    """SQL over ``fl``: the train part's features in long form."""
    chain = _feature_chain_sql("part = 'train'")
    at = chain.rindex("SELECT * FROM (SELECT")
    return O.with_ctes(*CLEAN, *SPLIT, "sp_train AS (SELECT * FROM sp WHERE part = 'train')",
                       f"fl AS ({chain[at:]})", *ctes) + body


def _unit_sql(salt: str) -> str:
    return f"(('0x' || substr(md5('{SEED}:{salt}:' || i), 1, 13))::BIGINT::DOUBLE / cast({16 ** 13} AS double))"


_WHOLE = ", ".join(f"'{c}'" for c in int_feature_cols(LABEL_COLS + ["age", "num_late_payments", "loan_term_months", "has_cosigner", "credit_score"]))
_IS_WHOLE = f"(feature IN ({_WHOLE}) OR " + " OR ".join(f"starts_with(feature, '{c}_')" for c in ONE_HOT_COLS) + ")"
ORACLE["d14_smote"] = _with_features(
    f"""SELECT fl.{ID_COL}, t.{TARGET_COL}, feature, value FROM fl JOIN sp_train t USING ({ID_COL})
UNION ALL
SELECT -(i + 1) AS {ID_COL}, q.label AS {TARGET_COL}, a.feature,
       CASE WHEN {_IS_WHOLE.replace("feature", "a.feature")} THEN trunc(a.value + gap * (b.value - a.value))
            ELSE a.value + gap * (b.value - a.value) END AS value
FROM draw CROSS JOIN quota q JOIN base ON base.at = least(floor(u * q.n_min)::BIGINT, q.n_min - 1)
JOIN near ON near.qid = base.id AND near.rank = least(floor(w * {SMOTE_K})::BIGINT, {SMOTE_K - 1}) + 1
JOIN fl a ON a.{ID_COL} = base.id JOIN fl b ON b.{ID_COL} = near.mid AND b.feature = a.feature""",
    f"""sizes AS (SELECT {TARGET_COL} AS label, count(*) AS n FROM sp_train GROUP BY 1)""",
    f"""quota AS (SELECT arg_min(label, n) AS label, min(n) AS n_min, trunc(cast({SMOTE_RATIO!r} AS double) * max(n) - min(n))::BIGINT AS n_new FROM sizes)""",
    f"""base AS (SELECT {ID_COL} AS id, row_number() OVER (ORDER BY md5({ID_COL} || ':{SEED}:smote'), {ID_COL}) - 1 AS at
             FROM sp_train WHERE {TARGET_COL} = (SELECT label FROM quota))""",
    f"""vec AS (SELECT {ID_COL} AS id, list(value ORDER BY feature) AS v FROM fl WHERE {ID_COL} IN (SELECT id FROM base) GROUP BY 1)""",
    f"""near AS (SELECT * FROM (SELECT a.id AS qid, b.id AS mid, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank
             FROM vec a JOIN vec b ON a.id <> b.id) WHERE rank <= {SMOTE_K})""",
    f"""draw AS (SELECT i, {_unit_sql('base')} AS u, {_unit_sql('nbr')} AS w, {_unit_sql('gap')} AS gap FROM (SELECT unnest(range(n_new)) AS i FROM quota))""")


@query("d14_smote")
def d14(spark, sf):
    feats, cols = feature_parts(spark, sf)
    train = feats.where(F.col("part") == "train").drop("part")
    out = nb.smote(train, ID_COL, TARGET_COL, cols, SMOTE_RATIO, SMOTE_K, SEED, int_cols=int_feature_cols(cols))
    return _long(out, [ID_COL, TARGET_COL], cols)


ORACLE["e07_knn_probability"] = _with_features(
    f"""SELECT qid AS {ID_COL}, avg(y)::double AS probability FROM (
  SELECT a.id AS qid, cast(b.y AS double) AS y, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank
  FROM vec a JOIN vec b ON a.part = 'test' AND b.part = 'train') WHERE rank <= 5 GROUP BY qid""",
    *TRAIN_SQL, *SAMPLE, *HOLD,
    f"""vec AS (SELECT fl.{ID_COL} AS id, any_value(ho.part) AS part, any_value(ho.{TARGET_COL}) AS y, list(value ORDER BY feature) AS v
            FROM fl JOIN ho ON ho.{ID_COL} = fl.{ID_COL} GROUP BY 1)""")


@query("e07_knn_probability")
def e07p(spark, sf):
    train, test, cols = bench_data(spark, sf)
    return nb.knn_vote(train, test, ID_COL, TARGET_COL, cols, 5)


def _one_model(names):
    def fn(spark, sf):
        train, test, cols = bench_data(spark, sf)
        specs = [s for s in mo.model_specs(cols, ID_COL) if s.name in names]
        return mo.evaluate_models(specs, train, test, TARGET_COL, cols)
    return fn


for _key, _names in {
    "e04_logistic_regression": ["LogisticRegression"],
    "e05_ridge_classifier": ["RidgeClassifier"],
    "e06_linear_svm": ["LinearSVM", "HingeSGD"],
    "e07_knn_vote": ["KNeighbors"],
    "e08_decision_tree": ["DecisionTree"],
    "e09_random_forest": ["RandomForest"],
    "e10_bagged_trees": ["BaggedTrees"],
    "e11_boosted_trees": ["GradientBoosting", "HistGradientBoosting", "BoostedTreesWeight6",
                          "BoostedTreesBalanced", "BoostedTrees1to6"],
    "e12_adaboost": ["AdaBoost"],
    "e13_gaussian_nb": ["GaussianNB"],
    "e14_linear_discriminant": ["LinearDiscriminant"],
    "e15_quadratic_discriminant": ["QuadraticDiscriminant"],
    "e16_mlp": ["MultilayerPerceptron"],
}.items():
    QUERIES[_key] = _one_model(_names)


@query("e17_guarded_fit")
def e17(spark, sf):
    train, test, cols = bench_data(spark, sf)
    specs = mo.model_specs(cols, ID_COL)
    return mo.leaderboard(mo.evaluate_models(specs, train, test, TARGET_COL, cols))


@query("e18_top3")
def e18(spark, sf):
    train, test, cols = bench_data(spark, sf)
    return mo.leaderboard(mo.evaluate_models(mo.model_specs(cols, ID_COL), train, test, TARGET_COL, cols), 3)


def tune_data(spark, sf):
    feats, cols = feature_parts(spark, sf)
    train = feats.where(F.col("part") == "train").drop("part")
    folded = rk.fold_ids(train, ID_COL, TARGET_COL, CV_FOLDS, seed=SEED, salt="fold").transform(stage)
    val = feats.where(F.col("part") == "val").drop("part")
    return folded, val, cols


# One setting inside the full search ranges to score by folds. The search itself
# (search.run_search: 30 trials a family, 5 folds), the refit of its winners and the
# best of them take hours here and aren't registered; README gives their seconds.
CV_PARAMS = {"maxIter": 100, "maxDepth": 3, "stepSize": 0.1}


def smote_balance(cols):
    return lambda d: nb.smote(d, ID_COL, TARGET_COL, cols, SMOTE_RATIO, SMOTE_K, SEED, int_cols=int_feature_cols(cols))


def fold_balance(folded, cols):
    """Oversampling of a fold's training part; the neighbours of all folds come from one search."""
    found = nb.fold_neighbours(folded, ID_COL, TARGET_COL, cols, CV_FOLDS, SMOTE_K)
    return lambda d, i: nb.smote(d, ID_COL, TARGET_COL, cols, SMOTE_RATIO, SMOTE_K, SEED, int_cols=int_feature_cols(cols),
                                 neighbours=found.where(F.col("mask") == i).drop("mask"))


@query("e19_cv_score")
def e19cv(spark, sf):
    folded, _, cols = tune_data(spark, sf)
    f1 = se.cv_f1("boosted", CV_PARAMS, folded, TARGET_COL, cols, k=CV_FOLDS, balance=fold_balance(folded, cols))
    return spark.createDataFrame([("boosted", CV_FOLDS, f1)], "family string, folds int, cv_f1 double")


def search_models(spark, sf, path, families=("boosted", "boosted_weighted", "mlp"), n_trials=30, lengths=5, budget=None,
                  parallelism=8, seconds=None):
    """E20-E22 on the driver tables: open or go on with the ledger under ``path``,
    oversampling inside each fold's training part. When nothing is pending, refit the
    winners on the balanced train part, validate them and return (report, models,
    feature columns); else None."""
    folded, val, cols = tune_data(spark, sf)
    ledger = se.Ledger(spark, path).open(se.draw_trials(list(families), len(cols), n_trials, lengths, SEED, budget))
    todo = {unit[0] for unit in ledger.pending(CV_FOLDS)}
    balance = fold_balance(folded, cols) if todo else None
    sets = {f: se.fold_sets(folded, TARGET_COL, cols, f, CV_FOLDS, balance=balance) for f in todo}
    if se.run_search(ledger, sets, CV_FOLDS, parallelism, seconds):
        return None
    train = smote_balance(cols)(folded.drop("fold")).transform(stage)
    return (*se.tuned_models(ledger, CV_FOLDS, train, val, TARGET_COL, cols), cols)


# ======================================================================
# A: sources and sinks;  F: model-based scoring, stream, description
# ======================================================================
from ..session import work_path  # noqa: E402
from ..sources import io as sio  # noqa: E402
from ..sources.runs import RunStore  # noqa: E402
from ..schema import application_schema  # noqa: E402
from . import pipelines as pl  # noqa: E402

ORACLE["a01_csv_scan"] = O.with_ctes() + "SELECT * FROM applications"


@query("a01_csv_scan")
def a01(spark, sf):
    path = work_path(spark, "applications-csv")
    sio.write_table(applications(spark, sf), path, fmt="csv")
    return sio.read_csv(spark, path, application_schema())


ORACLE["a02_table_sink"] = O.with_ctes(*CLEAN) + "SELECT * FROM clean"


@query("a02_table_sink")
def a02(spark, sf):
    path = work_path(spark, "clean")
    sio.write_table(cleaned(spark, sf), path)
    return spark.read.parquet(path)


ORACLE["a03_report_sink"] = ORACLE["c08_outcome_rate"]


@query("a03_report_sink")
def a03(spark, sf):
    path = work_path(spark, "outcome-report")
    sio.write_report(pr.outcome_rate_by_category(cleaned(spark, sf)), path)
    return spark.read.parquet(path)


def _state_sql():
    rows = [f"SELECT '{c}' AS column, 'median' AS kind, '' AS key, f_{c} AS num_value, NULL::varchar AS str_value FROM fill"
            for c in IMPUTE_NUMERIC_COLS]
    rows += [f"SELECT '{c}', 'mode', '', NULL::double, f_{c} FROM fill" for c in IMPUTE_CATEGORICAL_COLS]
    for c in ONE_HOT_COLS:
        rows.append(f"SELECT '{c}', 'category', v, cast(dense_rank() OVER (ORDER BY v) - 1 AS double), NULL::varchar "
                    f"FROM (SELECT DISTINCT cast({c} AS varchar) AS v FROM clean WHERE {c} IS NOT NULL)")
    for c in LABEL_COLS:
        rows.append(f"SELECT '{c}', 'label', v, cast(dense_rank() OVER (ORDER BY v) - 1 AS double), NULL::varchar "
                    f"FROM (SELECT DISTINCT cast({c} AS varchar) AS v FROM clean WHERE {c} IS NOT NULL)")
    for c in SCALE_COLS:
        med = O.quantile_sql("clean", c, 0.5, "midpoint")
        q1, q3 = O.quantile_sql("clean", c, 0.25), O.quantile_sql("clean", c, 0.75)
        rows.append(f"SELECT '{c}', 'center', '', {med}, NULL::varchar")
        rows.append(f"SELECT '{c}', 'scale', '', CASE WHEN ({q3} - {q1}) = 0 THEN cast(1 AS double) "
                    f"ELSE {q3} - {q1} END, NULL::varchar")
    return O.with_ctes(*CLEAN) + _union(rows)


ORACLE["a04_state_roundtrip"] = _state_sql()


@query("a04_state_roundtrip")
def a04(spark, sf):
    pre = ruled(spark, sf).transform(stage)
    imp = cl.MissingImputer().fit(pre)
    c = cl.TypeEnforcer().transform(imp.transform(pre)).transform(stage)
    enc = fe.Encoder().fit(c)
    scal = fe.RobustScaler().fit(c)
    path = work_path(spark, "state")
    sio.save_state(spark, imp.state_rows() + enc.state_rows() + scal.state_rows(), path)
    return sio.load_state(spark, path)


def boosted_candidate(params):
    """A boosted family's setting (of the search ranges, or a ledger's winner) as a candidate."""
    return lambda n: se.estimator("boosted", params), "balanced"


def train_run(spark, sf, candidates=None, oversample=False):
    """The whole path in the shared folder: clean, balance, fit and pick, tune the cut-off,
    evaluate, publish, serve. Returns the store and the data."""
    plan, data, table = pl.train_best(applications(spark, sf), candidates, oversample)
    store = RunStore(spark, work_path(spark, "run-store"))
    pl.publish_plan(store, plan, data, table, tags={"source": "lendscope"})
    return store, data


def _plan(spark, sf):
    """A plan that went through the store, as a scoring service loads it, and the
    deduplicated raw table."""
    store, data = train_run(spark, sf)
    return pl.served_plan(store), data.rows


@query("a05_model_roundtrip")
def a05(spark, sf):
    plan, data, table = pl.train_best(applications(spark, sf))
    store = RunStore(spark, work_path(spark, "run-store"))
    pl.publish_plan(store, plan, data, table)
    loaded = pl.served_plan(store)
    test = data.part("test")
    a = plan.model.transform(test).select(ID_COL, F.col("probability").alias("p1"))
    b = loaded.model.transform(test).select(ID_COL, F.col("probability").alias("p2"))
    return a.join(b, ID_COL).select(ID_COL, (F.col("p1") == F.col("p2")).alias("same_probability"))


@query("a06_run_record")
def a06(spark, sf):
    """The run's row: the winner of two candidates on the balanced train part."""
    store, _ = train_run(spark, sf, {**pl.DEFAULT_CANDIDATES, "GBTClassifier": boosted_candidate(CV_PARAMS)}, oversample=True)
    return store.runs()


ORACLE["f01_preprocess"] = _feature_chain_sql("part <> 'train'")


@query("f01_preprocess")
def f01(spark, sf):
    feats, fm = features_frame(spark, sf)
    return _long(feats.where(F.col("part") != "train"), [ID_COL, "part"], fm.feature_cols)


@query("f02_batch_probability")
def f02(spark, sf):
    # scoring input is the raw (deduplicated) table: the plan applies its own
    # fitted rules, imputation, coercion and features
    plan, rows = _plan(spark, sf)
    return plan.score(rows, keep=[ID_COL], stamp=False)


@query("f07_score_stamp")
def f07(spark, sf):
    plan, rows = _plan(spark, sf)
    return plan.score(rows, keep=[ID_COL], stamp=True).select(
        ID_COL, "scored_at")


def _stream(spark, plan, rows):
    """Outcomes of the request stream over the whole table ``rows``; some bodies lack inputs."""
    from ..streaming.scoring import read_outcomes, requests_from_table, run_stream
    src, sink, state = work_path(spark, "requests"), work_path(spark, "outcomes"), work_path(spark, "stream-ckpt")
    lacking = {"loan_amount": F.col(ID_COL) % 7 == 3, "annual_income": F.col(ID_COL) % 14 == 3}
    requests_from_table(rows, lacking).write.mode("overwrite").text(src)
    run_stream(spark, plan, src, sink, state)
    return read_outcomes(spark, sink)


@query("f09_stream_scoring")
def f09(spark, sf):
    from ..streaming.scoring import responses
    plan, rows = _plan(spark, sf)
    return responses(_stream(spark, plan, rows), plan.threshold)


_SENT = f"({ID_COL} % 7 <> 3)"
ORACLE["f09_stream_scorecard"] = O.with_ctes(*CLEAN[:1]) + f"""
SELECT {ID_COL} AS request_id, CASE WHEN {_SENT} THEN 0 END AS pos, CASE WHEN {_SENT} THEN 'scored' ELSE 'rejected' END AS status,
       CASE WHEN {ID_COL} % 14 = 3 THEN 'loan_amount,annual_income' WHEN NOT {_SENT} THEN 'loan_amount' END AS missing,
       CASE WHEN {_SENT} THEN {R4('p')} END AS default_prob, CASE WHEN {_SENT} THEN cast(p >= cast(0.5 AS double) AS integer) END AS prediction,
       CASE WHEN {_SENT} THEN CASE WHEN p >= cast(0.7 AS double) THEN 'High' WHEN p >= cast(0.4 AS double) THEN 'Medium' ELSE 'Low' END END AS risk_tier,
       CASE WHEN {_SENT} THEN CASE WHEN p >= cast(0.5 AS double) THEN 'Default' ELSE 'No Default' END END AS label
FROM (SELECT {ID_COL}, {SCORE_SQL} AS p FROM dedup)"""


@query("f09_stream_scorecard")
def f09s(spark, sf):
    return _stream(spark, scr.ScorecardPlan(0.5), applications_base_clean(spark, sf)).select(
        "request_id", "pos", "status", "missing", "default_prob", "prediction", "risk_tier", "label")


def applications_base_clean(spark, sf):
    return cl.DuplicateRemover().transform(applications(spark, sf))


@query("f10_model_description")
def f10(spark, sf):
    plan, _ = _plan(spark, sf)
    return plan.describe(spark)
