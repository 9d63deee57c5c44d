"""SQL text for the DuckDB oracle.

Every oracle query starts from the same applicant view, written as plain
SQL over the driver tables (FIXTURES.md section 3), followed by the same
cleaning steps the Spark operators run. The helpers here only assemble SQL
strings; they are used by ``__spark_entry__.oracle_sql`` and the tests.
"""

from __future__ import annotations

from ..schema import (
    APPLICATION_COLUMNS, FLOAT_COLS, IMPUTE_CATEGORICAL_COLS, IMPUTE_NUMERIC_COLS,
    INT_COLS, STR_COLS,
)

D = "cast({} as double)"


def dbl(x) -> str:
    """Exact double literal (parsed from its shortest repr string)."""
    return f"cast('{float(x)!r}' AS double)"


APPLICATIONS_CTE = f"""
l_agg AS (
  SELECT l_orderkey,
         count(*) AS lines,
         cast(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS bigint) AS returned,
         cast(sum(cast(l_extendedprice * l_discount AS decimal(18,4))) AS double) AS disc,
         cast(sum(cast(l_extendedprice * l_tax AS decimal(18,4))) AS double) AS tax
  FROM lineitem GROUP BY l_orderkey
),
app_l0 AS (
  SELECT * FROM orders
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN l_agg ON o_orderkey = l_orderkey
),
app_l1 AS (
  SELECT o_orderkey AS application_id,
         cast(15 + (o_custkey * 31 + o_orderkey) % 60 AS bigint) AS age,
         o_orderpriority AS education_level,
         o_orderstatus AS marital_status,
         cast(o_orderkey % 6 AS bigint) AS num_dependents,
         r_name AS region,
         c_mktsegment AS employment_type,
         cast(o_custkey % 401 AS double) / cast(10 AS double) AS employment_years,
         cast((o_custkey % 401) * 6 AS bigint) AS months_employed,
         c_acctbal AS monthly_income,
         disc AS savings_balance,
         tax AS investment_balance,
         cast(300 + (o_orderkey * 37) % 600 AS bigint) AS raw_score,
         cast(lines AS bigint) AS num_credit_lines,
         cast(coalesce(returned, 0) AS bigint) AS num_late_payments,
         cast((o_orderkey * 17) % 1000 AS double) / cast(1000 AS double) AS credit_util_rate,
         concat('P', cast(o_orderkey % 7 AS varchar)) AS loan_purpose,
         o_totalprice AS loan_amount,
         cast(CASE o_orderkey % 7 WHEN 0 THEN 12 WHEN 1 THEN 24 WHEN 2 THEN 36 WHEN 3 THEN 48
              WHEN 4 THEN 60 WHEN 5 THEN 84 ELSE 120 END AS bigint) AS loan_term_months,
         cast(1.5 AS double) + cast((o_custkey * 13) % 265 AS double) / cast(10 AS double) AS interest_rate,
         concat('T', cast(o_custkey % 4 AS varchar)) AS property_type,
         cast(CASE WHEN o_custkey % 5 = 0 THEN 1 ELSE 0 END AS bigint) AS has_cosigner,
         cast(o_custkey % 8 AS bigint) AS num_prev_loans
  FROM app_l0
),
app_l2 AS (
  SELECT *, loan_amount * (cast(1 AS double) + interest_rate / cast(100 AS double))
            / cast(loan_term_months AS double) AS monthly_payment
  FROM app_l1
),
app_l3 AS (
  SELECT *,
    least(greatest(monthly_payment / greatest(monthly_income, cast(1 AS double)), cast(0 AS double)), cast(1 AS double)) AS raw_dti,
    least(greatest(loan_amount / greatest(monthly_income * cast(12 AS double), cast(1 AS double)), cast(0 AS double)), cast(10 AS double)) AS loan_to_income
  FROM app_l2
),
app_l4 AS (
  SELECT *,
    cast(CASE WHEN cast(0.9 AS double) * num_late_payments + cast(2 AS double) * raw_dti
                   - cast(0.004 AS double) * (raw_score - 575)
                   + cast((application_id * 7919) % 1000 AS double) / cast(500 AS double) > cast(5 AS double)
              THEN 1 ELSE 0 END AS bigint) AS is_default,
    CASE WHEN (application_id * 11 + 3) % 100 < 3 THEN NULL ELSE monthly_income * cast(12 AS double) END AS annual_income,
    CASE WHEN (application_id * 13 + 5) % 100 < 3 THEN NULL ELSE raw_score END AS credit_score,
    CASE WHEN (application_id * 17 + 7) % 100 < 3 THEN NULL ELSE raw_dti END AS debt_to_income
  FROM app_l3
),
applications AS (
  SELECT {", ".join(APPLICATION_COLUMNS)} FROM app_l4
  UNION ALL
  SELECT {", ".join(APPLICATION_COLUMNS)} FROM app_l4 WHERE application_id % 200 = 0
)"""


def with_ctes(*ctes: str) -> str:
    """``WITH`` clause: the applicant view followed by extra CTEs."""
    parts = [APPLICATIONS_CTE.strip()] + [c.strip() for c in ctes if c]
    return "WITH " + ",\n".join(parts) + "\n"


# --------------------------------------------------------------------------
# Exact quantiles in SQL, with the same interpolation formulas as Spark side.
# --------------------------------------------------------------------------

def lerp_sql(x0: str, x1: str, t: str) -> str:
    """numpy's linear interpolation (two-sided form)."""
    return (f"(CASE WHEN {t} >= 0.5 THEN {x1} - ({x1} - {x0}) * (1.0 - {t}) "
            f"ELSE {x0} + ({x1} - {x0}) * {t} END)")


def quantile_sql(table: str, col: str, p: float, mode: str = "linear") -> str:
    """Scalar subquery: exact quantile of ``col`` (nulls skipped).

    ``linear`` -> numpy linear interpolation; ``midpoint`` -> (a+b)/2 for the
    median of an even count (pandas ``median``).
    """
    pos = f"(cast({p!r} as double) * cast(n - 1 AS double))"
    if mode == "midpoint":
        expr = ("CASE WHEN count(*) = 1 THEN min(v) "
                "ELSE (min(v) + max(v)) / cast(2 AS double) END")
    else:
        expr = lerp_sql("min(v)", "max(v)", f"(any_value({pos}) - floor(any_value({pos})))")
    return (
        f"(SELECT {expr} FROM (SELECT cast({col} AS double) AS v, "
        f"row_number() OVER (ORDER BY {col}) - 1 AS r, count(*) OVER () AS n "
        f"FROM {table} WHERE {col} IS NOT NULL) q "
        f"WHERE r = floor({pos}) OR r = ceil({pos}))"
    )


def mode_sql(table: str, col: str) -> str:
    """Most frequent non-null value, ties to the smallest value."""
    return (f"(SELECT {col} FROM {table} WHERE {col} IS NOT NULL GROUP BY {col} "
            f"ORDER BY count(*) DESC, {col} ASC LIMIT 1)")


# --------------------------------------------------------------------------
# Cleaning chain as CTEs (dedup -> rules -> impute -> coerce).
# --------------------------------------------------------------------------

RULES_SQL = {
    "annual_income": "annual_income < 0",
    "credit_score": "credit_score < 300 OR credit_score > 850",
    "age": "age < 18",
}


def cleaning_ctes() -> list[str]:
    dedup = "dedup AS (SELECT DISTINCT * FROM applications)"
    cols = []
    for c in APPLICATION_COLUMNS:
        if c in RULES_SQL:
            cols.append(f"CASE WHEN {RULES_SQL[c]} THEN NULL ELSE {c} END AS {c}")
        else:
            cols.append(c)
    ruled = f"ruled AS (SELECT {', '.join(cols)} FROM dedup)"
    fills = []
    for c in IMPUTE_NUMERIC_COLS:
        fills.append(f"{quantile_sql('ruled', c, 0.5, 'midpoint')} AS f_{c}")
    for c in IMPUTE_CATEGORICAL_COLS:
        fills.append(f"{mode_sql('ruled', c)} AS f_{c}")
    fit = f"fill AS (SELECT {', '.join(fills)})"
    imp_cols = []
    for c in APPLICATION_COLUMNS:
        if c in IMPUTE_NUMERIC_COLS:
            imp_cols.append(f"coalesce(cast({c} AS double), f_{c}) AS {c}")
        elif c in IMPUTE_CATEGORICAL_COLS:
            imp_cols.append(f"coalesce({c}, f_{c}) AS {c}")
        else:
            imp_cols.append(c)
    imputed = f"imputed AS (SELECT {', '.join(imp_cols)} FROM ruled, fill)"
    co = []
    for c in APPLICATION_COLUMNS:
        if c in INT_COLS:
            co.append(f"cast(trunc(coalesce(try_cast({c} AS double), 0)) AS bigint) AS {c}")
        elif c in FLOAT_COLS:
            co.append(f"try_cast({c} AS double) AS {c}")
        elif c in STR_COLS:
            co.append(f"cast({c} AS varchar) AS {c}")
        else:
            co.append(c)
    clean = f"clean AS (SELECT {', '.join(co)} FROM imputed)"
    return [dedup, ruled, fit, imputed, clean]


# --------------------------------------------------------------------------
# Rounding and histogram bins, same arithmetic as the Spark expressions.
# --------------------------------------------------------------------------

def np_round_sql(x: str, digits: int = 4) -> str:
    p = f"cast({10.0 ** digits!r} AS double)"
    return f"(round_even(({x}) * {p}, 0) / {p})"


def _adj(lo: str, hi: str):
    lo_ = f"(CASE WHEN {hi} = {lo} THEN {lo} - cast(0.5 AS double) ELSE {lo} END)"
    hi_ = f"(CASE WHEN {hi} = {lo} THEN {hi} + cast(0.5 AS double) ELSE {hi} END)"
    return lo_, hi_


def edge_sql(i: str, lo: str, hi: str, bins: int) -> str:
    lo_, hi_ = _adj(lo, hi)
    step = f"(({hi_} - {lo_}) / cast({bins} AS double))"
    return f"(CASE WHEN {i} >= {bins} THEN {hi_} ELSE cast({i} AS double) * {step} + {lo_} END)"


def hist_bin_sql(x: str, lo: str, hi: str, bins: int) -> str:
    lo_, hi_ = _adj(lo, hi)
    raw = f"cast(trunc(({x} - {lo_}) * (cast({bins} AS double) / ({hi_} - {lo_}))) AS integer)"
    raw = f"(CASE WHEN {raw} >= {bins} THEN {bins - 1} ELSE {raw} END)"
    fixed = f"(CASE WHEN {x} < {edge_sql(raw, lo, hi, bins)} THEN {raw} - 1 ELSE {raw} END)"
    return (f"(CASE WHEN {x} >= {edge_sql(f'({fixed} + 1)', lo, hi, bins)} AND {fixed} <> {bins - 1} "
            f"THEN {fixed} + 1 ELSE {fixed} END)")


def histogram_sql(table: str, cols: list[str], bins: int, by: str | None = None) -> str:
    g = f"cast({by} AS bigint)" if by else "cast(0 AS bigint)"
    gfilter = f" AND {by} IS NOT NULL" if by else ""
    vals = "\nUNION ALL\n".join(
        f"SELECT '{c}' AS column, {g} AS grp, cast({c} AS double) AS x FROM {table} "
        f"WHERE {c} IS NOT NULL{gfilter}" for c in cols)
    body = f"""
hv AS ({vals}),
hr AS (SELECT "column", grp, min(x) AS lo, max(x) AS hi FROM hv GROUP BY "column", grp),
hb AS (SELECT hv.column, hv.grp, {hist_bin_sql('hv.x', 'hr.lo', 'hr.hi', bins)} AS bin, count(*) AS cnt
       FROM hv JOIN hr ON hv.column = hr.column AND hv.grp = hr.grp GROUP BY ALL),
hf AS (SELECT hr.*, s.bin FROM hr, range(0, {bins}) s(bin))
SELECT hf.column, {'hf.grp AS ' + by + ',' if by else ''} cast(hf.bin AS integer) AS bin,
       {edge_sql('hf.bin', 'hf.lo', 'hf.hi', bins)} AS bin_lo,
       {edge_sql('(hf.bin + 1)', 'hf.lo', 'hf.hi', bins)} AS bin_hi,
       cast(coalesce(hb.cnt, 0) AS bigint) AS count
FROM hf LEFT JOIN hb ON hf.column = hb.column AND hf.grp = hb.grp AND hf.bin = hb.bin"""
    return body


# --------------------------------------------------------------------------
# Exact stratified split in SQL (same allocation rules and hash order).
# --------------------------------------------------------------------------

def _approx_mode_sql(name: str, counts: str, n_draws: str) -> str:
    """CTE ``name(lab, a)``: largest-remainder allocation of ``n_draws``
    over ``counts(lab, n)``, ties to the lower label."""
    return f"""{name} AS (
  SELECT lab, cast(fl AS bigint) + CASE WHEN row_number() OVER (ORDER BY cont - fl DESC, lab) <= need THEN 1 ELSE 0 END AS a
  FROM (SELECT lab, cont, fl, ({n_draws}) - sum(fl) OVER () AS need
        FROM (SELECT lab, cont, floor(cont) AS fl
              FROM (SELECT lab, cast(n AS double) / cast(sum(n) OVER () AS double) * cast(({n_draws}) AS double) AS cont
                    FROM {counts}) x) y) z)"""


def _sizes_sql(p: str, counts: str, frac: float) -> list[str]:
    """CTEs ``{p}_test(lab, a)``: per-class test counts of one split."""
    return [
        f"{p}_n AS (SELECT cast(ceil({dbl(frac)} * cast(sum(n) AS double)) AS bigint) AS n_test, "
        f"sum(n) AS n_all FROM {counts})",
        _approx_mode_sql(f"{p}_train", counts, f"SELECT n_all - n_test FROM {p}_n"),
        f"{p}_rest AS (SELECT c.lab, c.n - t.a AS n FROM {counts} c JOIN {p}_train t ON c.lab = t.lab)",
        _approx_mode_sql(f"{p}_test", f"{p}_rest", f"SELECT n_test FROM {p}_n"),
    ]


def split_sql(name: str, src: str, id_col: str, label: str | None, test_size: float,
              val_size: float | None, seed: int, salt: str, out_col: str = "part") -> list[str]:
    """CTEs ending in ``name``: ``src`` plus a part column."""
    lab = label if label else "0"
    key = f"md5(concat_ws(':', cast({id_col} AS varchar), '{seed}', '{salt}'))"
    ctes = [f"{name}_cc AS (SELECT {lab} AS lab, count(*) AS n FROM {src} GROUP BY 1)"]
    ctes += _sizes_sql(f"{name}_s1", f"{name}_cc", test_size)
    if val_size is not None:
        ctes.append(f"{name}_r2 AS (SELECT c.lab, c.n - t.a AS n FROM {name}_cc c JOIN {name}_s1_test t ON c.lab = t.lab)")
        ctes += _sizes_sql(f"{name}_s2", f"{name}_r2", val_size / (1 - test_size))
        cut = (f"{name}_cut AS (SELECT a.lab, a.a AS c1, a.a + b.a AS c2 FROM {name}_s1_test a "
               f"JOIN {name}_s2_test b ON a.lab = b.lab)")
        case = f"CASE WHEN r < c1 THEN 'test' WHEN r < c2 THEN 'val' ELSE 'train' END"
    else:
        cut = f"{name}_cut AS (SELECT lab, a AS c1 FROM {name}_s1_test)"
        case = "CASE WHEN r < c1 THEN 'test' ELSE 'train' END"
    ctes.append(cut)
    ctes.append(
        f"{name}_rk AS (SELECT s.*, {lab} AS _lab, row_number() OVER (PARTITION BY {lab} ORDER BY {key}, {id_col}) - 1 AS r FROM {src} s)")
    ctes.append(
        f"{name} AS (SELECT {name}_rk.* EXCLUDE (_lab, r), "
        f"{case} AS {out_col} FROM {name}_rk JOIN {name}_cut ON {name}_rk._lab = {name}_cut.lab)")
    return ctes


def sample_sql(name: str, src: str, id_col: str, frac: float, seed: int, salt: str) -> list[str]:
    key = f"md5(concat_ws(':', cast({id_col} AS varchar), '{seed}', '{salt}'))"
    return [f"{name} AS (SELECT * EXCLUDE (r) FROM (SELECT s.*, row_number() OVER (ORDER BY {key}, {id_col}) - 1 AS r "
            f"FROM {src} s) WHERE r < (SELECT round_even({dbl(frac)} * cast(count(*) AS double), 0) FROM {src}))"]


def fold_sql(name: str, src: str, id_col: str, label: str, k: int, seed: int, salt: str) -> list[str]:
    key = f"md5(concat_ws(':', cast({id_col} AS varchar), '{seed}', '{salt}'))"
    return [
        f"{name}_off AS (SELECT lab, coalesce(sum(n) OVER (ORDER BY lab ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off "
        f"FROM (SELECT {label} AS lab, count(*) AS n FROM {src} GROUP BY 1))",
        f"{name} AS (SELECT s.* EXCLUDE (r, _lab), cast((o.off + r) % {k} AS integer) AS fold FROM "
        f"(SELECT t.*, {label} AS _lab, row_number() OVER (PARTITION BY {label} ORDER BY {key}, {id_col}) - 1 AS r FROM {src} t) s "
        f"JOIN {name}_off o ON s._lab = o.lab)",
    ]
