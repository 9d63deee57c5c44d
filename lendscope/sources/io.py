"""CSV scan with explicit schema and NA tokens, table/report sinks, fitted
state tables, model store and the run record table.

All writes go to folders under the shared checkpoint folder (or a path the
caller gives): no machine-local temporary folder is used on a cluster.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The NA tokens a default CSV reader treats as missing.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]


# ---------------------------------------------------------------- A1
# Quotes are doubled inside quoted text, on both sides; blanks are data.
CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False,
               "ignoreTrailingWhiteSpace": False}


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             na_tokens: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """Header CSV read as text by column name, NA tokens -> NULL, then typed
    with ``try_cast`` (unparseable -> NULL). Columns may come in any order;
    those the file lacks are NULL, those the schema lacks are not read.
    ``multi_line`` allows newlines inside quotes (then a file is one split).
    The file's first line is read once for the names; no types are inferred."""
    tokens = NA_TOKENS if na_tokens is None else na_tokens
    reader = spark.read.options(**CSV_OPTIONS, multiLine=multi_line, enforceSchema=False)
    names = reader.csv(path).columns
    text = T.StructType([T.StructField(n, T.StringType(), True) for n in names])
    raw = reader.schema(text).csv(path)
    cols = []
    for f in schema.fields:
        if f.name not in names:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        held = F.col(f"`{f.name}`")
        c = F.when(held.isin(tokens), F.lit(None)).otherwise(held)
        cols.append((c if isinstance(f.dataType, T.StringType) else c.try_cast(f.dataType)).alias(f.name))
    return raw.select(*cols)


# ---------------------------------------------------------------- A2 / A3
def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    w = df.write.mode(mode)
    if fmt == "csv":
        w = w.options(**CSV_OPTIONS)
    w.format(fmt).save(path)
    return path


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Reports are small: one output file keeps them readable as one table."""
    return write_table(df.coalesce(1), path, fmt)


# ---------------------------------------------------------------- A4
STATE_SCHEMA = "column string, kind string, key string, num_value double, str_value string"


def state_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Fitted state rows (column, kind, key, value) -> typed state table;
    numeric values go to ``num_value``, text values to ``str_value``."""
    out = []
    for col, kind, key, value in rows:
        if isinstance(value, (int, float)) and not isinstance(value, bool):
            out.append((col, kind, key, float(value), None))
        else:
            out.append((col, kind, key, None, None if value is None else str(value)))
    return spark.createDataFrame(out, STATE_SCHEMA)


def save_state(spark: SparkSession, rows: list[tuple], path: str) -> str:
    return write_report(state_frame(spark, rows), path)


def load_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STATE_SCHEMA).parquet(path)


# ---------------------------------------------------------------- A5
def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


# ---------------------------------------------------------------- A6
RUNS_SCHEMA = "run_id string, kind string, key string, value string, ts timestamp"


def run_rows(run_id: str, params: dict, metrics: dict, tags: dict | None = None, artifacts: dict | None = None) -> list[tuple]:
    """One run (params, metrics, tags, artifact paths) in long format."""
    ts = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    rows = [(run_id, "param", k, str(v), ts) for k, v in params.items()]
    rows += [(run_id, "metric", k, repr(float(v)), ts) for k, v in metrics.items()]
    rows += [(run_id, "tag", k, str(v), ts) for k, v in (tags or {}).items()]
    return rows + [(run_id, "artifact", k, str(v), ts) for k, v in (artifacts or {}).items()]


def wide_runs(runs: DataFrame) -> DataFrame:
    """One row per run: metrics as doubles, params, tags and artifacts as text columns."""
    wide = (runs.withColumn("name", F.concat_ws(".", "kind", "key"))
            .groupBy("run_id").pivot("name").agg(F.first("value")))
    return wide.select(*[F.col(f"`{c}`").cast("double").alias(c) if c.startswith("metric.") else F.col(f"`{c}`")
                         for c in wide.columns])
