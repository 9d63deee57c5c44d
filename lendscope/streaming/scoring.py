"""Record scoring as a Structured Streaming query.

Requests are JSON lines ``{"data": {...}}`` where ``data`` is one applicant
object or a list of them; a ``request_id`` beside it is taken over, otherwise
a hash of the body stands for it. Every object must name all inputs (their
values may be null); a body that doesn't is rejected as a whole, with the
missing names.

The stream parses the lines with ``from_json`` against the applicant schema,
explodes lists and scores every record with the batch ``ScoringPlan``; a
rejected body is one row without a score. Both come from one read of the source
and are written by one ``foreachBatch`` to the folders
``batch=<id>/status=<scored|rejected>`` of a sink. The query is stateless (no
aggregation, no watermark) and a batch's folder is replaced as a whole, so a
batch that is run again adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import APPLICATION_COLUMNS, ID_COL, TARGET_COL, application_schema

REQUEST_FIELDS = [c for c in APPLICATION_COLUMNS if c not in (ID_COL, TARGET_COL)]


def record_schema() -> T.StructType:
    full = application_schema()
    return T.StructType([f for f in full.fields if f.name in REQUEST_FIELDS])


def requests_from_table(df: DataFrame, lacking: dict[str, Column] | None = None) -> DataFrame:
    """JSON request lines derived from applicant rows (even ids send one
    object, odd ids a one-element list), one ``value`` column. ``lacking`` says of
    an input in which rows the body leaves it out."""
    keep = {"ignoreNullFields": "false"}
    gone = F.lit("")
    for name, where in (lacking or {}).items():
        gone = F.concat(gone, F.when(where, F.lit(name + ",")).otherwise(F.lit("")))
    fields = F.map_from_arrays(F.array(*[F.lit(c) for c in REQUEST_FIELDS]),
                               F.array(*[F.to_json(F.struct(F.col(c).alias("v")), keep) for c in REQUEST_FIELDS]))
    sent = F.map_filter(fields, lambda k, _: ~F.array_contains(F.split(gone, ","), k))
    # {"v":1} of each input becomes "name":1
    named = F.transform(F.map_entries(sent), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), F.substr(e["value"], F.lit(6), F.length(e["value"]) - 6)))
    rec = F.concat(F.lit("{"), F.array_join(named, ","), F.lit("}"))
    data = F.when(F.col(ID_COL) % 2 == 0, rec).otherwise(F.concat(F.lit("["), rec, F.lit("]")))
    return df.select(F.concat(F.lit('{"request_id": '), F.col(ID_COL).cast("string"),
                              F.lit(', "data": '), data, F.lit("}")).alias("value"))


def parse_requests(lines: DataFrame) -> DataFrame:
    """From a ``value`` text column a row for each record (request_id, pos, status
    scored, its inputs) and one for each rejected body (status rejected, value,
    missing: names of absent inputs, empty if it doesn't parse). Works on a batch
    or a streaming frame."""
    env = T.StructType([T.StructField("request_id", T.LongType()),
                        T.StructField("data", T.StringType())])
    parsed = lines.select(F.col("value"), F.from_json("value", env).alias("e"))
    # malformed records land in a corrupt-record field instead of failing
    rs = T.StructType(record_schema().fields + [T.StructField("_corrupt", T.StringType())])
    opts = {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}
    one = F.from_json(F.col("e.data"), rs, opts)
    many = F.from_json(F.col("e.data"), T.ArrayType(rs), opts)
    is_list = F.trim(F.col("e.data")).startswith("[")
    recs = F.when(is_list, many).otherwise(F.array(one))
    # names of each object's fields, whatever their types
    named = F.when(is_list, F.from_json(F.col("e.data"), "array<map<string,string>>")).otherwise(
        F.array(F.from_json(F.col("e.data"), "map<string,string>")))
    needed = F.array(*[F.lit(c) for c in REQUEST_FIELDS])
    missing = F.array_distinct(F.flatten(F.transform(named, lambda m: F.array_except(needed, F.map_keys(m)))))
    staged = parsed.select("value", F.coalesce(F.col("e.request_id"), F.xxhash64("value")).alias("request_id"),
                           recs.alias("recs"), missing.alias("missing"))
    ok: Column = (F.col("recs").isNotNull() & (F.size(F.coalesce("missing", F.array(F.lit("")))) == 0)
                  & ~F.exists("recs", lambda r: r.isNull() | r["_corrupt"].isNotNull()))
    good = F.coalesce(ok, F.lit(False))
    rows = staged.select("request_id", F.when(good, "scored").otherwise("rejected").alias("status"),
                         F.when(~good, F.col("value")).alias("value"), F.when(~good, F.concat_ws(",", "missing")).alias("missing"),
                         F.posexplode_outer(F.when(good, F.col("recs"))).alias("pos", "r"))
    return rows.select("request_id", "pos", "status", "value", "missing", "r.*").drop("_corrupt")


def score_requests(plan, lines: DataFrame) -> DataFrame:
    """request_id, pos, status, value, missing, default_prob, prediction, risk_tier,
    label, scored_at; only records have a score, only rejected bodies value and missing."""
    keep = ["request_id", "pos", "status", "value", "missing"]
    # the feature chain needs an id column; the request id plays that role
    recs = parse_requests(lines).withColumn(ID_COL, F.col("request_id")).withColumn(TARGET_COL, F.lit(None).cast("bigint"))
    scored = plan.score(recs, keep=keep, stamp=True)
    given = F.col("status") == "scored"
    return scored.select(*keep, *[F.when(given, F.col(c)).alias(c) for c in scored.columns if c not in keep])


def responses(outcomes: DataFrame, threshold: float) -> DataFrame:
    """A row for each request, as a caller gets it: request_id, results (prediction,
    default_prob, risk_tier, label in the order sent), count, threshold, error. A
    group is one request's body."""
    fields = ("pos", "prediction", "default_prob", "risk_tier", "label")
    result = F.when(F.col("status") == "scored", F.struct(*fields))
    by = outcomes.groupBy("request_id").agg(F.array_sort(F.collect_list(result)).alias("results"), F.first("status").alias("status"),
                                            F.first("missing").alias("missing"))
    error = F.when(F.col("missing") != "", F.concat(F.lit("missing inputs: "), F.col("missing"))).otherwise(F.lit("body does not parse"))
    return by.select("request_id", F.transform("results", lambda r: r.dropFields("pos")).alias("results"), F.size("results").alias("count"),
                     F.lit(float(threshold)).alias("threshold"), F.when(F.col("status") == "rejected", error).alias("error"))


def write_batch(plan, sink_dir: str):
    """The function of ``foreachBatch``: one pass over the batch, one folder."""
    def run(lines: DataFrame, batch_id: int) -> None:
        score_requests(plan, lines).write.mode("overwrite").partitionBy("status").parquet(f"{sink_dir}/batch={batch_id}")
    return run


def run_stream(spark: SparkSession, plan, source_dir: str, sink_dir: str, checkpoint_dir: str) -> None:
    """Score every request file in ``source_dir`` (available-now trigger:
    process what is there, then stop). ``read_outcomes`` reads the sink."""
    lines = spark.readStream.format("text").load(source_dir)
    (lines.writeStream.foreachBatch(write_batch(plan, sink_dir)).option("checkpointLocation", checkpoint_dir)
     .trigger(availableNow=True).start().awaitTermination())


def read_outcomes(spark: SparkSession, sink_dir: str) -> DataFrame:
    return spark.read.parquet(sink_dir)
