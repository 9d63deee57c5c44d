import json

import pandas as pd
from pyspark.sql import functions as F

from conftest import SF_SMALL
from lendscope.operators import cleaning as cl
from lendscope.plans import pipelines as pl
from lendscope.session import stage, work_path
from lendscope.sources.tables import applications
from lendscope.streaming.scoring import (
    REQUEST_FIELDS, read_outcomes, requests_from_table, responses, run_stream, score_requests, write_batch,
)


def test_stream_equals_batch_twin_and_a_replay_adds_nothing(spark):
    apps = applications(spark, SF_SMALL)
    plan, _ = pl.train_plan(apps)
    src = work_path(spark, "req")
    reqs = requests_from_table(cl.DuplicateRemover().transform(apps), {"loan_amount": F.col("application_id") % 5 == 2})
    bad = spark.createDataFrame([("not json",), ('{"request_id": 1, "data": "x"}',)], "value string")
    reqs.unionByName(bad).write.text(src)
    sink, ck = work_path(spark, "out"), work_path(spark, "ck")
    run_stream(spark, plan, src, sink, ck)
    key = ["status", "request_id", "pos"]

    def rows(df):
        return df.drop("scored_at", "batch").toPandas().sort_values(key).reset_index(drop=True)
    streamed, batch = rows(read_outcomes(spark, sink)), rows(score_requests(plan, spark.read.text(src)))
    pd.testing.assert_frame_equal(streamed[batch.columns], batch)
    rejected = streamed[streamed.status == "rejected"]
    lacking = cl.DuplicateRemover().transform(apps).where("application_id % 5 = 2").count()
    assert len(rejected) == 2 + lacking and (rejected.missing == "loan_amount").sum() == lacking
    assert streamed[streamed.status == "scored"].default_prob.between(0, 1).all() and rejected.default_prob.isna().all()

    write_batch(plan, sink)(spark.read.text(src), 0)  # the same batch once more
    again = rows(read_outcomes(spark, sink))
    pd.testing.assert_frame_equal(again[streamed.columns], streamed)
    run_stream(spark, plan, src, sink, ck)  # nothing new: nothing added
    assert read_outcomes(spark, sink).count() == len(streamed)
    bad.limit(1).write.mode("append").text(src)
    run_stream(spark, plan, src, sink, ck)
    assert read_outcomes(spark, sink).count() == len(streamed) + 1


def test_bodies_without_id_and_with_missing_inputs(spark):
    apps = applications(spark, SF_SMALL)
    plan, _ = pl.train_plan(apps)
    whole = json.loads(requests_from_table(apps).first()["value"])["data"]
    whole = whole[0] if isinstance(whole, list) else whole
    assert set(whole) == set(REQUEST_FIELDS)
    part = {k: v for k, v in whole.items() if k not in ("loan_amount", "annual_income")}
    bodies = [{"data": whole}, {"data": [whole, whole]}, {"data": part}, {"data": [whole, part]}, {"data": {}}, {"other": 1}]
    lines = spark.createDataFrame([(json.dumps(b),) for b in bodies], "value string")
    out = score_requests(plan, lines).transform(stage)
    got = out.where("status = 'scored'").groupBy("request_id").count().collect()
    assert sorted(r["count"] for r in got) == [1, 2]
    missing = {r["value"]: r["missing"] for r in out.where("status = 'rejected'").collect()}
    assert len(missing) == 4
    assert set(missing[json.dumps(bodies[2])].split(",")) == {"loan_amount", "annual_income"} == set(missing[json.dumps(bodies[3])].split(","))
    assert set(missing[json.dumps(bodies[4])].split(",")) == set(REQUEST_FIELDS)
    answers = responses(out, plan.threshold).collect()
    assert sorted((r["count"], r["error"] is None) for r in answers) == [(0, False)] * 4 + [(1, True), (2, True)]
    assert all(r["threshold"] == plan.threshold and all(set(x.asDict()) == {"prediction", "default_prob", "risk_tier", "label"} for x in r["results"])
               for r in answers)


def test_plan_from_disk_scores_alike(spark):
    apps = applications(spark, SF_SMALL)
    plan, _ = pl.train_plan(apps, oversample=True)
    assert plan.oversampled
    back = pl.load_plan(spark, pl.save_plan(spark, plan, work_path(spark, "plan")))
    new = apps.withColumn("loan_purpose", F.lit("never seen"))
    for df in (apps, new):
        a, b = (p.score(df, ["applicant_id"] if "applicant_id" in df.columns else [df.columns[0]], stamp=False).toPandas() for p in (plan, back))
        pd.testing.assert_frame_equal(a.sort_values(a.columns[0]).reset_index(drop=True), b.sort_values(a.columns[0]).reset_index(drop=True))
    assert back.threshold == plan.threshold and back.describe(spark).first() == plan.describe(spark).first()
