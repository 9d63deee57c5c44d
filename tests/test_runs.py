import pytest
from conftest import SF_SMALL

from lendscope.plans import pipelines as pl
from lendscope.plans import registry as rg
from lendscope.session import work_path
from lendscope.sources.runs import RunStore
from lendscope.sources.tables import applications


def _rows(spark, n):
    return lambda path: spark.range(n).write.parquet(path)


def test_a_half_written_run_is_invisible(spark):
    store = RunStore(spark, work_path(spark, "store"))
    assert store.runs().count() == 0

    def broken(path):
        spark.range(3).write.parquet(path)
        raise ConnectionError("lost")
    with pytest.raises(ConnectionError):
        store.publish({"a": 1}, {"f1": 0.5}, artifacts={"model": _rows(spark, 2), "report": broken}, run_id="half")
    assert store.runs().count() == 0
    with pytest.raises(ValueError):
        store.promote("half")
    with pytest.raises(ValueError):
        store.artifact("half", "model")
    with pytest.raises(ValueError):
        store.serving()


def test_versions_and_two_writers(spark):
    path = work_path(spark, "store")
    one, two = RunStore(spark, path), RunStore(spark, path)
    a = one.publish({"kind": "x"}, {"f1": 0.25}, {"by": "one"}, {"model": _rows(spark, 1)})
    b = two.publish({"kind": "y"}, {"f1": 0.75}, {"by": "two"}, {"model": _rows(spark, 2)})
    found = {r["run_id"]: r for r in one.runs().collect()}
    assert found[a]["metric.f1"] == 0.25 and found[b]["param.kind"] == "y" and found[b]["tag.by"] == "two"
    assert spark.read.parquet(two.artifact(b, "model")).count() == 2 and found[b]["artifact.model"] == two.artifact(b, "model")
    assert (one.promote(a), two.promote(b)) == (1, 2) and one.serving() == two.serving() == b
    assert one.promote(a) == 3 and two.serving() == a  # undone by promoting the run before
    last = one._pointer()
    spark.createDataFrame([(3, b, last["ts"].replace(year=last["ts"].year + 1))], "version long, run_id string, ts timestamp").write.parquet(
        f"{path}/serving/{3:012d}-other")  # a second writer of the same version: the later one counts
    assert two.serving() == b


def test_the_winner_is_picked_published_and_served(spark):
    apps = applications(spark, SF_SMALL)
    small = {**pl.DEFAULT_CANDIDATES, "GBTClassifier": rg.boosted_candidate({"maxIter": 4, "maxDepth": 3, "stepSize": 0.3})}
    plan, data, table = pl.train_best(apps, small, oversample=True)
    rows = {r["family"]: r for r in table.collect()}
    assert set(rows) == set(small) and rows[plan.model_type]["is_best"] and plan.oversampled
    assert rows[plan.model_type]["f1"] == max(r["f1"] for r in rows.values())
    assert data.train.count() > data.part("train").count()
    store = RunStore(spark, work_path(spark, "store"))
    run = pl.publish_plan(store, plan, data, table, {"t": "x"})
    row = store.runs().first().asDict()
    assert row["param.model_type"] == plan.model_type and {f"artifact.{n}" for n in ("plan", "threshold", "report", "candidates")} <= set(row)
    assert {"metric.f1", "metric.roc_auc", "metric.accuracy", "metric.precision", "metric.recall"} <= set(row)
    assert spark.read.parquet(store.artifact(run, "threshold")).first()[0] == plan.threshold
    assert spark.read.parquet(store.artifact(run, "report")).count() == 5
    back = pl.served_plan(store)
    assert back.describe(spark).first() == plan.describe(spark).first()
    a, b = (sorted(p.score(apps, ["application_id"], stamp=False).collect()) for p in (plan, back))
    assert a == b
