import json

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from test_models import _data

from lendscope.functions import ranking as rk
from lendscope.operators import models as mo
from lendscope.operators import search as se
from lendscope.session import work_path

COLS = ["a", "b", "c"]
BUDGET = {"iters": (2, 6), "depth": (2, 3), "mlp_iter": 3}


@pytest.mark.parametrize("subsampling", [1.0, 0.6])
def test_f1_at_each_length_equals_a_fresh_fit_of_that_length(spark, subsampling):
    train, held = (mo._prepare(d, "y", COLS, "balanced").persist() for d in _data(spark, 500, 8))
    params = {"maxDepth": 3, "stepSize": 0.4, "subsamplingRate": subsampling}
    counts = se.prefix_counts(se.estimator("boosted", {**params, "maxIter": 9}).fit(train), held).collect()
    found = {r.rounds: r for r in counts}
    assert sorted(found) == list(range(1, 10)) and all(r.tp + r.fp + r.fn + r.tn == held.count() for r in counts)
    for n in (1, 2, 5, 9):
        fresh = se.estimator("boosted", {**params, "maxIter": n}).fit(train).transform(held)
        f1 = MulticlassClassificationEvaluator(labelCol=mo.LABEL, metricName="fMeasureByLabel", metricLabel=1.0).evaluate(fresh)
        assert abs(found[n].f1 - f1) < 1e-12, n
    assert len({r.f1 for r in counts}) > 2


def test_trials_share_fits_and_keep_to_the_ranges():
    rows = se.draw_trials(["boosted", "boosted_weighted", "mlp"], 7)
    assert len(rows) == 90 and rows == se.draw_trials(["boosted", "boosted_weighted", "mlp"], 7)
    for family in ("boosted", "boosted_weighted"):
        mine = [r for r in rows if r[0] == family]
        assert len({r[2] for r in mine}) == 6 and all(100 <= r[3] <= 500 and 3 <= json.loads(r[4])["maxDepth"] <= 10 for r in mine)
        assert len({r[4] for r in se.draw_trials([family], 7, lengths=1)}) == 30
    assert all(json.loads(r[4])["maxIter"] == 200 and r[3] is None for r in rows if r[0] == "mlp")


def test_a_stopped_search_goes_on_and_fits_nothing_twice(spark, monkeypatch):
    train, val = _data(spark, 240, 4)
    folded = rk.fold_ids(train, "rid", "y", 2).persist()
    families = ["boosted", "mlp"]
    sets = {f: se.fold_sets(folded, "y", COLS, f, 2) for f in families}
    path, fits, real = work_path(spark, "ledger"), [], se.fold_f1

    def counted(family, params, lengths, pair):
        if len(fits) == 3:
            raise ConnectionError("driver lost")
        fits.append((family, json.dumps(params, sort_keys=True), id(pair)))
        return real(family, params, lengths, pair)
    monkeypatch.setattr(se, "fold_f1", counted)
    trials = se.draw_trials(families, 3, n_trials=4, lengths=2, budget=BUDGET)
    with pytest.raises(ConnectionError):
        se.run_search(se.Ledger(spark, path).open(trials), sets, 2, parallelism=1)
    assert len(fits) == 3

    def later(family, params, lengths, pair):
        fits.append((family, json.dumps(params, sort_keys=True), id(pair)))
        return real(family, params, lengths, pair)
    monkeypatch.setattr(se, "fold_f1", later)
    ledger = se.Ledger(spark, path).open([])  # what is there stays
    assert se.run_search(ledger, sets, 2, seconds=0) == 12 - 3
    assert se.run_search(ledger, sets, 2, parallelism=3) == 0
    assert len(fits) == len(set(fits)) == 2 * 2 + 4 * 2
    done = ledger.trials(2).collect()
    assert len(done) == 8 and ledger.done().count() == 16
    best = {r.family: r for r in ledger.winners(2).collect()}
    for family in families:
        mine = sorted((-r.cv_f1, r.trial) for r in done if r.family == family)
        assert (-best[family].cv_f1, best[family].trial) == mine[0]

    report, models = se.tuned_models(ledger, 2, train, val, "y", COLS)
    rows = {r.family: r for r in report.collect()}
    assert set(models) == set(rows) == set(families) and sum(r.is_best for r in rows.values()) == 1
    won = json.loads(rows["boosted"].params)
    assert won == se.winner_params(best["boosted"]) and models["boosted"].getNumTrees == won["maxIter"] == best["boosted"].rounds
    assert max(rows.values(), key=lambda r: r.f1).is_best


def test_a_half_written_fit_is_not_done(spark):
    path = work_path(spark, "ledger")
    ledger = se.Ledger(spark, path).open(se.draw_trials(["boosted"], 3, 2, 2, budget=BUDGET))
    spark.createDataFrame([("boosted", 0, 0, 3, "{}", 0, 1.0, 1.0)], se.DONE_SCHEMA).write.parquet(f"{path}/done/boosted-0-0/_temporary/0")
    assert ledger.done().count() == 0 and len(ledger.pending(2)) == 2


def test_refit_fits_on_what_balance_returns(spark):
    train, test = _data(spark)
    flipped = se.refit_and_validate("boosted", {"maxIter": 2, "maxDepth": 2, "stepSize": 0.1}, train, test, "y", COLS,
                                    balance=lambda d: d.withColumn("y", 1 - d.y))
    assert flipped["auc"] < 0.3 and np.isfinite(flipped["f1"])
