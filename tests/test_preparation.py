from pyspark.sql import functions as F

from conftest import SF_SMALL

from lendscope.operators import cleaning as cl
from lendscope.plans import pipelines as pl
from lendscope.plans import registry as rg
from lendscope.schema import BENCH_SAMPLE_FRAC, ID_COL
from lendscope.session import stage
from lendscope.sources.tables import applications


def test_comparison_data_computes_features_of_the_drawn_rows_only(spark, monkeypatch):
    written = []

    def counted(df, name="stage"):
        out = stage(df, name)
        written.append((out.columns, out.count()))
        return out

    monkeypatch.setattr(rg, "stage", counted)
    train, test, cols = rg.bench_data(spark, SF_SMALL)
    n = train.count() + test.count()
    assert {rows for names, rows in written if set(cols) <= set(names)} == {n}
    monkeypatch.undo()
    feats, all_cols = rg.feature_parts(spark, SF_SMALL)
    part = feats.where(F.col("part") == "train").drop("part")
    assert cols == all_cols and n == round(BENCH_SAMPLE_FRAC * part.count())
    both = train.unionByName(test)
    assert train.columns == part.columns and both.exceptAll(part).isEmpty() and both.select(ID_COL).distinct().count() == n
    assert train.join(test, ID_COL).isEmpty()


def test_scoring_takes_the_rows_that_training_wrote(spark, monkeypatch):
    raw = cl.DuplicateRemover().transform(applications(spark, SF_SMALL))
    rows = pl.training_data(applications(spark, SF_SMALL)).rows
    assert raw.exceptAll(rows).isEmpty() and rows.exceptAll(raw).isEmpty()  # before rules and imputation

    def again(*_):
        raise AssertionError("the view is built a second time")

    monkeypatch.setattr(rg, "applications_base_clean", again)
    assert rg.f07(spark, SF_SMALL).select(ID_COL).exceptAll(raw.select(ID_COL)).isEmpty()
