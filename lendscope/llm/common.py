"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscope.session import work_path

#: White space of every operator here: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
#: Stands for a NULL doc_id inside an operator, so that it sorts last and joins.
NO_ID = (1 << 63) - 1


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage
    with files that outlive any executor, and fixes the rows for re-use."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """As ``stage``, in buckets: later joins on ``keys`` don't shuffle these rows."""
    path = work_path(df.sparkSession, name)
    called = re.sub(r"\W", "_", path)[-60:].lstrip("_")
    df.write.option("path", path).option("compression", "zstd").bucketBy(buckets, *keys).saveAsTable(called)
    return df.sparkSession.table(called)


#: Bytes of a table that every executor may hold.
MOST_BROADCAST = 64 << 20


def sized(df: DataFrame, row_bytes: Column | int, most: int = MOST_BROADCAST) -> DataFrame:
    """``df``, a written table, marked for broadcast if the sum of ``row_bytes``
    is ``most`` at most; else as it is, and Spark joins it by a shuffle."""
    total = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0]
    return F.broadcast(df) if (total or 0) <= most else df


#: Rows of whole texts that a Python worker gets at a time.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_ROWS`` rows at most, for the session: a worker and its
    executor hold a batch several times over, and keep that memory for later stages."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inner_id(name: str = "doc_id") -> Column:
    """doc_id as a long that is never NULL."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def outer_id(c: Column) -> Column:
    """Back to NULL where there was no doc_id."""
    return F.when(c != NO_ID, c)


def byte_slices(pdf, column: str, limit: int):
    """Cut a pandas batch into runs of rows of about ``limit`` text bytes
    (at least one row each), so that what a task holds doesn't hang on the
    length of the texts that happen to share an Arrow batch."""
    at, held = 0, 0
    for i, text in enumerate(pdf[column]):
        n = len(text) if text is not None else 0
        if i > at and held + n > limit:
            yield pdf.iloc[at:i]
            at, held = i, 0
        held += n
    if at < len(pdf):
        yield pdf.iloc[at:]
