"""Files of the digest index."""

import os

from pyspark.sql import functions as F

from lendscope.llm.exact import DigestIndex


def test_a_batch_is_one_file_a_bucket_whatever_the_number_of_tasks(spark, tmp_path, monkeypatch):
    kind = type(spark.range(1))
    dealt = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda self, n, *by: dealt(self, 31, *by))
    index = DigestIndex(spark, str(tmp_path / "index"), 8)
    rows = spark.range(2000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), F.col("id").alias("doc_id"))
    index.add(rows)
    index.add(rows.unionByName(rows))
    assert len([f for f in os.listdir(tmp_path / "index") if f.startswith("part-")]) == 8
    assert index.table().agg(F.count("*"), F.countDistinct("digest")).first() == (2000, 2000)
    joined = rows.join(index.table().hint("merge"), "digest").where("doc_id = keep_id")
    assert joined.count() == 2000
