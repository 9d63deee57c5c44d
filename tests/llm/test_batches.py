"""What a Python worker holds at a time."""

import pandas as pd
import public_tokenizers

from lendscope.llm import bpe, toxicity
from lendscope.llm.common import BATCH_ROWS, small_batches

SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_operators_hand_workers_small_batches(spark):
    docs = spark.range(0, 3 * BATCH_ROWS, 1, 1).selectExpr("id AS doc_id", "cast(id AS string) AS text")
    model = toxicity.ToxicityModel(weights=[0.0] * 12)
    before = spark.conf.get(SETTING)
    try:
        for step in (lambda: bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
                     lambda: toxicity.drop_toxic(docs, model), lambda: toxicity.score_toxicity(docs, model)):
            spark.conf.set(SETTING, "10000")
            assert step().count() == 3 * BATCH_ROWS
            sizes = docs.mapInPandas(lambda batches: (pd.DataFrame({"n": [len(b)]}) for b in batches), "n long")
            found = [r["n"] for r in sizes.collect()]
            assert sum(found) == 3 * BATCH_ROWS and max(found) <= BATCH_ROWS
        spark.conf.set(SETTING, "10")
        small_batches(spark)  # a smaller setting stays
        assert spark.conf.get(SETTING) == "10"
    finally:
        spark.conf.set(SETTING, before)


def test_codec_forgets_and_encodes_alike(monkeypatch):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    model = bpe.serialise_model(ranks)
    texts = [f"word{i} other{i * 7} ünï{i}" for i in range(50)]
    whole = [bpe.Codec(model, ranks, public_tokenizers.PATTERN).encode(t) for t in texts]
    assert bpe.REMEMBERED <= 100_000
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    c = bpe.Codec(model, ranks, public_tokenizers.PATTERN)
    assert [c.encode(t) for t in texts] == whole and len(c.known) < 40


def test_score_with_compressors_of_the_task():
    model = toxicity.fit(["vile slur here and there"] * 9, ["a calm word on trees"] * 9, settings=[(3.0, 2.0, 1)])
    texts = ["vile slur", "", "calm trees"]
    assert model.score(texts, model.compressors()).tolist() == model.score(texts).tolist()
