"""Corpus preparation: documents in, token ids of a clean, mixed corpus out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lendscope.llm import bpe, exact, mixing, superminhash, toxicity
from lendscope.llm.common import stage, table

#: A document goes at this score or above.
TOXIC = 0.7
#: Near duplicates: shingles of five words, 80 % of them shared.
SHINGLE, PERCENT = 5, 80
#: Shares of the tokens by quality, in a mixture of this size against the clean
#: corpus. Rates are 1 at least: what is short is repeated, no clean document goes.
WEIGHTS, BUDGET, LEAST = {"good": 0.9, "poor": 0.1}, 1.25, 1.0


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the classifier learns from labels."""
    return toxicity.drop_toxic(docs, toxicity.fit_labels(docs, table(spark, sf_dir, "labels")), TOXIC)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked near duplicates the row with the smallest doc_id stays."""
    return superminhash.drop_near_duplicates(docs, SHINGLE, PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, repeated as the fitted rates say."""
    model = mixing.fit_domains(docs, table(spark, sf_dir, "labels"), list(WEIGHTS))
    return mixing.mixed(docs, mixing.fit_mixture(mixing.memberships(docs, model), model, WEIGHTS, BUDGET, LEAST))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row of the mixture."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mix), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each over the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
