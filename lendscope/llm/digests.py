"""Digests: 128-bit keys, and SHA-256 of comma-joined values of groups of any size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import stage

#: SHA-256 of the empty string.
NOTHING = hashlib.sha256(b"").hexdigest()


def key128(c: Column) -> Column:
    """The first 16 bytes of a string's or binary's SHA-256."""
    return F.unhex(F.substring(F.sha2(c, 256), 1, 32))


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (key, value): a row for each run of a key in a batch."""
    for batch in batches:
        new = (batch["key"] != batch["key"].shift()).cumsum()
        parts = batch.assign(text=batch["value"].astype(str)).groupby(new, sort=False)
        yield pd.DataFrame({"key": parts["key"].first(), "least": parts["value"].first(),
                            "n": parts.size(), "text": parts["text"].agg(",".join)})


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs sorted by (key, least): a digest for each key, fed run by run."""
    key, n, state = None, 0, None
    for batch in batches:
        done = []
        for k, count, text in zip(batch["key"], batch["n"], batch["text"]):
            if k != key:
                if key is not None:
                    done.append((key, n, state.hexdigest()))
                key, n, state = k, 0, hashlib.sha256()
            state.update(("," if n else "").encode() + text.encode())
            n += count
        yield pd.DataFrame(done, columns=["key", "n", "sha256"])
    if key is not None:
        yield pd.DataFrame([(key, n, state.hexdigest())], columns=["key", "n", "sha256"])


def joined_sha256(rows: DataFrame) -> DataFrame:
    """rows (key binary, value: distinct within its key, never NULL) -> key, n,
    sha256 of the key's values in rising order, joined by commas.

    SHA-256 reads its input in order, so a group ends in one task; but what goes
    there are texts of up to a batch of values each, made where a range of the
    sorted rows lies, and the task holds one of them at a time. A group of any
    size is split before, and none is gathered."""
    kind = dict(rows.dtypes)["value"]
    rows = stage(rows.select("key", "value"), "joined")
    ranges = rows.repartitionByRange("key", "value").sortWithinPartitions("key", "value")
    runs = ranges.mapInPandas(_runs, f"key binary, least {kind}, n long, text string")
    return runs.repartition("key").sortWithinPartitions("key", "least").mapInPandas(_hashes, "key binary, n long, sha256 string")
