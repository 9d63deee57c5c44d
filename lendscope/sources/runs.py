"""Versioned store of training runs.

A run's artifacts are written first, its manifest last: a run without a manifest,
half-written or still being written, is not seen. What is served is a pointer of
its own that names a published run; promoting writes a new pointer and never
touches a run or an older pointer, so writers don't clash and a promotion is undone
by promoting the run before.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .io import RUNS_SCHEMA, run_rows, wide_runs

SERVING_SCHEMA = "version long, run_id string, ts timestamp"


class RunStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("recursiveFileLookup", True).parquet(f"{self.path}/{name}")
        except AnalysisException:  # nothing written yet
            return self.spark.createDataFrame([], schema)

    def publish(self, params: dict, metrics: dict, tags: dict | None = None,
                artifacts: dict[str, Callable[[str], object]] | None = None, run_id: str | None = None) -> str:
        """Write every artifact (name -> function that writes to a given folder), then the manifest."""
        run_id = run_id or uuid.uuid4().hex
        paths = {}
        for name, write in (artifacts or {}).items():
            paths[name] = f"{self.path}/artifacts/{run_id}/{name}"
            write(paths[name])
        rows = run_rows(run_id, params, metrics, tags, paths)
        self.spark.createDataFrame(rows, RUNS_SCHEMA).coalesce(1).write.parquet(f"{self.path}/manifests/{run_id}")
        return run_id

    def manifests(self) -> DataFrame:
        return self._folder("manifests", RUNS_SCHEMA)

    def runs(self) -> DataFrame:
        """One row a published run."""
        return wide_runs(self.manifests())

    def artifact(self, run_id: str, name: str) -> str:
        row = self.manifests().where((F.col("run_id") == run_id) & (F.col("kind") == "artifact") & (F.col("key") == name)).first()
        if row is None:
            raise ValueError(f"no published artifact {name} of run {run_id}")
        return row["value"]

    def _pointer(self):
        return self._folder("serving", SERVING_SCHEMA).orderBy(F.desc("version"), F.desc("ts"), "run_id").first()

    def promote(self, run_id: str) -> int:
        """Serve a published run; returns the pointer's version. Of two writers of the same version the later one counts."""
        if self.manifests().where(F.col("run_id") == run_id).first() is None:
            raise ValueError(f"run {run_id} is not published")
        last = self._pointer()
        version = (last["version"] if last else 0) + 1
        now = _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        self.spark.createDataFrame([(version, run_id, now)], SERVING_SCHEMA).coalesce(1).write.parquet(
            f"{self.path}/serving/{version:012d}-{uuid.uuid4().hex[:8]}")
        return version

    def serving(self) -> str:
        last = self._pointer()
        if last is None:
            raise ValueError("no run has been promoted")
        return last["run_id"]
