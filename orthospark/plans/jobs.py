"""Job control: states, log, retry, fingerprints and resumable stages."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schema import JOB_STATES, Settings


def may_follow(old: str, new: str) -> bool:
    """Is ``old`` -> ``new`` a step of the state machine? A failed job goes back to PENDING."""
    if old == "FAILED":
        return new == "PENDING"
    if new == "FAILED":
        return old != "COMPLETED"
    a, b = JOB_STATES.index(old), JOB_STATES.index(new)
    return b == a + 1


def latest(log: DataFrame) -> DataFrame:
    """Current state of every job of an append-only log (job_id, status, updated_at)."""
    return log.groupBy("job_id").agg(F.max_by("status", F.struct("updated_at", "seq")).alias("status"), F.max("updated_at").alias("updated_at"))


def merge_checkpoints(old: Column, new: Column) -> Column:
    """Shallow merge of two maps; the new value of a key wins."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)


def fingerprint(columns: list[Column]) -> Column:
    """SHA-256 of what a run depends on; nulls are told from empty strings."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]), 256)


class JobLog:
    """An append-only Parquet log of job states with shallow checkpoint data."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _append(self, job_id: str, status: str, data: dict, step: str | None = None, error: str | None = None) -> None:
        row = [(job_id, status, step, error, json.dumps(data))]
        df = self.spark.createDataFrame(row, "job_id string, status string, current_step string, error string, checkpoint string")
        df.select("*", F.current_timestamp().alias("updated_at"), F.lit(self._next()).alias("seq")).coalesce(1).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def _next(self) -> int:
        try:
            return (self.rows().agg(F.max("seq")).first()[0] or 0) + 1
        except Exception as e:  # no log yet
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return 1
            raise

    def start(self, config: dict) -> str:
        job_id = uuid.uuid4().hex
        self._append(job_id, "PENDING", {"config": config})
        return job_id

    def get(self, job_id: str) -> dict:
        row = self.rows().where(F.col("job_id") == job_id).orderBy(F.desc("seq")).first()
        if row is None:
            raise KeyError(job_id)
        return row.asDict() | {"checkpoint": json.loads(row["checkpoint"])}

    def move(self, job_id: str, status: str, data: dict | None = None, error: str | None = None) -> None:
        """The next state; ``data`` is merged over the checkpoint data, key by key."""
        now = self.get(job_id)
        if not may_follow(now["status"], status):
            raise ValueError(f"a job can't go from {now['status']} to {status}")
        self._append(job_id, status, now["checkpoint"] | (data or {}), status.lower(), error)

    def retry(self, job_id: str) -> None:
        """Back to PENDING, from FAILED only; checkpoint data stay, so finished stages are skipped."""
        if self.get(job_id)["status"] != "FAILED":
            raise ValueError("only a failed job can be retried")
        self.move(job_id, "PENDING")


class StageStore:
    """Stage results as Parquet below a folder, valid for one fingerprint."""

    def __init__(self, spark: SparkSession, root: str, inputs: dict, settings: Settings) -> None:
        text = json.dumps({"inputs": inputs, "settings": asdict(settings)}, sort_keys=True, default=str)
        self.spark, self.key = spark, hashlib.sha256(text.encode()).hexdigest()
        self.root = f"{root.rstrip('/')}/{self.key}"
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def done(self, stage: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{stage}/_SUCCESS"))

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's rows: read back if finished before, else computed, written and read."""
        if not self.done(name):
            make().write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.parquet(f"{self.root}/{name}")

    def clear(self) -> None:
        self._fs.delete(self._path(self.root), True)
