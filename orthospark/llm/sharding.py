"""Size-tiered compaction of document shards under a versioned manifest.

A store is a folder of immutable parquet files and a log of manifests ``_manifest/v<n>.json``;
a version names the files that make up the table. Arrivals are appended as they come, one small
file a partition, without a shuffle. Compaction merges runs of similar size: shards fall into
tiers by the power of ``fan_in`` that their size is of the target; as soon as a tier holds a run
of shards that fills a target-sized file, or ``fan_in`` shards, they become one file, and that
goes on until no tier has work. Only shards of the same tier are merged, so a row is rewritten
at most once a tier.

Every write goes to a fresh folder below ``data/`` first; a version becomes visible by renaming
its finished manifest into place, which fails if another writer has taken the number (the commit
is then retried on the new version). That needs a file system whose rename is atomic and refuses
an existing target: local files, HDFS and the hierarchical stores of ``ATOMIC``; others (plain object stores copy and
delete) are refused unless the caller vouches for a single writer. Lost tasks leave files that no manifest names;
``vacuum`` removes those and what old versions alone name, but no file younger than an age above
that of any append in flight and none of the versions to keep. A merged file is one partition of a plain
scan of its sources, so merging shuffles nothing; a run has at most the target's size, so a
task's work is bounded.

Edge cases: null ids and texts and any columns are kept as they are (the rows are copied);
repeated rows stay repeated; an empty table gives an empty first version; input columns named
like a result column of ``places`` are only read under their own names by ``read``.
"""

from __future__ import annotations

import functools
import json
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, table


#: Schemes of file systems on which a rename is atomic and fails where the target exists.
ATOMIC = ("file", "hdfs", "viewfs", "webhdfs", "abfs", "abfss", "ofs")


@dataclass(frozen=True)
class Shard:
    """One immutable file: its path below the store, bytes, and the merges behind it."""

    path: str
    size: int
    level: int


@dataclass(frozen=True)
class Policy:
    """Target size, shards a merge takes at least, and merges in one job."""

    target_bytes: int = 128 << 20
    fan_in: int = 4
    max_run: int = 64
    merges_a_job: int = 32


class ConcurrentCommit(RuntimeError):
    """Another writer has committed the version."""


class ShardStore:
    """A sharded table below ``root``, a folder of a file system in ``ATOMIC``, or of any with ``single_writer``."""

    def __init__(self, spark: SparkSession, root: str, single_writer: bool = False) -> None:
        # a session of its own: unions keep each member a partition; else single partitions become one
        self.spark, self.root = spark.newSession(), root.rstrip("/")
        self.spark.conf.set("spark.sql.unionOutputPartitioning", "false")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        scheme = self._fs.getUri().getScheme()
        if scheme not in ATOMIC and not single_writer:
            raise ValueError(f"renames in {scheme} don't exclude a second writer")

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def _list(self, path: str) -> list[tuple[str, int]]:
        if not self._exists(path):
            return []
        found = [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(self._path(path))]
        return sorted(found)

    def version(self) -> int:
        """The newest version; 0 before the first commit."""
        return max((int(n[1:-5]) for n, _ in self._list(f"{self.root}/_manifest") if n.startswith("v") and n.endswith(".json")), default=0)

    def manifest(self, version: int | None = None) -> list[Shard]:
        """The shards of a version, the newest by default."""
        version = self.version() if version is None else version
        if version == 0:
            return []
        rows = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        stream = self._fs.open(self._path(f"{self.root}/_manifest/v{version:08d}.json"))
        try:
            return [Shard(**x) for x in json.loads(rows.toString(stream, "UTF-8"))["shards"]]
        finally:
            stream.close()

    def commit(self, shards: list[Shard], base: int) -> int:
        """Make ``shards`` version ``base + 1``, atomically."""
        folder, name = f"{self.root}/_manifest", f"v{base + 1:08d}.json"
        self._fs.mkdirs(self._path(folder))
        staged = self._path(f"{folder}/.{uuid.uuid4().hex}")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps({"version": base + 1, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        target = self._path(f"{folder}/{name}")
        if self._fs.exists(target) or not self._fs.rename(staged, target):
            self._fs.delete(staged, False)
            raise ConcurrentCommit(name)
        return base + 1

    def _write(self, df: DataFrame, level: int) -> list[Shard]:
        """Write each partition as a file of a fresh folder; shards in partition order."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").option("maxRecordsPerFile", 0).parquet(f"{self.root}/{folder}")
        return [Shard(f"{folder}/{n}", size, level) for n, size in self._list(f"{self.root}/{folder}") if n.startswith("part-")]

    def append(self, df: DataFrame) -> int:
        """Add the rows of ``df`` as small shards; returns the new version."""
        new = self._write(df, 0)
        while True:
            base = self.version()
            try:
                return self.commit(self.manifest(base) + new, base)
            except ConcurrentCommit:
                continue

    def compact(self, policy: Policy = Policy()) -> int:
        """Merge until no tier has a run to merge; returns the newest version."""
        while True:
            base = self.version()
            shards = self.manifest(base)
            runs = plan_merges(shards, policy)
            if not runs:
                return base
            merged: list[Shard] = []
            for a in range(0, len(runs), policy.merges_a_job):
                part = runs[a : a + policy.merges_a_job]
                frames = [self._scan([s.path for s in run]).coalesce(1) for run in part]
                merged += self._write(functools.reduce(DataFrame.unionByName, frames), 1 + max(s.level for run in part for s in run))
            gone = {s.path for run in runs for s in run}
            try:
                self.commit([s for s in shards if s.path not in gone] + merged, base)
            except ConcurrentCommit:
                continue

    def _scan(self, paths: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{p}" for p in paths])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version; nothing before the first."""
        shards = self.manifest(version)
        return self._scan([s.path for s in shards]) if shards else self.spark.range(0).select()

    def places(self, id_col: str = "doc_id", version: int | None = None) -> DataFrame:
        """doc_id, shard (file name), shard_bytes and row of every row of a version."""
        shards = self.manifest(version)
        if not shards:
            return self.spark.createDataFrame([], "doc_id long, shard string, shard_bytes long, row long")
        rows = self._scan([s.path for s in shards]).select(
            F.col(f"`{id_col}`").alias("doc_id"), F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("shard_bytes"), F.col("_metadata.row_index").alias("row")
        )
        return rows.select("doc_id", F.regexp_extract("p", "([^/]+/[^/]+)$", 1).alias("shard"), "shard_bytes", "row")

    def vacuum(self, keep_versions: int = 2, min_age_s: float = 24 * 3600) -> int:
        """Delete files of at least ``min_age_s`` that none of the last ``keep_versions`` versions names; returns how many.

        Files of an append that isn't committed yet are younger, if no append takes longer than that.
        """
        newest, n = self.version(), 0
        named = {s.path for v in range(max(1, newest - keep_versions + 1), newest + 1) for s in self.manifest(v)}
        before = (time.time() - min_age_s) * 1000
        for folder, _ in self._list(f"{self.root}/data"):
            place = self._path(f"{self.root}/data/{folder}")
            files = [(s.getPath().getName(), s.getModificationTime()) for s in self._fs.listStatus(place)]
            gone = [f for f, at in files if f"data/{folder}/{f}" not in named and at <= before]
            parts = [f for f in gone if f.startswith("part-")]
            n += len(parts)
            if len(gone) == len(files) and self._fs.getFileStatus(place).getModificationTime() <= before:
                self._fs.delete(place, True)
            else:
                for f in parts:
                    self._fs.delete(self._path(f"{self.root}/data/{folder}/{f}"), False)
        return n


def tier(size: int, policy: Policy) -> int:
    """0 for a target-sized shard (half the target or more), else 1 + powers of ``fan_in`` below it."""
    n, edge = 0, policy.target_bytes / 2
    while size < edge and n < 40:
        n, edge = n + 1, edge / policy.fan_in
    return n


def plan_merges(shards: list[Shard], policy: Policy) -> list[list[Shard]]:
    """Runs of shards of one tier whose sum is at most about the target size.

    A run is merged once it has ``fan_in`` shards or fills half the target.
    """
    runs, tiers = [], {}
    for s in shards:
        tiers.setdefault(tier(s.size, policy), []).append(s)
    tiers.pop(0, None)
    for t in sorted(tiers, reverse=True):
        run, size = [], 0
        for s in [*sorted(tiers[t], key=lambda s: (s.size, s.path)), None]:
            if s is None or run and (size + s.size > policy.target_bytes or len(run) == policy.max_run):
                if len(run) >= policy.fan_in or len(run) > 1 and size >= policy.target_bytes / 2:
                    runs.append(run)
                run, size = [], 0
            if s is not None:
                run.append(s)
                size += s.size
    return runs


def shard_documents(docs: DataFrame, root: str, policy: Policy = Policy()) -> ShardStore:
    """Append ``docs`` to the store at ``root`` and compact it; superseded files stay for ``vacuum``."""
    store = ShardStore(docs.sparkSession, root)
    store.append(docs)
    store.compact(policy)
    return store


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents in a fresh store; where each row came to lie."""
    root = f"{ensure_checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    return shard_documents(table(spark, sf_dir, "documents"), root).places()
