"""Shared plumbing of the training-data operators.

Lineage is cut only with ``checkpoint()`` into the folder that the session names
in ``spark.checkpoint.dir``; a local session without one gets a private folder, a cluster an error.
"""

from __future__ import annotations

import gc
import re
import tempfile
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir`` (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; set one only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="orthospark-ckpt-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the files of shuffles that nothing refers to any more.

    It follows the driver's garbage collection, which else may come much later than the files hurt.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


_RESIDENT: dict = {}


def resident(name: object, make: Callable[[], object]) -> object:
    """The one large cache that a worker process keeps; asking for another drops it.

    Worker processes outlive a stage and are shared by all operators of a job.
    """
    if _RESIDENT.get("name") != name:
        _RESIDENT.clear()
        _RESIDENT.update(name=name, value=make())
    return _RESIDENT["value"]


def release() -> None:
    """Drop what an earlier stage left in this worker process."""
    _RESIDENT.clear()


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop columns whose name equals one of ``names``, ignoring case."""
    low = {n.lower() for n in names}
    keep = [c for c in df.columns if c.lower() not in low]
    return df.select(*[f"`{c}`" for c in keep]) if len(keep) < len(df.columns) else df


def shuffle_width(spark: SparkSession) -> int:
    """Partitions a keyed exchange of this session gets."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def grouped_stream(df: DataFrame, keys: list[str], fn: Callable[[tuple, pa.Table], Iterator[pa.RecordBatch] | None],
                   schema: str, width: int | None = None) -> DataFrame:
    """Call ``fn(key, rows)`` once per key, streaming over key-sorted partitions.

    Cheaper per group than ``applyInArrow`` when most groups are a few rows.
    ``fn`` must be given bounded groups; only one group is held at a time.
    """
    width = width or shuffle_width(df.sparkSession)
    dealt = df.repartition(width, *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[pa.Table] = []
        held_key: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            cols = [t.column(k).to_pylist() for k in keys]
            cuts = [0]
            if len(keys) == 1:
                c = cols[0]
                cuts += [i for i in range(1, len(c)) if c[i] != c[i - 1]]
            else:
                z = list(zip(*cols))
                cuts += [i for i in range(1, len(z)) if z[i] != z[i - 1]]
            cuts.append(t.num_rows)
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(c[a] for c in cols)
                if held_key is not None and key != held_key:
                    out = fn(held_key, pa.concat_tables(held) if len(held) > 1 else held[0])
                    if out is not None:
                        yield from out
                    held = []
                held_key = key
                held.append(t.slice(a, b - a))
        if held_key is not None:
            out = fn(held_key, pa.concat_tables(held) if len(held) > 1 else held[0])
            if out is not None:
                yield from out

    return dealt.mapInArrow(run, schema)


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of an Arrow column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of the splitmix64 generator: a bijection that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def _tables(most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20240229))
    byte = rng.integers(1, 2**64 - 1, 256, dtype=np.uint64) | np.uint64(1)
    r = np.uint64(0x9E3779B97F4A7C15)
    r_inv = np.uint64(pow(int(r), -1, 2**64))
    up, down = np.ones(most, np.uint64), np.ones(most, np.uint64)
    if most > 1:
        up[1:], down[1:] = r, r_inv
        with np.errstate(over="ignore"):
            up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return byte, up, down


_POWERS: list = [1 << 16, None]


def word_hashes(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the maximal runs of word bytes, and the runs' start offsets.

    ``data``: UTF-8 bytes; ``is_word``: a 256-entry boolean table of word bytes.
    A prefix sum of ``T[byte] * r**i`` gives every run's polynomial hash without a loop.
    """
    n = data.size
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    flag = is_word[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flag, [False])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not starts.size:
        return np.empty(0, np.uint64), starts
    if _POWERS[1] is None or _POWERS[0] < n:
        while _POWERS[0] < n:
            _POWERS[0] *= 2
        _POWERS[1] = _tables(_POWERS[0])
    byte, up, down = _POWERS[1]
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(byte[data] * up[:n], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; one shingle of all words if there are fewer."""
    if words.size == 0:
        return words
    w = min(width, words.size)
    out = np.full(words.size - w + 1, np.uint64(w), np.uint64)
    for i in range(w):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + words[i : words.size - w + 1 + i])
    return out
