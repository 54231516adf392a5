"""Exact deduplication with a heavy-hitter split.

1. A digest of every whole text (lower-cased in A-Z only, null as empty) is taken once.
2. Each task runs Misra-Gries over its digests. Summaries are merged by a sum per digest;
   those that reach ``n / (counters + 1)`` are the candidates, at most ``counters + 1`` of
   them, and every digest in ``2 n / (counters + 1)`` rows or more is among them.
3. An exact count over all rows verifies the candidates and finds their winners, which are
   broadcast (their number is bounded by ``counters``: 2048, or four times the shuffle
   partitions): losing copies of frequent texts are decided map-side and never shuffled.
4. All other digests are below ``2 n / (counters + 1)`` rows each and use an ordinary shuffle.

Edge cases: a null text equals the empty text; a null id loses against every other id; of
rows that repeat id and text exactly one stays; an empty table gives an empty result; input
columns named like a result column are replaced.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, release, shuffle_width, table, without

RESULT = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
_D, _K, _N, _L, _T, _W = "__xd_digest", "__xd_keep", "__xd_n", "__xd_lead", "__xd_row", "__xd_winner"
_FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def text_digest(column: str) -> Column:
    """SHA-256 of the text after lower-casing A-Z, as 32 bytes; null counts as empty."""

    @F.arrow_udf("binary")
    def digest(texts: pa.Array) -> pa.Array:
        release()
        sha = hashlib.sha256
        return pa.array([sha((t or "").encode("utf-8", "surrogatepass").translate(_FOLD)).digest() for t in texts.to_pylist()], pa.binary())

    return digest(F.col(f"`{column}`").cast("string"))


def default_counters(spark: SparkSession) -> int:
    """So many that a digest which isn't heavy fills half a shuffle partition's fair share at most."""
    return max(2048, 4 * shuffle_width(spark))


def misra_gries(digests: DataFrame, counters: int) -> DataFrame:
    """Candidates for heavy digests: ``digest``, at most ``counters + 1`` rows."""

    def summarise(batches):
        held: dict[bytes, int] = {}
        for batch in batches:
            for d in batch.column(0).to_pylist():
                if d in held:
                    held[d] += 1
                elif len(held) < counters:
                    held[d] = 1
                else:
                    held = {k: v - 1 for k, v in held.items() if v > 1}
        yield pa.RecordBatch.from_pydict({_D: pa.array(list(held), pa.binary()), _N: pa.array(list(held.values()), pa.int64())})

    n = digests.count()
    least = max(2.0, n / (counters + 1))
    return (
        digests.select(_D).mapInArrow(summarise, f"{_D} binary, {_N} long").groupBy(_D).agg(F.sum(_N).alias(_N)).where(F.col(_N) >= F.lit(least)).select(_D)
    )


def _winners(digests: DataFrame, counters: int) -> DataFrame:
    """Exact sizes and winners (id and, where rows are numbered, row) of the heavy digests; at most ``counters + 1`` rows."""
    found = F.broadcast(misra_gries(digests, counters))
    row = [F.coalesce(F.max_by(_T, "__xd_id"), F.max(_T)).alias(_W)] if _T in digests.columns else []  # all ids null: any row
    return digests.join(found, _D).groupBy(_D).agg(F.count(F.lit(1)).alias(_N), F.max("__xd_id").alias(_K), *row).withColumn(_L, F.lit(True))


def _digests(docs: DataFrame, id_col: str, text_col: str, numbered: bool = False) -> DataFrame:
    """Ids and digests, written once; ``numbered`` adds a number to every row, which holds as the table is a checkpoint."""
    number = [F.monotonically_increasing_id().alias(_T)] if numbered else []
    return checkpointed(docs.select(F.col(f"`{id_col}`").alias("__xd_id"), text_digest(text_col).alias(_D), *number))


def dedup_decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Winners are told by row number, so of a heavy digest one row is shuffled, also where all its rows bear one id.
    """
    digests = _digests(docs, id_col, text_col, numbered=True)
    heavy = F.broadcast(_winners(digests, counters or default_counters(docs.sparkSession)))
    split = digests.join(heavy, _D, "left")
    led, loses = F.col(_L).isNotNull(), F.col(_L).isNotNull() & (F.col(_T) != F.col(_W))
    group = Window.partitionBy(_D)
    losers = split.where(loses).select("__xd_id", _D, F.col(_K).alias("keep_id"), F.col(_N).alias("group_size"), F.lit(False).alias("kept"))
    rest = split.where(~loses).select(
        "__xd_id",
        _D,
        F.when(led, F.col(_K)).otherwise(F.max("__xd_id").over(group)).alias("keep_id"),
        F.when(led, F.col(_N)).otherwise(F.count(F.lit(1)).over(group)).alias("group_size"),
        (F.row_number().over(group.orderBy(F.col("__xd_id").desc_nulls_last())) == 1).alias("kept"),
    )
    out = losers.unionByName(rest)
    return out.select(F.col("__xd_id").alias("doc_id"), "keep_id", F.col("group_size").cast("long"), "kept", F.lower(F.hex(_D)).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``.

    Rows of a frequent text that lose by their id go map-side. Of the others each task passes on one row a
    digest at most (the limit of a window's groups), so rows that repeat id and text aren't gathered either.
    """
    rows = without(docs, ["keep_id", "group_size", "kept", _D, _K, _N, _L]).withColumn(_D, text_digest(text_col))
    heavy = F.broadcast(_winners(_digests(docs, id_col, text_col), counters or default_counters(docs.sparkSession)))
    the_id = F.col(f"`{id_col}`")
    stays = rows.join(heavy, _D, "left").where(F.col(_L).isNull() | the_id.eqNullSafe(F.col(_K))).select(*[f"`{c}`" for c in rows.columns])
    first = F.row_number().over(Window.partitionBy(_D).orderBy(the_id.desc_nulls_last()))
    return stays.withColumn(_N, first).where(F.col(_N) == 1).drop(_D, _N)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: decisions for all documents."""
    return dedup_decisions(table(spark, sf_dir, "documents"))


ORACLE = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
