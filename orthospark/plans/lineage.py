"""Cutting lineage in the shared checkpoint folder, and two-level running sums."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is named, a local session gets a private one; a cluster must name it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="orthospark-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df``; later steps start from the written copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def running_sums(df: DataFrame, group: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Inclusive running sums by ``group`` in ``order``, without one task per group.

    Rows are range-partitioned by (group, order); each range sums its own rows, and the totals of
    the ranges before it (one row per range and group) are added.
    """
    width = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = cut(df.repartitionByRange(width, F.col(group), *order).withColumn("__pid", F.spark_partition_id()))
    own = Window.partitionBy("__pid", group).orderBy(*order)
    totals = dealt.groupBy("__pid", group).agg(*[F.sum(v).alias(f"__t_{k}") for k, v in sums.items()])
    before = Window.partitionBy(group).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__pid", group, *[F.coalesce(F.sum(f"__t_{k}").over(before), F.lit(0)).alias(f"__o_{k}") for k in sums])
    local = dealt.select("*", *[F.sum(v).over(own).alias(f"__l_{k}") for k, v in sums.items()])
    out = local.join(offsets, ["__pid", group])
    return out.select(*df.columns, *[(F.col(f"__l_{k}") + F.col(f"__o_{k}")).alias(k) for k in sums])
