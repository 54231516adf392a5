"""Box-overlap joins as equi-joins on a grid of several levels.

Every box lies on the level whose cells are at least as large as the box, so it covers at most
four cells there, whatever its size. A pair meets on the coarser of its two levels: each side is
exploded to its own level and to the coarser ones that the other side has. A pair that shares
several cells is kept in the cell of the intersection's lower left corner only. Catalyst sees a
plain equi-join, so AQE can split crowded cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes


def _level(b, cell: float) -> Column:
    size = F.greatest(b[2] - b[0], b[3] - b[1]).cast("double")
    return F.when(size <= cell, F.lit(0)).otherwise(F.ceil(F.log2(size / F.lit(cell)))).cast("int")


def _exploded(df: DataFrame, b, cell: float, levels: list[int], side: str) -> DataFrame:
    width = lambda lv: F.lit(cell) * F.pow(F.lit(2.0), lv)
    d = df.withColumn(f"__own{side}", _level(b, cell))
    d = d.withColumn("__lv", F.explode(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= F.col(f"__own{side}"))))
    at = lambda v: F.floor(v / width(F.col("__lv"))).cast("long")
    d = d.withColumn("__gx", F.explode(F.sequence(at(b[0]), at(b[2]))))
    return d.withColumn("__gy", F.explode(F.sequence(at(b[1]), at(b[3]))))


def box_join(left: DataFrame, right: DataFrame, l_prefix: str, r_prefix: str, keys: list[tuple[str, str]] = (), cell: float | None = None, strategy: str | None = None) -> DataFrame:
    """All pairs of rows whose boxes overlap (closed) and whose ``keys`` are equal.

    ``strategy``: a join hint. "merge" where both sides are large: estimates don't know how many rows the
    grid adds, so a broadcast may look cheaper than it is, and it would keep few input files' few tasks.

    Columns of both sides must be distinct (use prefixes). ``cell``: edge of the finest cells;
    by default the 90th percentile of the left side's extents.
    """
    lb, rb = boxes.box(l_prefix), boxes.box(r_prefix)
    if cell is None:
        q = left.select(F.percentile_approx(F.greatest(lb[2] - lb[0], lb[3] - lb[1]).cast("double"), 0.9)).first()[0]
        cell = float(q) if q and q > 0 else 1.0
    found = left.select(_level(lb, cell).alias("l")).union(right.select(_level(rb, cell).alias("l"))).where("l IS NOT NULL").distinct()
    levels = sorted(r[0] for r in found.collect())  # one row per power of two of the extents
    if not levels:
        levels = [0]
    a = _exploded(left, lb, cell, levels, "l")
    b = _exploded(right, rb, cell, levels, "r").withColumnsRenamed({"__lv": "__lv2", "__gx": "__gx2", "__gy": "__gy2"})
    on = (F.col("__lv") == F.col("__lv2")) & (F.col("__gx") == F.col("__gx2")) & (F.col("__gy") == F.col("__gy2"))
    for x, y in keys:
        on = on & (F.col(x) == F.col(y))
    width = F.lit(cell) * F.pow(F.lit(2.0), F.col("__lv"))
    corner = boxes.intersection(lb, rb)
    home = (F.floor(corner[0] / width) == F.col("__gx")) & (F.floor(corner[1] / width) == F.col("__gy"))
    pairs = a.join(b.hint(strategy) if strategy else b, on & (F.col("__lv") == F.greatest("__ownl", "__ownr")) & boxes.overlaps(lb, rb) & home)
    return pairs.select(*left.columns, *right.columns)


def with_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(c).alias(prefix + c) for c in df.columns])
