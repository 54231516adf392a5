"""Predicates and projections over detections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes
from .schema import CLASS_NAMES


def merge_tiles(parts: list[DataFrame]) -> DataFrame:
    """Detections of all tiles, as one relation."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_confidence(dets: DataFrame, least: int = 50) -> DataFrame:
    return dets.where(F.col("confidence") >= least)


def by_registry(dets: DataFrame) -> DataFrame:
    """Only registered classes (a fixed dimension of four)."""
    return dets.where(F.col("class_name").isin(*CLASS_NAMES))


def by_size(dets: DataFrame, area_m2: Column, least: float = 25.0, most: float = 1_000_000.0) -> DataFrame:
    return dets.where((area_m2 > 0) & (area_m2 >= least) & (area_m2 <= most))


def by_shape(dets: DataFrame, most_aspect: float = 100.0) -> DataFrame:
    """Drop boxes without width or height and those longer than ``most_aspect`` times their width."""
    return dets.where(boxes.aspect(boxes.box()) <= most_aspect)


def by_request(dets: DataFrame, class_name: str | None = None, min_confidence: int | None = None) -> DataFrame:
    if class_name:
        dets = dets.where(F.col("class_name") == class_name)
    if min_confidence is not None:
        dets = dets.where(F.col("confidence") >= min_confidence)
    return dets


def page(dets: DataFrame, offset: int = 0, limit: int = 100, order: str = "det_id") -> DataFrame:
    """One page in a stable order; the limit is the feature and lies in 1..1000."""
    if not 1 <= limit <= 1000 or offset < 0:
        raise ValueError("limit must be in 1..1000 and offset not negative")
    return dets.orderBy(order).offset(offset).limit(limit)


def clip_to_box(dets: DataFrame, aoi: tuple) -> DataFrame:
    """Boxes cut to the area of interest; those that only touch it have no polygon left."""
    a = tuple(F.lit(v) for v in aoi)
    i = boxes.intersection(boxes.box(), a)
    rest = [c for c in dets.columns if c not in boxes.SIDES]
    return dets.where((i[2] > i[0]) & (i[3] > i[1])).select(*rest, *[x.alias(s) for x, s in zip(i, boxes.SIDES)])


def feature_json(dets: DataFrame, area_m2: Column, order: str = "det_id") -> DataFrame:
    """One GeoJSON feature per detection (property ``class``)."""
    b = boxes.box()
    at = lambda x, y: F.array(x, y)
    ring = F.array(at(b[2], b[1]), at(b[2], b[3]), at(b[0], b[3]), at(b[0], b[1]), at(b[2], b[1]))
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.col(order).cast("string").alias("id"), F.col("class_name").alias("class"), F.col("confidence"), F.col("source"), area_m2.alias("area_m2")
        ).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    return dets.select(order, F.to_json(feature).alias("feature"))


def export_rows(dets: DataFrame, area_m2: Column, order: str = "det_id") -> DataFrame:
    """Export relation: 0-based position as id, unrounded area and the centre."""
    from ..plans.lineage import running_sums

    x, y = boxes.center(boxes.box())
    counted = running_sums(dets.withColumn("__one", F.lit(1)).withColumn("__all", F.lit(0)), "__all", [F.col(order)], {"__n": F.col("__one")})
    return counted.select(
        (F.col("__n") - 1).cast("long").alias("id"), "class_name", "confidence", "source", area_m2.alias("area_m2"), x.alias("center_x"), y.alias("center_y")
    )


def control_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows picked by a seeded arithmetic hash: repeatable, all rows if there are fewer."""
    h = (F.col(key) * F.lit(2654435761) + F.lit(seed) * F.lit(40503)) % F.lit(4294967291)
    return rows.orderBy(h, F.col(key)).limit(n)


def class_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, "Polygon") for c in CLASS_NAMES], "class_name string, geometry_type string")
