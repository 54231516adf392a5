"""Counts, densities and areas per zone and class."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import boxes, geometry
from ..functions.geodesic import polygon_area
from .schema import CLASS_NAMES
from .spatial_join import box_join, with_prefix


def indicators(dets: DataFrame, zones: DataFrame) -> DataFrame:
    """One row per zone and class that meet; boxes that only touch a zone count with area 0."""
    d = with_prefix(dets.select("class_name", *boxes.SIDES), "d_")
    z = with_prefix(zones.select("zone_id", *boxes.SIDES), "z_")
    pairs = box_join(d, z, "d_", "z_")
    clipped = boxes.ellipsoid_area(boxes.to_degrees(boxes.intersection(boxes.box("d_"), boxes.box("z_"))))
    whole = boxes.ellipsoid_area(boxes.to_degrees(boxes.box("z_"))) / 1e6
    agg = (
        pairs.select(F.col("z_zone_id").alias("zone_id"), F.col("d_class_name").alias("class_name"), clipped.alias("area"), whole.alias("km2"))
        .groupBy("zone_id", "class_name").agg(F.count(F.lit(1)).alias("count"), F.sum("area").alias("area"), F.max("km2").alias("km2"))
    )
    km2 = F.when(F.col("km2") > 0, F.col("km2")).otherwise(1.0)
    return agg.select("zone_id", "class_name", "count", F.round(F.col("count") / km2, 4).alias("density_per_km2"), F.round("area", 2).alias("total_area_m2"))


def summary(found: DataFrame) -> DataFrame:
    """One row per zone; a class that is absent from a zone has nulls."""
    per_class = [F.max(F.when(F.col("class_name") == c, F.col(k))).alias(f"{c}_{n}") for c in CLASS_NAMES
                 for k, n in (("count", "count"), ("total_area_m2", "area_m2"), ("density_per_km2", "density_per_km2"))]
    return found.groupBy("zone_id").agg(F.sum("count").alias("total_detections"), F.round(F.sum("total_area_m2"), 2).alias("total_area_m2"), *per_class)


def polygon_indicators(dets: DataFrame, zones: DataFrame) -> DataFrame:
    """The same for WKB polygons (geom, with box columns) and polygon zones.

    Areas are geodesic. A detection that only touches a zone counts with area 0.
    """
    d = with_prefix(dets.select("class_name", "geom", *boxes.SIDES), "d_")
    z = with_prefix(zones.select("zone_id", "geom", *boxes.SIDES), "z_")

    @F.arrow_udf("double")
    def common(a: pa.Array, b: pa.Array) -> pa.Array:
        out = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            p, q = geometry.from_wkb(x), geometry.from_wkb(y)
            part = polygon_area(geometry.clip(p, q))
            out.append(part if part > 0 else 0.0 if geometry.intersects(p, q) else None)
        return pa.array(out, pa.float64())

    pairs = box_join(d, z, "d_", "z_").select(
        F.col("z_zone_id").alias("zone_id"), F.col("d_class_name").alias("class_name"), common(F.col("d_geom"), F.col("z_geom")).alias("area")
    )
    size = zones.select("zone_id", (geometry.st_area_geodesic(F.col("geom")) / 1e6).alias("km2"))
    agg = pairs.where("area IS NOT NULL").groupBy("zone_id", "class_name").agg(F.count(F.lit(1)).alias("count"), F.sum("area").alias("area")).join(size, "zone_id")
    km2 = F.when(F.col("km2") > 0, F.col("km2")).otherwise(1.0)
    return agg.select("zone_id", "class_name", "count", F.round(F.col("count") / km2, 4).alias("density_per_km2"), F.round("area", 2).alias("total_area_m2"))
