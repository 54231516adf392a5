"""From files to files: processing of class masks, and evaluation of two GeoJSON files."""

from __future__ import annotations

import json
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.projections import reproject_polygons
from ..operators import filters, matching, raster, vectorize, zonal
from ..operators.schema import Settings, require_geographic
from ..sources import geotiff, vector
from .jobs import StageStore
from .lineage import cut, running_sums
from .pipeline import number, polygon_chain


def with_box(df: DataFrame, geom: str = "geom") -> DataFrame:
    """Box columns of WKB polygons."""

    @F.arrow_udf("struct<minx: double, miny: double, maxx: double, maxy: double>")
    def box(geoms: pa.Array) -> pa.Array:
        found = [g.bounds(g.from_wkb(x)) if x is not None else None for x in geoms.to_pylist()]
        return pa.array([None if b is None else dict(zip(("minx", "miny", "maxx", "maxy"), b)) for b in found],
                        pa.struct([(n, pa.float64()) for n in ("minx", "miny", "maxx", "maxy")]))

    return df.withColumn("__b", box(F.col(geom))).select(*df.columns, "__b.*")


def mask_tiles(spark: SparkSession, path: str, classes: list[str], settings: Settings) -> tuple[DataFrame, int]:
    """Tiles of a mask file whose band k holds the probabilities of class k, and the EPSG code."""
    head = geotiff.headers(spark, path).first()
    if head is None:
        raise FileNotFoundError(path)
    if head["bands"] != len(classes):
        raise ValueError(f"{head['bands']} bands, but {len(classes)} classes")
    t = raster.Affine(*head["transform"])
    grid = raster.tile_grid(spark, head["height"], head["width"], settings.tile_size, settings.tile_overlap)
    px = cut(geotiff.pixels(geotiff.blocks(spark, path, settings.tile_size)))
    parts = []
    for k, name in enumerate(classes):
        band = px.where(F.col("band") == k).select("r", "c", F.col("value").cast("double").alias("prob"))
        dense = raster.padded(raster.to_tiles(band, settings.tile_size, settings.tile_overlap), grid, settings.tile_size, "prob")
        parts.append(vectorize.tiles_from_pixels(dense, settings.tile_size, t, settings.tile_size - settings.tile_overlap, name))
    return filters.merge_tiles(parts), head["srid"]


def process(spark: SparkSession, path: str, classes: list[str], out: str, settings: Settings = Settings(), aoi_path: str | None = None,
            aoi_srid: int = 4326, resume: bool = True) -> dict[str, str]:
    """Masks to detections in three formats, and indicators of the area; returns the written files.

    The area of interest is reprojected to the raster's reference system for clip and indicators.
    """
    aoi = vector.read_aoi(aoi_path) if aoi_path else None
    stat = Path(path).stat()
    inputs = {"path": str(Path(path).resolve()), "mtime": stat.st_mtime, "size": stat.st_size, "aoi": Path(aoi_path).read_text() if aoi_path else "no-aoi", "classes": classes}
    store = StageStore(spark, f"{out}/.stages", inputs, settings)
    if not resume:
        store.clear()
    tiles, srid = mask_tiles(spark, path, classes, settings)
    require_geographic(srid)
    if aoi is not None and aoi_srid != srid:
        aoi = reproject_polygons(aoi, aoi_srid, srid)
    found = store.stage("detect", lambda: number(vectorize.mask_polygons(tiles)))
    kept = store.stage("postprocess", lambda: polygon_chain(found, settings, aoi, srid))
    files = vector.write_all(_numbered(kept).select(*vector.FIELDS, "geom"), out, "detections", srid)
    if aoi is not None:
        zone = spark.createDataFrame([("aoi", g.to_wkb(aoi))], "zone_id string, geom binary")
        found = cut(zonal.polygon_indicators(with_box(kept.select("class_name", "geom")), with_box(zone)))
        vector.write_indicators_csv(found, f"{out}/indicators_csv")
        Path(f"{out}/indicators.json").write_text(json.dumps([r.asDict() for r in found.select(*vector.INDICATOR_COLUMNS).orderBy("class_name").collect()], indent=2))
        files |= {"csv": f"{out}/indicators_csv", "json": f"{out}/indicators.json"}
    return files


def _numbered(dets: DataFrame) -> DataFrame:
    """``id``: the 0-based position."""
    d = running_sums(dets.withColumn("__one", F.lit(1)).withColumn("__all", F.lit(0)), "__all", [F.col("det_id")], {"__n": F.col("__one")})
    return d.withColumn("id", (F.col("__n") - 1).cast("long")).drop("__one", "__all", "__n")


def evaluate(spark: SparkSession, predictions: str, truth: str, iou: float = 0.5, sample: int = 0, seed: int = 42) -> dict:
    """The evaluation report of two feature collections; ``sample`` adds a control sample of predictions."""
    p = with_box(vector.read_geojson(spark, predictions)).withColumnRenamed("ord", "det_id")
    t = with_box(vector.read_geojson(spark, truth)).withColumnRenamed("ord", "gt_id")
    p, t = cut(p), cut(t)
    pairs = cut(matching.candidate_pairs(p, t, iou, geom="geom"))
    matches = cut(matching.greedy_matches(pairs))
    errors = matching.report_errors(matching.error_examples(p, t, matches, geom="geom"))
    out = vector.evaluation_report(matching.class_metrics(p, t, pairs, matches), errors)
    if sample:
        picked = filters.control_sample(p, "det_id", sample, seed).select("class_name", "confidence", g.st_as_text(F.col("geom")).alias("geometry"))
        out["control_sample"] = [r.asDict() for r in picked.collect()]
    return out
