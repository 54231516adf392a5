"""Registered queries over rasters, polygons, sources, sinks and job control."""

from __future__ import annotations

import sqlite3
import struct
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import boxes
from ..functions import geometry as g
from ..functions import projections as pj
from ..operators import matching, raster, vectorize
from ..operators.schema import UPLOAD_SUFFIXES
from ..sources import geotiff, stac, vector
from . import fixtures as fx
from . import jobs, pipeline
from .catalog import AOI, IOU, SQL, _area_sql, query, _SETTINGS
from .lineage import cut, running_sums, shared_folder

SIZE, OVERLAP, WIDTH = 64, 8, 64
STRIDE = SIZE - OVERLAP
PIX = fx.PIXELS_CTE
DIM = f"dim AS (SELECT count(*) AS h, {WIDTH} AS w FROM embeddings)"
TILES = f"""{DIM}, tiles AS (SELECT CAST(i AS INT) AS tile_row, CAST(j AS INT) AS tile_col, i * {STRIDE} AS row_off, j * {STRIDE} AS col_off, least({SIZE}, h - i * {STRIDE}) AS valid_h, least({SIZE}, w - j * {STRIDE}) AS valid_w
  FROM dim, (SELECT unnest(range(0, 100000)) AS i) a, (SELECT unnest(range(0, 100)) AS j) b WHERE i * {STRIDE} < h AND j * {STRIDE} < w)"""
TILED = f"""tiled AS (SELECT tile_row, tile_col, CAST(r - row_off AS INT) AS tr, CAST(c - col_off AS INT) AS tc, prob FROM probs JOIN tiles ON r >= row_off AND r < row_off + {SIZE} AND c >= col_off AND c < col_off + {SIZE})"""
DENSE = f"""dense AS (SELECT t.tile_row, t.tile_col, CAST(a.i AS INT) AS tr, CAST(b.i AS INT) AS tc, coalesce(prob, 0.0) AS prob, (a.i < valid_h AND b.i < valid_w) AS valid
  FROM tiles t, range({SIZE}) a(i), range({SIZE}) b(i) LEFT JOIN tiled p ON p.tile_row = t.tile_row AND p.tile_col = t.tile_col AND p.tr = a.i AND p.tc = b.i)"""
ALL = f"{PIX}, {TILES}, {TILED}, {DENSE}"


def _height(spark, sf) -> int:
    return spark.read.parquet(f"{sf}/embeddings.parquet").count()


def _tiles(spark, sf) -> DataFrame:
    return raster.tile_grid(spark, _height(spark, sf), WIDTH, SIZE, OVERLAP)


def _dense(spark, sf) -> DataFrame:
    tiled = raster.to_tiles(fx.pixels(spark, sf).select("r", "c", "prob"), SIZE, OVERLAP)
    return raster.padded(tiled, _tiles(spark, sf), SIZE, "prob")


def _tif(spark, sf, transform: raster.Affine) -> str:
    """The folder of a GeoTIFF of the embeddings (a fixture; its source rows pass the driver)."""
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").toLocalIterator()
    data = np.array([r["embedding"] for r in rows], np.float32)[None]
    raw = geotiff.encode(geotiff.Raster(data, transform, 4326))
    folder = f"{shared_folder(spark)}/tif-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/a.tif")
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, False)
    out.write(bytearray(raw))
    out.close()
    return folder


def _transform(spark, sf) -> raster.Affine:
    return raster.Affine(1.0, 0.0, 0.0, 0.0, -1.0, float(_height(spark, sf)))


@query("tile_grid", "SELECT * FROM tiles", TILES)
def tile_grid(spark, sf):
    return _tiles(spark, sf).select("tile_row", "tile_col", *[F.col(c).cast("long").alias(c) for c in ("row_off", "col_off", "valid_h", "valid_w")])


@query("tile_bounds", f"SELECT tile_row, tile_col, (1000 + 10 * col_off)::DOUBLE AS west, (5000 - 10 * (row_off + {SIZE}))::DOUBLE AS south, (1000 + 10 * (col_off + {SIZE}))::DOUBLE AS east, (5000 - 10 * row_off)::DOUBLE AS north FROM tiles", TILES)
def tile_bounds(spark, sf):
    return raster.tile_bounds(_tiles(spark, sf), raster.Affine(10.0, 0.0, 1000.0, 0.0, -10.0, 5000.0), SIZE)


@query("raster_metadata", "SELECT 1 AS band_count, 4326 AS srid, 10::DOUBLE AS \"left\", 49::DOUBLE AS bottom, 42::DOUBLE AS \"right\", 49 + h / 4 AS top, 0.5::DOUBLE AS res_x, 0.25::DOUBLE AS res_y FROM dim", DIM)
def raster_metadata(spark, sf):
    """Read from the header of a written file."""
    folder = _tif(spark, sf, raster.Affine(0.5, 0.0, 10.0, 0.0, -0.25, 49.0 + _height(spark, sf) * 0.25))
    return geotiff.metadata(geotiff.headers(spark, folder)).drop("path")


@query("tile_pixels", "SELECT * FROM tiled", f"{PIX}, {TILES}, {TILED}")
def tile_pixels(spark, sf):
    return raster.to_tiles(fx.pixels(spark, sf).select("r", "c", "prob"), SIZE, OVERLAP)


@query("valid_mask", "SELECT tile_row, tile_col, tr, tc, valid, CASE WHEN valid THEN prob ELSE 0 END AS prob FROM dense", ALL)
def valid_mask(spark, sf):
    return raster.masked(_dense(spark, sf))


@query("threshold_mask", "SELECT tile_row, tile_col, count(*) AS n, sum((prob >= 0.5)::INT)::BIGINT AS n_on FROM dense GROUP BY ALL", ALL)
def threshold_mask(spark, sf):
    d = raster.threshold(raster.masked(_dense(spark, sf)))
    return d.groupBy("tile_row", "tile_col").agg(F.count(F.lit(1)).alias("n"), F.sum("mask").alias("n_on"))


@query("binary_closing", """SELECT tile_row, tile_col, tr, tc, mask, closed FROM (
  SELECT *, CASE WHEN count(*) OVER dr < 3 THEN 0 ELSE min(e1) OVER dr END AS closed FROM (
   SELECT *, CASE WHEN count(*) OVER dc < 3 THEN 0 ELSE min(m2) OVER dc END AS e1 FROM (
    SELECT *, max(m1) OVER dc AS m2 FROM (SELECT tile_row, tile_col, tr, tc, (prob >= 0.6)::INT AS mask, max((prob >= 0.6)::INT) OVER dr AS m1 FROM dense
     WINDOW dr AS (PARTITION BY tile_row, tile_col, tc ORDER BY tr ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
    WINDOW dc AS (PARTITION BY tile_row, tile_col, tr ORDER BY tc ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
   WINDOW dc AS (PARTITION BY tile_row, tile_col, tr ORDER BY tc ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))
  WINDOW dr AS (PARTITION BY tile_row, tile_col, tc ORDER BY tr ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))""", ALL)
def binary_closing(spark, sf):
    d = raster.threshold(_dense(spark, sf), least=0.6)
    return raster.closing(d).select("tile_row", "tile_col", "tr", "tc", "mask", "closed")


BANDS = f"{PIX}, bands AS (SELECT r % 3 AS band, r, c, value * 10 AS value FROM pixels)"


def _bands(spark, sf) -> DataFrame:
    return fx.pixels(spark, sf).select((F.col("r") % 3).alias("band"), "r", "c", (F.col("value") * 10).alias("value"))


@query("band_stretch", """SELECT band, r, c, round(CASE WHEN top > 1 THEN CASE WHEN hi > lo THEN least(1.0, greatest(0.0, (value - lo) / (hi - lo))) ELSE 0.0 END ELSE value END, 9) AS stretched
  FROM bands JOIN (SELECT band, quantile_cont(value, 0.02) FILTER (value > 0) AS lo, quantile_cont(value, 0.98) FILTER (value > 0) AS hi FROM bands GROUP BY band) USING (band), (SELECT max(value) AS top FROM bands)""", BANDS)
def band_stretch(spark, sf):
    return raster.percentile_stretch(_bands(spark, sf)).select("band", "r", "c", F.round("stretched", 9).alias("stretched"))


@query("minmax_uint8", "SELECT r, c, CAST(floor((value - lo) / (hi - lo) * 255.0) AS INT) AS byte FROM pixels, (SELECT min(value) AS lo, max(value) AS hi FROM pixels)", PIX)
def minmax_uint8(spark, sf):
    return raster.minmax_uint8(fx.pixels(spark, sf)).select("r", "c", "byte")


@query("mask_readback", "SELECT band, r, c, CASE WHEN top > 1 THEN (value > 0)::INT::DOUBLE ELSE value END AS \"binary\" FROM bands, (SELECT max(value) AS top FROM bands)", BANDS)
def mask_readback(spark, sf):
    return raster.binarize(_bands(spark, sf)).select("band", "r", "c", "binary")


@query("softmax_classes", """SELECT vec_id, k - 1 AS channel, round(exp(x[k] - m) / t, 9) AS prob FROM (
  SELECT vec_id, x, m, list_sum(list_transform(x, lambda y: exp(y - m))) AS t, unnest(range(2, 6)) AS k FROM (SELECT vec_id, x, list_max(x) AS m FROM (SELECT vec_id, embedding[1:5]::DOUBLE[] AS x FROM embeddings)))""", "")
def softmax_classes(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.slice("embedding", 1, 5).cast("array<double>").alias("channels"))
    d = raster.softmax(e).select("vec_id", F.posexplode("probs").alias("k", "p"))
    return d.select("vec_id", (F.col("k") + 1).cast("long").alias("channel"), F.round("p", 9).alias("prob"))


RBOXES = """rboxes AS (SELECT vec_id AS box_id, (vec_id * 7) % 50 AS c0, (vec_id * 7) % 50 + 3 + vec_id % 9 AS c1, (vec_id * 13) % (h - 20) AS r0, (vec_id * 13) % (h - 20) + 4 + vec_id % 11 AS r1 FROM embeddings, dim)"""


def _raster_boxes(spark, sf) -> DataFrame:
    h, v = _height(spark, sf), F.col("vec_id")
    c0, r0 = (v * 7) % 50, (v * 13) % (h - 20)
    return spark.read.parquet(f"{sf}/embeddings.parquet").select(
        v.alias("box_id"), c0.cast("double").alias("minx"), (h - (r0 + 4 + v % 11)).cast("double").alias("miny"), (c0 + 3 + v % 9).cast("double").alias("maxx"), (h - r0).cast("double").alias("maxy")
    )


@query("mask_confidence", f"""SELECT box_id, CAST(greatest(0, least(100, trunc(coalesce(avg(prob) FILTER (prob > 0), 0.5) * 100))) AS INT) AS confidence
  FROM rboxes, dim LEFT JOIN probs ON r >= r0 AND r < least(h, r1 + 1) AND c >= c0 AND c < least({WIDTH}, c1 + 1) GROUP BY box_id""", f"{PIX}, {DIM}, {RBOXES}")
def mask_confidence(spark, sf):
    return raster.mask_confidence(_raster_boxes(spark, sf), fx.pixels(spark, sf), _transform(spark, sf), _height(spark, sf), WIDTH, "box_id")


@query("clip_raster", "SELECT r - min(r) OVER () AS r, c - min(c) OVER () AS c, prob FROM probs, dim WHERE c < 40.5 AND c + 1 > 10.25 AND h - r - 1 < h - 20.5 AND h - r > h - 90.75", f"{PIX}, {DIM}")
def clip_raster(spark, sf):
    h = _height(spark, sf)
    return raster.clip_to_box(fx.pixels(spark, sf).select("r", "c", "prob"), _transform(spark, sf), (10.25, h - 90.75, 40.5, h - 20.5))


@query("pixel_to_geo", "SELECT r, c, 10 + c / 4 AS x, 50 - r / 2 AS y FROM pixels", PIX)
def pixel_to_geo(spark, sf):
    return raster.pixel_to_geo(fx.pixels(spark, sf).select("r", "c"), raster.Affine(0.25, 0.0, 10.0, 0.0, -0.5, 50.0))


@query("geo_to_pixel", "SELECT det_id, (minx - 16.0) / 4.0 AS col, (1024.0 - miny) / 8.0 AS row FROM detections")
def geo_to_pixel(spark, sf):
    d = fx.detections(spark, sf).select("det_id", F.col("minx").alias("x"), F.col("miny").alias("y"))
    return raster.geo_to_pixel(d, raster.Affine(4.0, 0.0, 16.0, 0.0, -8.0, 1024.0)).select("det_id", "col", "row")


@query("mercator_roundtrip", """SELECT det_id, round(x, 4) AS x, round(y, 4) AS y, round(degrees(x / 6378137.0), 9) AS lon, round(degrees(2 * atan(exp(y / 6378137.0)) - pi() / 2), 9) AS lat
  FROM (SELECT det_id, radians(10.0 + minx * 0.0001) * 6378137.0 AS x, ln(tan(pi() / 4 + radians(49.0 + miny * 0.0001) / 2)) * 6378137.0 AS y FROM detections)""")
def mercator_roundtrip(spark, sf):
    b = boxes.to_degrees(boxes.box())
    x, y = pj.to_mercator(pj.COLUMN, b[0], b[1])
    d = fx.detections(spark, sf).select("det_id", x.alias("x"), y.alias("y"))
    lon, lat = pj.from_mercator(pj.COLUMN, F.col("x"), F.col("y"))
    return d.select("det_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


_LONLAT = (pj.Sql("(10.0::DOUBLE + minx * 0.0001::DOUBLE)"), pj.Sql("(49.0::DOUBLE + miny * 0.0001::DOUBLE)"))


@query("utm_roundtrip", f"SELECT det_id, round(x, 4) AS x, round(y, 4) AS y, round({pj.from_utm(pj.SQL, pj.Sql('x'), pj.Sql('y'), 32)[0].text}, 9) AS lon, round({pj.from_utm(pj.SQL, pj.Sql('x'), pj.Sql('y'), 32)[1].text}, 9) AS lat"
       f" FROM (SELECT det_id, {pj.to_utm(pj.SQL, *_LONLAT, 32)[0].text} AS x, {pj.to_utm(pj.SQL, *_LONLAT, 32)[1].text} AS y FROM detections)")
def utm_roundtrip(spark, sf):
    b = boxes.to_degrees(boxes.box())
    x, y = pj.reproject(pj.COLUMN, b[0], b[1], 4326, 32632)
    d = fx.detections(spark, sf).select("det_id", x.alias("x"), y.alias("y"))
    lon, lat = pj.reproject(pj.COLUMN, F.col("x"), F.col("y"), 32632, 4326)
    return d.select("det_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))


@query("clip_raster_ring", "SELECT r - 10 AS r, c - 5 AS c, CASE WHEN r BETWEEN 20 AND 39 AND c BETWEEN 20 AND 29 THEN 0.0 ELSE prob END AS prob FROM probs WHERE r BETWEEN 10 AND 89 AND c BETWEEN 5 AND 49", PIX)
def clip_raster_ring(spark, sf):
    """An area with a hole along cell borders, so no cell is touched from both sides."""
    h = _height(spark, sf)
    shell, hole = g.box(5, h - 90, 50, h - 10)[0][0], g.box(20, h - 40, 30, h - 20)[0][0][::-1]
    return raster.clip_to_polygon(fx.pixels(spark, sf).select("r", "c", "prob"), _transform(spark, sf), [[shell, hole]], 3857, 3857, h, WIDTH)


def _mask_tiles(spark, sf, least: float) -> DataFrame:
    """Probability tiles in which everything below ``least`` is 0.1."""
    d = _dense(spark, sf).withColumn("prob", F.when(F.col("prob") >= least, F.col("prob")).otherwise(F.when(F.col("valid"), F.lit(0.1)).otherwise(F.lit(0.0))))
    return vectorize.tiles_from_pixels(d, SIZE, _transform(spark, sf), STRIDE, "building")


_LABELS = f"""RECURSIVE {ALL}, lit AS (SELECT tile_row, tile_col, tr, tc, tr * {SIZE} + tc AS id FROM dense WHERE valid AND prob >= 0.75),
reach AS (SELECT tile_row, tile_col, tr, tc, id AS label FROM lit
  UNION SELECT b.tile_row, b.tile_col, b.tr, b.tc, a.label FROM reach a JOIN lit b ON a.tile_row = b.tile_row AND a.tile_col = b.tile_col AND abs(a.tr - b.tr) + abs(a.tc - b.tc) = 1),
labels_ AS (SELECT tile_row, tile_col, tr, tc, min(label) AS label FROM reach GROUP BY tile_row, tile_col, tr, tc)"""


@query("component_bbox", f"""SELECT tile_row, tile_col, n_cells, (minx + tile_col * {STRIDE})::DOUBLE AS minx, (maxx + tile_col * {STRIDE})::DOUBLE AS maxx, (h - tile_row * {STRIDE} - maxy)::DOUBLE AS miny, (h - tile_row * {STRIDE} - miny)::DOUBLE AS maxy
  FROM (SELECT tile_row, tile_col, count(*)::INT AS n_cells, min(tc)::DOUBLE AS minx, max(tc) + 1.0 AS maxx, min(tr)::DOUBLE AS miny, max(tr) + 1.0 AS maxy FROM labels_ GROUP BY tile_row, tile_col, label), dim""",
       _LABELS)
def component_bbox(spark, sf):
    found = vectorize.mask_polygons(_mask_tiles(spark, sf, 0.75), 0.75, close=False)
    return found.select("tile_row", "tile_col", "n_cells", "minx", "maxx", "miny", "maxy")


@query("mask_polygons", """SELECT tile_row, tile_col, (rank() OVER (PARTITION BY tile_row, tile_col ORDER BY label) - 1)::INT AS position, count(*)::INT AS n_cells, count(*)::DOUBLE AS area, 3 AS type
  FROM labels_ GROUP BY tile_row, tile_col, label""", _LABELS)
def mask_polygons(spark, sf):
    found = vectorize.mask_polygons(_mask_tiles(spark, sf, 0.75), 0.75, close=False)
    return found.select("tile_row", "tile_col", "position", "n_cells", F.round(g.st_area(F.col("geom")), 6).alias("area"), g.st_type(F.col("geom")).alias("type"))


def _polygon(points: list) -> Column:
    """WKB of a ring of (x, y) columns."""
    ring = F.array(*[F.array(x, y) for x, y in points])
    return g.st_from_geojson(F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))))


@query("geodesic_area", f"SELECT det_id, round({_area_sql()}, 1) AS area_m2 FROM detections")
def geodesic_area(spark, sf):
    """Boxes of a few hundred metres, whose geodesic sides leave the parallels by less than a millimetre."""
    w, so, e, n = (F.col(s).cast("double") * 0.0001 + (10.0 if k % 2 == 0 else 49.0) for k, s in enumerate(boxes.SIDES))
    d = fx.detections(spark, sf).select("det_id", _polygon([(w, so), (e, so), (e, n), (w, n), (w, so)]).alias("geom"))
    return d.select("det_id", F.round(g.st_area_geodesic(F.col("geom")), 1).alias("area_m2"))


@query("geometry_valid", "SELECT det_id, 3 AS type, det_id % 3 <> 0 AND det_id % 5 <> 0 AS valid FROM detections")
def geometry_valid(spark, sf):
    """Boxes; every third crosses itself, every fifth is a line."""
    a, b, c, d = (F.col(s).cast("double") for s in boxes.SIDES)
    flat = F.when(F.col("det_id") % 5 == 0, b).otherwise(d)
    cross = F.col("det_id") % 3 == 0
    one, two = F.when(cross, flat).otherwise(b), F.when(cross, b).otherwise(flat)
    shape = _polygon([(a, b), (c, one), (c, two), (a, flat), (a, b)])
    d = fx.detections(spark, sf).select("det_id", shape.alias("geom"))
    return d.select("det_id", g.st_type(F.col("geom")).alias("type"), g.st_is_valid(F.col("geom")).alias("valid"))


@query("simplify_polygons", "SELECT det_id, CASE WHEN det_id % 3 = 2 THEN 6 ELSE 5 END AS n_points, round((maxx - minx) * (maxy - miny) + CASE WHEN det_id % 3 = 2 THEN (maxx - minx) * 1.5 ELSE 0 END, 6)::DOUBLE AS area FROM detections")
def simplify_polygons(spark, sf):
    """Boxes with a vertex in the middle of the lower side, 0, 0.5 or 3 below it; tolerance 1."""
    a, b, c, d = (F.col(s).cast("double") for s in boxes.SIDES)
    down = F.element_at(F.array(F.lit(0.0), F.lit(0.5), F.lit(3.0)), (F.col("det_id") % 3 + 1).cast("int"))
    shape = _polygon([(a, b), ((a + c) / 2, b - down), (c, b), (c, d), (a, d), (a, b)])
    small = fx.detections(spark, sf).select("det_id", g.st_simplify(shape, 1.0).alias("geom"))
    return small.select("det_id", F.size(F.split(g.st_as_text(F.col("geom")), ",")).alias("n_points"), F.round(g.st_area(F.col("geom")), 6).alias("area"))


@query("clip_polygons", "SELECT det_id, round(greatest(0, least(maxx, 905) - greatest(minx, 105)) * greatest(0, least(maxy, 875) - greatest(miny, 95)), 6)::DOUBLE AS area FROM detections WHERE least(maxx, 905) > greatest(minx, 105) AND least(maxy, 875) > greatest(miny, 95)")
def clip_polygons(spark, sf):
    cols = [F.col(s).cast("double") for s in boxes.SIDES]
    d = fx.detections(spark, sf).select("det_id", g.st_clip(g.st_box(*cols), g.box(105, 95, 905, 875)).alias("geom")).where("geom IS NOT NULL")
    return d.select("det_id", F.round(g.st_area(F.col("geom")), 6).alias("area"))


_PART = lambda a, b, c, d: f"greatest(0, least(maxx, {c}) - greatest(minx, {a})) * greatest(0, least(maxy, {d}) - greatest(miny, {b}))"


@query("clip_to_ring", f"SELECT det_id, round(a, 6)::DOUBLE AS area FROM (SELECT det_id, {_PART(105, 95, 905, 875)} - {_PART(400, 380, 610, 640)} AS a FROM detections) WHERE a > 0")
def clip_to_ring(spark, sf):
    """An area of interest with a hole: the general overlay."""
    aoi = [[g.box(105, 95, 905, 875)[0][0], g.box(400, 380, 610, 640)[0][0][::-1]]]
    cols = [F.col(s).cast("double") for s in boxes.SIDES]
    d = fx.detections(spark, sf).select("det_id", g.st_clip(g.st_box(*cols), aoi).alias("geom")).where("geom IS NOT NULL")
    return d.select("det_id", F.round(g.st_area(F.col("geom")), 6).alias("area"))


@query("make_valid", "SELECT det_id, det_id % 2 = 0 AS was_valid, true AS valid, round((maxx - minx) * (maxy - miny) / CASE WHEN det_id % 2 = 0 THEN 1.0 ELSE 2.0 END, 6)::DOUBLE AS area FROM detections")
def make_valid(spark, sf):
    """Boxes; every second has two corners swapped and crosses itself: made valid it is two triangles."""
    a, b, c, d = (F.col(s).cast("double") for s in boxes.SIDES)
    swap = F.col("det_id") % 2 == 1
    one, two = F.when(swap, d).otherwise(b), F.when(swap, b).otherwise(d)
    shape = _polygon([(a, b), (c, one), (c, two), (a, d), (a, b)])
    d = fx.detections(spark, sf).select("det_id", shape.alias("raw")).withColumn("geom", g.st_make_valid(F.col("raw")))
    return d.select("det_id", g.st_is_valid(F.col("raw")).alias("was_valid"), g.st_is_valid(F.col("geom")).alias("valid"), F.round(g.st_area(F.col("geom")), 6).alias("area"))


@query("polygon_iou", "SELECT hi, lo, round(iou, 9) AS iou FROM (SELECT a.det_id AS hi, b.det_id AS lo, (least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * (least(a.maxy, b.maxy) - greatest(a.miny, b.miny)) AS i,"
       " i::DOUBLE / ((a.maxx - a.minx) * (a.maxy - a.miny) + (b.maxx - b.minx) * (b.maxy - b.miny) - i) AS iou FROM detections a JOIN detections b ON a.class_name = b.class_name"
       " AND (a.confidence > b.confidence OR a.confidence = b.confidence AND a.det_id < b.det_id) AND least(a.maxx, b.maxx) > greatest(a.minx, b.minx) AND least(a.maxy, b.maxy) > greatest(a.miny, b.miny)) WHERE iou >= 0.3")
def polygon_iou(spark, sf):
    from ..operators import nms

    d = fx.detections(spark, sf).withColumn("geom", g.st_box(*[F.col(s).cast("double") for s in boxes.SIDES]))
    return nms.overlap_pairs(d, 0.3, geom="geom").select("hi", "lo", F.round("iou", 9).alias("iou"))


@query("centroid_wkt", "SELECT det_id, (minx + maxx) / 2.0::DOUBLE AS x, (miny + maxy) / 2.0::DOUBLE AS y FROM detections")
def centroid_wkt(spark, sf):
    d = fx.detections(spark, sf).withColumn("geom", g.st_box(*[F.col(s).cast("double") for s in boxes.SIDES]))
    xy = F.split(F.regexp_extract(g.st_centroid_wkt(F.col("geom")), r"POINT \((.*)\)", 1), " ")
    return d.select("det_id", xy[0].cast("double").alias("x"), xy[1].cast("double").alias("y"))


ITEMS = """items AS (SELECT 'item-' || o_orderkey AS id, CASE WHEN o_custkey % 2 = 0 THEN 'sentinel-2-l2a' ELSE 'other' END AS collection, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderdate END AS "datetime",
  (o_custkey % 300) - 150.0 AS west, (o_orderkey % 120) - 60.0 AS south, (o_custkey % 300) - 148.5 AS east, (o_orderkey % 120) - 58.5 AS north FROM orders)"""


def _items(spark, sf) -> DataFrame:
    text = ITEMS[len("items AS (") : -1].replace("FROM orders", "FROM {o}").replace('"datetime"', "datetime").replace(".0", ".0D").replace(".5", ".5D")
    return spark.sql(text, o=spark.read.parquet(f"{sf}/orders.parquet"))


@query("stac_filter_newest", """SELECT id, "datetime", row_number() OVER (ORDER BY "datetime" DESC, id) AS place FROM items WHERE west <= 20 AND east >= -20 AND south <= 30 AND north >= -30
  AND "datetime" >= '1996-01-01' AND "datetime" < '1997-01-01' AND collection = 'sentinel-2-l2a'""", ITEMS)
def stac_filter_newest(spark, sf):
    found = stac.search(_items(spark, sf), stac.parse_bbox("-20,-30,20,30"), "1996-01-01/1996-12-31", "sentinel-2-l2a")
    one = found.select("id", "datetime").withColumns({"one": F.lit(1), "every": F.lit(0)})
    out = running_sums(one, "every", [F.col("datetime").desc_nulls_last(), F.col("id")], {"place": F.col("one")})
    return out.select("id", "datetime", F.col("place").cast("long").alias("place"))


@query("upload_allowlist", "SELECT event_id, p AS path FROM (SELECT event_id, 'img_' || event_id || CASE event_id % 6 WHEN 0 THEN '.TIF' WHEN 1 THEN '.tiff' WHEN 2 THEN '.jpg' WHEN 3 THEN '.png' WHEN 4 THEN '.jp2' ELSE '' END AS p FROM events) WHERE event_id % 6 IN (0, 1, 3, 4)", "")
def upload_allowlist(spark, sf):
    k = F.col("event_id") % 6
    suffix = F.when(k == 0, ".TIF").when(k == 1, ".tiff").when(k == 2, ".jpg").when(k == 3, ".png").when(k == 4, ".jp2").otherwise("")
    d = fx.events(spark, sf).select("event_id", F.concat(F.lit("img_"), F.col("event_id").cast("string"), suffix).alias("path"))
    return d.where(F.lower(F.regexp_extract("path", r"(\.[^.]*)$", 1)).isin(*UPLOAD_SUFFIXES))


@query("geojson_read_defaults", """SELECT event_id, coalesce(nullif(a, ''), nullif(b, ''), 'unknown') AS class_name, CASE WHEN c IS NULL THEN 100 ELSE c END AS confidence, CASE WHEN c IS NULL OR c = 0 THEN 100 ELSE c END AS legacy_confidence,
  coalesce(nullif(s, ''), 'ground_truth') AS source FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'road' END AS a, CASE event_id % 4 WHEN 0 THEN NULL ELSE 'water' END AS b,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE 70 END AS c, CASE event_id % 7 WHEN 0 THEN '' ELSE event_type END AS s FROM events)""", "")
def geojson_read_defaults(spark, sf):
    e = F.col("event_id")
    props = F.struct(
        F.when(e % 3 == 1, "").when(e % 3 == 2, "road").alias("class_name"), F.when(e % 4 != 0, "water").alias("class"),
        F.when(e % 5 == 1, 0.0).when(e % 5 > 1, 70.0).alias("confidence"), F.when(e % 7 == 0, "").otherwise(F.col("event_type")).alias("source"),
    )
    d = fx.events(spark, sf).select(props.alias("properties"), e.alias("geometry"))
    new, old = vector.with_defaults(d), vector.with_defaults(d, legacy=True)
    return new.withColumnRenamed("geometry", "event_id").join(old.select(F.col("geometry").alias("event_id"), F.col("confidence").alias("legacy_confidence")), "event_id")


def _plain_ctes(name: str) -> tuple[str, str]:
    """The common tables of a registered oracle and its last SELECT."""
    text = SQL[name].removeprefix("WITH ")
    depth = 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if depth == 0 and text.startswith(" SELECT", k):
            return text[:k], text[k + 1 :]
    raise ValueError(name)


@query("indicators_json", _plain_ctes("zone_indicators")[1], _plain_ctes("zone_indicators")[0])
def indicators_json(spark, sf):
    """The rows of the written array."""
    from ..operators import zonal

    array = vector.indicators_json(zonal.indicators(fx.detections(spark, sf), fx.zones(spark, sf)))
    kinds = "array<struct<zone_id: string, class_name: string, count: bigint, density_per_km2: double, total_area_m2: double>>"
    return array.select(F.inline(F.from_json("json", kinds)))


def _degrees(geom: Column) -> Column:
    """Polygons in grid units as degrees; the box join before it works on exact integers."""
    move = lambda raw: g.to_wkb([[[(10 + x * 0.0001, 49 + y * 0.0001) for x, y in r] for r in p] for p in g.from_wkb(raw)])
    return F.arrow_udf(lambda a: pa.array([move(x) for x in a.to_pylist()], pa.binary()), "binary")(geom)


#: Degrees a grid unit in the chain's queries: a power of two, so that overlaps at the threshold are exact.
_UNIT = 2.0**-13


def _boxed(df: DataFrame) -> DataFrame:
    """Boxes as polygons in degrees, with their box columns."""
    at = lambda s, k: (F.col(s).cast("double") * _UNIT + (10.0 if k % 2 == 0 else 49.0)).alias(s)
    rest = [c for c in df.columns if c not in boxes.SIDES]
    d = df.select(*rest, *[at(s, k) for k, s in enumerate(boxes.SIDES)])
    return d.withColumn("geom", g.st_box(*[F.col(s) for s in boxes.SIDES]))


@query("polygon_zone_indicators", 'SELECT zone_id, class_name, "count", round(density_per_km2, 2) AS density_per_km2, round(total_area_m2, -1) AS total_area_m2 FROM indicators', _plain_ctes("zone_indicators")[0])
def polygon_zone_indicators(spark, sf):
    """The polygon lane on boxes, some of which only touch a zone."""
    from ..operators import zonal

    flat = lambda df: df.withColumn("geom", g.st_box(*[F.col(s).cast("double") for s in boxes.SIDES]))
    d, z = fx.detections(spark, sf), fx.zones(spark, sf)
    met = zonal.polygon_indicators(flat(d).withColumn("geom", _degrees(F.col("geom"))), flat(z).withColumn("geom", _degrees(F.col("geom"))))
    return met.select("zone_id", "class_name", "count", F.round("density_per_km2", 2).alias("density_per_km2"), F.round("total_area_m2", -1).alias("total_area_m2"))


def _chain_cte() -> str:
    return _plain_ctes("postprocess")[0].replace("* 0.0001::DOUBLE", f"* {_UNIT}::DOUBLE")


@query("polygon_chain", f"""SELECT det_id, class_name, confidence, round(area, 6)::DOUBLE AS area FROM (SELECT det_id, class_name, confidence, (maxx - minx) * (maxy - miny) AS area FROM k)""", _chain_cte())
def polygon_chain(spark, sf):
    d, aoi = _chain_input(spark, sf)
    out = pipeline.polygon_stages(d, _SETTINGS, aoi)[0]
    return out.select("det_id", "class_name", "confidence", F.round(g.st_area(F.col("geom")) / _UNIT**2, 6).alias("area"))


@query("polygon_chain_stats", _plain_ctes("postprocess_stats")[1], _chain_cte())
def polygon_chain_stats(spark, sf):
    d, aoi = _chain_input(spark, sf)
    return pipeline.polygon_stages(d, _SETTINGS, aoi)[1]


def _chain_input(spark, sf) -> tuple[DataFrame, list]:
    w, s, e, n = AOI
    return _boxed(fx.detections(spark, sf)), g.box(10 + w * _UNIT, 49 + s * _UNIT, 10 + e * _UNIT, 49 + n * _UNIT)


@query("polygon_class_metrics", _plain_ctes("class_metrics")[1], _plain_ctes("class_metrics")[0])
def polygon_class_metrics(spark, sf):
    """Evaluation by the polygons' own overlap, on boxes."""
    flat = lambda df: df.withColumn("geom", g.st_box(*[F.col(s).cast("double") for s in boxes.SIDES]))
    p, t = flat(fx.detections(spark, sf)), flat(fx.ground_truth(spark, sf))
    pairs = cut(matching.candidate_pairs(p, t, IOU, geom="geom"))
    return matching.class_metrics(p, t, pairs, cut(matching.greedy_matches(pairs)))


LOG = """log AS (SELECT 'job-' || user_id AS job_id, CASE event_id % 9 WHEN 0 THEN 'PENDING' WHEN 1 THEN 'LOADING' WHEN 2 THEN 'TILING' WHEN 3 THEN 'DETECTING' WHEN 4 THEN 'POSTPROCESSING' WHEN 5 THEN 'EXPORTING'
  WHEN 6 THEN 'COMPUTING_INDICATORS' WHEN 7 THEN 'COMPLETED' ELSE 'FAILED' END AS status, ts AS updated_at, event_id AS seq FROM events)"""


def _log(spark, sf) -> DataFrame:
    return spark.sql(LOG[len("log AS (") : -1].replace("FROM events", "FROM {e}"), e=fx.events(spark, sf))


@query("job_latest_state", "SELECT job_id, max_by(status, (updated_at, seq)) AS status, max(updated_at) AS updated_at FROM log GROUP BY job_id", LOG)
def job_latest_state(spark, sf):
    return jobs.latest(_log(spark, sf))


@query("job_log", "SELECT job_id, status, seq FROM log WHERE job_id = 'job-7'", LOG)
def job_log(spark, sf):
    return _log(spark, sf).where(F.col("job_id") == "job-7").select("job_id", "status", "seq")


@query("checkpoint_merge", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE 'old' END AS load, 'old-tile' AS tile, CASE WHEN event_id % 2 = 1 THEN 'new-detect' END AS detect FROM events""", "")
def checkpoint_merge(spark, sf):
    e = F.col("event_id")
    old = F.create_map(F.lit("load"), F.lit("old"), F.lit("tile"), F.lit("old-tile"))
    new = F.create_map(F.when(e % 2 == 0, "load").otherwise("detect"), F.when(e % 2 == 0, "new").otherwise("new-detect"))
    d = fx.events(spark, sf).select("event_id", jobs.merge_checkpoints(old, new).alias("m"))
    get = lambda k: F.try_element_at("m", F.lit(k)).alias(k)
    return d.select("event_id", get("load"), get("tile"), get("detect"))


@query("fingerprint", "SELECT event_id, sha256('=' || event_type || ':' || '=' || user_id || ':' || CASE WHEN event_id % 3 = 0 THEN '-' ELSE '=' || event_id END) AS key FROM events", "")
def fingerprint(spark, sf):
    e = F.col("event_id")
    return fx.events(spark, sf).select("event_id", jobs.fingerprint([F.col("event_type"), F.col("user_id"), F.when(e % 3 != 0, e)]).alias("key"))


@query("geotiff_scan", "SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, round(value, 6) AS value FROM pixels", PIX)
def geotiff_scan(spark, sf):
    """Embeddings written as a GeoTIFF, scanned back."""
    folder = _tif(spark, sf, raster.Affine(0.5, 0.0, 10.0, 0.0, -0.5, 50.0))
    px = geotiff.pixels(geotiff.blocks(spark, folder, 256))
    return px.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.round(F.col("value").cast("double"), 6).alias("value"))


def _export(spark, sf) -> DataFrame:
    b = [F.col(s).cast("double") for s in boxes.SIDES]
    d = cut(fx.detections(spark, sf).select(F.col("det_id").alias("id"), "class_name", "confidence", "source", boxes.area(boxes.box()).cast("double").alias("area_m2"), g.st_box(*b).alias("geom")))
    return d


@query("gpkg_sink", "SELECT class_name, count(*) AS n, sum(confidence)::BIGINT AS confidence FROM detections GROUP BY class_name")
def gpkg_sink(spark, sf):
    path = vector.write_geopackage(_export(spark, sf), vector.scratch(".gpkg"))
    with sqlite3.connect(path) as db:
        rows = db.execute("SELECT class_name, count(*), sum(confidence) FROM detections GROUP BY class_name").fetchall()
    Path(path).unlink()
    return spark.createDataFrame(rows, "class_name string, n long, confidence long")


@query("shp_sink", "SELECT count(*) AS n, min(minx)::DOUBLE AS minx, min(miny)::DOUBLE AS miny, max(maxx)::DOUBLE AS maxx, max(maxy)::DOUBLE AS maxy FROM detections")
def shp_sink(spark, sf):
    path = vector.write_shapefile(_export(spark, sf), vector.scratch(".shp"))
    head, index = Path(path).read_bytes()[:100], Path(path).with_suffix(".shx").stat().st_size
    for s in (".shp", ".shx", ".dbf", ".prj", ".cpg"):
        Path(path).with_suffix(s).unlink()
    return spark.createDataFrame([((index - 100) // 8, *struct.unpack_from("<4d", head, 36))], "n long, minx double, miny double, maxx double, maxy double")


@query("geojson_sink", "SELECT class_name, source, count(*) AS n, sum(confidence)::BIGINT AS confidence, sum((maxx - minx) * (maxy - miny))::DOUBLE AS area FROM detections GROUP BY class_name, source")
def geojson_sink(spark, sf):
    """Written as a feature collection, read back by the source."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/geojson-{uuid.uuid4().hex}/a.geojson")
    target = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    vector.write_geojson(_export(spark, sf), target)
    d = vector.read_geojson(spark, target)
    return d.groupBy("class_name", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("confidence"), F.sum(g.st_area(F.col("geom"))).alias("area"))
