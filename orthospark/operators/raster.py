"""Raster operators in long form (one row per pixel: r, c, value), plain Catalyst expressions.

Long form lets Spark deal pixels over the cluster and SQL check the results; the block form, one
array per tile, is in ``vectorize``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Affine:
    """x = a*col + b*row + c, y = d*col + e*row + f."""

    a: float
    b: float
    c: float
    d: float
    e: float
    f: float

    def forward(self, col, row):
        return self.a * col + self.b * row + self.c, self.d * col + self.e * row + self.f

    def inverse(self) -> Affine:
        det = self.a * self.e - self.b * self.d
        if det == 0:
            raise ValueError("the transform has no inverse")
        a, b, d, e = self.e / det, -self.b / det, -self.d / det, self.a / det
        return Affine(a, b, -a * self.c - b * self.f, d, e, -d * self.c - e * self.f)

    def moved(self, col: int, row: int) -> Affine:
        """The transform of a window that starts at (col, row)."""
        x, y = self.forward(col, row)
        return Affine(self.a, self.b, x, self.d, self.e, y)

    def bounds(self, width: int, height: int) -> tuple[float, float, float, float]:
        xs, ys = zip(*[self.forward(c, r) for c in (0, width) for r in (0, height)])
        return min(xs), min(ys), max(xs), max(ys)

    @classmethod
    def from_bounds(cls, west: float, south: float, east: float, north: float, width: int, height: int) -> Affine:
        return cls((east - west) / width, 0.0, west, 0.0, -(north - south) / height, north)


def tile_grid(spark: SparkSession, height: int, width: int, size: int, overlap: int) -> DataFrame:
    """(tile_row, tile_col, row_off, col_off, valid_h, valid_w): all tiles, edge tiles cut."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the tile size")
    stride = size - overlap
    rows, cols = -(-height // stride), -(-width // stride)
    t = spark.range(rows * cols).select((F.floor(F.col("id") / cols)).cast("int").alias("tile_row"), (F.col("id") % cols).cast("int").alias("tile_col"))
    return t.select(
        "tile_row", "tile_col", (F.col("tile_row") * stride).alias("row_off"), (F.col("tile_col") * stride).alias("col_off"),
        F.least(F.lit(size), height - F.col("tile_row") * stride).alias("valid_h"), F.least(F.lit(size), width - F.col("tile_col") * stride).alias("valid_w"),
    )


def tile_bounds(tiles: DataFrame, t: Affine, size: int) -> DataFrame:
    """West, south, east and north of every (padded) tile."""
    x0, y0 = t.forward(F.col("col_off"), F.col("row_off"))
    x1, y1 = t.forward(F.col("col_off") + size, F.col("row_off") + size)
    return tiles.select("tile_row", "tile_col", F.least(x0, x1).alias("west"), F.least(y0, y1).alias("south"), F.greatest(x0, x1).alias("east"), F.greatest(y0, y1).alias("north"))


def to_tiles(pixels: DataFrame, size: int, overlap: int) -> DataFrame:
    """Every pixel in each tile that covers it: tile_row, tile_col, tr, tc (place in the tile) and the pixel's other columns."""
    stride = size - overlap

    def covering(p: Column) -> Column:
        return F.sequence(F.greatest(F.lit(0).cast("long"), F.ceil((p - size + 1) / stride)), F.floor(p / stride))

    rest = [c for c in pixels.columns if c not in ("r", "c")]
    d = pixels.withColumn("tile_row", F.explode(covering(F.col("r")))).withColumn("tile_col", F.explode(covering(F.col("c"))))
    return d.select(
        F.col("tile_row").cast("int").alias("tile_row"), F.col("tile_col").cast("int").alias("tile_col"),
        (F.col("r") - F.col("tile_row") * stride).cast("int").alias("tr"), (F.col("c") - F.col("tile_col") * stride).cast("int").alias("tc"), *rest,
    )


def padded(tiled: DataFrame, tiles: DataFrame, size: int, value: str) -> DataFrame:
    """Dense tiles: all size x size cells of each tile, 0 and valid = false beyond the raster."""
    cells = tiles.select("tile_row", "tile_col", "valid_h", "valid_w", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("tr"))
    cells = cells.withColumn("tc", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    keys = ["tile_row", "tile_col", "tr", "tc"]
    out = cells.join(tiled.select(*keys, value), keys, "left")
    valid = (F.col("tr") < F.col("valid_h")) & (F.col("tc") < F.col("valid_w"))
    return out.select(*keys, F.coalesce(F.col(value), F.lit(0.0)).alias(value), valid.alias("valid"))


def masked(tiled: DataFrame, prob: str = "prob") -> DataFrame:
    """Probabilities times the valid mask."""
    return tiled.withColumn(prob, F.when(F.col("valid"), F.col(prob)).otherwise(F.lit(0.0)))


def threshold(df: DataFrame, prob: str = "prob", least: float = 0.5) -> DataFrame:
    return df.withColumn("mask", (F.col(prob) >= F.lit(least)).cast("int"))


def closing(dense: DataFrame, mask: str = "mask") -> DataFrame:
    """3 x 3 binary closing of dense tiles: two separable passes of maxima, then of minima.

    Cells beyond the tile count as 0 in both, so erosion eats what touches the border.
    """
    tile = ["tile_row", "tile_col"]
    along_r = Window.partitionBy(*tile, "tc").orderBy("tr").rowsBetween(-1, 1)
    along_c = Window.partitionBy(*tile, "tr").orderBy("tc").rowsBetween(-1, 1)
    low = lambda c, w: F.when(F.count(F.lit(1)).over(w) < 3, F.lit(0)).otherwise(F.min(c).over(w))
    d = dense.withColumn("__m", F.max(mask).over(along_r))
    d = d.withColumn("__m", F.max("__m").over(along_c))
    d = d.withColumn("__m", low("__m", along_c))
    d = d.withColumn("__m", low("__m", along_r))
    return d.withColumn("closed", F.col("__m")).drop("__m")


def percentile_stretch(df: DataFrame, value: str = "value", band: str = "band") -> DataFrame:
    """2 to 98 percent stretch of each band's positive values; only if the raster exceeds 1; a flat band gives 0."""
    positive = F.when(F.col(value) > 0, F.col(value))
    stats = df.groupBy(band).agg(F.percentile(positive, F.array(F.lit(0.02), F.lit(0.98))).alias("q"))
    top = df.agg(F.max(value).alias("top"))
    d = df.join(F.broadcast(stats), band).join(F.broadcast(top))  # one row a band, and one row
    lo, hi = F.coalesce(F.col("q")[0], F.lit(0.0)), F.coalesce(F.col("q")[1], F.lit(1.0))
    scaled = F.when(hi > lo, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(value) - lo) / (hi - lo)))).otherwise(F.lit(0.0))
    return d.withColumn("stretched", F.when(F.col("top") > 1, scaled).otherwise(F.col(value))).drop("q", "top")


def minmax_uint8(df: DataFrame, value: str = "value") -> DataFrame:
    """Global min-max stretch to 0..255, truncating; a constant raster gives 0."""
    s = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    d = df.join(F.broadcast(s))
    v = F.when(F.col("hi") > F.col("lo"), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * 255.0)).otherwise(F.lit(0))
    return d.withColumn("byte", v.cast("int")).drop("lo", "hi")


def binarize(df: DataFrame, value: str = "value") -> DataFrame:
    """A mask read back: values above 0 are 1 if the raster exceeds 1, else they stay."""
    d = df.join(F.broadcast(df.agg(F.max(value).alias("top"))))
    return d.withColumn("binary", F.when(F.col("top") > 1, (F.col(value) > 0).cast("double")).otherwise(F.col(value))).drop("top")


def softmax(df: DataFrame, channels: str = "channels") -> DataFrame:
    """Class probabilities of a channel array, without the background channel 0."""
    top = F.array_max(channels)
    e = F.transform(F.col(channels), lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("probs", F.slice(F.transform(e, lambda x: x / total), 2, F.size(channels) - 1))


def mask_confidence(dets: DataFrame, pixels: DataFrame, t: Affine, height: int, width: int, key: str) -> DataFrame:
    """Confidence of boxes from the probabilities in their bounding window.

    Window: from the floor of the upper left corner to the floor of the lower right one, the
    latter included, inside the raster. Mean of the positive values, 0.5 without any, in percent,
    truncated; 50 for an empty window. The window is joined by row and filtered by column.
    """
    inv = t.inverse()
    c0, r0 = inv.forward(F.col("minx"), F.col("maxy"))
    c1, r1 = inv.forward(F.col("maxx"), F.col("miny"))
    lo = lambda v: F.greatest(F.lit(0).cast("long"), F.floor(v))
    hi = lambda v, n: F.least(F.lit(n).cast("long"), F.floor(v) + 1)
    w = dets.select(key, lo(F.least(r0, r1)).alias("r0"), hi(F.greatest(r0, r1), height).alias("r1"), lo(F.least(c0, c1)).alias("c0"), hi(F.greatest(c0, c1), width).alias("c1"))
    inside = w.where("r1 > r0 AND c1 > c0").withColumn("r", F.explode(F.sequence(F.col("r0"), F.col("r1") - 1)))
    hit = inside.join(pixels.select("r", "c", "prob"), "r").where("c >= c0 AND c < c1")
    mean = hit.groupBy(key).agg(F.avg(F.when(F.col("prob") > 0, F.col("prob"))).alias("m"))
    p = F.coalesce("m", F.lit(0.5)) * 100
    conf = F.greatest(F.lit(0), F.least(F.lit(100), F.coalesce(p, F.lit(50.0)).cast("int")))
    return w.join(mean, key, "left").select(key, conf.alias("confidence"))


def clip_to_box(pixels: DataFrame, t: Affine, aoi: tuple) -> DataFrame:
    """Pixels of the area's window: any touched cell stays, the window starts at 0, 0."""
    x0, y0 = t.forward(F.col("c"), F.col("r"))
    x1, y1 = t.forward(F.col("c") + 1, F.col("r") + 1)
    touch = (F.least(x0, x1) < F.lit(aoi[2])) & (F.greatest(x0, x1) > F.lit(aoi[0])) & (F.least(y0, y1) < F.lit(aoi[3])) & (F.greatest(y0, y1) > F.lit(aoi[1]))
    inside = pixels.where(touch)
    first = inside.agg(F.min("r").alias("__r"), F.min("c").alias("__c"))
    d = inside.join(F.broadcast(first))
    rest = [F.col(c) for c in pixels.columns if c not in ("r", "c")]
    return d.select((F.col("r") - F.col("__r")).alias("r"), (F.col("c") - F.col("__c")).alias("c"), *rest)


def clip_to_polygon(pixels: DataFrame, t: Affine, aoi: list, aoi_srid: int, srid: int, height: int, width: int) -> DataFrame:
    """Pixels of the area's window, 0 outside the area; any touched cell is inside.

    The area is reprojected to the raster's reference system first; an area that misses the raster
    is an error. Cells are tested by rows of the area's window, as one broadcast list of column ranges.
    """
    from ..functions import geometry as g
    from ..functions.projections import reproject_polygons

    area = reproject_polygons(aoi, aoi_srid, srid) if aoi_srid != srid else aoi
    west, south, east, north = t.bounds(width, height)
    if g.intersection_area(area, g.box(west, south, east, north)) <= 0:
        raise ValueError("the area of interest doesn't meet the raster")
    inv = t.inverse()
    cells = [[[inv.forward(x, y) for x, y in r] for r in p] for p in area]
    c0, r0, c1, r1 = g.bounds(cells)
    c0, r0, c1, r1 = max(0, math.floor(c0)), max(0, math.floor(r0)), min(width, math.ceil(c1)), min(height, math.ceil(r1))
    spans = []
    for r in range(r0, r1):
        for p in g.intersection(cells, g.box(c0, r, c1, r + 1)):
            b = g.bounds([p])
            spans.append((r, max(c0, math.floor(b[0])), min(c1, math.ceil(b[2]))))
    spark = pixels.sparkSession
    ranges = spark.createDataFrame(spans, "r long, a long, b long").groupBy("r").agg(F.collect_list(F.struct("a", "b")).alias("s"))
    window = pixels.where((F.col("r") >= r0) & (F.col("r") < r1) & (F.col("c") >= c0) & (F.col("c") < c1))
    joined = window.join(F.broadcast(ranges), "r", "left")  # a few numbers a raster row
    inside = F.coalesce(F.exists("s", lambda x: (F.col("c") >= x["a"]) & (F.col("c") < x["b"])), F.lit(False))
    joined = joined.withColumn("__in", inside)
    rest = [F.when(F.col("__in"), F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in pixels.columns if c not in ("r", "c")]
    return joined.select((F.col("r") - r0).alias("r"), (F.col("c") - c0).alias("c"), *rest)


def pixel_to_geo(df: DataFrame, t: Affine) -> DataFrame:
    x, y = t.forward(F.col("c"), F.col("r"))
    return df.withColumn("x", x).withColumn("y", y)


def geo_to_pixel(df: DataFrame, t: Affine) -> DataFrame:
    c, r = t.inverse().forward(F.col("x"), F.col("y"))
    return df.withColumn("col", c).withColumn("row", r)
