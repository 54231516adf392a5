"""Raster to vector over tiles as rows: one probability array per tile and class."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from .raster import Affine
from .schema import CLASS_NAMES

#: tile_row, tile_col, class_name, h, w, valid_h, valid_w, transform (6 numbers), data (row-major).
TILE = T.StructType(
    [T.StructField("tile_row", T.IntegerType()), T.StructField("tile_col", T.IntegerType()), T.StructField("class_name", T.StringType())]
    + [T.StructField(n, T.IntegerType()) for n in ("h", "w", "valid_h", "valid_w")]
    + [T.StructField("transform", T.ArrayType(T.DoubleType())), T.StructField("data", T.ArrayType(T.FloatType()))]
)
REGIONS = "tile_row int, tile_col int, class_name string, confidence int, source string, geom binary, minx double, miny double, maxx double, maxy double, n_cells int, position int"


def window_confidence(prob: np.ndarray, t: Affine, box: tuple) -> int:
    """Mean positive probability in a box's window (see ``raster.mask_confidence``)."""
    inv = t.inverse()
    c0, r0 = inv.forward(box[0], box[3])
    c1, r1 = inv.forward(box[2], box[1])
    h, w = prob.shape
    a, b = max(0, math.floor(min(r0, r1))), min(h, math.floor(max(r0, r1)) + 1)
    c, d = max(0, math.floor(min(c0, c1))), min(w, math.floor(max(c0, c1)) + 1)
    if a >= b or c >= d:
        return 50
    part = prob[a:b, c:d]
    part = part[part > 0]
    mean = float(part.mean()) if part.size else 0.5
    return max(0, min(100, int(mean * 100)))


def regions(prob: np.ndarray, t: Affine, least: float = 0.5, close: bool = True) -> list[tuple[list, int, int]]:
    """(polygons in georeferenced coordinates, confidence, cells) of each region of a tile."""
    mask = prob >= least
    if not mask.any():
        return []
    if close:
        mask = g.binary_closing(mask)
    labels = g.label_regions(mask)
    out = []
    names, counts = np.unique(labels[labels > 0], return_counts=True)
    for name, n in zip(names.tolist(), counts.tolist()):
        rings = [[[t.forward(c, r) for c, r in ring] for ring in p] for p in g.trace(labels, name)]
        if g.why_invalid(rings) is not None:
            continue
        out.append((rings, window_confidence(prob, t, g.bounds(rings)), n))
    return out


def mask_polygons(tiles: DataFrame, least: float = 0.5, source: str = "mask", close: bool = True) -> DataFrame:
    """Detections of probability tiles; unregistered classes are left out.

    Each tile is one row, so a task holds one Arrow batch of tiles at a time. ``position``: the place
    among the regions of the tile and class, by their first cells.
    """

    def run(batches):
        for b in batches:
            out = []
            for row in b.to_pylist():
                prob = np.asarray(row["data"], np.float32).reshape(row["h"], row["w"]).copy()
                prob[row["valid_h"] :] = 0
                prob[:, row["valid_w"] :] = 0
                for k, (rings, conf, n) in enumerate(regions(prob, Affine(*row["transform"]), least, close)):
                    out.append((row["tile_row"], row["tile_col"], row["class_name"], conf, source, g.to_wkb(rings), *g.bounds(rings), n, k))
            if out:
                kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.binary(), *[pa.float64()] * 4, pa.int32(), pa.int32()]
                names = [c.split()[0] for c in REGIONS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    return tiles.where(F.col("class_name").isin(*CLASS_NAMES)).mapInArrow(run, REGIONS)


def tiles_from_pixels(dense: DataFrame, size: int, t: Affine, stride: int, class_name: str, value: str = "prob") -> DataFrame:
    """Dense long-form tiles (tile_row, tile_col, tr, tc, value, valid) as one row per tile."""
    cells = F.sort_array(F.collect_list(F.struct("tr", "tc", value)))
    rows = dense.groupBy("tile_row", "tile_col").agg(
        cells.alias("cells"), F.max(F.when(F.col("valid"), F.col("tr") + 1)).alias("valid_h"), F.max(F.when(F.col("valid"), F.col("tc") + 1)).alias("valid_w")
    )
    x, y = t.forward(F.col("tile_col") * stride, F.col("tile_row") * stride)
    lit = lambda v: F.lit(float(v))
    return rows.select(
        "tile_row", "tile_col", F.lit(class_name).alias("class_name"), F.lit(size).alias("h"), F.lit(size).alias("w"), "valid_h", "valid_w",
        F.array(lit(t.a), lit(t.b), x.cast("double"), lit(t.d), lit(t.e), y.cast("double")).alias("transform"),
        F.transform("cells", lambda c: c[value].cast("float")).alias("data"),
    )


def detect(tiles: DataFrame, models: list, least: float = 0.5) -> DataFrame:
    """Detections of image tiles by pluggable models, in the models' order.

    A model has ``source`` and ``predict(image: (bands, h, w) array) -> {class: (h, w) array}``; it
    is loaded on the executors by ``load()`` once a task. Tiles need ``bands`` beside TILE's columns.
    """
    schema = "tile_row int, tile_col int, class_name string, h int, w int, valid_h int, valid_w int, transform array<double>, data array<float>, part int"
    parts = []
    for k, model in enumerate(models):

        def run(batches, model=model, k=k):
            loaded = model.load() if hasattr(model, "load") else model
            for b in batches:
                out = []
                for r in b.to_pylist():
                    image = np.asarray(r["data"], np.float32).reshape(r["bands"], r["h"], r["w"])
                    for name, prob in loaded.predict(image).items():
                        out.append({c: r[c] for c in ("tile_row", "tile_col", "h", "w", "valid_h", "valid_w", "transform")} | {"class_name": name, "data": np.asarray(prob, np.float32).ravel(), "part": k})
                if out:
                    fields = [("tile_row", pa.int32()), ("tile_col", pa.int32()), ("class_name", pa.string()), ("h", pa.int32()), ("w", pa.int32()), ("valid_h", pa.int32()), ("valid_w", pa.int32()),
                              ("transform", pa.list_(pa.float64())), ("data", pa.list_(pa.float32())), ("part", pa.int32())]
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema(fields))

        parts.append(mask_polygons(tiles.mapInArrow(run, schema).drop("part"), least, model.source).withColumn("model", F.lit(k)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
