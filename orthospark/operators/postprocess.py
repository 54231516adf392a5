"""The post-processing chain, with the count after each step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import filters, nms
from .schema import Settings


def run(dets: DataFrame, settings: Settings, area_m2: Callable[[], Column], aoi: tuple | None = None) -> tuple[DataFrame, DataFrame]:
    """Suppression, confidence, size, shape, simplification, optional clip: (rows, stage counts).

    The order matters: suppression sees unfiltered detections. The result of suppression is
    materialised once; the later filters are one pass, and their counts are conditional sums of it.
    Boxes have no vertex to remove, so simplification keeps them (polygons: see geometry).
    """
    n_in = dets.count()
    kept = cut(nms.nms(dets, settings.nms_iou_threshold))
    area = area_m2()
    steps = [
        F.col("confidence") >= settings.confidence_threshold,
        (area > 0) & (area >= settings.min_area_m2) & (area <= settings.max_area_m2),
        F.coalesce(filters.boxes.aspect(filters.boxes.box()) <= 100.0, F.lit(False)),
    ]
    passed, flags = F.lit(True), []
    for s in steps:
        passed = passed & s
        flags.append(passed)
    out = kept.where(flags[-1])
    names = ["after_nms", "after_confidence_filter", "after_size_filter", "after_shape_filter", "after_simplify"]
    counts = [F.count(F.lit(1)), *[F.count_if(f) for f in flags], F.count_if(flags[-1])]
    if aoi is not None:
        out = filters.clip_to_box(out, aoi)
        a = tuple(F.lit(v) for v in aoi)
        i = filters.boxes.intersection(filters.boxes.box(), a)
        names.append("after_clip")
        counts.append(F.count_if(flags[-1] & (i[2] > i[0]) & (i[3] > i[1])))
    names.append("output_count")
    counts.append(counts[-1])
    wide = kept.agg(*[c.alias(n) for n, c in zip(names, counts)]).withColumn("input_count", F.lit(n_in).cast("long"))
    pairs = F.array(*[F.struct(F.lit(n).alias("stage"), F.col(n).cast("long").alias("n")) for n in ["input_count", *names]])
    return out, wide.select(F.inline(pairs))
