"""Command line: ``python -m orthospark process|evaluate|search``."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.schema import Settings
from .plans import workflow
from .sources import stac


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="orthospark")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("process", help="class masks (a GeoTIFF with a band per class) to detections and indicators")
    a.add_argument("--input", required=True)
    a.add_argument("--classes", required=True, help="names of the bands, separated by commas")
    a.add_argument("--output", required=True)
    a.add_argument("--aoi")
    a.add_argument("--tile-size", type=int, default=512)
    a.add_argument("--tile-overlap", type=int, default=64)
    a.add_argument("--no-resume", action="store_true")
    a = sub.add_parser("evaluate", help="GeoJSON detections against GeoJSON ground truth")
    a.add_argument("--predictions", "-p", required=True)
    a.add_argument("--ground-truth", "-g", required=True)
    a.add_argument("--iou", type=float, default=0.5)
    a.add_argument("--output", "-o")
    a.add_argument("--sample", type=int, default=0)
    a = sub.add_parser("search", help="items of a catalogue in JSON lines")
    a.add_argument("--items", required=True)
    a.add_argument("--bbox", required=True, help="west,south,east,north")
    a.add_argument("--datetime", required=True, help="from/to")
    a.add_argument("--collection")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict | list:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("orthospark").getOrCreate()
    if args.command == "process":
        s = Settings(tile_size=args.tile_size, tile_overlap=args.tile_overlap)
        return workflow.process(spark, args.input, args.classes.split(","), args.output, s, args.aoi, resume=not args.no_resume)
    if args.command == "evaluate":
        report = workflow.evaluate(spark, args.predictions, args.ground_truth, args.iou, args.sample)
        if args.output:
            Path(args.output).write_text(json.dumps(report, indent=2, ensure_ascii=False))
        return report
    items = spark.read.schema(stac.ITEM).json(args.items)
    found = stac.require_items(stac.search(items, stac.parse_bbox(args.bbox), args.datetime, args.collection))
    return [r.asDict() for r in found.withColumn("datetime", F.col("datetime").cast("string")).collect()]


if __name__ == "__main__":
    print(json.dumps(main(), indent=2, ensure_ascii=False))
