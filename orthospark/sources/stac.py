"""Catalogue items: search (filter and order), and download of an asset.

Items: id, collection, datetime, west, south, east, north, assets (map of href).
"""

from __future__ import annotations

import shutil
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEM = "id string, collection string, datetime timestamp, west double, south double, east double, north double, assets map<string, string>"


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """``west,south,east,north``."""
    parts = [float(x) for x in text.split(",")]
    if len(parts) != 4:
        raise ValueError("a bounding box has four numbers")
    return tuple(parts)


def search(items: DataFrame, bbox: tuple, datetime_range: str, collection: str | None = None) -> DataFrame:
    """Items whose box meets ``bbox`` in the range (``from/to``, ``..`` open), newest first, undated last."""
    west, south, east, north = bbox
    start, _, end = datetime_range.partition("/")
    end = end or start
    out = items.where((F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south))
    if start not in ("", ".."):
        out = out.where(F.col("datetime") >= F.lit(start).cast("timestamp"))
    if end not in ("", ".."):
        day = len(end) == 10
        limit = F.lit(end).cast("timestamp")
        out = out.where(F.col("datetime") < limit + F.expr("INTERVAL 1 DAY") if day else F.col("datetime") <= limit)
    if collection:
        out = out.where(F.col("collection") == collection)
    return out.orderBy(F.col("datetime").desc_nulls_last(), "id")


def require_items(found: DataFrame) -> DataFrame:
    """The items; none is an error."""
    if found.isEmpty():
        raise RuntimeError("no item matches the search")
    return found


def download(item: dict, folder: str, asset: str, chunk: int = 8192) -> str:
    """Stream one asset of an item to ``<id>_<asset>.tif`` below ``folder``."""
    assets = item["assets"]
    if asset not in assets:
        raise ValueError(f"no asset {asset!r}; there are {', '.join(sorted(assets))}")
    Path(folder).mkdir(parents=True, exist_ok=True)
    target = Path(folder) / f"{item['id']}_{asset}.tif"
    with urllib.request.urlopen(assets[asset], timeout=60) as src, open(target, "wb") as dst:
        shutil.copyfileobj(src, dst, chunk)
    return str(target)
