"""Guards of files that come in and go out."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import Path

from ..operators.schema import UPLOAD_SUFFIXES

MOST_BYTES = 2 << 30
DOWNLOAD_FORMATS = ("geojson", "gpkg", "shp")


def accept(name: str, chunks: Iterable[bytes], folder: str, most: int = MOST_BYTES) -> str:
    """Write an uploaded raster; a wrong suffix or an overflow is an error and leaves no file."""
    if Path(name).suffix.lower() not in UPLOAD_SUFFIXES:
        raise ValueError(f"only {', '.join(UPLOAD_SUFFIXES)} files are taken")
    Path(folder).mkdir(parents=True, exist_ok=True)
    path, size = Path(folder) / Path(name).name, 0
    try:
        with open(path, "wb") as f:
            for c in chunks:
                size += len(c)
                if size > most:
                    raise ValueError(f"more than {most} bytes")
                f.write(c)
    except BaseException:
        path.unlink(missing_ok=True)
        raise
    return str(path)


def result_file(root: str, job_id: str, fmt: str, status: str) -> Path:
    """The file of a finished job's export; never one outside ``root``."""
    if status != "COMPLETED":
        raise ValueError(f"the job is {status}")
    if fmt not in DOWNLOAD_FORMATS:
        raise ValueError(f"no such format: {fmt}")
    base = Path(root).resolve()
    path = (base / job_id / f"detections.{fmt}").resolve()
    if not path.is_relative_to(base):
        raise PermissionError("the path leaves the output folder")
    if not path.exists():
        raise FileNotFoundError(str(path))
    return path
