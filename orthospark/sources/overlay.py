"""A PNG of a raster with detection outlines and a legend, without a plotting library."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..operators.raster import Affine

#: Outline colours by class; others take the last.
COLORS = {"building": (230, 60, 50), "road": (240, 200, 40), "vegetation": (60, 170, 70), "water": (50, 110, 220), "": (200, 60, 200)}


def normalize(data: np.ndarray) -> np.ndarray:
    """(h, w, 3) in 0..1: the first three bands, or one band three times.

    If any value exceeds 1, each band is stretched between the 2nd and 98th percentile of its
    positive values; a flat band gives 0.
    """
    bands = data[:3] if data.shape[0] >= 3 else np.repeat(data[:1], 3, axis=0)
    image = bands.astype(np.float32).transpose(1, 2, 0).copy()
    if image.size and image.max() > 1:
        for k in range(3):
            band = image[..., k]
            positive = band[band > 0]
            lo, hi = np.percentile(positive, [2, 98]) if positive.size else (0.0, 1.0)
            image[..., k] = np.clip((band - lo) / (hi - lo), 0, 1) if hi > lo else 0
    return np.clip(image, 0, 1)


def _segment(image: np.ndarray, a: tuple, b: tuple, color: tuple) -> None:
    n = int(max(abs(b[0] - a[0]), abs(b[1] - a[1]), 1)) * 2 + 1
    x = np.floor(np.linspace(a[0], b[0], n)).astype(int)
    y = np.floor(np.linspace(a[1], b[1], n)).astype(int)
    ok = (x >= 0) & (y >= 0) & (x < image.shape[1]) & (y < image.shape[0])
    image[y[ok], x[ok]] = color


def render(data: np.ndarray, t: Affine, detections: list[tuple[str, list]], legend: bool = True) -> np.ndarray:
    """uint8 image: the raster, outlines of (class_name, polygons), and a swatch of each class that occurs."""
    image = (normalize(data) * 255).astype(np.uint8)
    inv = t.inverse()
    for name, polygons in detections:
        for ring in (r for p in polygons for r in p):
            px = [inv.forward(x, y) for x, y in ring]
            for a, b in zip(px, px[1:]):
                _segment(image, a, b, COLORS.get(name, COLORS[""]))
    if legend:
        for k, name in enumerate(sorted({n for n, _ in detections})):
            image[2 + 6 * k : 6 + 6 * k, 2:10] = COLORS.get(name, COLORS[""])
    return image


def write_png(image: np.ndarray, path: str) -> str:
    h, w, _ = image.shape
    rows = np.concatenate([np.zeros((h, 1), np.uint8), image.reshape(h, w * 3)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    with open(path, "wb") as f:
        f.write(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">2I5B", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b""))
    return path
