"""GeoTIFF as a Spark source: header rows, block rows and pixels, and a small writer.

Files are read through Spark's binaryFile source, so any file system that Spark reaches works,
and parsed without native libraries: strips and tiles, chunky or planar, uncompressed, Deflate,
PackBits or LZW, with or without the horizontal predictor, 8 to 64 bits.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import Affine
from ..operators.schema import UPLOAD_SUFFIXES

#: TIFF field types (code: struct letter and size) and tags; fixed by the format.
_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 16: ("Q", 8)}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, NODATA = 33550, 33922, 34264, 34735, 42113
HEADER = "path string, bands int, height int, width int, srid int, transform array<double>, nodata double"
BLOCKS = "path string, band int, row_off int, col_off int, h int, w int, data array<float>"


@dataclass
class Raster:
    """A decoded raster: (bands, height, width), transform and EPSG code (None: no reference system)."""

    data: np.ndarray
    transform: Affine
    srid: int | None
    nodata: float | None = None
    tags: dict = field(default_factory=dict)


def _tags(raw: bytes) -> tuple[str, dict]:
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if order is None or len(raw) < 8:
        raise ValueError("not a TIFF file")
    magic = struct.unpack_from(order + "H", raw, 2)[0]
    if magic == 42:
        at, n_size, entry, slot = struct.unpack_from(order + "I", raw, 4)[0], "H", 12, 4
    elif magic == 43:
        at, n_size, entry, slot = struct.unpack_from(order + "Q", raw, 8)[0], "Q", 20, 8
    else:
        raise ValueError("not a TIFF file")
    n = struct.unpack_from(order + n_size, raw, at)[0]
    at += struct.calcsize(n_size)
    out = {}
    for i in range(n):
        e = at + i * entry
        tag, kind = struct.unpack_from(order + "HH", raw, e)
        count = struct.unpack_from(order + ("I" if slot == 4 else "Q"), raw, e + 4)[0]
        if kind not in _TYPES:
            continue
        letter, size = _TYPES[kind]
        where = e + 4 + slot
        if count * size > slot:
            where = struct.unpack_from(order + ("I" if slot == 4 else "Q"), raw, where)[0]
        if letter == "s":
            out[tag] = raw[where : where + count].rstrip(b"\0").decode("latin-1")
        elif letter == "II":
            v = struct.unpack_from(f"{order}{2 * count}I", raw, where)
            out[tag] = tuple(a / b if b else 0.0 for a, b in zip(v[::2], v[1::2]))
        else:
            out[tag] = struct.unpack_from(f"{order}{count}{letter}", raw, where)
    return order, out


def _lzw(raw: bytes) -> bytes:
    out, table, width, bits, n, prev = bytearray(), [], 9, 0, 0, None
    for byte in raw:
        bits, n = (bits << 8) | byte, n + 8
        while n >= width:
            code = (bits >> (n - width)) & ((1 << width) - 1)
            n -= width
            bits &= (1 << n) - 1
            if code == 257:
                return bytes(out)
            if code == 256:
                table, width, prev = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
                continue
            if prev is None:
                entry = table[code]
            else:
                entry = table[code] if code < len(table) else prev + prev[:1]
                table.append(prev + entry[:1])
            out += entry
            prev = entry
            width = 12 if len(table) >= 2047 else 11 if len(table) >= 1023 else 10 if len(table) >= 511 else 9
    return bytes(out)


def _packbits(raw: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(raw):
        n = raw[i]
        if n < 128:
            out += raw[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += raw[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def _srid(keys: tuple) -> int | None:
    found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
    code = found.get(3072) or found.get(2048)
    return code if code and code != 32767 else None


def _geo(tags: dict) -> tuple[Affine, int | None]:
    if TRANSFORM in tags:
        m = tags[TRANSFORM]
        t = Affine(m[0], m[1], m[3], m[4], m[5], m[7])
    elif PIXEL_SCALE in tags and TIEPOINT in tags:
        sx, sy = tags[PIXEL_SCALE][:2]
        i, j, _, x, y, _ = tags[TIEPOINT][:6]
        t = Affine(sx, 0.0, x - i * sx, 0.0, -sy, y + j * sy)
    else:
        t = Affine(1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    return t, _srid(tags.get(GEO_KEYS, ()))


def decode(raw: bytes, require_srid: bool = True) -> Raster:
    """Parse a file. A raster without a reference system is an error unless allowed."""
    order, tags = _tags(raw)
    t, srid = _geo(tags)
    if srid is None and require_srid:
        raise ValueError("the raster has no coordinate reference system")
    w, h, bands = tags[WIDTH][0], tags[HEIGHT][0], tags.get(SAMPLES, (1,))[0]
    bits, form = tags.get(BITS, (1,))[0], tags.get(SAMPLE_FORMAT, (1,))[0]
    kind = np.dtype(order + {1: "u", 2: "i", 3: "f"}[form] + str(bits // 8))
    planar, how, predictor = tags.get(PLANAR, (1,))[0], tags.get(COMPRESSION, (1,))[0], tags.get(PREDICTOR, (1,))[0]
    unpack = {1: lambda b: b, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}.get(how)
    if unpack is None or predictor not in (1, 2):
        raise ValueError(f"unsupported compression {how} or predictor {predictor}")
    tiled = TILE_OFFSETS in tags
    bw, bh = (tags[TILE_WIDTH][0], tags[TILE_HEIGHT][0]) if tiled else (w, min(h, tags.get(ROWS_PER_STRIP, (h,))[0]))
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags[STRIP_OFFSETS], tags[STRIP_BYTES])
    across, down = -(-w // bw), -(-h // bh)
    per = bands if planar == 1 else 1
    out = np.zeros((bands, h, w), kind.newbyteorder("="))
    for k, (at, n) in enumerate(zip(offsets, sizes)):
        plane, place = divmod(k, across * down)
        y, x = (place // across) * bh, (place % across) * bw
        rows = bh if tiled else min(bh, h - y)
        block = np.frombuffer(unpack(raw[at : at + n]), kind, rows * bw * per).reshape(rows, bw, per).astype(out.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        part = block[: h - y, : w - x].transpose(2, 0, 1)
        lo = 0 if planar == 1 else plane
        out[lo : lo + per, y : y + part.shape[1], x : x + part.shape[2]] = part
    nodata = tags.get(NODATA)
    return Raster(out, t, srid, float(nodata) if nodata not in (None, "") else None, tags)


def encode(r: Raster, compress: bool = True) -> bytes:
    """A strip-organised, planar GeoTIFF."""
    bands, h, w = r.data.shape
    data = np.ascontiguousarray(r.data)
    form = {"u": 1, "i": 2, "f": 3}[data.dtype.kind]
    strips = [(zlib.compress if compress else bytes)(data[b].astype(data.dtype.newbyteorder("<")).tobytes()) for b in range(bands)]
    t = r.transform
    keys = [1, 1, 0, 2, 1024, 0, 1, 2 if r.srid == 4326 else 1, 2048 if r.srid == 4326 else 3072, 0, 1, r.srid or 32767]
    fields: list = [
        (WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [data.dtype.itemsize * 8] * bands), (COMPRESSION, 3, [8 if compress else 1]), (262, 3, [1]), (STRIP_OFFSETS, 4, None),
        (SAMPLES, 3, [bands]), (ROWS_PER_STRIP, 4, [h]), (STRIP_BYTES, 4, [len(s) for s in strips]), (PLANAR, 3, [2]), (SAMPLE_FORMAT, 3, [form] * bands),
        (TRANSFORM, 12, [t.a, t.b, 0.0, t.c, t.d, t.e, 0.0, t.f, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0]),
    ]
    if r.srid is not None:
        fields.append((GEO_KEYS, 3, keys))
    at = 8 + sum(map(len, strips))
    offsets, pos = [], 8
    for s in strips:
        offsets.append(pos)
        pos += len(s)
    head, extra, extra_at = [], b"", at + 2 + 12 * len(fields) + 4
    for tag, kind, values in fields:
        values = offsets if values is None else values
        letter, size = _TYPES[kind]
        raw = struct.pack(f"<{len(values)}{letter}", *values)
        if len(raw) <= 4:
            slot = raw.ljust(4, b"\0")
        else:
            slot = struct.pack("<I", extra_at + len(extra))
            extra += raw
        head.append(struct.pack("<HHI", tag, kind, len(values)) + slot)
    return struct.pack("<2sHI", b"II", 42, at) + b"".join(strips) + struct.pack("<H", len(fields)) + b"".join(head) + b"\0" * 4 + extra


def _files(spark: SparkSession, path: str) -> DataFrame:
    pattern = "(?i).*(" + "|".join(s.replace(".", "\\.") for s in UPLOAD_SUFFIXES[:2]) + ")$"
    return spark.read.format("binaryFile").load(path).where(F.col("path").rlike(pattern)).select("path", "content")


def headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: shape, EPSG code and transform."""

    def run(batches):
        for b in batches:
            out = []
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                _, tags = _tags(raw)
                t, srid = _geo(tags)
                if srid is None:
                    raise ValueError(f"{p}: the raster has no coordinate reference system")
                nodata = tags.get(NODATA)
                out.append((p, tags.get(SAMPLES, (1,))[0], tags[HEIGHT][0], tags[WIDTH][0], srid, [t.a, t.b, t.c, t.d, t.e, t.f], float(nodata) if nodata else None))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=[c.split()[0] for c in HEADER.split(", ")])

    return _files(spark, path).mapInArrow(run, HEADER)


def metadata(header: DataFrame) -> DataFrame:
    """Band count, EPSG code, bounds and resolution, by affine arithmetic on the header."""
    t = F.col("transform")
    x = lambda c, r: t[0] * c + t[1] * r + t[2]
    y = lambda c, r: t[3] * c + t[4] * r + t[5]
    w, h, zero = F.col("width"), F.col("height"), F.lit(0)
    xs = [x(zero, zero), x(w, zero), x(zero, h), x(w, h)]
    ys = [y(zero, zero), y(w, zero), y(zero, h), y(w, h)]
    return header.select(
        "path", F.col("bands").alias("band_count"), "srid", F.least(*xs).alias("left"), F.least(*ys).alias("bottom"), F.greatest(*xs).alias("right"), F.greatest(*ys).alias("top"),
        F.abs(t[0]).alias("res_x"), F.abs(t[4]).alias("res_y"),
    )


def blocks(spark: SparkSession, path: str, size: int = 512) -> DataFrame:
    """Bands cut in blocks of at most size x size, as float rows."""

    def run(batches):
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data = decode(raw).data
                for band in range(data.shape[0]):
                    for y in range(0, data.shape[1], size):
                        for x in range(0, data.shape[2], size):
                            part = data[band, y : y + size, x : x + size].astype(np.float32)
                            row = (p, band, y, x, part.shape[0], part.shape[1], part.ravel())
                            kinds = [pa.string(), *[pa.int32()] * 5, pa.list_(pa.float32())]
                            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=[c.split()[0] for c in BLOCKS.split(", ")])

    return _files(spark, path).mapInArrow(run, BLOCKS)


def pixels(block_rows: DataFrame) -> DataFrame:
    """Long form of blocks: path, band, r, c, value."""
    d = block_rows.select("path", "band", "row_off", "col_off", "w", F.posexplode("data").alias("k", "value"))
    return d.select("path", "band", (F.col("row_off") + F.floor(F.col("k") / F.col("w"))).alias("r"), (F.col("col_off") + F.col("k") % F.col("w")).alias("c"), "value")
