import math
import sqlite3
import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthospark.functions import geodesic, geometry as g, projections as pj
from orthospark.operators import raster, vectorize
from orthospark.operators.schema import Settings
from orthospark.plans import jobs, pipeline
from orthospark.sources import geotiff, stac, tables, vector
from orthospark.streaming import tiles as stream


def test_projections():
    x, y = pj.reproject(pj.NUMPY, np.array([3.0]), np.array([45.0]), 4326, 32631)
    assert (x[0], y[0]) == (pytest.approx(500000.0, abs=1e-6), pytest.approx(0.9996 * 4984944.378, abs=1e-3))  # the meridian's length to 45 degrees
    lon, lat = np.array([3.0, 5.9, 0.1]), np.array([0.0, 83.0, 45.0])
    for srid in (32631, 3857):
        a, b = pj.reproject(pj.NUMPY, *pj.reproject(pj.NUMPY, lon, lat, 4326, srid), srid, 4326)
        assert a == pytest.approx(lon, abs=1e-9) and b == pytest.approx(lat, abs=1e-9)
    x, y = pj.reproject(pj.NUMPY, np.array([3.0]), np.array([-45.0]), 4326, 32731)
    assert x[0] == pytest.approx(500000) and 0 < y[0] < 10_000_000
    with pytest.raises(ValueError):
        pj.reproject(pj.NUMPY, lon, lat, 4326, 27700)
    moved = pj.reproject_polygons(pj.reproject_polygons(g.box(10, 49, 11, 50), 4326, 3857), 3857, 4326)
    assert np.allclose(moved, g.box(10, 49, 11, 50))


def test_raster_clip_by_area(spark):
    px = spark.range(100).select(F.floor(F.col("id") / 10).alias("r"), (F.col("id") % 10).alias("c"), F.lit(1.0).alias("v"))
    t = raster.Affine.from_bounds(10.0, 49.0, 10.1, 49.1, 10, 10)
    triangle = [[[(10.02, 49.02), (10.08, 49.02), (10.02, 49.08), (10.02, 49.02)]]]
    out = raster.clip_to_polygon(px, t, pj.reproject_polygons(triangle, 4326, 3857), 3857, 4326, 10, 10).collect()
    assert max(r.r for r in out) <= 6 and 20 <= sum(r.v for r in out) <= 35
    with pytest.raises(ValueError):
        raster.clip_to_polygon(px, t, g.box(0, 0, 1, 1), 4326, 4326, 10, 10)


def test_tile_grid_of_a_square(spark):
    t = raster.tile_grid(spark, 1000, 1000, 512, 64).collect()
    assert len(t) == 9
    assert {(r.row_off, r.valid_h) for r in t} == {(0, 512), (448, 512), (896, 104)}
    assert raster.tile_grid(spark, 256, 256, 512, 64).count() == 1
    assert raster.tile_grid(spark, 512, 512, 512, 64).count() == 4  # trailing tiles repeat the overlap
    with pytest.raises(ValueError):
        raster.tile_grid(spark, 10, 10, 8, 8)


def test_affine():
    t = raster.Affine.from_bounds(10.0, 49.9, 10.1, 50.0, 100, 100)
    assert t.forward(0, 0) == (10.0, 50.0)
    c, r = t.inverse().forward(*t.forward(17, 31))
    assert (c, r) == (pytest.approx(17), pytest.approx(31))
    assert t.bounds(100, 100) == pytest.approx((10.0, 49.9, 10.1, 50.0))


def slow_closing(m):
    h, w = m.shape
    at = lambda a, i, j: bool(a[i, j]) if 0 <= i < h and 0 <= j < w else False
    near = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    d = np.array([[any(at(m, i + a, j + b) for a, b in near) for j in range(w)] for i in range(h)])
    return np.array([[all(at(d, i + a, j + b) for a, b in near) for j in range(w)] for i in range(h)])


def test_closing_forms_agree(spark):
    rng = np.random.default_rng(0)
    m = rng.random((12, 12)) > 0.6
    want = slow_closing(m)
    assert (g.binary_closing(m) == want).all()
    rows = [(0, 0, i, j, int(m[i, j])) for i in range(12) for j in range(12)]
    d = spark.createDataFrame(rows, "tile_row int, tile_col int, tr int, tc int, mask int")
    got = {(r.tr, r.tc): r.closed for r in raster.closing(d).collect()}
    assert all(got[i, j] == want[i, j] for i in range(12) for j in range(12))


def test_regions_are_traced_with_holes_and_corners():
    m = np.array(
        [[1, 1, 1, 1, 0, 0], [1, 0, 0, 1, 0, 1], [1, 0, 1, 1, 0, 0], [1, 1, 1, 0, 1, 0], [0, 0, 0, 1, 1, 0]], bool
    )
    lab = g.label_regions(m)
    names = [x for x in np.unique(lab) if x]
    assert len(names) == 3
    for name in names:
        polygons = g.trace(lab, name)
        assert len(polygons) == 1 and g.why_invalid(polygons) is None or name == names[0]
        assert g.area(polygons) == (lab == name).sum()
    assert len(g.trace(lab, names[0])[0]) == 2  # one hole


@pytest.mark.parametrize("seed", range(5))
def test_traced_area_equals_cell_count(seed):
    m = np.random.default_rng(seed).random((16, 16)) > 0.45
    lab = g.label_regions(m)
    for name in np.unique(lab[lab > 0]):
        p = g.trace(lab, name)
        assert g.area(p) == (lab == name).sum()
        ys, xs = np.nonzero(lab == name)
        assert g.bounds(p) == (xs.min(), ys.min(), xs.max() + 1, ys.max() + 1)


def tile_rows(spark, prob, class_name="building", **over):
    h, w = prob.shape
    t = raster.Affine.from_bounds(10.0, 49.0, 10.1, 49.1, w, h)
    row = {"tile_row": 0, "tile_col": 0, "class_name": class_name, "h": h, "w": w, "valid_h": h, "valid_w": w, "transform": [t.a, t.b, t.c, t.d, t.e, t.f], "data": prob.ravel().tolist()} | over
    return spark.createDataFrame([tuple(row.values())], vectorize.TILE)


def test_masks_become_detections(spark):
    prob = np.zeros((64, 64), np.float32)
    prob[10:20, 10:20], prob[40:50, 30:50] = 0.9, 0.7
    out = vectorize.mask_polygons(tile_rows(spark, prob)).orderBy("n_cells").collect()
    assert [r.n_cells for r in out] == [100, 200] and [r.confidence for r in out] == [89, 69]
    assert all(g.why_invalid(g.from_wkb(bytes(r.geom))) is None for r in out)
    assert vectorize.mask_polygons(tile_rows(spark, prob, "cloud")).count() == 0
    assert vectorize.mask_polygons(tile_rows(spark, prob * 0.5)).count() == 0
    assert vectorize.mask_polygons(tile_rows(spark, prob, valid_h=30)).count() == 1  # padding is masked


def test_models_are_pluggable(spark):
    class Bright:
        source = "bright"

        def predict(self, image):
            return {"building": image[0], "water": image[1]}

    image = np.zeros((2, 32, 32), np.float32)
    image[0, 4:10, 4:10], image[1, 20:25, 20:25] = 0.9, 0.8
    t = [0.001, 0.0, 10.0, 0.0, -0.001, 50.0]
    df = spark.createDataFrame([(0, 0, 2, 32, 32, 32, 32, t, image.ravel().tolist())], "tile_row int, tile_col int, bands int, h int, w int, valid_h int, valid_w int, transform array<double>, data array<float>")
    out = vectorize.detect(df, [Bright()]).collect()
    assert {(r.class_name, r.source, r.n_cells) for r in out} == {("building", "bright", 36), ("water", "bright", 25)}


def test_stretches(spark):
    d = spark.createDataFrame([(0, float(v)) for v in range(0, 101)] + [(1, 5.0)] * 3, "band int, value double")
    s = raster.percentile_stretch(d).collect()
    v = np.arange(1, 101)
    lo, hi = np.percentile(v, [2, 98])
    for r in s:
        want = 0.0 if r.band == 1 else min(1.0, max(0.0, (r.value - lo) / (hi - lo)))
        assert r.stretched == pytest.approx(want)
    same = raster.minmax_uint8(spark.createDataFrame([(3.0,)] * 4, "value double")).collect()
    assert {r.byte for r in same} == {0}
    b = raster.minmax_uint8(spark.createDataFrame([(0.0,), (0.5,), (1.0,)], "value double")).collect()
    assert sorted(r.byte for r in b) == [0, 127, 255]
    p = raster.softmax(spark.createDataFrame([([1.0, 2.0, 3.0],)], "channels array<double>")).first().probs
    e = np.exp([1, 2, 3])
    assert p == pytest.approx((e / e.sum())[1:].tolist())


# ---- geometry


OCTANT = geodesic.ring_area([0, 90, 0], [0, 0, 90])


def test_geodesic_areas():
    total = 510065621724088.44  # the WGS84 ellipsoid, a published constant
    assert OCTANT == pytest.approx(total / 8, rel=1e-9)
    # a thin quadrangle: geodesic edges and parallels agree, and so must the closed form
    b, e2 = 6378137.0 * (1 - 1 / 298.257223563), (2 - 1 / 298.257223563) / 298.257223563
    e = math.sqrt(e2)
    q = lambda y: (lambda s: s / (1 - e2 * s * s) + math.log((1 + e * s) / (1 - e * s)) / (2 * e))(math.sin(math.radians(y)))
    want = b * b / 2 * math.radians(0.001) * (q(49.001) - q(49.0))
    assert geodesic.ring_area([10, 10.001, 10.001, 10], [49, 49, 49.001, 49.001]) == pytest.approx(want, rel=1e-6)
    ring = [(10, 49), (10.2, 49), (10.2, 49.1), (10, 49.1), (10, 49)]
    hole = [(10.05, 49.02), (10.1, 49.02), (10.1, 49.05), (10.05, 49.05), (10.05, 49.02)]
    assert geodesic.polygon_area([[ring, hole]]) == pytest.approx(geodesic.polygon_area([[ring]]) - geodesic.polygon_area([[hole]]))
    assert geodesic.ring_area([179.9, -179.9, -179.9, 179.9], [0, 0, 0.1, 0.1]) == pytest.approx(geodesic.ring_area([-0.1, 0.1, 0.1, -0.1], [0, 0, 0.1, 0.1]), rel=1e-9)
    assert geodesic.ring_area([1, 2], [1, 2]) == 0.0


def test_codecs_round_trip():
    p = [[[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 0.0)]], [[(10.5, 0.25), (12.0, 0.0), (11.0, 3.0), (10.5, 0.25)], [(10.9, 0.5), (11.2, 0.5), (11.0, 1.0), (10.9, 0.5)]]]
    for x in (p, p[:1], p[1:]):
        assert g.from_wkb(g.to_wkb(x)) == x and g.from_wkt(g.to_wkt(x)) == x and g.from_geojson(g.to_geojson(x)) == x
    big = struct.pack(">BII", 0, 3, 1) + struct.pack(">I", 4) + struct.pack(">8d", 0, 0, 4, 0, 4, 4, 0, 0)
    assert g.from_wkb(big) == p[:1] and g.wkb_type(big) == 3
    with pytest.raises(ValueError):
        g.from_wkb(struct.pack("<BI2d", 1, 1, 1.0, 2.0))


def test_validity():
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    assert g.why_invalid([[square]]) is None
    assert g.why_invalid([[square, [(1, 1), (2, 1), (2, 2), (1, 1)]]]) is None
    for bad in (
        [], [[]], [[[(0, 0), (1, 1), (0, 0)]]], [[[(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]]], [[square, [(5, 5), (6, 5), (6, 6), (5, 5)]]],
        [[[(0, 0), (4, 0), (float("nan"), 4), (0, 0)]]], [[[(0, 0), (4, 0), (8, 0), (0, 0)]]],
    ):
        assert g.why_invalid(bad) is not None


def test_overlap_areas():
    rng = np.random.default_rng(1)
    u = [[[(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6), (0, 0)]]]  # a U
    assert g.intersection_area(u, g.box(0, 3, 6, 5)) == pytest.approx(8)
    assert g.intersection_area(u, u) == pytest.approx(g.area(u))
    ring = [[[(0, 0), (6, 0), (6, 6), (0, 6), (0, 0)], [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]]]
    assert g.intersection_area(ring, g.box(1, 1, 5, 5)) == pytest.approx(12)
    for _ in range(20):
        t = np.sort(rng.random(7) * 2 * math.pi)
        star = [[g.closed([(5 + r * math.cos(a), 5 + r * math.sin(a)) for a, r in zip(t, 2 + rng.random(7) * 3)])]]
        b = g.box(*np.sort(rng.random(2) * 10)[:1], 1.0, 9.0, 6.5)
        assert g.intersection_area(star, b) == pytest.approx(g.area(g.clip(star, b)), abs=1e-9)
    assert g.iou(g.box(0, 0, 2, 2), g.box(1, 0, 3, 2)) == pytest.approx(1 / 3)
    assert g.iou(g.box(0, 0, 1, 1), g.box(1, 0, 2, 1)) == 0
    assert g.area(g.clip(u, u)) == pytest.approx(g.area(u))


def _random_polygon(rng, n):
    """Any closed ring, mostly self-crossing."""
    return [[g.closed([tuple(p) for p in rng.random((n, 2)) * 10])]]


@pytest.mark.parametrize("seed", range(25))
def test_overlay_is_valid_and_has_the_area(seed):
    rng = np.random.default_rng(seed)
    a, b = g.make_valid(_random_polygon(rng, 5 + seed % 6)), g.make_valid(_random_polygon(rng, 4 + seed % 5))
    for x in (a, b):
        assert all(g.why_invalid([p]) is None for p in x), g.why_invalid(x)
    both = g.intersection(a, b)
    assert all(g.why_invalid([p]) is None for p in both)
    assert g.area(both) == pytest.approx(g.intersection_area(a, b), rel=1e-6, abs=1e-7)
    either = g.overlay(a, b, lambda x, y: x or y)
    assert g.area(either) == pytest.approx(g.area(a) + g.area(b) - g.area(both), rel=1e-6, abs=1e-6)


def test_overlay_of_simple_shapes():
    bow = [[[(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]]]
    fixed = g.make_valid(bow)
    assert len(fixed) == 2 and g.area(fixed) == pytest.approx(8)
    ring = [[[(0, 0), (6, 0), (6, 6), (0, 6), (0, 0)], [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]]]
    cut = g.clip(ring, ring)
    assert len(cut) == 1 and len(cut[0]) == 2 and g.area(cut) == 32
    assert g.intersection(g.box(0, 0, 1, 1), g.box(1, 0, 2, 1)) == [] and g.intersection(g.box(0, 0, 1, 1), g.box(5, 5, 6, 6)) == []
    assert g.overlay(g.box(0, 0, 1, 1), g.box(1, 0, 2, 1), lambda x, y: x or y) == [[[(0, 0), (2, 0), (2, 1), (0, 1), (0, 0)]]]
    two = g.intersection([[[(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6), (0, 0)]]], g.box(0, 3, 6, 5))
    assert len(two) == 2 and g.area(two) == 8


def test_simplify_keeps_validity():
    ring = g.closed([(math.cos(a) * (1 + 0.001 * (-1) ** k), math.sin(a) * (1 + 0.001 * (-1) ** k)) for k, a in enumerate(np.linspace(0, 2 * math.pi, 200, endpoint=False))])
    s = g.simplify([[ring]], 0.01)
    assert len(s[0][0]) < 60 and g.why_invalid(s) is None
    assert g.area(s) == pytest.approx(g.area([[ring]]), rel=0.02)
    assert g.simplify(g.box(0, 0, 1, 1), 0.1) == g.box(0, 0, 1, 1)


# ---- files


@pytest.mark.parametrize("kind", ["<f4", "<u1", "<i2", "<f8"])
@pytest.mark.parametrize("compress", [True, False])
def test_geotiff_round_trip(kind, compress):
    data = (np.arange(2 * 7 * 5) % 120).reshape(2, 7, 5).astype(kind)
    r = geotiff.decode(geotiff.encode(geotiff.Raster(data, raster.Affine(0.5, 0, 10, 0, -0.5, 50), 4326), compress))
    assert (r.data == data).all() and r.srid == 4326 and r.transform == raster.Affine(0.5, 0, 10, 0, -0.5, 50)


def test_geotiff_needs_a_reference_system_and_reads_variants():
    raw = geotiff.encode(geotiff.Raster(np.zeros((1, 2, 2), "u1"), raster.Affine(1, 0, 0, 0, -1, 0), None))
    with pytest.raises(ValueError):
        geotiff.decode(raw)
    assert geotiff.decode(raw, require_srid=False).srid is None
    with pytest.raises(ValueError):
        geotiff.decode(b"not a tiff at all")
    assert geotiff._packbits(bytes([2, 1, 2, 3, 254, 9])) == bytes([1, 2, 3, 9, 9, 9])
    # clear, 'A', 'B', 'A B' from the table, end; codes of 9 bits
    codes, bits = [256, 65, 66, 258, 257], ""
    for c in codes:
        bits += f"{c:09b}"
    bits = bits.ljust(-(-len(bits) // 8) * 8, "0")
    assert geotiff._lzw(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))) == b"ABAB"


def test_geotiff_source(spark, tmp_path):
    data = np.arange(600, dtype=np.float32).reshape(1, 20, 30)
    (tmp_path / "a.tif").write_bytes(geotiff.encode(geotiff.Raster(data, raster.Affine(0.5, 0, 10, 0, -0.25, 50), 4326)))
    (tmp_path / "b.txt").write_text("no raster")
    head = geotiff.headers(spark, str(tmp_path))
    assert head.count() == 1
    m = geotiff.metadata(head).first()
    assert (m.band_count, m.srid, m.left, m.bottom, m.right, m.top, m.res_x, m.res_y) == (1, 4326, 10.0, 45.0, 25.0, 50.0, 0.5, 0.25)
    px = geotiff.pixels(geotiff.blocks(spark, str(tmp_path), 8)).collect()
    assert {(r.r, r.c): r.value for r in px} == {(i, j): float(i * 30 + j) for i in range(20) for j in range(30)}


@pytest.fixture()
def rows(spark):
    data = [(i, "road" if i % 2 else "building", 50 + i, "t", g.to_wkb(g.box(10 + i, 49, 10.5 + i, 49.5)), 1.5 * i) for i in range(5)]
    return spark.createDataFrame(data, "id long, class_name string, confidence int, source string, geom binary, area_m2 double")


def test_vector_files(spark, rows, tmp_path):
    paths = vector.write_all(rows, str(tmp_path / "out"))
    back = vector.read_geojson(spark, paths["geojson"]).orderBy("ord").collect()
    want = rows.orderBy("id").collect()
    assert [(r.class_name, r.confidence, r.source, bytes(r.geom)) for r in back] == [(r.class_name, r.confidence, r.source, bytes(r.geom)) for r in want]
    with sqlite3.connect(paths["gpkg"]) as db:
        found = db.execute("SELECT id, class_name, geom FROM detections ORDER BY id").fetchall()
        assert db.execute("SELECT min_x, max_x, srs_id FROM gpkg_contents").fetchone() == (10.0, 14.5, 4326)
    assert [(i, c) for i, c, _ in found] == [(r.id, r.class_name) for r in want]
    assert all(x[:2] == b"GP" and x[40:] == bytes(r.geom) for (_, _, x), r in zip(found, want))
    shp = Path(paths["shp"]).read_bytes()
    assert struct.unpack(">i", shp[:4])[0] == 9994 and struct.unpack(">i", shp[24:28])[0] * 2 == len(shp)
    assert struct.unpack_from("<4d", shp, 36) == (10.0, 49.0, 14.5, 49.5)
    ring = struct.unpack_from("<10d", shp, 100 + 8 + 4 + 32 + 8 + 4)
    assert g.signed_area(list(zip(ring[::2], ring[1::2]))) < 0  # shells go clockwise
    dbf = Path(paths["shp"]).with_suffix(".dbf").read_bytes()
    assert struct.unpack_from("<I", dbf, 4)[0] == 5
    none = vector.write_all(rows.limit(0), str(tmp_path / "none"))
    assert vector.read_geojson(spark, none["geojson"]).count() == 0


def test_geojson_is_written_and_read_off_the_driver(spark, monkeypatch, tmp_path):
    import json

    from orthospark.plans import catalog, catalog_more  # noqa: F401

    names = ['a "b",', "c\n},", "\u2028\u00e9", None]
    data = [(k, names[k % 4], k % 101 if k % 5 else None, "s", g.to_wkb(g.box(10 + k, 49, 10.5 + k, 49.5) * (1 + k % 2)), k / 3) for k in range(200)]
    df = spark.createDataFrame(data[::-1], "id long, class_name string, confidence int, source string, geom binary, area_m2 double").repartition(7)

    def none(*_, **__):
        raise AssertionError("rows on the driver")

    with monkeypatch.context() as m:
        m.setattr(type(df), "toLocalIterator", none)
        m.setattr(Path, "read_text", none)
        here = vector.write_geojson(df, str(tmp_path / "a b[1].geojson"))
        there = vector.write_geojson(df, f"file:{tmp_path}/c.geojson")
        empty = vector.write_geojson(df.limit(0), str(tmp_path / "empty.geojson"))
        sink = catalog.Q["geojson_sink"](spark, "/root/testdata/sf0.001")
    features = [json.dumps({"type": "Feature", "properties": dict(zip(vector.FIELDS, (*r[:4], r[5]))), "geometry": json.loads(g.to_geojson(g.from_wkb(r[4])))}, ensure_ascii=False, separators=(",", ":")) for r in data]
    want = '{"type":"FeatureCollection","features":[\n' + ",\n".join(features) + "\n]}\n"
    assert Path(here).read_bytes() == want.encode() == (tmp_path / "c.geojson").read_bytes()
    assert Path(empty).read_text() == '{"type":"FeatureCollection","features":[\n]}\n'
    assert sum(r.n for r in sink.collect()) == 1000


def test_large_geojson_is_read_line_by_line(spark, tmp_path):
    import json

    def feature(k, **more):
        ring = [[k, 0], [k + 1, 0], [k + 1, 1], [k, 0]]
        return {"type": "Feature", "properties": {"class_name": f'"{k}}}],[{{', "confidence": k, **more}, "geometry": {"type": "Polygon", "coordinates": [ring]}}

    every = [feature(k) for k in range(60)]
    lines = [json.dumps(f) for f in every]
    start = '{"type": "FeatureCollection", "features": ['
    layouts = {
        "ours": (start + "\n" + ",\n".join(lines) + "\n]}\n", True),
        "gdal": ('{\r\n"type": "FeatureCollection",\r\n"crs": { "type": "name", "properties": {} },\r\n"features": [\r\n' + " ,\r\n".join(lines) + '\r\n],\r\n"bbox": [0, 0, 1, 1]\r\n}\r\n', True),
        "one": (start + "\n" + lines[0] + "\n]}", True),
        "odd_value": (start + "\n" + ",\n".join(json.dumps(feature(k, source=[k])) for k in range(9)) + "\n]}", True),
        "compact": (json.dumps({"type": "FeatureCollection", "features": every}), False),
        "indented": (json.dumps({"type": "FeatureCollection", "features": every}, indent=1), False),
        "indented_one": (json.dumps({"type": "FeatureCollection", "features": every[:1]}, indent=1), False),
        "gaps": (start + "\n" + ",\n\n".join(lines) + "\n]}", False),
        "pairs": (start + "\n" + ",\n".join(f"{a},{b}" for a, b in zip(lines[::2], lines[1::2])) + "\n]}", False),
        "elsewhere": ('{"features": [], "links": [\n' + ",\n".join(lines) + "\n]}", False),
        "nested": ('{"features": [{"type": "Feature", "more": [\n' + ",\n".join(lines) + "\n]}]}", False),
        "joined": (start + lines[0] + ",\n" + ",\n".join(lines[1:]) + "]}", False),
    }
    for name, (text, _) in layouts.items():
        (tmp_path / f"{name} %.geojson").write_bytes(text.encode())
    rows = lambda d: [tuple(r) for r in d.select("ord", "class_name", "confidence", "source", "geom").orderBy("ord").collect()]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(old, ("3000", "100")):
            spark.conf.set(k, v)
        lined = [f.rsplit("/", 1)[1] for f in vector._lined(spark, str(tmp_path), 0)]
        assert sorted(lined) == sorted(f"{name}%20%25.geojson" for name, (_, yes) in layouts.items() if yes)
        got = rows(vector.read_geojson(spark, str(tmp_path), whole=0))
        parts = vector.read_geojson(spark, str(tmp_path / "ours %.geojson"), whole=0).rdd.getNumPartitions()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    want = rows(vector.read_geojson(spark, str(tmp_path)))
    assert got == want and [r[0] for r in want] == list(range(len(want))) and parts > 2
    assert len(want) == 7 * 60 + 9 + 1 + 1 + 1  # "elsewhere" has none, "nested" one


def test_geojson_defaults(spark, tmp_path):
    text = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"class":"water","confidence":0,"source":""},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}},{"type":"Feature","properties":{},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}]}'
    (tmp_path / "t.geojson").write_text(text)
    got = [(r.class_name, r.confidence, r.source) for r in vector.read_geojson(spark, str(tmp_path / "t.geojson")).orderBy("ord").collect()]
    assert got == [("water", 0, "ground_truth"), ("unknown", 100, "ground_truth")]
    old = vector.read_geojson(spark, str(tmp_path / "t.geojson"), legacy=True).orderBy("ord").first()
    assert old.confidence == 100
    (tmp_path / "aoi.json").write_text('{"type":"Polygon","coordinates":[[[0,0],[4,4],[4,0],[0,4],[0,0]]]}')
    with pytest.raises(ValueError):
        vector.read_aoi(str(tmp_path / "aoi.json"))


def test_catalogue_search(spark, tmp_path):
    import datetime as dt

    item = lambda i, day, west: (i, "c", day and dt.datetime(2024, 1, day), west, 0.0, west + 1, 1.0, {"visual": f"file://{tmp_path}/src.bin"})
    items = spark.createDataFrame([item("a", 5, 0.0), item("b", 9, 0.5), item("c", 7, 50.0), item("d", None, 0.0)], stac.ITEM)
    found = stac.search(items, (0.2, 0.2, 0.8, 0.8), "2024-01-01/2024-01-09", "c")
    assert [r.id for r in found.collect()] == ["b", "a"]
    assert [r.id for r in stac.search(items, (0, 0, 1, 1), "../..").collect()] == ["b", "a", "d"]
    with pytest.raises(RuntimeError):
        stac.require_items(stac.search(items, (80, 80, 81, 81), "../.."))
    with pytest.raises(ValueError):
        stac.parse_bbox("1,2,3")
    (tmp_path / "src.bin").write_bytes(b"x" * 20_000)
    path = stac.download(found.first().asDict(), str(tmp_path / "dl"), "visual")
    assert Path(path).name == "b_visual.tif" and Path(path).stat().st_size == 20_000
    with pytest.raises(ValueError, match="visual"):
        stac.download(found.first().asDict(), str(tmp_path), "red")


# ---- jobs, pipeline, stream


def test_job_log(spark, tmp_path):
    log = jobs.JobLog(spark, str(tmp_path / "jobs"))
    j = log.start({"tile_size": 64})
    log.move(j, "LOADING", {"load": 1})
    with pytest.raises(ValueError):
        log.move(j, "EXPORTING")
    with pytest.raises(ValueError):
        log.retry(j)
    log.move(j, "FAILED", error="lost")
    log.retry(j)
    now = log.get(j)
    assert now["status"] == "PENDING" and now["checkpoint"]["load"] == 1
    assert {r.status for r in jobs.latest(log.rows()).collect()} == {"PENDING"}
    with pytest.raises(KeyError):
        log.get("nobody")


def test_tables_replace_a_job(spark, tmp_path):
    d = spark.createDataFrame([(1,), (2,)], "x int")
    for job in ("a", "b"):
        tables.replace_job(d, str(tmp_path / "t"), job)
    tables.replace_job(d.limit(1), str(tmp_path / "t"), "a")
    assert tables.read_job(spark, str(tmp_path / "t"), "a").count() == 1
    assert tables.read_job(spark, str(tmp_path / "t"), "b").count() == 2


def test_pipeline_resumes(spark, tmp_path):
    prob = np.zeros((64, 64), np.float32)
    prob[10:30, 10:30] = 0.9
    tile = tile_rows(spark, prob)
    both = tile.unionByName(tile.withColumn("tile_col", F.lit(1)))  # the same place twice: suppressed
    s = Settings(max_area_m2=1e9)
    out = pipeline.run(spark, both, str(tmp_path), {"file": "a", "mtime": 1}, s)
    assert out.count() == 1 and out.first().area_m2 > 0
    store = jobs.StageStore(spark, str(tmp_path), {"file": "a", "mtime": 1}, s)
    assert store.done("detect") and store.done("postprocess")
    store.stage("detect", lambda: pytest.fail("a finished stage ran again"))
    assert not jobs.StageStore(spark, str(tmp_path), {"file": "a", "mtime": 2}, s).done("detect")
    clipped = pipeline.run(spark, both, str(tmp_path), {"file": "b"}, s, g.box(0, 0, 10.03, 60))
    assert 0 < clipped.first().area_m2 < out.first().area_m2
    assert pipeline.run(spark, tile_rows(spark, prob * 0), str(tmp_path), {"file": "c"}, s).count() == 0


def test_tile_stream(spark, tmp_path):
    prob = np.zeros((32, 32), np.float32)
    prob[5:15, 5:15] = 0.8
    tile_rows(spark, prob).write.parquet(str(tmp_path / "in"))
    q = stream.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
