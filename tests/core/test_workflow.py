import json
import zlib

import numpy as np
import pytest

from orthospark.__main__ import main
from orthospark.functions import geometry as g
from orthospark.operators.raster import Affine
from orthospark.sources import files, geotiff, overlay, vector


@pytest.fixture()
def masks(tmp_path):
    data = np.zeros((2, 100, 100), np.float32)
    data[0, 20:40, 20:40], data[1, 60:80, 50:75] = 0.9, 0.8
    t = Affine.from_bounds(10.0, 49.9, 10.1, 50.0, 100, 100)
    path = tmp_path / "masks.tif"
    path.write_bytes(geotiff.encode(geotiff.Raster(data, t, 4326)))
    return str(path), data, t


def test_process_and_evaluate(spark, masks, tmp_path):
    path, data, t = masks
    aoi = tmp_path / "aoi.geojson"
    aoi.write_text(g.to_geojson(g.box(10.01, 49.91, 10.09, 49.985)))
    args = ["process", "--input", path, "--classes", "building,water", "--output", str(tmp_path / "out"), "--tile-size", "64", "--tile-overlap", "8", "--aoi", str(aoi)]
    with pytest.raises(ValueError):
        main([*args[:3], "--classes", "one", *args[5:]], spark)
    out = main(args, spark)
    assert set(out) == {"geojson", "gpkg", "shp", "csv", "json"}
    back = vector.read_geojson(spark, out["geojson"]).collect()
    assert {r.class_name for r in back} <= {"building", "water"} and back
    zones = {r["class_name"]: r for r in json.loads((tmp_path / "out" / "indicators.json").read_text())}
    assert all(r["zone_id"] == "aoi" and r["density_per_km2"] > 0 for r in zones.values())
    assert spark.read.csv(out["csv"], header=True).columns == vector.INDICATOR_COLUMNS
    assert main(args, spark) == out  # resumed
    report = main(["evaluate", "-p", out["geojson"], "-g", out["geojson"], "-o", str(tmp_path / "r.json"), "--sample", "1"], spark)
    assert all(m["f1"] == 1.0 and m["map"] == 1.0 and m["iou"] == 1.0 for m in report["metrics"])
    assert report["error_examples"] == [] and len(report["control_sample"]) == 1
    assert json.loads((tmp_path / "r.json").read_text()) == report


def test_search(spark, tmp_path):
    rows = [{"id": "a", "collection": "c", "datetime": "2024-01-05T00:00:00", "west": 0, "south": 0, "east": 1, "north": 1, "assets": {"v": "x"}}]
    (tmp_path / "items.json").write_text("\n".join(map(json.dumps, rows)))
    found = main(["search", "--items", str(tmp_path / "items.json"), "--bbox", "0,0,2,2", "--datetime", "2024-01-01/2024-02-01"], spark)
    assert [r["id"] for r in found] == ["a"]


def test_overlay(masks, tmp_path):
    _, data, t = masks
    image = overlay.render(np.repeat(data[:1], 3, axis=0), t, [("building", g.box(10.02, 49.96, 10.04, 49.98)), ("odd", g.box(10.05, 49.91, 10.06, 49.92))])
    assert image.shape == (100, 100, 3) and tuple(image[20, 30]) == overlay.COLORS["building"] and tuple(image[30, 30]) == (229, 229, 229)
    raw = open(overlay.write_png(image, str(tmp_path / "o.png")), "rb").read()
    assert raw[:8] == b"\x89PNG\r\n\x1a\n"
    at = raw.index(b"IDAT")
    rows = np.frombuffer(zlib.decompress(raw[at + 4 : at + 4 + int.from_bytes(raw[at - 4 : at], "big")]), np.uint8).reshape(100, 301)
    assert (rows[:, 1:].reshape(100, 100, 3) == image).all()
    wide = overlay.normalize(np.arange(1.0, 101.0).reshape(1, 10, 10))
    assert wide.min() == 0 and wide.max() == 1 and (overlay.normalize(np.full((3, 2, 2), 7.0)) == 0).all()


def test_file_guards(tmp_path):
    path = files.accept("A.TIF", [b"ab", b"c"], str(tmp_path))
    assert open(path, "rb").read() == b"abc"
    with pytest.raises(ValueError):
        files.accept("a.exe", [b"x"], str(tmp_path))
    with pytest.raises(ValueError):
        files.accept("b.png", [b"x" * 9], str(tmp_path), most=8)
    assert not (tmp_path / "b.png").exists()
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "detections.gpkg").write_text("x")
    assert files.result_file(str(tmp_path), "j", "gpkg", "COMPLETED").name == "detections.gpkg"
    for bad in (("j", "gpkg", "FAILED"), ("j", "exe", "COMPLETED")):
        with pytest.raises(ValueError):
            files.result_file(str(tmp_path), *bad)
    with pytest.raises(PermissionError):
        files.result_file(str(tmp_path / "j"), "../..", "gpkg", "COMPLETED")
    with pytest.raises(FileNotFoundError):
        files.result_file(str(tmp_path), "k", "shp", "COMPLETED")


def test_positions_over_several_files(spark, tmp_path):
    import json

    for k in range(3):
        features = [{"type": "Feature", "properties": {"class_name": f"c{k}{i}"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}} for i in range(k + 1)]
        (tmp_path / f"{k}.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = vector.read_geojson(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.ord, r.class_name) for r in got] == [(0, "c00"), (1, "c10"), (2, "c11"), (3, "c20"), (4, "c21"), (5, "c22")]


def test_detections_are_numbered_in_input_order(spark):
    from orthospark.plans.pipeline import number

    rows = [(t, c, k) for t in range(3) for c in ("building", "water", "vegetation", "road") for k in range(2)]
    df = spark.createDataFrame([(0, t, c, k) for t, c, k in reversed(rows)], "tile_row int, tile_col int, class_name string, position int").repartition(4)
    from orthospark.operators.schema import CLASS_NAMES

    want = sorted(rows, key=lambda r: (r[0], list(CLASS_NAMES).index(r[1]), r[2]))
    assert [(r.tile_col, r.class_name, r.position) for r in number(df).orderBy("det_id").collect()] == want


def test_zones_that_are_only_touched_count(spark):
    from orthospark.functions import geometry as g
    from orthospark.operators import zonal
    from orthospark.plans.workflow import with_box

    zone = spark.createDataFrame([("z", bytearray(g.to_wkb(g.box(10.0, 49.0, 10.01, 49.01))))], "zone_id string, geom binary")
    shapes = [g.box(10.01, 49.0, 10.02, 49.01), g.box(10.01, 49.01, 10.02, 49.02), g.box(10.002, 49.002, 10.003, 49.003), g.box(10.0101, 49.0, 10.02, 49.01)]
    dets = spark.createDataFrame([(c, bytearray(g.to_wkb(s))) for c, s in zip(("road", "road", "water", "building"), shapes)], "class_name string, geom binary")
    got = {r.class_name: (r["count"], r.total_area_m2) for r in zonal.polygon_indicators(with_box(dets), with_box(zone)).collect()}
    assert set(got) == {"road", "water"} and got["road"] == (2, 0.0) and got["water"][0] == 1 and got["water"][1] > 0
