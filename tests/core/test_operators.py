import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from orthospark.functions import boxes
from orthospark.operators import filters, matching, nms, postprocess, spatial_join, zonal
from orthospark.operators.schema import Settings, require_geographic
from orthospark.plans import fixtures as fx

SCHEMA = "det_id long, class_name string, confidence int, source string, minx double, miny double, maxx double, maxy double"
SF = "/root/testdata/sf0.001"


def dets(spark, rows):
    return spark.createDataFrame([(i, c, k, "t", *map(float, b)) for i, (c, k, b) in enumerate(rows)], SCHEMA)


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    i = w * h if w > 0 and h > 0 else 0
    u = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i
    return i / u if u > 0 else 0.0


def touch(a, b):
    return a[0] <= b[2] and b[0] <= a[2] and a[1] <= b[3] and b[1] <= a[3]


def greedy_nms(rows, t):
    kept = []
    for i in sorted(range(len(rows)), key=lambda i: (-rows[i][1], i)):
        if not any(rows[k][0] == rows[i][0] and touch(rows[k][2], rows[i][2]) and iou(rows[k][2], rows[i][2]) >= t for k in kept):
            kept.append(i)
    return set(kept)


def some_boxes(seed, n, size=40):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x, y = rng.randint(0, size), rng.randint(0, size)
        w, h = rng.choice([1, 3, 8, 60]), rng.choice([1, 3, 8])
        out.append((rng.choice("ab"), rng.randint(0, 5), (x, y, x + w, y + h)))
    return out


@pytest.mark.parametrize("t", [0.0, 0.1, 0.5, 1.0])
def test_suppression_equals_the_greedy_walk(spark, t):
    rows = some_boxes(7, 150)
    got = {r.det_id for r in nms.nms(dets(spark, rows), t).collect()}
    assert got == greedy_nms(rows, t)


def test_suppressed_boxes_suppress_nobody(spark):
    rows = [("a", 90, (0, 0, 10, 10)), ("a", 80, (0, 4, 10, 14)), ("a", 70, (0, 8, 10, 18))]
    assert {r.det_id for r in nms.nms(dets(spark, rows), 0.3).collect()} == {0, 2}
    pairs = nms.overlap_pairs(dets(spark, rows), 0.3)
    assert {(r.hi, r.lo) for r in pairs.collect()} == {(0, 1), (1, 2)}  # a one-shot anti-join would drop 2 as well
    assert nms.nms(dets(spark, rows).limit(0), 0.5).count() == 0


def test_grid_join_equals_the_nested_loop(spark):
    a, b = some_boxes(1, 80, 100), some_boxes(2, 80, 100)
    left = spatial_join.with_prefix(dets(spark, a), "a_")
    right = spatial_join.with_prefix(dets(spark, b), "b_")
    want = Counter((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if touch(x[2], y[2]))
    for cell in (None, 0.7, 500.0):
        got = Counter((r.a_det_id, r.b_det_id) for r in spatial_join.box_join(left, right, "a_", "b_", cell=cell).collect())
        assert got == want


def test_filters(spark):
    rows = [("building", 50, (0, 0, 10, 10)), ("road", 49, (0, 0, 1000, 10)), ("cloud", 99, (5, 5, 5, 9)), ("water", 100, (0, 0, 1010, 10))]
    d = dets(spark, rows)
    ids = lambda x: {r.det_id for r in x.collect()}
    assert ids(filters.by_confidence(d, 50)) == {0, 2, 3}
    assert ids(filters.by_registry(d)) == {0, 1, 3}
    assert ids(filters.by_shape(d, 100.0)) == {0, 1}
    assert ids(filters.by_size(d, boxes.area(boxes.box()), 100.0, 10_000.0)) == {0, 1}
    assert ids(filters.by_request(d, "", 99)) == {2, 3}
    assert [r.det_id for r in filters.page(d, 1, 2).collect()] == [1, 2]
    with pytest.raises(ValueError):
        filters.page(d, 0, 0)
    clipped = filters.clip_to_box(d, (5, 5, 20, 20)).collect()
    assert {(r.det_id, r.minx, r.maxx) for r in clipped} == {(0, 5.0, 10.0), (1, 5.0, 20.0), (3, 5.0, 20.0)}
    assert filters.control_sample(d, "det_id", 10).count() == 4 and filters.control_sample(d, "det_id", 2).count() == 2


def test_chain_counts(spark):
    rows = [("a", 90, (0, 0, 100, 100)), ("a", 20, (300, 0, 400, 100)), ("a", 80, (1, 1, 101, 101)), ("a", 85, (600, 0, 700, 100)), ("a", 95, (5000, 0, 5100, 100))]
    out, stats = postprocess.run(dets(spark, rows), Settings(min_area_m2=1, max_area_m2=1e9), lambda: boxes.area(boxes.box()), (0, 0, 1000, 1000))
    assert {r.det_id for r in out.collect()} == {0, 3}
    assert {r.stage: r.n for r in stats.collect()} == {
        "input_count": 5, "after_nms": 4, "after_confidence_filter": 3, "after_size_filter": 3, "after_shape_filter": 3, "after_simplify": 3, "after_clip": 2, "output_count": 2,
    }


def test_zones_count_touching_boxes(spark):
    zones = spark.createDataFrame([("z", 0.0, 0.0, 100.0, 100.0), ("far", 900.0, 900.0, 901.0, 901.0)], "zone_id string, minx double, miny double, maxx double, maxy double")
    d = dets(spark, [("road", 1, (100, 0, 110, 10)), ("road", 1, (90, 90, 110, 110)), ("water", 1, (0, 0, 100, 100))])
    got = {r.class_name: r for r in zonal.indicators(d, zones).collect()}
    assert got["road"]["count"] == 2 and got["water"]["count"] == 1
    assert got["road"].total_area_m2 == pytest.approx(got["water"].total_area_m2 / 100, rel=1e-3)
    s = zonal.summary(zonal.indicators(d, zones)).collect()
    assert len(s) == 1 and s[0].total_detections == 3 and s[0].building_count is None


def greedy_match(preds, truth, t):
    pairs = sorted(((-iou(p[2], g[2]), i, j) for i, p in enumerate(preds) for j, g in enumerate(truth) if p[0] == g[0] and iou(p[2], g[2]) >= t))
    mp, mg, out = set(), set(), set()
    for _, i, j in pairs:
        if i not in mp and j not in mg:
            mp.add(i), mg.add(j), out.add((i, j))
    return out


def slow_ap(preds, truth, t, name):
    order = sorted((i for i, p in enumerate(preds) if p[0] == name), key=lambda i: (-preds[i][1], i))
    gts = [j for j, g in enumerate(truth) if g[0] == name]
    if not gts:
        return 0.0 if order else 1.0
    free, tps, points = set(gts), 0, []
    for n, i in enumerate(order, 1):
        best = max(((iou(preds[i][2], truth[j][2]), -j) for j in free), default=(0, 0))
        if free and best[0] >= t:
            free.discard(-best[1])
            tps += 1
        points.append((tps / n, tps / len(gts)))
    return sum(max((p for p, r in points if r >= k / 10.0), default=0.0) for k in range(11)) / 11


def truth_frame(spark, rows):
    return dets(spark, rows).select(F.col("det_id").alias("gt_id"), "class_name", *boxes.SIDES)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matchers_equal_their_walks(spark, seed):
    p, g = some_boxes(seed, 120, 25), some_boxes(seed + 50, 70, 25)
    dp, dg = dets(spark, p), truth_frame(spark, g)
    pairs = matching.candidate_pairs(dp, dg, 0.3)
    assert {(r.pi, r.gi) for r in matching.greedy_matches(pairs).collect()} == greedy_match(p, g, 0.3)
    ap = {r.class_name: r.ap for r in matching.average_precision(dp, dg, pairs).collect()}
    for name in "ab":
        assert ap[name] == pytest.approx(slow_ap(p, g, 0.3, name), abs=1e-9)


def test_metrics_of_edge_sets(spark):
    box = (0, 0, 10, 10)
    p = dets(spark, [("a", 90, box), ("b", 80, box), ("b", 70, (50, 50, 60, 60))])
    g = truth_frame(spark, [("a", 0, box), ("c", 0, box)])
    pairs = matching.candidate_pairs(p, g)
    m = {r.class_name: r for r in matching.class_metrics(p, g, pairs, matching.greedy_matches(pairs)).collect()}
    assert (m["a"].precision, m["a"].recall, m["a"].f1, m["a"].iou, m["a"].map) == (1, 1, 1, 1, 1)
    assert (m["b"].precision, m["b"].false_positives, m["b"].map) == (0, 2, 0)
    assert (m["c"].recall, m["c"].false_negatives, m["c"].map) == (0, 1, 0)
    e = matching.error_examples(p, g, matching.greedy_matches(pairs))
    assert Counter(r.type for r in e.collect()) == {"false_positive": 2, "false_negative": 1}
    assert [r.class_name for r in matching.report_errors(e, 2).collect()] == ["b", "b"]


def test_fixture_is_not_degenerate(spark):
    d = fx.detections(spark, SF)
    n = d.count()
    assert d.select("class_name", *boxes.SIDES).distinct().count() > 0.99 * n
    assert fx.ground_truth(spark, SF).count() == n * 6 // 10
    contested = matching.candidate_pairs(fx.detections(spark, "/root/testdata/sf0.01"), fx.ground_truth(spark, "/root/testdata/sf0.01"))
    assert contested.groupBy("pi").count().where("count > 1").count() > 0


def test_settings_are_checked():
    for bad in ({"tile_overlap": 512}, {"min_area_m2": 5.0, "max_area_m2": 5.0}, {"nms_iou_threshold": 1.5}, {"confidence_threshold": 101}):
        with pytest.raises(ValueError):
            Settings(**bad)
    with pytest.raises(ValueError):
        require_geographic(3857)


def test_no_nested_loops_in_the_join_plan(spark):
    d = fx.detections(spark, SF)
    plan = nms.overlap_pairs(d, 0.5)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
