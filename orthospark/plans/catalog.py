"""Registered queries over the derived relations, with their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes
from ..operators import filters, matching, nms, postprocess, zonal
from . import fixtures as fx

AOI = (105, 95, 905, 875)
SIZE = (10_000.0, 100_000.0)
IOU = 0.5

_DEG = ["(10.0::DOUBLE + {} * 0.0001::DOUBLE)", "(49.0::DOUBLE + {} * 0.0001::DOUBLE)"]


def _area_sql(minx: str = "minx", miny: str = "miny", maxx: str = "maxx", maxy: str = "maxy") -> str:
    return boxes.ellipsoid_area_sql(_DEG[0].format(minx), _DEG[1].format(miny), _DEG[0].format(maxx), _DEG[1].format(maxy))


def _area():
    return boxes.ellipsoid_area(boxes.to_degrees(boxes.box()))


def _iou_sql(a: str, b: str) -> str:
    w = f"(least({a}.maxx, {b}.maxx) - greatest({a}.minx, {b}.minx))"
    h = f"(least({a}.maxy, {b}.maxy) - greatest({a}.miny, {b}.miny))"
    i = f"(CASE WHEN {w} > 0 AND {h} > 0 THEN {w} * {h} ELSE 0 END)"
    area = lambda t: f"(({t}.maxx - {t}.minx) * ({t}.maxy - {t}.miny))"
    u = f"({area(a)} + {area(b)} - {i})"
    return f"(CASE WHEN {u} > 0 THEN {i}::DOUBLE / {u}::DOUBLE ELSE 0.0 END)"


def _touch_sql(a: str, b: str) -> str:
    return f"{a}.minx <= {b}.maxx AND {b}.minx <= {a}.maxx AND {a}.miny <= {b}.maxy AND {b}.miny <= {a}.maxy"


NMS_CTE = f"""folded AS (
  SELECT class_name, list_reduce(list([{{'det_id': det_id, 'confidence': confidence, 'minx': minx, 'miny': miny, 'maxx': maxx, 'maxy': maxy}}] ORDER BY confidence DESC, det_id),
    lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {_touch_sql('k', 'x[1]')} AND {_iou_sql('k', 'x[1]')} >= {IOU})) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept
  FROM detections GROUP BY class_name),
survivors AS (SELECT d.* FROM (SELECT unnest(kept).det_id AS det_id FROM folded) k JOIN detections d USING (det_id))"""

PAIRS_CTE = f"""pairs AS (SELECT p.class_name, p.det_id AS pi, g.gt_id AS gi, p.confidence, {_iou_sql('p', 'g')} AS iou
  FROM detections p JOIN ground_truth g ON p.class_name = g.class_name AND {_touch_sql('p', 'g')} AND {_iou_sql('p', 'g')} >= {IOU})"""

MATCH_CTE = f"""{PAIRS_CTE},
walked AS (
  SELECT class_name, list_reduce(list([{{'pi': pi, 'gi': gi, 'iou': iou}}] ORDER BY iou DESC, pi, gi),
    lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.pi = x[1].pi OR k.gi = x[1].gi)) > 0 THEN acc ELSE list_concat(acc, x) END) AS m
  FROM pairs GROUP BY class_name),
matches AS (SELECT class_name, m.pi AS pi, m.gi AS gi, m.iou AS iou FROM (SELECT class_name, unnest(m) AS m FROM walked))"""

AP_CTE = """wishes AS (SELECT class_name, pi, confidence, list(gi ORDER BY iou DESC, gi) AS g FROM pairs GROUP BY class_name, pi, confidence),
served AS (
  SELECT class_name, list_reduce(list([{'pi': pi, 'g': g, 'got': NULL::BIGINT}] ORDER BY confidence DESC, pi),
    lambda acc, x: list_append(acc, {'pi': x[1].pi, 'g': x[1].g, 'got': list_filter(x[1].g, lambda y: NOT list_contains(list_transform(acc, lambda k: k.got), y))[1]}),
    [{'pi': -1::BIGINT, 'g': []::BIGINT[], 'got': NULL::BIGINT}]) AS s
  FROM wishes GROUP BY class_name),
hits AS (SELECT s.pi AS pi FROM (SELECT unnest(s) AS s FROM served) WHERE s.got IS NOT NULL),
marked AS (SELECT class_name, confidence, det_id, (det_id IN (SELECT pi FROM hits))::INT AS tp FROM detections),
runs AS (SELECT class_name, sum(tp) OVER w AS tps, count(*) OVER w AS n FROM marked WINDOW w AS (PARTITION BY class_name ORDER BY confidence DESC, det_id ROWS UNBOUNDED PRECEDING)),
n_gt AS (SELECT class_name, count(*) AS n_gt FROM ground_truth GROUP BY class_name),
points AS (SELECT class_name, tps / n AS p, tps / n_gt AS r FROM runs JOIN n_gt USING (class_name)),
levels AS (SELECT i, i / 10.0::DOUBLE AS lv FROM range(11) t(i)),
best AS (SELECT class_name, i, max(CASE WHEN r >= lv THEN p END) AS p FROM points, levels GROUP BY class_name, i),
aps AS (SELECT class_name, sum(coalesce(p, 0) ORDER BY i) / 11.0::DOUBLE AS ap FROM best GROUP BY class_name)"""

INDICATORS_CTE = f"""met AS (
  SELECT z.zone_id, d.class_name, {_area_sql('greatest(d.minx, z.minx)', 'greatest(d.miny, z.miny)', 'least(d.maxx, z.maxx)', 'least(d.maxy, z.maxy)')} AS area,
    {_area_sql('z.minx', 'z.miny', 'z.maxx', 'z.maxy')} / 1e6 AS km2
  FROM detections d JOIN zones z ON {_touch_sql('d', 'z')}),
indicators AS (SELECT zone_id, class_name, count(*) AS "count", round(count(*) / CASE WHEN max(km2) > 0 THEN max(km2) ELSE 1.0 END, 4) AS density_per_km2, round(sum(area), 2) AS total_area_m2
  FROM met GROUP BY zone_id, class_name)"""

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, cte: str = fx.CTE):
    """Register a query and, if SQL can express it, its oracle."""

    def register(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = f"WITH {cte} {sql}" if cte else sql
        return fn

    return register


@query("detections_base", "SELECT * FROM detections")
def detections_base(spark, sf):
    return fx.detections(spark, sf)


@query("merge_tiles", "SELECT det_id, class_name, confidence, source FROM detections UNION ALL SELECT gt_id, class_name, 100, 'ground_truth' FROM ground_truth")
def merge_tiles(spark, sf):
    truth = fx.ground_truth(spark, sf).select(F.col("gt_id").alias("det_id"), "class_name", F.lit(100).alias("confidence"), F.lit("ground_truth").alias("source"))
    return filters.merge_tiles([fx.detections(spark, sf).select("det_id", "class_name", "confidence", "source"), truth])


@query("filter_confidence", "SELECT det_id, class_name, confidence FROM detections WHERE confidence >= 50")
def filter_confidence(spark, sf):
    return filters.by_confidence(fx.detections(spark, sf), 50).select("det_id", "class_name", "confidence")


@query("filter_class_registry", "SELECT event_id, event_type FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'road' ELSE event_type END AS event_type FROM events) WHERE event_type IN ('building', 'road', 'vegetation', 'water')", "")
def filter_class_registry(spark, sf):
    e = fx.events(spark, sf).select("event_id", F.when(F.col("event_id") % 7 == 0, "road").otherwise(F.col("event_type")).alias("event_type"))
    return filters.by_registry(e.withColumnRenamed("event_type", "class_name")).withColumnRenamed("class_name", "event_type")


@query("filter_shape", "SELECT det_id, greatest(maxx - minx, maxy - miny)::DOUBLE / least(maxx - minx, maxy - miny)::DOUBLE AS aspect FROM detections"
       " WHERE maxx > minx AND maxy > miny AND greatest(maxx - minx, maxy - miny)::DOUBLE / least(maxx - minx, maxy - miny)::DOUBLE <= 2")
def filter_shape(spark, sf):
    return filters.by_shape(fx.detections(spark, sf), 2.0).select("det_id", boxes.aspect(boxes.box()).alias("aspect"))


@query("filter_size", f"SELECT det_id, round(a, 2) AS area_m2 FROM (SELECT det_id, {_area_sql()} AS a FROM detections) WHERE a > 0 AND a BETWEEN {SIZE[0]} AND {SIZE[1]}")
def filter_size(spark, sf):
    return filters.by_size(fx.detections(spark, sf), _area(), *SIZE).select("det_id", F.round(_area(), 2).alias("area_m2"))


@query("filter_request", "SELECT det_id, confidence FROM detections WHERE class_name = 'water' AND confidence >= 70")
def filter_request(spark, sf):
    return filters.by_request(fx.detections(spark, sf), "water", 70).select("det_id", "confidence")


@query("page_detections", "SELECT det_id, class_name, confidence FROM detections WHERE confidence >= 20 ORDER BY det_id LIMIT 100 OFFSET 200")
def page_detections(spark, sf):
    return filters.page(filters.by_request(fx.detections(spark, sf), None, 20), 200, 100).select("det_id", "class_name", "confidence")


@query("job_counts", "SELECT source, count(*) AS total, count(*) FILTER (confidence >= 50) AS confident FROM detections GROUP BY source")
def job_counts(spark, sf):
    return fx.detections(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("confidence") >= 50).alias("confident"))


@query("feature_json", """SELECT det_id, '{"type":"Feature","properties":{"id":"' || det_id || '","class":"' || class_name || '","confidence":' || confidence || ',"source":"' || source ||
  '","area_m2":' || ((maxx - minx) * (maxy - miny)) || '},"geometry":{"type":"Polygon","coordinates":[[[' || maxx || ',' || miny || '],[' || maxx || ',' || maxy || '],[' || minx || ',' || maxy || '],['
  || minx || ',' || miny || '],[' || maxx || ',' || miny || ']]]}}' AS feature FROM detections""")
def feature_json(spark, sf):
    return filters.feature_json(fx.detections(spark, sf), boxes.area(boxes.box()))


@query("export_rows", f"SELECT row_number() OVER (ORDER BY det_id) - 1 AS id, class_name, confidence, source, round({_area_sql()}, 2) AS area_m2, (minx + maxx) / 2.0::DOUBLE AS center_x, (miny + maxy) / 2.0::DOUBLE AS center_y FROM detections")
def export_rows(spark, sf):
    return filters.export_rows(fx.detections(spark, sf), F.round(_area(), 2))


@query("box_iou_pairs", f"""SELECT hi, lo, iou FROM (SELECT a.det_id AS hi, b.det_id AS lo, {_iou_sql('a', 'b')} AS iou FROM detections a JOIN detections b ON a.class_name = b.class_name
  AND (a.confidence > b.confidence OR a.confidence = b.confidence AND a.det_id < b.det_id) AND {_touch_sql('a', 'b')}) WHERE iou >= 0.1""")
def box_iou_pairs(spark, sf):
    return nms.overlap_pairs(fx.detections(spark, sf), 0.1)


@query("nms_keep", "SELECT det_id, class_name, confidence FROM survivors", f"{fx.CTE}, {NMS_CTE}")
def nms_keep(spark, sf):
    return nms.nms(fx.detections(spark, sf), IOU).select("det_id", "class_name", "confidence")


_CHAIN = f"""{fx.CTE}, {NMS_CTE},
c AS (SELECT * FROM survivors WHERE confidence >= 50),
s AS (SELECT * FROM c WHERE {_area_sql()} BETWEEN {SIZE[0]} AND {SIZE[1]}),
h AS (SELECT * FROM s WHERE maxx > minx AND maxy > miny AND greatest(maxx - minx, maxy - miny)::DOUBLE / least(maxx - minx, maxy - miny)::DOUBLE <= 100),
k AS (SELECT * REPLACE (greatest(minx, {AOI[0]}) AS minx, greatest(miny, {AOI[1]}) AS miny, least(maxx, {AOI[2]}) AS maxx, least(maxy, {AOI[3]}) AS maxy) FROM h
  WHERE least(maxx, {AOI[2]}) > greatest(minx, {AOI[0]}) AND least(maxy, {AOI[3]}) > greatest(miny, {AOI[1]}))"""


@query("postprocess_stats", """SELECT 'input_count' AS stage, (SELECT count(*) FROM detections) AS n UNION ALL SELECT 'after_nms', (SELECT count(*) FROM survivors)
  UNION ALL SELECT 'after_confidence_filter', (SELECT count(*) FROM c) UNION ALL SELECT 'after_size_filter', (SELECT count(*) FROM s) UNION ALL SELECT 'after_shape_filter', (SELECT count(*) FROM h)
  UNION ALL SELECT 'after_simplify', (SELECT count(*) FROM h) UNION ALL SELECT 'after_clip', (SELECT count(*) FROM k) UNION ALL SELECT 'output_count', (SELECT count(*) FROM k)""", _CHAIN)
def postprocess_stats(spark, sf):
    return postprocess.run(fx.detections(spark, sf), _SETTINGS, _area, AOI)[1]


@query("postprocess", "SELECT det_id, class_name, confidence, minx, miny, maxx, maxy FROM k", _CHAIN)
def postprocess_rows(spark, sf):
    return postprocess.run(fx.detections(spark, sf), _SETTINGS, _area, AOI)[0].select("det_id", "class_name", "confidence", *boxes.SIDES)


@query("clip_to_aoi", f"""SELECT det_id, greatest(minx, {AOI[0]}) AS minx, greatest(miny, {AOI[1]}) AS miny, least(maxx, {AOI[2]}) AS maxx, least(maxy, {AOI[3]}) AS maxy FROM detections
  WHERE least(maxx, {AOI[2]}) > greatest(minx, {AOI[0]}) AND least(maxy, {AOI[3]}) > greatest(miny, {AOI[1]})""")
def clip_to_aoi(spark, sf):
    return filters.clip_to_box(fx.detections(spark, sf), AOI).select("det_id", *boxes.SIDES)


@query("zone_indicators", "SELECT * FROM indicators", f"{fx.CTE}, {INDICATORS_CTE}")
def zone_indicators(spark, sf):
    return zonal.indicators(fx.detections(spark, sf), fx.zones(spark, sf))


_PIVOT = ", ".join(
    f"max(CASE WHEN class_name = '{c}' THEN {k} END) AS {c}_{n}"
    for c in ("building", "road", "vegetation", "water") for k, n in (('"count"', "count"), ("total_area_m2", "area_m2"), ("density_per_km2", "density_per_km2"))
)


@query("zone_summary_pivot", f'SELECT zone_id, sum("count")::BIGINT AS total_detections, round(sum(total_area_m2), 2) AS total_area_m2, {_PIVOT} FROM indicators GROUP BY zone_id', f"{fx.CTE}, {INDICATORS_CTE}")
def zone_summary_pivot(spark, sf):
    return zonal.summary(zonal.indicators(fx.detections(spark, sf), fx.zones(spark, sf)))


@query("class_universe", "SELECT class_name FROM detections UNION SELECT class_name FROM ground_truth")
def class_universe(spark, sf):
    return matching.class_universe(fx.detections(spark, sf), fx.ground_truth(spark, sf))


@query("match_pairs", "SELECT class_name, pi, gi, iou FROM matches", f"{fx.CTE}, {MATCH_CTE}")
def match_pairs(spark, sf):
    return matching.greedy_matches(matching.candidate_pairs(fx.detections(spark, sf), fx.ground_truth(spark, sf), IOU))


def _evaluation(spark, sf):
    d, g = fx.detections(spark, sf), fx.ground_truth(spark, sf)
    from .lineage import cut

    pairs = cut(matching.candidate_pairs(d, g, IOU))
    return d, g, pairs, cut(matching.greedy_matches(pairs))


@query("average_precision", "SELECT class_name, round(coalesce(ap, 0), 6) AS ap FROM (SELECT DISTINCT class_name FROM detections) LEFT JOIN aps USING (class_name)", f"{fx.CTE}, {PAIRS_CTE}, {AP_CTE}")
def average_precision(spark, sf):
    d, g = fx.detections(spark, sf), fx.ground_truth(spark, sf)
    from .lineage import cut

    ap = matching.average_precision(d, g, cut(matching.candidate_pairs(d, g, IOU)))
    return ap.select("class_name", F.round("ap", 6).alias("ap"))


@query("class_metrics", """SELECT class_name, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, round(mean_iou, 4) AS iou,
    round(ap, 4) AS map, tp AS true_positives, n_pred - tp AS false_positives, n_gt - tp AS false_negatives
  FROM (SELECT *, tp / n_pred AS p, tp / n_gt AS r FROM (SELECT class_name, count(*) AS n_pred FROM detections GROUP BY class_name) JOIN n_gt USING (class_name)
    JOIN (SELECT class_name, count(*) AS tp, avg(iou) AS mean_iou FROM matches GROUP BY class_name) USING (class_name) JOIN aps USING (class_name))""", f"{fx.CTE}, {MATCH_CTE}, {AP_CTE}")
def class_metrics(spark, sf):
    return matching.class_metrics(*_evaluation(spark, sf))


_WKT = "'POLYGON ((' || maxx || ' ' || miny || ', ' || maxx || ' ' || maxy || ', ' || minx || ' ' || maxy || ', ' || minx || ' ' || miny || ', ' || maxx || ' ' || miny || '))'"
_ERRORS = f"""errors AS (SELECT class_name, 'false_positive' AS type, 0 AS part, det_id AS ord, confidence, {_WKT} AS geometry FROM detections WHERE det_id NOT IN (SELECT pi FROM matches)
  UNION ALL SELECT class_name, 'false_negative', 1, gt_id, NULL, {_WKT} FROM ground_truth WHERE gt_id NOT IN (SELECT gi FROM matches))"""


@query("error_examples", "SELECT class_name, type, ord, confidence, geometry FROM errors", f"{fx.CTE}, {MATCH_CTE}, {_ERRORS}")
def error_examples(spark, sf):
    d, g, _, m = _evaluation(spark, sf)
    return matching.error_examples(d, g, m).drop("part")


@query("report_errors", "SELECT class_name, type, ord, confidence, geometry FROM errors ORDER BY class_name, part, ord LIMIT 50", f"{fx.CTE}, {MATCH_CTE}, {_ERRORS}")
def report_errors(spark, sf):
    d, g, _, m = _evaluation(spark, sf)
    return matching.report_errors(matching.error_examples(d, g, m)).drop("part")


@query("control_sample", "SELECT det_id, class_name FROM detections ORDER BY (det_id * 2654435761 + 42 * 40503) % 4294967291, det_id LIMIT 100")
def control_sample(spark, sf):
    return filters.control_sample(fx.detections(spark, sf), "det_id", 100, 42).select("det_id", "class_name")


_SETTINGS = postprocess.Settings(min_area_m2=SIZE[0], max_area_m2=SIZE[1])
