"""Detections, ground truth, zones and rasters derived from the star-schema tables.

Integer arithmetic only, so boxes are exact; the same text runs in Spark SQL and DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DETECTIONS = """SELECT event_id AS det_id,
  CASE (event_id % 11) % 4 WHEN 0 THEN 'building' WHEN 1 THEN 'road' WHEN 2 THEN 'vegetation' ELSE 'water' END AS class_name,
  CAST((event_id*event_id*13 + event_id*7919) % 101 AS INT) AS confidence,
  CAST(CASE WHEN event_id % 3 = 0 THEN 'model_b' ELSE 'model_a' END AS STRING) AS source,
  CAST((event_id*event_id*7 + event_id*104729) % 997 + 1100 * floor(event_id / 10000) AS BIGINT) AS minx,
  (event_id*event_id*11 + event_id*15485863) % 991 AS miny,
  CAST((event_id*event_id*7 + event_id*104729) % 997 + 10 + (event_id*event_id*3 + event_id*31) % 43 + 1100 * floor(event_id / 10000) AS BIGINT) AS maxx,
  (event_id*event_id*11 + event_id*15485863) % 991 + 10 + (event_id*event_id*5 + event_id*17) % 41 AS maxy
FROM events"""
GROUND_TRUTH = """SELECT det_id AS gt_id, class_name, minx + det_id % 5 AS minx, miny + (det_id*det_id) % 4 AS miny,
  maxx + det_id % 5 AS maxx, maxy + (det_id*det_id) % 4 AS maxy
FROM detections WHERE (det_id*det_id + det_id*3) % 5 <> 0"""
ZONES = """SELECT n_name AS zone_id, CAST((n_nationkey % 5) * 210 AS BIGINT) AS minx, CAST(floor(n_nationkey / 5) * 210 AS BIGINT) AS miny,
  CAST((n_nationkey % 5) * 210 + 200 AS BIGINT) AS maxx, CAST(floor(n_nationkey / 5) * 210 + 200 AS BIGINT) AS maxy FROM nation"""

#: For an oracle: the same views in DuckDB.
CTE = f"detections AS ({DETECTIONS.replace('AS STRING', 'AS VARCHAR')}), ground_truth AS ({GROUND_TRUTH}), zones AS ({ZONES})"
PIXELS_CTE = """pixels AS (SELECT vec_id AS r, CAST(k - 1 AS BIGINT) AS c, CAST(embedding[k] AS DOUBLE) AS value
  FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings)),
probs AS (SELECT r, c, least(1.0, greatest(0.0, 0.5 + value)) AS prob FROM pixels)"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """det_id (also the input order), class_name, confidence, source and the box."""
    return spark.sql(DETECTIONS.replace("FROM events", "FROM {events}"), events=events(spark, sf_dir))


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(GROUND_TRUTH.replace("FROM detections", "FROM {d}"), d=detections(spark, sf_dir))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ZONES.replace("FROM nation", "FROM {n}"), n=spark.read.parquet(f"{sf_dir}/nation.parquet"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One band in long form: r, c, value (double) and prob = 0.5 + value, clipped to 0..1."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return spark.sql(
        "SELECT vec_id AS r, CAST(k AS BIGINT) AS c, CAST(v AS DOUBLE) AS value,"
        " least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), CAST(0.5 AS DOUBLE) + CAST(v AS DOUBLE))) AS prob"
        " FROM (SELECT vec_id, posexplode(embedding) AS (k, v) FROM {e})",
        e=e,
    )
