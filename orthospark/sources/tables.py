"""Engine tables as Parquet, partitioned by job; JDBC scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_job(df: DataFrame, path: str, job_id: str) -> None:
    """Delete and insert of a job's rows: its partition is overwritten, others stay."""
    (df.withColumn("job_id", F.lit(job_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path))


def read_job(spark: SparkSession, path: str, job_id: str) -> DataFrame:
    """A job's rows; the filter prunes partitions."""
    return spark.read.parquet(path).where(F.col("job_id") == job_id)


def detection_rows(dets: DataFrame, area_m2) -> DataFrame:
    """Rows to store: the area is rounded to two places, a rule of the store only."""
    return dets.withColumn("area_m2", F.round(area_m2, 2))


def read_jdbc(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 32, **options) -> DataFrame:
    """A database table, read in ``parts`` ranges of a numeric key if its bounds are given."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()
