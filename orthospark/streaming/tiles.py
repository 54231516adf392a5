"""An extension: detections from tiles as they arrive (Structured Streaming).

Vectorising and filters are stateless and run on the stream; suppression needs whole batches and
runs in ``foreachBatch``, whose writes are idempotent by batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import filters, nms, vectorize
from ..operators.schema import Settings
from ..plans.pipeline import number


def read_tiles(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(vectorize.TILE).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def detections(tiles: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return filters.by_confidence(vectorize.mask_polygons(tiles), settings.confidence_threshold)


def start(spark: SparkSession, folder: str, out: str, checkpoint: str, settings: Settings = Settings()) -> StreamingQuery:
    """Write suppressed detections of each batch to ``out/batch=<n>``."""

    def write(batch: DataFrame, n: int) -> None:
        rows = nms.nms(number(batch), settings.nms_iou_threshold)
        rows.withColumn("batch", F.lit(n)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    return detections(read_tiles(spark, folder), settings).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
