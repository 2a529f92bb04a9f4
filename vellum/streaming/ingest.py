"""Streaming ingestion: an extension beside the batch plan, which runs unchanged on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.model import DOCUMENT, IMAGE_SUFFIXES


def image_stream(spark: SparkSession, path: str, within: str = "1 hour") -> DataFrame:
    """New image files, each content once within the watermark."""
    raw = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(path)
    named = raw.where(F.lower("path").rlike(f"[.]({'|'.join(IMAGE_SUFFIXES)})$")).withColumn("sha256", F.sha2("content", 256))
    return named.withWatermark("modificationTime", within).dropDuplicatesWithinWatermark(["sha256"])


def document_stream(spark: SparkSession, path: str) -> DataFrame:
    """New documents (JSON lines) as they arrive."""
    return spark.readStream.schema(DOCUMENT).json(path)


def each_batch(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Run the batch plan on each micro-batch; a batch that is run again has the same number, so sinks can overwrite by it."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def review_rate(documents: DataFrame, window: str = "10 minutes", late: str = "1 hour", at: str = "at") -> DataFrame:
    """Pages and pages to review for each window of event time; rows later than the watermark are left out."""
    w = documents.withWatermark(at, late)
    return w.groupBy(F.window(at, window)).agg(F.count("*").alias("pages"), F.count_if("review.needs_review").alias("needs_review"))
