"""Captured pages as a stream: normalised, first of each address within the watermark, extracted, appended as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from webloom.functions import urls as U
from webloom.operators import pages as P

CAPTURE = "page_id long, url string, html string, fetched_at timestamp"


def captures(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(CAPTURE).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def extracted(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """The stream's pages with their structures; an address that comes again within the watermark is dropped before it is parsed."""
    keyed = stream.where(F.col("fetched_at").isNotNull()).withColumn("normalized_url", U.normalize(F.col("url"))).withWatermark("fetched_at", late)
    first = keyed.dropDuplicatesWithinWatermark(["normalized_url"])
    return P.with_kind(P.extract(P.detect(first), platform="platform"))


def start(stream: DataFrame, out: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends to out; the checkpoint makes each batch count once. once: works through what is there, then stops."""
    writer = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
