"""Files that arrive over time: the same steps in each micro-batch, newest revision wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, suffix: str = ".pdf", per_batch: int = 1000) -> DataFrame:
    """New files as they land, like :func:`foliant.sources.documents.files`."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.schema(schema).format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("maxFilesPerTrigger", per_batch).load(path)
    return found.select(F.sha2("path", 256).alias("file_id"), "path", "length", F.col("modificationTime").alias("modified"), "content")


def process(stream: DataFrame, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Runs a batch step on each micro-batch and appends its rows with the batch's number; ends when all present files are read."""

    def batch(df: DataFrame, number: int) -> None:
        step(df).withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Islands on time over a stream: sessions of a key that end after a gap, for events at most ``late`` late."""
    at = F.col(time).cast("timestamp")
    return events.withColumn("__at", at).withWatermark("__at", late).groupBy(F.session_window("__at", gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
