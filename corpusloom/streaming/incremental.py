"""Structured Streaming variants: documents that arrive as files are deduplicated and counted as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions import text as tx


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files in a folder, with the schema of those that are there."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def first_copies(docs: DataFrame, time_col: str, delay: str = "7 days", text_col: str = "text") -> DataFrame:
    """Documents whose normalised text has not been seen within the watermark.

    State is one hash per text and ends with the watermark, so that it does not grow without bound.
    """
    keyed = docs.withColumn("normalized_sha256", F.sha2(tx.normalized(F.col(text_col)).cast("binary"), 256))
    return keyed.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["normalized_sha256"])


def windowed_terms(docs: DataFrame, time_col: str, window: str = "1 day", delay: str = "2 days", text_col: str = "text") -> DataFrame:
    """``(start, term, tf)``: words per window of event time; later documents than the watermark are left out."""
    words = docs.withWatermark(time_col, delay).select(F.col(time_col).alias("at"), F.explode(tx.words(F.col(text_col))).alias("term"))
    return words.groupBy(F.window("at", window).alias("w"), "term").agg(F.count("*").alias("tf")).select(F.col("w.start").alias("start"), "term", "tf")


def run_available(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything that is there and stop; the checkpoint makes a later run go on from there."""
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
