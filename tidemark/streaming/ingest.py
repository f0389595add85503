"""A landing folder as a stream: ingest what is new, then stop; and live aspect means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources import sinks


def ingest_available(spark: SparkSession, landing: str, schema: str, root: str) -> StreamingQuery:
    """Ingests the files that arrived since the last run (AvailableNow).  Content
    hashes make a replayed batch harmless, so each document is stored once."""
    files = spark.readStream.schema(schema).json(landing)
    return files.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/_ingest").foreachBatch(lambda batch, _: sinks.ingest(batch, root) and None).start()


def windowed_means(scores: DataFrame, width: str = "7 days", late: str = "2 days") -> DataFrame:
    """Mean score per ticker, aspect and window of event time; rows later than ``late`` are ignored."""
    w = F.window("ts", width)
    return scores.withWatermark("ts", late).groupBy(w, "ticker", "aspect").agg(F.avg("score").alias("mean"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "ticker", "aspect", "mean", "n")


def distinct_documents(documents: DataFrame, late: str = "7 days") -> DataFrame:
    """Documents without repeats of a content hash within the watermark."""
    return documents.withWatermark("ts", late).dropDuplicatesWithinWatermark(["content_hash"])
