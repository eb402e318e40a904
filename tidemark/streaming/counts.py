"""Topic and pair counts as Structured Streaming aggregations over an event-like source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.itemsets import pairs_of

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read_events(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour", topic: str = "event_type") -> DataFrame:
    """start, topic, count, total by windows of event time; state older than the watermark goes. Runs on a
    stream and on a batch alike."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = seen.groupBy(F.window("ts", window).alias("w"), F.col(topic).alias("topic")).agg(F.count("*").alias("count"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("start"), "topic", "count", "total")


def windowed_pairs(transactions: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, a, b, count of item pairs; transactions (ts, items) have sorted items."""
    seen = transactions.withWatermark("ts", late) if transactions.isStreaming else transactions
    rows = seen.select("ts", F.explode(pairs_of(F.col("items"))).alias("p"))
    grouped = rows.groupBy(F.window("ts", window).alias("w"), F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.count("*").alias("count"))
    return grouped.select(F.col("w.start").alias("start"), "a", "b", "count")


def run_available(df: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """All counts of what a stream has to give now, late rows included: each batch writes the table anew next to the
    checkpoint, so a run without new data gives the former one. The state of every window is kept, on the executors."""
    path = f"{checkpoint.rstrip('/')}-tables/{name}"
    write = lambda rows, _: rows.write.mode("overwrite").parquet(path)
    df.writeStream.foreachBatch(write).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_available(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Counts of the windows that the watermark has closed, appended to parquet once each. State is bounded by the
    windows still open, whose counts come with a later run; rows later than the watermark are left out."""
    df.writeStream.format("parquet").option("path", path).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)
