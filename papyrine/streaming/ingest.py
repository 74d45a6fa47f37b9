"""Streams of new abstracts and events, as an extension of the batch corpus: the same expressions over readStream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from papyrine.functions import text as X


def parquet_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def cleaned_stream(documents: DataFrame, text: str = "text") -> DataFrame:
    """R1 over a stream: stateless, so any number of tasks."""
    return documents.withColumn("cleaned", X.cleaned(F.col(text))).where("cleaned <> ''")


def distinct_stream(rows: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark; state is bounded by it."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "1 hour", time: str = "ts", by: str = "event_type") -> DataFrame:
    """Tumbling counts and sums; rows later than the watermark are dropped."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def append_to(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends each batch once (the sink's log and the checkpoint make it exactly once) until what is there is read."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
