"""Streaming queries run over what is there and end."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.plans.base import query, table
from papyrine.sources.shared import shared_dir
from papyrine.streaming import ingest


def _finished(spark: SparkSession, rows: DataFrame) -> DataFrame:
    where = f"{shared_dir(spark)}/papyrine-stream-{uuid.uuid4().hex}"
    ingest.append_to(rows, f"{where}/rows", f"{where}/log").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{where}/rows")


@query("stream_cleaned", "SELECT lang, count(*) AS texts FROM documents GROUP BY lang")
def stream_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus read as a stream, cleaned, appended to a table."""
    documents = ingest.parquet_stream(spark, f"{sf_dir}/documents.parquet*", table(spark, sf_dir, "documents").schema)
    done = _finished(spark, ingest.cleaned_stream(documents).select("doc_id", "lang", "cleaned"))
    return done.groupBy("lang").agg(F.count("*").alias("texts"))


@query("event_windows", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the windowed counts."""
    counted = ingest.windowed_counts(table(spark, sf_dir, "events").select("ts", "event_type", "value"))
    return counted.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))
