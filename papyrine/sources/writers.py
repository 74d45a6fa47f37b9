"""Sinks: tables by year and part, line corpora, edge lists, rankings and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrine.functions import text as X


def by_year(rows: DataFrame, path: str) -> None:
    """K1: one folder a year, so a model year is a pruned scan."""
    rows.repartition("year").write.mode("overwrite").partitionBy("year").parquet(path)


def parts(rows: DataFrame, path: str, part: str = "part") -> None:
    """K2, K5: one folder a part."""
    rows.repartition(part).write.mode("overwrite").partitionBy(part).parquet(path)


def year_lines(sentences: DataFrame, path: str, year: int | None = None, column: str = "sentences") -> None:
    """K3: a line for each sentence (an array of tokens) of documents up to a year."""
    rows = sentences if year is None else sentences.where(F.col("year") <= year)
    rows.select(F.explode(column).alias("s")).select(F.array_join("s", " ").alias("value")).write.mode("overwrite").text(path)


def text_lines(documents: DataFrame, path: str, column: str = "tokens") -> None:
    """K4"""
    documents.select(X.detokenised(F.col(column)).alias("value")).write.mode("overwrite").text(path)


def edge_tsv(edges: DataFrame, path: str) -> None:
    """K6, K7"""
    edges.write.mode("overwrite").option("sep", "\t").csv(path)


def ranking_tsv(scored: DataFrame, path: str, *keys: str) -> None:
    """K9: keys and a score of four decimals, best first."""
    scored.orderBy(F.col("score").desc(), *keys).select(*keys, F.printf(F.lit("%.4f"), "score").alias("score")).write.mode("overwrite").option("sep", "\t").csv(path)


def with_year_tsv(rows: DataFrame, years: DataFrame, path: str, pmid: str = "pmid") -> None:
    """Rows of a known id with their year, N/A where it isn't known; headers stay."""
    out = rows.where(F.coalesce(F.trim(pmid), F.lit("")) != "").join(years, pmid, "left").withColumn("year", F.coalesce(F.col("year").cast("string"), F.lit("N/A")))
    out.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def metrics_json(rows: DataFrame, path: str) -> None:
    """K8"""
    rows.write.mode("overwrite").json(path)
