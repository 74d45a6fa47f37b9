"""A training corpus from documents: toxicity, line dedup, near-duplicates, decontamination, encoding."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import bpe, decontaminate, linededup, neardup, toxicity
from papyrine.llm.common import drop_stored, split_rows, stored, table, tables_of

_SCORE = "__papyrine_score"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose toxicity reaches the threshold. Null and empty texts show nothing toxic; repeated rows go or stay together."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, _SCORE).where(F.col(_SCORE) < toxicity.THRESHOLD).drop(_SCORE)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with repeated lines out of their texts (and n_chars counted anew); documents of which nothing is left go. Null and empty texts stay."""
    out = linededup.dedup_lines(docs).where(~F.col(linededup.EMPTY))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(linededup.N_REMOVED) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(kind))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def whole_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, text) of the documents of the folder that have since lost characters: what they held before lines were cut.

    However little a document has lost, it may fall below the similarity of near-duplicates. Ids and lengths are compared first, so that only the texts
    of such documents are shuffled.
    """
    before = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    mark = lambda rows, name: rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).alias(name))
    changed = stored(mark(docs, "now").join(mark(before, "then"), "doc_id").where(F.col("now") < F.col("then")).select("doc_id").distinct())
    return split_rows(before, changed)[1].join(changed.hint("merge"), "doc_id", "left_semi")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document, that of the smallest id, of each group of near-duplicates (five-word shingles, similarity of 0.8 or more).

    Documents are linked by their texts as they are and, where line dedup has cut any of them, also as they were: a near copy that has lost its
    repeated lines is no longer similar, but still a copy. Null and empty texts are linked with nothing; rows that repeat a doc_id go or stay together; rows without stay.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).unionByName(whole_texts(spark, docs, sf_dir))
    gone = stored(neardup.near_duplicates(rows, k=5, percent=80).where(~F.col("kept")).select("doc_id").distinct())
    apart, asked = split_rows(docs, gone)
    return apart.unionByName(asked.join(gone.withColumnRenamed("doc_id", "__papyrine_id").hint("merge"), F.col("doc_id").cast("bigint") == F.col("__papyrine_id"), "left_anti"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs in which no benchmark item occurs. Null and empty texts stay; repeated rows go or stay together; an empty benchmark removes nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of what they decode to."""
    return bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near-duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("encoding", encode),
]

#: SQL has no expression for compression lengths, sketches or merges; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage is written before the next begins; then the tables that it has used go."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with tables_of(spark) as used:
            after = stored(stage(spark, docs, sf_dir))
            used.remove(after)
        if k:
            drop_stored(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
