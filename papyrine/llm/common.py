"""What the training-data operators share: reading tables, labelled samples, shared-folder tables and components."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.operators.graph import components  # noqa: F401  used by the operators
from papyrine.sources.shared import drop_stored, stored, tables_of  # noqa: F401

#: Word separators of the word-based contracts: space and the controls tab to carriage return.
BLANKS = " \t\n\x0b\x0c\r"


#: Bytes of an Arrow batch: long texts come in fewer rows a batch.
BATCH_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; from here on the session's Arrow batches are bounded by bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Gives freed memory back to the system: a Python worker outlives its stage, and what it holds on to counts against the next."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: nothing to give back by this way


def held_out(modulus: int, remainder: int):
    """True where crc32 of the id as text leaves this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == remainder, F.lit(False))


def map_arrow(df: DataFrame, per_batch: Callable[[pa.RecordBatch], pa.RecordBatch], schema: T.StructType | str) -> DataFrame:
    """per_batch over the Arrow batches of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield per_batch(batch)
        trim()

    return df.mapInArrow(run, schema)


def labelled_ids(labels: DataFrame, column: str, modulus: int, remainder: int, most: int) -> DataFrame:
    """(doc_id, label) of learnable rows: not held out, label 0 or 1, `most` rows of each label at most.

    Rows are taken in hash order, so the sample doesn't depend on the layout of the table. Repeated ids count once, with the larger label.
    """
    usable = (
        labels.select("doc_id", F.col(column).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(modulus, remainder))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .withColumn("_order", F.xxhash64("doc_id"))
    )
    sides = [usable.where(F.col("label") == k).orderBy("_order", "doc_id").limit(most) for k in (0, 1)]
    return sides[0].unionByName(sides[1]).select("doc_id", "label")


def sample_texts(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text, label) of the sampled ids. ids has a fixed bound (labelled_ids), so it may be broadcast."""
    return documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


#: Bits of the bitmap over hashed doc_ids. Fixed: a task is sent this many at most, however many ids there are.
BUCKETS = 1 << 23
_MARK, _WORD, _BITS = "__papyrine_needed", "__papyrine_word", "__papyrine_bits"


def bucket(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id.cast("bigint")), F.lit(BUCKETS)).cast("bigint")


def bitmap(rows: DataFrame) -> DataFrame:
    """(__papyrine_word, __papyrine_bits): a bitmap over hashed doc_ids, BUCKETS / 64 rows at most whatever the number of ids, so it may be broadcast."""
    at = rows.select(bucket(F.col("doc_id")).alias("b"))
    return at.groupBy(F.expr("int(b div 64)").alias(_WORD)).agg(F.expr("bit_or(shiftleft(1L, int(b % 64)))").alias(_BITS))


def split_rows(documents: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents whose doc_id surely isn't among those of rows, and the others: only these have to be shuffled for a join."""
    at = bucket(F.col("doc_id"))
    marked = documents.withColumn(_WORD, F.floor(at / 64).cast("int")).join(F.broadcast(bitmap(rows)), _WORD, "left")
    needed = F.coalesce(F.expr(f"shiftright({_BITS}, int(pmod(xxhash64(cast(doc_id as bigint)), {BUCKETS}) % 64)) & 1L = 1L"), F.lit(False))
    marked = marked.withColumn(_MARK, needed).select(*(F.col(f"`{c}`") for c in documents.columns), _MARK)
    return marked.where(~F.col(_MARK)).drop(_MARK), marked.where(_MARK).drop(_MARK)
