"""Whole texts meet what a table of any size knows about their tokens, block by block.

Texts are dealt to blocks of bounded size; a block is sent only the rows of the table whose keys occur in it. No occurrence of a token is ever a row of a
shuffle or a sort, and no task holds more than a block and its rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a block in the mean, and of the least one that is worth a task of its own.
BLOCK_CHARS, LEAST_CHARS = 1 << 23, 1 << 20
#: Bits of the bitmap over hashed keys: a task is sent this many at most, however many keys there are.
BUCKETS = 1 << 23


def maybe_among(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys may be among those of table: all that are, few others. Only a bitmap over hashed keys is broadcast."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    bits = table.select(bit.alias("_bit")).groupBy(F.expr("int(_bit div 64)").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, int(_bit % 64)))").alias("_bits"))
    asked = rows.withColumn("_bit", bit).withColumn("_word", F.expr("int(_bit div 64)"))
    return asked.join(F.broadcast(bits), "_word").where("shiftright(_bits, int(_bit % 64)) & 1L = 1L").select(*rows.columns)


def blocks_of(texts: DataFrame, *carried: str) -> tuple[DataFrame, int]:
    """texts (doc_id, text and what is carried) dealt by `_block`, and the number of blocks; rows of one id lie in one block. Null texts go."""
    known = texts.select("doc_id", "text", *carried).where("text is not null")
    chars = known.agg(F.sum(F.length("text"))).first()[0] or 0
    cores = texts.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-chars // BLOCK_CHARS), min(2 * cores, chars // LEAST_CHARS))
    return known.withColumn("_block", F.pmod(F.xxhash64("doc_id"), F.lit(n))).repartition(n, "_block"), n


def with_facts(texts: DataFrame, pieces: Column, facts: DataFrame, keys: list[str], run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """The rows that `run` makes of each block: of its texts (doc_id, text) and of the rows of facts whose keys are among its texts' pieces.

    pieces: an array of structs of the keys, of one text.
    """
    dealt, n = blocks_of(texts)
    held = dealt.select("_block", F.inline(pieces).alias(*keys))
    asked = maybe_among(held, facts, keys).distinct()
    met = asked.join(facts, keys).withColumnRenamed("_block", "_to").repartition(n, "_to")
    return dealt.groupBy("_block").cogroup(met.groupBy("_to")).applyInArrow(run, schema)


def lines_of(texts: pa.Table) -> Iterator[tuple[object, list[str]]]:
    """Each id with its blank-separated tokens; those of an id that repeats are put together by place."""
    found: dict[object, list[list[str]]] = {}
    for key, text in zip(texts["doc_id"].to_pylist(), texts["text"].to_pylist(), strict=True):
        found.setdefault(key, []).append(text.split(" "))
    for key, lines in found.items():
        yield key, lines[0] if len(lines) == 1 else [t for _, t in sorted((k, t) for line in lines for k, t in enumerate(line))]
