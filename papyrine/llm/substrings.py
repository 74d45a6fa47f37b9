"""Substring dedup by hashing lines and passages: digests are grouped globally, the earliest ranked occurrence stays, the rest goes.

A unit is a line, whatever its length: each whose digest occurs earlier goes, and nothing beside it. Passages shared inside longer lines are caught by
digests as well: a passage is PASSAGE words in a row; of every WINDOW passages that begin one after another at least one is hashed, chosen by content
alone (winnowing), and the words of a hashed passage go when it occurs earlier. So no repeat of PASSAGE + WINDOW - 1 words stays whole wherever it
lies, WINDOW - 1 words at most stay at each of its ends, and every word that goes belongs to a repeated line or passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.llm.common import split_rows, stored, table, trim

#: Words that a line needs to be hashed (1: every line that isn't blank), and words of a passage.
LINE_WORDS, PASSAGE = 1, 20
#: Passages of which at least one is hashed. At most PASSAGE, so that the hashed passages of a repeat leave no gap.
WINDOW = 16
#: Distinct words whose hashes a task remembers.
REMEMBERED = 150_000
#: Columns named so that they clash with none of the documents'.
REMOVED, _REPEATED, _ID = "__papyrine_removed", "__papyrine_repeated", "__papyrine_id"
#: The unit of a row that tells of a repeat inside a document.
_INSIDE = np.iinfo(np.int64).min
_WORDS = re.compile(r"\S+")
#: Odd multipliers and their inverses modulo 2^64, for hashes of runs of words by differences of sums.
_R1, _R2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def split_units(text: str | None) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, normalised bytes) of each line of a whole text that isn't blank; offsets are code points, without outer white space."""
    out, at = [], 0
    for line in (text or "").split("\n"):
        words = line.split()
        if words:
            out.append((at + len(line) - len(line.lstrip()), at + len(line.rstrip()), len(words), " ".join(words).lower().encode("utf-8", "replace")))
        at += len(line) + 1
    return out


def _digest(raw: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(raw)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _extreme(values: np.ndarray, size: int, pick: np.ufunc) -> np.ndarray:
    """pick over each window of `size` values."""
    done = 1
    while done < size:
        step = min(done, size - done)
        values = pick(values[: len(values) - step], values[step:])
        done += step
    return values


class Passages:
    """Finds the hashed passages of texts, remembering words and powers."""

    def __init__(self, words: int = PASSAGE, window: int = WINDOW):
        self.words, self.window = words, window
        self.known: dict[str, int] = {}
        self.powers = [np.ones(1, np.uint64)] * 4

    def _power(self, n: int) -> list[np.ndarray]:
        if len(self.powers[0]) < n:
            n = max(n, 2 * len(self.powers[0]))
            bases = (_R1, pow(_R1, -1, 1 << 64), _R2, pow(_R2, -1, 1 << 64))
            self.powers = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in bases]
        return self.powers

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, h1, h2) of the passages that are hashed: the least of each window, and the first and last of the text."""
        own = (text or "").lower().split()
        n = len(own) - self.words + 1
        if n < 1:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for w in set(own).difference(self.known):
            self.known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
        h = np.fromiter(map(self.known.__getitem__, own), np.uint64, len(own))
        r1, i1, r2, i2 = self._power(len(own))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * r1[: len(own)])])
        h1 = (total[self.words :] - total[:n]) * i1[:n]
        h1 ^= h1 >> np.uint64(31)
        size = min(self.window, n)
        least = _extreme(h1, size, np.minimum)
        # a passage is the least of a window if it equals the greatest of the minima of the windows that hold it
        edge = np.zeros(size - 1, np.uint64)
        chosen = _extreme(np.concatenate([edge, least, edge]), size, np.maximum) == h1
        chosen[[0, -1]] = True
        at = np.flatnonzero(chosen)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * r2[: len(own)])])
        h2 = (total[at + self.words] - total[at]) * i2[at]
        return at, h1[at].view(np.int64), h2.view(np.int64)


def _units(batches: Iterator[pa.RecordBatch], line_words: int, words: int) -> Iterator[pa.RecordBatch]:
    """(h1, h2, doc_id, unit) of the first occurrence in each document of each line and passage that is hashed; a passage from word n has unit -1 - n.

    A document in which something repeats also gives one row of unit _INSIDE, without digest.
    """
    passages = Passages(words)
    for batch in batches:
        parts: list[tuple[np.ndarray, ...]] = []
        rows: list[tuple] = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            if doc_id is None:
                continue
            text = text.as_py()
            seen, inside = set(), False
            for n, (_, _, many, raw) in enumerate(split_units(text)):
                if many >= line_words:
                    if raw in seen:
                        inside = True
                    else:
                        seen.add(raw)
                        rows.append((*_digest(raw), doc_id, n))
            at, h1, h2 = passages(text)
            if len(at):
                _, first = np.unique(h1, return_index=True)
                if len(first) < len(at):
                    inside = True
                    at, h1, h2 = at[first], h1[first], h2[first]
                parts.append((h1, h2, np.full(len(at), doc_id, np.int64), -1 - at))
            if inside:
                rows.append((None, None, doc_id, _INSIDE))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], _COLUMNS)
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts])) for k in range(4)], _COLUMNS)
    trim()


_COLUMNS = ["h1", "h2", "doc_id", "unit"]


def removed_spans(text: str | None, repeated: set[int], passages: Passages, line_words: int = LINE_WORDS) -> list[tuple[int, int, int]]:
    """(start, end, words) to take out, in code points of the original text. repeated: lines and passages (-1 - first word) whose digest occurs in an earlier document.

    A line that repeats an earlier line of the same text goes too, and so does a passage that begins after an equal one ends.
    """
    first: dict[bytes, int] = {}
    spans: list[tuple[int, int]] = []
    for n, (start, end, many, raw) in enumerate(split_units(text)):
        if many >= line_words:
            at = first.setdefault(raw, n)
            if at in repeated or at != n:
                spans.append((start, end))
    earliest: dict[tuple, int] = {}
    begins = []
    for at, *key in zip(*(x.tolist() for x in passages(text)), strict=True):
        known = earliest.setdefault(tuple(key), at)
        if -1 - known in repeated or at - known >= passages.words:
            begins.append(at)
    if not spans and not begins:
        return []
    places = [m.span() for m in _WORDS.finditer(text or "")]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans + [(places[at][0], places[at + passages.words - 1][1]) for at in begins]):
        if merged and (a <= merged[-1][1] or not text[merged[-1][1] : a].strip()):
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return [(a, b, len(text[a:b].split())) for a, b in merged]


def _cut(batches: Iterator[pa.RecordBatch], names: list[str], line_words: int, words: int) -> Iterator[pa.RecordBatch]:
    passages = Passages(words)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))
    for batch in batches:
        texts, spans = [], []
        for text, repeated in zip(batch["text"], batch[_REPEATED].to_pylist(), strict=True):
            text = text.as_py()
            gone = removed_spans(text, set(repeated or ()), passages, line_words)
            kept, at = [], 0
            for a, b, _ in gone:
                kept.append(text[at:a])
                at = b
            texts.append("".join([*kept, text[at:]]) if gone else text)
            spans.append([{"start": a, "end": b, "words": n} for a, b, n in gone])
        named = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"text": pa.array(texts, pa.string()), REMOVED: pa.array(spans, span)}
        yield pa.RecordBatch.from_arrays([named[c] for c in names], names)
    trim()


def dedup_substrings(documents: DataFrame, line_words: int = LINE_WORDS, words: int = PASSAGE) -> DataFrame:
    """documents, all their columns, with repeated lines and passages out of `text` and their original spans in REMOVED (start, end in code points, words).

    Lines are compared without case and with runs of white space as one space. Documents rank by doc_id: the document of the smallest id keeps a line or
    passage, later ones lose it; inside a document the first occurrence stays. Spans with nothing but white space between them are one span. Null texts
    stay null, empty ones empty. Rows without doc_id lose only what repeats inside them and count for no other. Rows that repeat a doc_id rank as one
    document. Texts of any length are read whole. Columns may have any names but those added here. An empty table gives none.
    """
    key = F.col("doc_id").cast("bigint")
    rows = documents.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"))
    units = stored(rows.mapInArrow(partial(_units, line_words=line_words, words=words), "h1 bigint, h2 bigint, doc_id bigint, unit bigint"))
    digests = units.where("h1 is not null")
    # written, so that the join has a plain exchange on either side and a digest that very many documents hold can be split
    shared = stored(digests.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    later = digests.join(shared.hint("merge"), ["h1", "h2"]).where("doc_id > first").select("doc_id", "unit").unionByName(units.where("h1 is null").select("doc_id", "unit"))
    repeated = stored(later.groupBy("doc_id").agg(F.collect_set("unit").alias(_REPEATED)))
    # documents without repeats are neither shuffled nor read by Python again; those without id may repeat inside
    idle, busy = split_rows(documents, repeated)
    span = T.ArrayType(T.StructType([T.StructField(x, T.IntegerType()) for x in ("start", "end", "words")]))
    none = F.array().cast("array<bigint>")
    nameless = idle.where(key.isNull()).withColumn(_REPEATED, none)
    idle = idle.where(key.isNotNull()).withColumn(REMOVED, F.array().cast(span))
    busy = busy.join(repeated.withColumnRenamed("doc_id", _ID).hint("merge"), key == F.col(_ID), "left").drop(_ID).unionByName(nameless)
    schema = T.StructType([*documents.schema, T.StructField(REMOVED, span)])
    return idle.unionByName(busy.mapInArrow(partial(_cut, names=schema.names, line_words=line_words, words=words), schema))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.size(REMOVED).cast("bigint").alias("n_removed"),
        F.size(F.filter(REMOVED, lambda s: s["words"] >= PASSAGE)).cast("bigint").alias("n_passages"),
        F.col(REMOVED).alias("removed"),
        "text",
    )
