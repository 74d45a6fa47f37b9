"""Line dedup by a segment-partition edit join: equal lines and lines within a few edits of an earlier one go.

How many edits make two lines the same depends on the shorter one: budget(length), one for each PER_EDIT bytes and EDITS at most. A line is cut into
one segment more than its budget; a line within as many edits holds one of them at a place not far off. Every line is an index entry for its own
segments and probes the segments of lines that are a few bytes shorter, only at the places that such a match can have. Pairs that share a key and whose
byte parities agree well enough are verified by a banded bit-parallel edit distance on their texts. Keys that very many lines share are dealt in
blocks, every pair of blocks being a group of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.llm.common import BLANKS, split_rows, stored, table, trim

#: Edits within which lines are joined at most, and bytes of the shorter line for each edit. Lines of fewer bytes are joined if equal.
EDITS, PER_EDIT = 2, 8
#: Lines of one block of a key.
BLOCK = 2_048
#: Bytes from which the masks of a line are cut to the band.
LONG = 256


def budget(length: int, edits: int = EDITS) -> int:
    """Edits within which a line of so many bytes is joined with longer ones."""
    return min(edits, length // PER_EDIT)


def segments(length: int, edits: int = EDITS) -> list[tuple[int, int]]:
    """(start, length) of the even partition; the last segments are the longer ones."""
    n = edits + 1
    short, longer = length // n, length % n
    out, start = [], 0
    for i in range(n):
        size = short + (i >= n - longer)
        out.append((start, size))
        start += size
    return out


def probes(length: int, indexed: int, edits: int = EDITS) -> list[tuple[int, int, int]]:
    """(segment, start, size): where a line of `length` can hold segments of a line of `indexed` <= length bytes (multi-match-aware)."""
    delta, out = length - indexed, []
    for i, (start, size) in enumerate(segments(indexed, edits)):
        low = max(0, start - i, start + delta - (edits - i))
        high = min(length - size, start + i, start + delta + (edits - i))
        out += [(i, at, size) for at in range(low, high + 1)]
    return out


def within(a: bytes, b: bytes, k: int = EDITS) -> bool:
    """Whether the edit distance of a and b is at most k: bit-parallel over a diagonal band of 2k + 1 cells."""
    if abs(len(a) - len(b)) > k:
        return False
    if a == b:
        return True
    n = min(len(a), len(b))
    x, y = np.frombuffer(a, np.uint8)[:n], np.frombuffer(b, np.uint8)[:n]
    differ = np.flatnonzero(x != y)
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    if n:
        differ = np.flatnonzero(np.frombuffer(a, np.uint8)[::-1][:n] != np.frombuffer(b, np.uint8)[::-1][:n])
        tail = int(differ[0]) if len(differ) else n
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    if len(a) < len(b):
        a, b = b, a
    if len(b) <= k:  # fewer columns than the band is wide on one side: the plain table is smaller
        costs = list(range(len(a) + 1))
        for j, y in enumerate(b, 1):
            left = [j]
            for i, x in enumerate(a, 1):
                left.append(min(costs[i] + 1, left[-1] + 1, costs[i - 1] + (x != y)))
            costs = left
        return costs[-1] <= k
    # In column j the highest bit of the band is row j + k; the score runs down that diagonal, then along the last row.
    width = 2 * k + 2
    full = (1 << width) - 1
    agree: list[int] | None = None
    masks: dict[int, int] = {}
    if len(a) > LONG:  # masks of the whole line would be shifted once a byte; those of the band come from its diagonals
        agree = _diagonals(np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8), k)
    else:
        for i, c in enumerate(a):
            masks[c] = masks.get(c, 0) | 1 << i
    plus, minus, score, rows = full ^ (full >> (k + 1)), 0, k, len(a)
    for j, c in enumerate(b):
        shift = j + k + 1 - width
        equal = agree[j] if agree else (masks.get(c, 0) >> shift if shift >= 0 else masks.get(c, 0) << -shift) & full
        zero = (((equal & plus) + plus) ^ plus) | equal | minus
        right_plus = (minus | ~(zero | plus)) & full
        right_minus = zero & plus & full
        if j + k < rows:
            score += not zero >> (width - 1) & 1
        else:
            edge = width - 2 - (j + k - rows)
            score += (right_plus >> edge & 1) - (right_minus >> edge & 1)
        if score > k + (len(b) - j - 1) + k:
            return False
        down = (zero & full) >> 1
        plus = (right_minus | ~(down | right_plus)) & full
        minus = down & right_plus
    return score <= k


def _diagonals(a: np.ndarray, b: np.ndarray, k: int) -> list[int]:
    """For each place j of b the bits of the rows j - k - 1 to j + k of a that equal it."""
    out = np.zeros(len(b), np.int64)
    for bit, offset in enumerate(range(-k - 1, k + 1)):
        low, high = max(0, -offset), min(len(b), len(a) - offset)
        if high > low:
            out[low:high] |= (a[low + offset : high + offset] == b[low:high]).astype(np.int64) << bit
    return out.tolist()


def units(text: str | None) -> list[tuple[int, bytes]]:
    """(line number, trimmed line) of the lines that are compared, repeats included."""
    return [(n, raw) for n, line in enumerate((text or "").split("\n")) if (raw := line.strip(BLANKS).encode("utf-8", "replace"))]


def _digest(raw: bytes) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(raw)
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
            if doc_id is None:
                continue
            seen = set()
            for n, raw in units(text.as_py()):
                if raw not in seen:
                    seen.add(raw)
                    rows.append((*_digest(raw), doc_id, n))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["h1", "h2", "doc_id", "line"])


def _parities(raw: bytes) -> int:
    """One bit for each of 64 byte classes: the parity of its count. An edit changes two bits at most."""
    odd = np.bincount(np.frombuffer(raw, np.uint8) & 63, minlength=64) & 1
    return int(np.packbits(odd.astype(bool)).view(">i8")[0])


def _signatures(batches: Iterator[pa.RecordBatch], edits: int) -> Iterator[pa.RecordBatch]:
    """Index entries (also probes for lines of equal length) and probes of the lines of a batch, each distinct line once."""
    plans: dict[int, tuple[list, list]] = {}
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        seen: set[bytes] = set()
        for text in batch["text"]:
            seen.update(raw for _, raw in units(text.as_py()) if budget(len(raw), edits))
        for part in _chunks(sorted(seen), 8_000):
            keys: list[int] = []
            counts, ids, sigs, indexed = [], [], [], []
            for raw in part:
                n = len(raw)
                plan = plans.get(n)
                if plan is None:
                    if len(plans) > 4_000:
                        plans.clear()
                    own = [(n * 4 + i, s, s + size) for i, (s, size) in enumerate(segments(n, budget(n, edits)))]
                    shorter = [m for m in range(n - edits, n + 1) if m > 0 and 0 < budget(m, edits) >= n - m]
                    away = [(m * 4 + i, s, s + size) for m in shorter for i, s, size in probes(n, m, budget(m, edits))]
                    plan = plans[n] = (own, [p for p in away if p not in set(own)])
                for seed, s, e in plan[0]:
                    keys.append(digest(raw[s:e], seed))
                for seed, s, e in plan[1]:
                    keys.append(digest(raw[s:e], seed))
                counts.append(len(plan[0]) + len(plan[1])), indexed.append(len(plan[0]))
                ids.append(_digest(raw)[0]), sigs.append(_parities(raw))
            counts_ = np.array(counts)
            place = np.arange(counts_.sum()) - np.repeat(np.cumsum(counts_) - counts_, counts_)
            arrays = [
                pa.array(np.array(keys, np.uint64).view(np.int64)),
                pa.array(np.repeat(np.array(ids, np.int64), counts_)),
                pa.array(np.repeat(np.array(sigs, np.int64), counts_)),
                pa.array(place < np.repeat(np.array(indexed), counts_)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "id", "sig", "indexed"])
    trim()


def _chunks(items: list, n: int) -> Iterator[list]:
    for i in range(0, len(items), n):
        yield items[i : i + n]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = {raw: _digest(raw) for text in batch["text"] for _, raw in units(text.as_py()) if budget(len(raw))}
        d = list(rows.values())
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in d], pa.int64()), pa.array([x[1] for x in d], pa.int64()), pa.array(list(rows), pa.binary())], ["h1", "h2", "raw"])


def _verified(batches: Iterator[pa.RecordBatch], edits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = pa.array([within(a, b, budget(min(len(a), len(b)), edits)) for a, b in zip(batch["raw_a"].to_pylist(), batch["raw_b"].to_pylist(), strict=True)], pa.bool_())
        yield batch.select(["a1", "a2", "b1", "b2"]).filter(keep)


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _dealt(rows: DataFrame) -> DataFrame:
    """rows (key, id, size, ...) with lo and hi: keys of up to BLOCK lines as they are, others as every pair of their blocks."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.when(F.col("size") <= BLOCK, F.lit(0)).otherwise(F.pmod(F.xxhash64("id", F.lit(11)), blocks).cast("int"))
    other = F.explode(F.when(F.col("size") <= BLOCK, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1)))
    return rows.withColumn("own", own).withColumn("other", other).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other", "size")


def links(documents: DataFrame, classes: DataFrame, edits: int = EDITS) -> DataFrame:
    """(a1, a2, b1, b2): pairs of different lines within their edits, both ways round. classes: (h1, h2, first)."""
    rows = _rows(documents)
    signatures = rows.mapInArrow(partial(_signatures, edits=edits), "key bigint, id bigint, sig bigint, indexed boolean")
    # nearly every key belongs to one line: one sort by key leaves those of several, with a bound on their number
    same = Window.partitionBy("key")
    several = signatures.withColumns({"_least": F.min("id").over(same), "_most": F.max("id").over(same), "size": F.count("*").over(same)}).where("_least <> _most").drop("_least", "_most")
    once = _dealt(stored(several).groupBy("key", "id").agg(F.max("indexed").alias("indexed"), F.first("sig").alias("sig"), F.first("size").alias("size")))
    side = lambda s: [F.col("id").alias(s), F.col("sig").alias(f"sig_{s}"), F.col("own").alias(f"own_{s}")]
    left = once.where("indexed").select("key", "lo", "hi", *side("a"))
    right = once.select("key", "lo", "hi", *side("b"), "indexed")
    alike = (F.col("a") != F.col("b")) & (F.bit_count(F.col("sig_a").bitwiseXOR(F.col("sig_b"))) <= 2 * edits) & (~F.col("indexed") | (F.col("a") < F.col("b")))
    here = (F.least("own_a", "own_b") == F.col("lo")) & (F.greatest("own_a", "own_b") == F.col("hi"))
    pairs = stored(left.join(right, ["key", "lo", "hi"]).where(alike & here).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct()
    firsts = ends.join(classes, "h1").select(F.col("first").alias("doc_id")).distinct()
    texts = split_rows(rows, firsts)[1].mapInArrow(_texts, "h1 bigint, h2 bigint, raw binary").join(ends, "h1", "left_semi").dropDuplicates(["h1", "h2"])
    texts = stored(texts)
    text = lambda s: texts.select(F.col("h1").alias(f"{s}1"), F.col("h2").alias(f"{s}2"), F.col("raw").alias(f"raw_{s}"))
    found = pairs.join(text("a"), F.col("a") == F.col("a1")).join(text("b"), F.col("b") == F.col("b1")).select("a1", "a2", "b1", "b2", "raw_a", "raw_b")
    found = found.mapInArrow(partial(_verified, edits=edits), "a1 bigint, a2 bigint, b1 bigint, b2 bigint")
    return stored(found.unionByName(found.select(F.col("b1").alias("a1"), F.col("b2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))))


def decisions(documents: DataFrame, edits: int = EDITS) -> DataFrame:
    """(doc_id, line, n_links, removed) of compared lines that repeat or have links; line is the first such line of the document.

    removed: the line also occurs in an earlier document (by id), or has a link to a line that first occurs earlier (by document, then line). Only
    lines that were there are counted; a line that repeats inside its document is told there.
    """
    lines = stored(_rows(documents).mapInArrow(_lines, "h1 bigint, h2 bigint, doc_id bigint, line bigint"))
    classes = stored(lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.count("*").alias("documents")))
    near = links(documents, classes, edits)
    # where each linked line first occurs
    linked = near.select(F.col("a1").alias("h1"), F.col("a2").alias("h2")).distinct().join(classes, ["h1", "h2"]).join(lines, ["h1", "h2"]).where("doc_id = first").groupBy("h1", "h2", "first").agg(F.min("line").alias("at"))
    here = linked.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("first").alias("a_first"), F.col("at").alias("a_at"))
    there = linked.select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), F.col("first").alias("b_first"), F.col("at").alias("b_at"))
    earlier = (F.col("b_first") < F.col("a_first")) | ((F.col("b_first") == F.col("a_first")) & (F.col("b_at") < F.col("a_at")))
    by_class = near.join(here, ["a1", "a2"]).join(there, ["b1", "b2"]).groupBy(F.col("a1").alias("h1"), F.col("a2").alias("h2")).agg(F.count("*").alias("n_links"), F.max(earlier).alias("later"))
    # written, so that the join with the lines has a plain exchange on either side and a line that very many documents hold can be split
    decided = stored(classes.join(by_class, ["h1", "h2"], "left").where("documents > 1 or n_links is not null"))
    removed = (F.col("doc_id") != F.col("first")) | F.coalesce("later", F.lit(False))
    # merge joins at every size: neither side has a bound
    return lines.join(decided.hint("merge"), ["h1", "h2"]).select("doc_id", "line", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), removed.alias("removed"))


#: Columns added to documents, named so that they clash with none of theirs.
N_LINES, N_REMOVED, N_LINKS, EMPTY, _GONE, _ID = (f"__papyrine_{x}" for x in ("n_lines", "n_removed", "n_links", "empty", "gone", "id"))


def _apply(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Takes the removed lines and the repeats inside a document out of the text."""
    for batch in batches:
        texts, n_lines, n_removed, empty = [], [], [], []
        for text, gone in zip(batch["text"], batch[_GONE].to_pylist(), strict=True):
            text = text.as_py()
            out, seen, removed = set(), set(), set(gone or ())
            first: dict[bytes, int] = {}
            compared = units(text)
            for n, raw in compared:
                if first.setdefault(raw, n) in removed or raw in seen:
                    out.add(n)
                seen.add(raw)
            kept = "\n".join(line for n, line in enumerate(text.split("\n")) if n not in out) if out else text
            texts.append(kept)
            n_lines.append(len(compared)), n_removed.append(len(out))
            empty.append(bool(out) and not kept.strip(BLANKS))
        named = dict(zip(batch.schema.names, batch.columns, strict=True))
        named |= {"text": pa.array(texts, pa.string()), N_LINES: pa.array(n_lines, pa.int64()), N_REMOVED: pa.array(n_removed, pa.int64()), EMPTY: pa.array(empty, pa.bool_())}
        yield pa.RecordBatch.from_arrays([named[c] for c in columns], columns)
    trim()


def dedup_lines(documents: DataFrame, edits: int = EDITS) -> DataFrame:
    """documents, all their columns, with the removed lines out of `text`, and the columns N_LINES, N_REMOVED, N_LINKS and EMPTY (nothing is left of a text that lost lines).

    Lines are trimmed of ASCII white space; blank ones are never compared nor removed. A line goes if it occurs earlier in its document, occurs in a
    document of smaller id, or lies within budget() edits (of UTF-8 bytes) of a line that first occurs earlier; lines of under PER_EDIT bytes have no
    edits, so they go only if equal. Lines of any length are compared whole. Columns of documents may have any names but those added here. Null texts stay null and empty ones empty. Rows without doc_id lose only repeats inside themselves and count for no
    other. Rows that repeat a doc_id count as one document: identical ones get identical results. An empty table gives none.
    """
    decided = stored(decisions(documents, edits).groupBy("doc_id").agg(F.collect_list(F.when(F.col("removed"), F.col("line"))).alias(_GONE), F.sum("n_links").alias(N_LINKS)))
    idle, busy = split_rows(documents, decided)
    idle = idle.withColumns({_GONE: F.array().cast("array<bigint>"), N_LINKS: F.lit(0).cast("bigint")})
    busy = busy.join(decided.withColumnRenamed("doc_id", _ID).hint("merge"), F.col("doc_id").cast("bigint") == F.col(_ID), "left").drop(_ID).withColumn(N_LINKS, F.coalesce(F.col(N_LINKS), F.lit(0).cast("bigint")))
    added = [T.StructField(N_LINES, T.LongType()), T.StructField(N_REMOVED, T.LongType()), T.StructField(N_LINKS, T.LongType()), T.StructField(EMPTY, T.BooleanType())]
    schema = T.StructType([*documents.schema, *added])
    # the texts are joined by merging at every size; neither side has a bound
    return idle.unionByName(busy).mapInArrow(partial(_apply, columns=schema.names), schema)


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col(N_LINES).alias("n_lines"), F.col(N_REMOVED).alias("n_removed"), F.col(N_LINKS).alias("n_links"), "text")
