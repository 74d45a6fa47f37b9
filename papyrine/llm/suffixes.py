"""Repeated strings by bucket-pointer refinement: buckets of q-grams are refined by identifiers at earlier and later offsets until a whole string is compared.

Every string of LENGTH bytes has one pointer: the q-gram of the least hash in it (the first of equals). Equal strings point to equal q-grams at equal
distances, so the strings of a text fall into runs that share a pointer, about one a LENGTH - Q + 1 half bytes, and only runs are shuffled. The initial
buckets are those of the pointers' q-grams; most hold one run and end there. Runs of equal bytes are one class, so a bucket of copies is one row. What is
left is refined: the strings of a run that lie in a range of distances share a core around the pointer, a bucket is split by the identifier of that core,
and ranges are cut in four again and again, with the buckets of one level as the input of the next; a bucket of one ends. At the last level the core is the
whole string. So every string that starts twice is found, whatever the size of a group, and nothing is compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.llm.common import drop_stored, split_rows, stored, table, trim

#: Bytes of a string, and of the grams of the initial buckets.
LENGTH, Q = 200, 48
#: Distances of one range at each level of refinement: a power of two down to 1, four times less each time.
RANGES = (64, 16, 4, 1)
#: Bytes of a text that are hashed at once. A run that a bound cuts in two is refined like any other.
CHUNK = 1 << 20
#: Classes of a bucket that one task refines; larger buckets are refined by rounds of shuffles, which no size of a bucket makes uneven.
TOGETHER = 2_000
#: Columns named so that they clash with none of the documents'.
SPANS, KEPT, TEXT, _DOC, _KEY = (f"__papyrine_{x}" for x in ("spans", "kept", "text", "doc", "key"))
_RUNS = "h long, g long, doc long, key long, place long"
_RNG = np.random.default_rng(20250214)
_TABLE = _RNG.integers(0, 1 << 64, (2, 256), np.uint64)
_R = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


class Hashes:
    """Hashes of substrings by differences of sums, modulo 2^64, over random words for bytes."""

    def __init__(self, size: int):
        self.powers = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for r in _R for b in (r, pow(r, -1, 1 << 64))]

    def sums(self, raw: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[k][raw] * self.powers[2 * k][: len(raw)])])

    def between(self, sums: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        h = (sums[b] - sums[a]) * self.powers[2 * k + 1][a]
        h = (h ^ (h >> np.uint64(33))) * _MIX
        return h ^ (h >> np.uint64(29))


def _least(values: np.ndarray, size: int) -> np.ndarray:
    done = 1
    while done < size:
        step = min(done, size - done)
        values = np.minimum(values[: len(values) - step], values[step:])
        done += step
    return values


def runs(raw: bytes, hashes: Hashes, length: int, q: int) -> tuple[np.ndarray, ...]:
    """(h, g, at, low, high): of each run of strings with one pointer the hashes of its gram and of all its bytes, the pointer, and its distances."""
    parts = []
    for start in range(0, max(len(raw) - length + 1, 0), CHUNK):
        own = np.frombuffer(raw, np.uint8, min(len(raw) - start, CHUNK + length - 1), start)
        sums, other = hashes.sums(own, 0), hashes.sums(own, 1)
        at = np.arange(len(own) - q + 1)
        grams = hashes.between(sums, at, at + q, 0)
        low_bits = np.uint64((1 << 21) - 1)  # CHUNK + LENGTH is under 2^21
        pointer = (_least((grams & ~low_bits) | at.astype(np.uint64), length - q + 1) & low_bits).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], pointer[1:] != pointer[:-1]]))
        last = np.concatenate([first[1:], [len(pointer)]]) - 1
        p = pointer[first]
        g = hashes.between(other, first, last + length, 1) ^ ((p - first).astype(np.uint64) * np.uint64(_R[1])) ^ ((last - first).astype(np.uint64) * np.uint64(_R[0]))
        parts.append((grams[p], g, p + start, p - last, p - first))
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (zip(*parts, strict=True) if parts else [[]] * 5))


def _place(at: np.ndarray, low: np.ndarray, high: np.ndarray, again: np.ndarray) -> np.ndarray:
    """Pointer, distances and whether the run repeats within its text, in one number: rows of the largest shuffles hold five of them."""
    return (at << 32) | (low << 17) | (high << 1) | again


def _placed() -> tuple[Column, Column, Column]:
    """Pointer and distances out of a place."""
    return tuple(F.expr(x).cast("int") for x in ("shiftright(place, 32)", "shiftright(place, 17) & 32767L", "shiftright(place, 1) & 65535L"))


def _runs(batches: Iterator[pa.RecordBatch], length: int, q: int) -> Iterator[pa.RecordBatch]:
    """A row for each distinct run of a text. Runs that repeat within the text also give rows of null h: spans surely repeated, start << 32 | end."""
    hashes = Hashes(CHUNK + length)
    names = ["h", "g", "doc", "key", "place"]
    for batch in batches:
        parts, spans = [], []
        for text, doc, key in zip(batch["text"].cast(pa.binary()), *(batch[c].to_numpy() for c in ("doc", "key")), strict=True):
            raw = text.as_py()
            if raw is None or len(raw) < length:
                continue
            h, g, at, low, high = runs(raw, hashes, length, q)
            _, first, inverse, n = np.unique(np.stack([h, g], 1), axis=0, return_index=True, return_inverse=True, return_counts=True)
            again = n[inverse.ravel()] > 1
            parts.append((h[first].view(np.int64), g[first].view(np.int64), np.full(len(first), doc), np.full(len(first), key), _place(at, low, high, again)[first]))
            spans += [(doc, key, a << 32 | b) for a, b in merged(at[again] - high[again], at[again] - low[again] + length)]
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*parts, strict=True)], names)
        if spans:
            none = pa.nulls(len(spans), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, *(pa.array(x, pa.int64()) for x in zip(*spans, strict=True))], names)
    trim()


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """The spans as sorted spans that neither overlap nor touch."""
    if not len(starts):
        return []
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.flatnonzero(np.concatenate([[True], starts[1:] > ends[:-1]]))
    return list(zip(starts[new].tolist(), ends[np.concatenate([new[1:], [len(starts)]]) - 1].tolist(), strict=True))


def _regions(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of asked runs, with the classes that they stand for."""
    names, kinds = ["h", "g", "whole", "small", "low", "high", "raw"], (pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
    for batch in batches:
        out: list[tuple] = []
        for text, asked in zip(batch["text"].cast(pa.binary()), batch["asked"].to_pylist(), strict=True):
            raw = text.as_py()
            out += [(x["h"], x["g"], x["whole"], x["small"], x["low"], x["high"], raw[x["at"] - x["high"] : x["at"] - x["low"] + length]) for x in asked]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    trim()


def _core(low: int, high: int, raw: bytes, part: int, width: int, length: int, most: int) -> bytes | None:
    """What all strings at the distances of a range hold: the bytes from a before the pointer to length - b after it. None if the run has none of them.

    A run with one string of the range has these bytes, whether or not it has the other strings.
    """
    a, b = part * width, min(part * width + width - 1, most)
    return raw[high - a : high - b + length] if a <= high and b >= low else None


def refine_bucket(members: list[tuple], length: int, most: int, level: int = 0, parts: range | None = None) -> Iterator[tuple[int, int]]:
    """(g, distance) of the strings of members (g, whole, low, high, raw) that aren't whole and that another member holds.

    A bucket is split by the cores of each range of distances; what is left of it is refined by the ranges that this one is cut into.
    """
    width = RANGES[level]
    for part in range(most // width + 1) if parts is None else parts:
        split: dict[bytes, list[tuple]] = {}
        for m in members:
            core = _core(m[2], m[3], m[4], part, width, length, most)
            if core is not None:
                split.setdefault(core, []).append(m)
        for left in split.values():
            if len(left) > 1 and not all(m[1] for m in left):
                if width == 1:
                    yield from ((m[0], part) for m in left if not m[1])
                else:
                    times = width // RANGES[level + 1]
                    yield from refine_bucket(left, length, most, level + 1, range(part * times, part * times + times))


def _refine(batches: Iterator[pa.RecordBatch], length: int, most: int) -> Iterator[pa.RecordBatch]:
    """(h, g, parts) of small buckets, whose rows follow one another."""

    def done(h: int, bucket: dict[int, tuple]) -> list[tuple]:
        found: dict[int, list[int]] = {}
        for g, part in refine_bucket(list(bucket.values()), length, most):
            found.setdefault(g, []).append(part)
        return [(h, g, parts) for g, parts in found.items()]

    names, kinds = ["h", "g", "parts"], (pa.int64(), pa.int64(), pa.list_(pa.int32()))
    make = lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    now, bucket = None, {}
    for batch in batches:
        out: list[tuple] = []
        for h, g, *rest in zip(*(batch[c].to_pylist() for c in ("h", "g", "whole", "low", "high", "raw")), strict=True):
            if h != now:
                out += done(now, bucket)
                now, bucket = h, {}
            bucket.setdefault(g, (g, *rest))  # rows that repeat an id and its text give the same class again
        if out:
            yield make(out)
    if out := done(now, bucket):
        yield make(out)
    trim()


def _cores(batches: Iterator[pa.RecordBatch], length: int, most: int, width: int) -> Iterator[pa.RecordBatch]:
    """(h, g, whole, part, c1, c2): the identifier of the core of each of `parts`, ranges of `width` distances, that holds strings of the run."""
    names, kinds = ["h", "g", "whole", "part", "c1", "c2"], (pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64())
    for batch in batches:
        out: list[tuple] = []
        for h, g, whole, low, high, raw, parts in zip(*(batch[c].to_pylist() for c in ("h", "g", "whole", "low", "high", "raw", "parts")), strict=True):
            for part in parts:
                core = _core(low, high, raw, part, width, length, most)
                if core is not None:
                    d = xxhash.xxh3_128_digest(core, seed=part)
                    out.append((h, g, whole, part, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
    trim()


def _cut(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        kept, gone = [], []
        for text, spans in zip(batch[TEXT].cast(pa.binary()), batch[SPANS], strict=True):
            raw, found = text.as_py(), spans.values
            own = merged(found.field("start").to_numpy(), found.field("end").to_numpy())
            pieces, at = [], 0
            for a, b in own:
                pieces.append(raw[at:a])
                at = b
            kept.append(b"".join([*pieces, raw[at:]]))
            gone.append([{"start": a, "end": b} for a, b in own])
        named = dict(zip(batch.schema.names, batch.columns, strict=True)) | {KEPT: pa.array(kept, pa.binary()), SPANS: pa.array(gone, span)}
        yield pa.RecordBatch.from_arrays([named[c] for c in names], names)
    trim()


def refined(regions: DataFrame, length: int, q: int) -> DataFrame:
    """(h, g, parts) of the classes that aren't whole: the distances at which their strings occur in another class.

    regions: (h, g, whole, low, high, raw), one row for each class of a bucket that holds several. Each level splits the buckets that the last one left.
    """
    parts = F.sequence(F.expr(f"int(low div {RANGES[0]})"), F.expr(f"int(high div {RANGES[0]})"))
    active = regions.withColumn("parts", parts)
    for level, width in enumerate(RANGES):
        cores = stored(active.mapInArrow(partial(_cores, length=length, most=length - q, width=width), "h long, g long, whole boolean, part int, c1 long, c2 long"))
        shared = stored(cores.groupBy("c1", "c2").agg(F.count("*").alias("k"), F.min("whole").alias("whole")).where("k > 1 AND NOT whole").select("c1", "c2"))
        left = cores.join(shared.hint("merge"), ["c1", "c2"])
        if width == 1:
            return stored(left.where("NOT whole").groupBy("h", "g").agg(F.collect_list("part").alias("parts")))
        times = width // RANGES[level + 1]
        halves = left.select("h", "g", F.explode(F.sequence(F.col("part") * times, F.col("part") * times + (times - 1))).alias("part"))
        active = regions.join(halves.groupBy("h", "g").agg(F.collect_list("part").alias("parts")).hint("merge"), ["h", "g"])
    raise ValueError("the last range has to be a single distance")


def repeated_spans(texts: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """(doc, key, spans) of the texts (doc, key, text) that hold a string of `length` bytes that starts twice: byte spans that cover those strings."""
    found = stored(texts.mapInArrow(partial(_runs, length=length, q=q), _RUNS))
    every = found.where("h IS NOT NULL")
    buckets = every.groupBy("h").agg(F.sum(F.expr("1 + (place & 1L)")).alias("k")).where("k > 1").select("h")
    buckets = stored(buckets)
    hot = stored(every.join(buckets.hint("merge"), "h"))
    drop_stored(buckets)
    whole = ((F.count("*") > 1) | (F.max(F.expr("place & 1L")) > 0)).alias("whole")
    classes = stored(hot.groupBy("h", "g").agg(whole, F.min(F.struct("doc", "key", "place")).alias("holder")))
    mixed = classes.groupBy("h").agg(F.count("*").alias("k"), F.min("whole").alias("whole")).where("k > 1 AND NOT whole").select("h", (F.col("k") <= TOGETHER).alias("small"))
    asked = classes.join(mixed.hint("merge"), "h").select("h", "g", "whole", "small", "holder.*")
    at, low, high = _placed()
    asked = asked.select("doc", "key", F.struct("h", "g", "whole", "small", at.alias("at"), low.alias("low"), high.alias("high")).alias("x"))
    asked = stored(asked.groupBy("doc", "key").agg(F.collect_list("x").alias("asked")))
    near = split_rows(texts.withColumnRenamed("doc", "doc_id"), asked.select(F.col("doc").alias("doc_id")))[1].withColumnRenamed("doc_id", "doc")
    schema = "h long, g long, whole boolean, small boolean, low int, high int, raw binary"
    regions = stored(near.join(asked.hint("merge"), ["doc", "key"]).mapInArrow(partial(_regions, length=length), schema))
    drop_stored(asked)
    dealt = regions.where("small").select("h", "g", "whole", "low", "high", "raw").repartition("h").sortWithinPartitions("h")
    parts = stored(dealt.mapInArrow(partial(_refine, length=length, most=length - q), "h long, g long, parts array<int>"))
    large = regions.where("NOT small")
    if large.limit(1).count():
        parts = parts.unionByName(refined(large.groupBy("h", "g", "whole", "low", "high").agg(F.first("raw").alias("raw")), length, q))
    verdicts = classes.where("whole").select("h", "g", F.lit(None).cast("array<int>").alias("parts")).unionByName(parts)
    span = lambda a, b: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"))
    run = F.array(span(at - high, at - low + length))
    judged = hot.join(verdicts.hint("merge"), ["h", "g"])
    spans = judged.select("doc", "key", F.when(F.col("parts").isNull(), run).otherwise(F.transform("parts", lambda r: span(at - r, at - r + length))).alias("s"))
    inside = found.where("h IS NULL").select("doc", "key", F.array(span(F.expr("shiftright(place, 32)"), F.expr("place & 4294967295L"))).alias("s"))
    out = stored(spans.unionByName(inside).groupBy("doc", "key").agg(F.flatten(F.collect_set("s")).alias("spans")))
    for used in (found, hot, classes, regions):
        drop_stored(used)
    return out


def dedup_suffixes(documents: DataFrame, length: int = LENGTH, q: int = Q) -> DataFrame:
    """documents, all their columns, with SPANS (start, end in bytes of the text in UTF-8) and KEPT, the bytes outside of them.

    A byte goes if a string of `length` bytes that covers it starts anywhere else too, in the same text or another; overlaps count, and all strings are
    judged on the input. Texts are compared as bytes, so what stays needn't be valid UTF-8. Null texts count as empty; texts under `length` bytes lose
    nothing. Rows are texts of their own: equal rows lose all, whether or not they share an id; ids may be null. Texts of any length are read whole.
    Columns may have any names but those added here. An empty table gives none.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # a text is known by its id and hash; rows of one id and one text share their spans, as equal texts do anyway
    keyed = documents.withColumns({TEXT: text, _DOC: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63))), _KEY: F.xxhash64(text)})
    spans = repeated_spans(keyed.select(F.col(_DOC).alias("doc"), F.col(_KEY).alias("key"), F.col(TEXT).alias("text")), length, q)
    # texts that lose nothing are neither shuffled nor read by Python again
    names = [*documents.columns, TEXT, _DOC, _KEY]
    bare = keyed.select(F.col(_DOC).alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    idle, busy = (rows.select("row.*") for rows in split_rows(bare, spans.select(F.col("doc").alias("doc_id"))))
    kind = "array<struct<start:int,end:int>>"
    idle = idle.withColumns({SPANS: F.array().cast(kind), KEPT: F.col(TEXT).cast("binary")})
    met = busy.join(spans.select(F.col("doc").alias(_DOC), F.col("key").alias(_KEY), F.col("spans").alias(SPANS)).hint("merge"), [_DOC, _KEY], "left")
    met = met.withColumn(SPANS, F.coalesce(SPANS, F.array().cast(kind)))
    out = [*documents.columns, SPANS, KEPT]
    schema = T.StructType([*documents.schema, *idle.select(SPANS, KEPT).schema])
    done = met.select(*(F.col(f"`{c}`") for c in documents.columns), TEXT, SPANS).mapInArrow(partial(_cut, names=out), schema)
    return idle.select(*(F.col(f"`{c}`") for c in out)).unionByName(done)


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_suffixes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    gone = F.aggregate(SPANS, F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    return out.select("doc_id", n_bytes.alias("n_bytes"), gone.alias("n_removed"), F.size(SPANS).cast("bigint").alias("n_spans"), F.sha2(KEPT, 256).alias("kept_sha256"))
