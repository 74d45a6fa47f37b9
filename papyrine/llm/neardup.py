"""Near-duplicate documents by MinHash bands and odd sketches, confirmed on full shingle sets.

Stages, each on the output of the one before:
1. one pass over the texts: shingle set, its digest, MinHash bands, odd sketch, set size;
2. documents of equal sets become one representative (smallest id);
3. representatives that share a band form buckets; within a bucket the odd sketches' XOR population counts estimate similarities, and a spanning
   forest of the pairs whose estimate may reach the threshold is kept;
4. components of those forests are families: any true link lies inside one family;
5. within a family links are confirmed on full sets and again only a spanning forest is kept;
6. components of the confirmed links are the result.
Buckets and families above a size are dealt in blocks, every pair of blocks being a group of its own, so no group gathers in one task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm.common import BLANKS, components, stored, table, trim

BANDS, ROWS = 28, 4
#: Bits of an odd sketch, and MinHash samples folded into it.
SKETCH_BITS, SAMPLES = 1024, BANDS * ROWS
#: Members of one block of a bucket or family, and shingles of one block of a family.
BLOCK, BLOCK_SHINGLES = 512, 1_000_000
#: Standard deviations that an estimate may lie under the threshold.
SLACK = 5.0
_WORD = re.compile(f"[^{re.escape(BLANKS)}]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_rng = np.random.default_rng(20240607)
_A = _rng.integers(1, 2**63, SAMPLES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_SPREAD = [np.uint64(int(x) | 1) for x in _rng.integers(1, 2**63, 16)]
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(33))) * _M2
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes."""

    def __init__(self, k: int):
        self.k = k
        self.known: dict[str, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").translate(_LOWER))
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > 150_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(words))
        out = np.full(len(h) - k + 1, k, np.uint64)
        for i in range(k):
            out = _mix(out * _SPREAD[i % len(_SPREAD)] + h[i : len(h) - k + 1 + i])
        return np.unique(out)


def minhash(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, np.iinfo(np.uint64).max)
    for i in range(0, len(shingles), 256):
        np.minimum(least, (shingles[i : i + 256, None] * _A + _B).min(0), out=least)
    return least


def odd_sketch(samples: np.ndarray) -> bytes:
    """Parity bitmap of the MinHash samples: each (position, value) flips one bit."""
    bits = _mix(samples + np.arange(SAMPLES, dtype=np.uint64) * _M1) % np.uint64(SKETCH_BITS)
    return np.packbits(np.bincount(bits.astype(np.int64), minlength=SKETCH_BITS) % 2 == 1).tobytes()


def largest_distance(threshold: float) -> int:
    """XOR population count that a pair at the threshold exceeds with a chance of about SLACK standard deviations.

    At similarity J the samples differ in SAMPLES * (1 - J) positions on average; each differing position flips two bits.
    """
    differing = SAMPLES * (1 - threshold) + SLACK * math.sqrt(SAMPLES * threshold * (1 - threshold))
    flips = 2 * min(differing, SAMPLES)
    expected = SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** flips)
    return math.ceil(expected + SLACK * math.sqrt(max(expected, 1) * 0.25))


def linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """100 * intersection >= percent * union, in integers."""
    return 100 * inter >= percent * (a + b - inter)


class Forest:
    """Union-find over positions, yielding only the edges that join two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def spanning(close: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix, by breadth first search over whole rows."""
    n = len(close)
    left = np.ones(n, bool)
    out: list[tuple[int, int]] = []
    for start in range(n):
        if not left[start]:
            continue
        left[start] = False
        queue = [start]
        while queue:
            i = queue.pop()
            found = np.flatnonzero(close[i] & left)
            left[found] = False
            out += [(i, int(j)) for j in found]
            queue += found.tolist()
    return out


def joining(close: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of one block or, of two, the edges between them that join what isn't joined within either.

    What a block joins within itself comes from the group of that block alone: otherwise every pair of blocks would give all of it again.
    """
    same = own[:, None] == own[None, :]
    if same.all():
        return spanning(close)
    within = Forest(len(own))
    for i, j in spanning(close & same):
        within.join(i, j)
    label = np.array([within.root(i) for i in range(len(own))])
    i, j = np.nonzero(np.triu(close & ~same))
    _, first = np.unique(label[i] * len(own) + label[j], return_index=True)
    return [(a, b) for a, b in zip(i[first].tolist(), j[first].tolist(), strict=True) if within.join(a, b)]


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys of rows sorted by them; at most one group (a bounded block or pair of blocks) is held besides a batch."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if rest is not None:
            rows = pa.concat_tables([rest, rows])
        columns = [rows[k].to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(len(rows) - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        cuts = np.flatnonzero(change) + 1
        starts = np.concatenate([[0], cuts])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            if b - a > 1:
                yield rows.slice(a, b - a)
        rest = rows.slice(starts[-1])
    if rest is not None and len(rest) > 1:
        yield rest


def features(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set, bands and sketch of each row with words; rows without words or id are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sizes, digests, bands, sketches = [], [], [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                found = shingler(text.as_py())
                ids.append(doc_id), sizes.append(len(found))
                if not len(found) or doc_id is None:
                    digests.append(None), bands.append(None), sketches.append(None)
                    continue
                samples = minhash(found)
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                folded = samples.reshape(BANDS, ROWS)
                band = np.arange(1, BANDS + 1, dtype=np.uint64)
                for r in range(ROWS):
                    band = _mix(band * _SPREAD[r] + folded[:, r])
                bands.append(band.view(np.int64))
                sketches.append(odd_sketch(samples))
            arrays = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "digest", "bands", "sketch"])
        trim()

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, sketch binary")


def _dealt(members: DataFrame, key: str, member: str) -> DataFrame:
    """members with (key, lo, hi, own): groups of up to two blocks as they are, larger ones as every pair of their blocks; own is the member's block.

    Needs members of groups of two at least with the group's size in `size`, counted in members.
    """
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    whole = F.col("size") <= 2 * BLOCK
    own = F.when(whole, F.lit(0)).otherwise(F.pmod(F.xxhash64(member, F.lit(11)), blocks).cast("int"))
    other = F.explode(F.when(whole, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), blocks - 1)))
    return members.withColumn("own", own).withColumn("other", other).withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other")


def _sorted(rows: DataFrame, keys: list[str], member: str) -> DataFrame:
    """Groups one after the other, members in order: trees of a group then start from its least member, so bands that share members share edges."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, member)


def candidate_edges(representatives: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest, bucket by bucket, of the pairs whose odd sketches allow the threshold."""
    most = largest_distance(percent / 100)
    keyed = representatives.withColumn("row", F.xxhash64("digest"))  # a doc_id may have several texts: they would meet crosswise by it
    entries = keyed.select("row", F.explode("bands").alias("band"))
    sizes = entries.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = entries.join(sizes, "band").join(keyed.select("row", "doc_id", "n_shingles", "sketch"), "row")
    dealt = _sorted(_dealt(members, "band", "doc_id").select("band", "lo", "hi", "own", "doc_id", "n_shingles", "sketch"), ["band", "lo", "hi"], "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for group in _groups(batches, ["band", "lo", "hi"]):
            ids = group["doc_id"].to_numpy()
            sketch = np.frombuffer(b"".join(group["sketch"].to_pylist()), np.uint64).reshape(len(ids), -1)
            size = group["n_shingles"].to_numpy()
            if len(ids) == 2:
                if np.bitwise_count(sketch[0] ^ sketch[1]).sum() <= most and 100 * size.min() >= percent * size.max():
                    a.append(int(ids.max())), b.append(int(ids.min()))
            else:
                close = 100 * np.minimum(size[:, None], size) >= percent * np.maximum(size[:, None], size)
                differ = np.zeros((len(ids), len(ids)), np.int16)
                for w in range(sketch.shape[1]):
                    differ += np.bitwise_count(sketch[:, w, None] ^ sketch[None, :, w])
                for i, j in joining(close & (differ <= most), group["own"].to_numpy()):
                    a.append(int(max(ids[i], ids[j]))), b.append(int(min(ids[i], ids[j])))
            if len(a) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        trim()

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def exact_links(sets: list[np.ndarray], percent: int, own: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links of a group of shingle sets, on exact intersections; of two blocks (own), only what joins them."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    if n == 2:
        inter = len(np.intersect1d(*sets, assume_unique=True))
        return [(0, 1)] if linked(np.int64(inter), sizes[0], sizes[1], percent) else []
    owner = np.repeat(np.arange(n), sizes)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    counts = np.bincount(column)
    keep = counts[column] > 1
    owner, column = owner[keep], column[keep]
    _, column = np.unique(column, return_inverse=True)
    inter = np.zeros((n, n), np.float32)
    step = max(256, 16_000_000 // max(1, n))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        lo, hi = np.searchsorted(column, [first, first + step])
        part = np.zeros((n, min(step, int(column[-1]) + 1 - first)), np.float32)
        part[owner[lo:hi], column[lo:hi] - first] = 1
        inter += part @ part.T
    exact = np.rint(inter).astype(np.int64)
    return joining(linked(exact, sizes[:, None], sizes[None, :], percent), np.zeros(n, np.int32) if own is None else own)


def confirmed_edges(documents: DataFrame, families: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): a spanning forest of each family's links, on full shingle sets. families: (doc_id, family, n_shingles) of representatives."""
    shingles = F.ceil(F.sum("n_shingles") * (BLOCK / BLOCK_SHINGLES)).cast("bigint")
    sizes = families.groupBy("family").agg(F.count("*").alias("n"), shingles.alias("weight")).where("n > 1").select("family", F.greatest("n", "weight").alias("size"))
    members = families.select("doc_id", "family").distinct().join(sizes, "family")  # once, however many texts the doc_id has
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(members, "doc_id")
    dealt = _sorted(_dealt(texts, "family", "doc_id").select("family", "lo", "hi", "own", "doc_id", "text"), ["family", "lo", "hi"], "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        a: list[int] = []
        b: list[int] = []
        for group in _groups(batches, ["family", "lo", "hi"]):
            ids = group["doc_id"].to_numpy()
            for i, j in exact_links([shingler(t.as_py()) for t in group["text"]], percent, group["own"].to_numpy()):
                if ids[i] != ids[j]:
                    a.append(int(max(ids[i], ids[j]))), b.append(int(min(ids[i], ids[j])))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        trim()

    return dealt.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row.

    Two documents are linked if 100 * intersection >= percent * union of their sets of k-word shingles (with fewer words, the whole sequence is one
    shingle); component_id is the smallest doc_id reachable over links, kept tells doc_id = component_id. Null, empty and blank texts have no
    shingles and are linked with nothing. Equal sets are linked. A row without doc_id is its own: component_id null, kept true. Rows that repeat a
    doc_id are each returned, with a common component_id if their texts link them, and all kept or none. Other columns are dropped; an empty table
    gives none.
    """
    found = stored(features(documents, k))
    known = found.where(F.col("digest").isNotNull())
    representatives = stored(known.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("copies")))
    candidates = candidate_edges(representatives, percent)
    families = components(candidates).select(F.col("node").alias("doc_id"), F.col("component").alias("family")).join(representatives.select("doc_id", "n_shingles"), "doc_id")
    links = components(confirmed_edges(documents, families, k, percent)).select(F.col("node").alias("representative"), F.col("component").alias("linked"))
    classes = representatives.select("digest", F.col("doc_id").alias("representative"), "copies").join(links, "representative", "left").where((F.col("copies") > 1) | F.col("linked").isNotNull())
    classes = classes.select("digest", F.coalesce("linked", "representative").alias("linked"))
    out = found.select("doc_id", "n_shingles", "digest").join(classes, "digest", "left").withColumn("component_id", F.coalesce("linked", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op7_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
