"""Target-distribution importance resampling over hashed features, by bucket-partitioned postings.

Every document gives one posting (bucket, document, count) for each bucket of its features. Postings are shuffled by bucket, where they meet the totals of
both corpora and so their bucket's gain; each emits its contribution, and contributions are summed by document. A draw is the documents of the highest
weight plus Gumbel noise, which is a sample without replacement in proportion to exp(weight).
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.llm.common import drop_stored, stored, table, trim

BUCKETS, MOST_WORDS = 10_000, 1
#: Documents need so many words to be drawn; the draw takes this share of them, in percent.
LEAST, PERCENT, SEED = 20, 10, 2024
#: Slices into which the postings of a bucket are dealt by document: a bucket that most documents have isn't one task.
SLICES = 32
#: Distinct features whose buckets a task remembers.
REMEMBERED = 200_000
#: A-Z in lower case, digits, small letters and bytes beyond ASCII as they are, everything else a blank.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_COUNTED = "row bigint, doc_id bigint, n_words bigint, n_features bigint, buckets array<int>, counts array<bigint>"


def words(raw: bytes) -> list[bytes]:
    """Runs of ASCII digits, letters (in lower case) and characters beyond ASCII, of a text in UTF-8."""
    return raw.translate(_PLAIN).split()


def features(own: list[bytes], most: int) -> Iterator[bytes]:
    """All runs of 1 to `most` words, joined by one space."""
    yield from own
    for n in range(2, most + 1):
        for i in range(len(own) - n + 1):
            yield b" ".join(own[i : i + n])


def _count(batches: Iterator[pa.RecordBatch], most: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Postings of each text; row is a number within the task's rows, made whole by the caller."""
    known: dict[bytes, int] = {}
    for batch in batches:
        texts = batch["text"].cast(pa.binary())
        n_words, n_features, places, counts, sizes = [], [], [], [], [0]
        for text in texts:
            own = words(text.as_py() or b"")
            found = Counter(features(own, most) if most > 1 else own)
            if len(known) > REMEMBERED:
                known.clear()
            for f in found:
                if f not in known:
                    known[f] = zlib.crc32(f) % buckets
            at, inverse = np.unique(np.fromiter(map(known.__getitem__, found), np.int32, len(found)), return_inverse=True)
            n = np.bincount(inverse, np.fromiter(found.values(), np.float64, len(found)), len(at)).astype(np.int64)  # whole numbers, far under 2^53
            n_words.append(len(own))
            n_features.append(int(n.sum()))
            places.append(at)
            counts.append(n)
            sizes.append(sizes[-1] + len(at))
        offsets = pa.array(sizes, pa.int32())
        joined = [np.concatenate(x) if x else np.empty(0) for x in (places, counts)]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in zip(joined, (pa.int32(), pa.int64()), strict=True)]
        columns = [batch["row"], batch["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), *lists]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_words", "n_features", "buckets", "counts"])
    trim()


def counted(texts: DataFrame, most: int = MOST_WORDS, buckets: int = BUCKETS) -> DataFrame:
    """(row, doc_id, n_words, n_features, buckets, counts) of each text (doc_id, text), written: rows keep their numbers whatever is computed again."""
    rows = texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(partial(_count, most=most, buckets=buckets), _COUNTED))


def _postings(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.explode(F.arrays_zip("buckets", "counts")).alias("p")).select("row", F.col("p.buckets").alias("bucket"), F.col("p.counts").alias("n"))


def _floored_mean(total: Column, n: Column) -> Column:
    """total / n without its fraction, towards minus infinity, in whole numbers."""
    return F.when(n > 0, (total - F.pmod(total, n)) / n).otherwise(F.lit(0))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): floor(1000 ln) of a bucket's smoothed share of the target's features over that of the source's, for each bucket of the source.

    Both corpora are summed by bucket, within tasks first, and meet there: no more rows than buckets are left.
    """
    both = _postings(source).select("bucket", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t"))
    both = both.unionByName(_postings(target).select("bucket", F.lit(0).cast("bigint").alias("s"), F.col("n").alias("t")))
    totals = stored(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    whole = totals.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    size, asked = (F.lit(float(x + buckets)) for x in whole)
    ratio = ((F.col("t") + F.lit(1.0)) * size) / ((F.col("s") + F.lit(1.0)) * asked)
    return totals.where("s > 0").select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("bigint").alias("gain"))


def weighed(source: DataFrame, gained: DataFrame, slices: int = SLICES) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) of counted documents: each posting meets its bucket's gain, contributions are summed by document."""
    place = lambda k: (F.col("bucket") * slices + k).alias("place")  # noqa: E731  bucket and slice in one number
    dealt = _postings(source).select("row", "n", place(F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int")))
    copies = gained.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(place(F.col("slice")), "gain")
    contributions = dealt.join(copies.hint("shuffle_hash"), "place").select("row", (F.col("n") * F.col("gain")).alias("c"))
    own = ["doc_id", "n_words", "n_features"]
    none = [F.lit(None).cast("bigint").alias(c) for c in own]
    summed = contributions.select("row", "c", *none).unionByName(source.select("row", F.lit(0).cast("bigint").alias("c"), *own))
    by_row = summed.groupBy("row").agg(F.sum("c").alias("total"), *(F.max(c).alias(c) for c in own))
    return by_row.select("row", *own, _floored_mean(F.col("total"), F.col("n_features")).cast("bigint").alias("weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """1000 times a Gumbel variate, floored, from the first 8 hex digits of sha256("seed:doc_id")."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("bigint")


def ranked(scored: DataFrame, quota: Column, order: list[Column]) -> DataFrame:
    """scored with `rank` from 1 in this order, null beyond the quota: rows are dealt by ranges, numbered within them, and offsets come from one row a range."""
    ranged = stored(scored.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    local = ranged.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order))).join(F.broadcast(offsets), "_part")
    rank = (F.col("_offset") + F.col("_at")).cast("bigint")
    return local.withColumn("rank", F.when(rank <= quota, rank)).drop("_part", "_at", "_offset", "_all")


def resample(documents: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST, most: int = MOST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank for each row of documents (doc_id, text), weighed against target (text).

    Of the rows with at least `least` words, `percent` in a hundred are drawn: those of the highest score, ties to the smaller doc_id, ranked from 1; rank
    is null for the others. Null and empty texts have no features and weight 0. Rows that repeat a doc_id each count as a document and share their noise;
    at equal scores either may come first. Rows without doc_id are weighed but have no noise: score and rank are null, and they don't count among those
    that the draw is a share of. An empty target makes every gain a smoothed one against nothing; an empty table gives no rows. Texts of any length are
    counted whole. Other columns are dropped, whatever their names.
    """
    source = counted(documents, most, buckets)
    asked = counted(target.select(F.lit(None).cast("bigint").alias("doc_id"), "text"), most, buckets)
    scored = stored(weighed(source, gains(source, asked, buckets)).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    for used in (source, asked):
        drop_stored(used)
    able = (F.col("n_words") >= least) & F.col("doc_id").isNotNull()
    found = ranked(scored.where(able), F.floor(F.lit(percent) * F.col("_all") / 100), [F.col("score").desc(), F.col("doc_id").asc(), F.col("row").asc()])
    rest = scored.where(~able).withColumn("rank", F.lit(None).cast("bigint"))
    return found.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
