"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text, compared window by window.

A window is one word in a fixed frame; its evidence is how many bytes the toxic dictionary saves over the ordinary one. Evidence is turned into a
probability by boosted stumps, that is by thresholds on the evidence, calibrated on documents that the dictionaries in use there have not seen.
"""

from __future__ import annotations

import heapq
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.llm import boosting
from papyrine.llm.common import drop_stored, held_out, labelled_ids, map_arrow, sample_texts, stored, table, trim

#: Labelled rows of each class that the fit reads at most.
SAMPLE_PER_CLASS = 6_000
THRESHOLD = 0.7
#: Words that a dictionary holds at most: those typical of its class, and those common in any text.
TYPICAL, COMMON = 1_500, 2_000
#: Bytes of a word that make one window; longer words are cut into several.
LONGEST = 64
#: Windows of one generation whose evidence a task remembers.
REMEMBERED = 120_000
_EDGE = ".,!?*&%$#|\"'():;-"
_OPEN, _CLOSE = b"\x01\x02", b"\x03\x04"


def windows(text: str | None) -> Counter[bytes]:
    """The windows of a whole text with their counts: its lower-case words without outer punctuation, cut every LONGEST bytes."""
    out: Counter[bytes] = Counter()
    for word, n in Counter((text or "").lower().split()).items():
        raw = word.strip(_EDGE).encode("utf-8", "replace")
        if 0 < len(raw) <= LONGEST:
            out[raw] = out.get(raw, 0) + n
        else:
            for i in range(0, len(raw), LONGEST):
                out[raw[i : i + LONGEST]] += n
    return out


class Distance:
    """Bytes saved by the toxic dictionary over the ordinary one, per window."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes]):
        self.toxic, self.ordinary = _compressor(toxic), _compressor(ordinary)
        self.known: dict[bytes, tuple[int, float]] = {}
        self.before: dict[bytes, tuple[int, float]] = {}

    def __call__(self, window: bytes) -> tuple[int, float]:
        found = self.known.get(window)
        if found is None:
            found = self.before.get(window)
            if found is None:
                framed = _OPEN + window + _CLOSE + _OPEN + window[::-1] + _CLOSE
                saved = len(self.ordinary.compress(framed)) - len(self.toxic.compress(framed))
                found = (saved, saved / len(window))
            if len(self.known) >= REMEMBERED:  # windows of two generations are remembered
                self.before, self.known = self.known, {}
            self.known[window] = found
        return found


def _compressor(words: list[bytes]) -> zstandard.ZstdCompressor:
    """The first words end up nearest to the data, where a reference to them costs least."""
    settings = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=16, hash_log=16, search_log=9, min_match=4, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    content = b"".join(_OPEN + w + _CLOSE for w in reversed(words)) or _OPEN + b"\x00" * 8 + _CLOSE
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=dictionary, compression_params=settings)


def evidence(text: str | None, distance: Distance) -> list[float]:
    """What the calibrated thresholds see of one whole text: its largest savings, and how many distinct windows and occurrences save much."""
    own = windows(text)
    if not own:
        return [0.0] * EVIDENCE
    values, telling = [], []
    for w, n in own.items():
        one = distance(w)
        values.append(one[0])
        if one[0] >= 3:
            telling.append((one[0], one[1], n))
    saved = heapq.nlargest(3, values)
    share = heapq.nlargest(2, (r for _, r, _ in telling)) or [0.0]
    total = sum(own.values())
    count = lambda rule: float(sum(rule(s, r) for s, r, _ in telling))
    times = lambda rule: float(sum(n for s, r, n in telling if rule(s, r)))
    whole, long, most = (lambda s, r: s >= 4 and r >= 0.9), (lambda s, r: s >= 5), (lambda s, r: s >= 5 and r >= 0.5)
    return [
        *(float(sum(saved[:k]) / len(saved[:k])) for k in (1, 2, 3)),
        *(count(lambda s, r, k=k: s >= k) for k in (3, 4, 5, 6)),
        float(share[0]), float(sum(share)), count(whole), times(whole), times(long), times(most), times(whole) / total, times(most) / total,
        float(sum(s >= 4 for s, _, _ in telling) / len(values)), float(np.log1p(len(values))),
    ]


#: Numbers that evidence() returns.
EVIDENCE = 17


def _typical(counts, side: str, other: str, totals: dict[str, float]) -> list[bytes]:
    """Words much more frequent in documents of `side`, most telling first."""
    n, m = counts[side].to_numpy(float), counts[other].to_numpy(float)
    expected = (m + 0.5) / max(totals[other], 1) * totals[side]
    telling = (n - expected) / np.sqrt(expected + 0.25)
    keep = (n >= 3) & (n > 3 * expected) & (telling > 4)
    order = np.lexsort((counts["word"].to_numpy(), -telling))
    return [bytes(counts["word"].iloc[i]) for i in order if keep[i] and len(counts["word"].iloc[i]) >= 4][:TYPICAL]


def fit(documents: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, per_class: int = SAMPLE_PER_CLASS) -> dict:
    """Dictionaries and thresholds, from at most 2 * per_class labelled rows that are not held out.

    Word counts are aggregated on the executors; the driver gets the leading words and one row of evidence per sampled document. Thresholds are
    calibrated crosswise: evidence on each half of the sample comes from dictionaries of the other half. Null texts count as empty, labels other than 0
    and 1 are passed over, of repeated labels the larger counts; without labels of both classes every text gets the same score.
    """
    # the sampled texts are read from the corpus once; their number has a bound
    sampled = stored(sample_texts(documents, labelled_ids(labels, "toxic", modulus, remainder, per_class)).withColumn("half", (F.xxhash64("doc_id", F.lit(7)) % 2 == 0).cast("int")))

    def words(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [(w, label, half) for t, label, half in zip(batch["text"].to_pylist(), batch["label"].to_pylist(), batch["half"].to_pylist(), strict=True) for w in sorted(windows(t))]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())], ["word", "label", "half"])

    names = {(k, h): f"n{k}{h}" for k in (0, 1) for h in (0, 1)}
    sums = [F.sum(((F.col("label") == k) & (F.col("half") == h)).cast("long")).alias(n) for (k, h), n in names.items()]
    counts = map_arrow(sampled, words, "word binary, label int, half int").groupBy("word").agg(*sums)
    totals = sampled.agg(*sums).first().asDict()
    totals = {k: v or 0 for k, v in totals.items()}
    toxic, ordinary = F.col("n10") + F.col("n11"), F.col("n00") + F.col("n01")
    n1, n0 = max(1, totals["n10"] + totals["n11"]), max(1, totals["n00"] + totals["n01"])
    counts = stored(counts.where(toxic + ordinary >= 2).withColumns({"toxic": toxic, "ordinary": ordinary}))
    toxic, ordinary = F.col("toxic"), F.col("ordinary")
    # words that tell too little for either dictionary stay on the executors
    lead = lambda by: counts.where(by > 2).orderBy(by.desc(), "word").limit(3 * TYPICAL)
    expect1, expect0 = (ordinary + 0.5) * (n1 / n0), (toxic + 0.5) * (n0 / n1)
    leading = lead((toxic - expect1) / F.sqrt(expect1 + 0.25)).unionByName(lead((ordinary - expect0) / F.sqrt(expect0 + 0.25))).unionByName(counts.orderBy(ordinary.desc(), "word").limit(COMMON)).distinct().toPandas()

    def dictionaries(halves: tuple[int, ...]) -> tuple[list[bytes], list[bytes]]:
        own = leading.assign(a=sum(leading[f"n1{h}"] for h in halves), b=sum(leading[f"n0{h}"] for h in halves))
        total = {"a": sum(totals[f"n1{h}"] for h in halves), "b": sum(totals[f"n0{h}"] for h in halves)}
        common = own.sort_values(["b", "word"], ascending=[False, True])["word"][:COMMON]
        common = [bytes(w) for w in common if len(w) > 1]
        bad, good = _typical(own, "a", "b", total), _typical(own, "b", "a", total)
        return bad + common, good[: len(bad)] + common

    crossed = {h: dictionaries((1 - h,)) for h in (0, 1)}

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        distances = {h: Distance(*d) for h, d in crossed.items()}
        x = [evidence(t, distances[h]) for t, h in zip(batch["text"].to_pylist(), batch["half"].to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch["label"].cast(pa.int32())], ["x", "label"])

    rows = map_arrow(sampled, per_batch, "x array<double>, label int").toPandas()
    drop_stored(sampled), drop_stored(counts)
    if rows.empty:
        return {"dictionaries": ([], []), "trees": boosting.constant(0.01)}
    x = np.stack(rows["x"].to_list())
    order = np.lexsort(x.T)
    y = rows["label"].to_numpy(float)[order]
    return {"dictionaries": dictionaries((0, 1)), "trees": boosting.fit(x[order], y, trees=120, depth=2, rate=0.1, least=0.5)}


def score(rows: DataFrame, model: dict, name: str = "score") -> DataFrame:
    """rows with a score (0 to 1) in the column `name`: every column and row of the input stays, but an input column of that name gives way.

    Null, empty and wordless texts have no windows and get the one score of no evidence. Repeated rows get equal scores. An empty table gives none.
    Texts of any length are read whole; words of over LONGEST bytes are cut into several windows.
    """
    rows = rows.drop(name)
    schema = T.StructType([*rows.schema, T.StructField(name, T.DoubleType())])

    def run(batches):
        distance = Distance(*model["dictionaries"])
        for batch in batches:
            if batch.num_rows:
                x = np.array([evidence(t.as_py(), distance) for t in batch["text"]])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model["trees"].probability(x))], [*batch.schema.names, name])
        trim()

    return rows.mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"))
    return score(documents.select("doc_id", "text"), model).select("doc_id", held_out(3, 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
