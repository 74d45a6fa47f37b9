"""Language by compression: the language whose zstandard dictionary makes a text's windows smallest, rejected when the margin is narrow.

Only lower-case words are compressed, so punctuation and case don't matter, and a window that repeats in a text counts once. Every window stands behind
a frame that every dictionary ends with: a window of a few words would else be stored uncompressed. Texts of all lengths are treated alike.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.llm.common import held_out, table

#: Documents of each language that the fit reads at most, windows that its dictionary holds, and their code points.
DOCUMENTS_PER_LANGUAGE, WINDOWS, WINDOW = 400, 128, 400
#: Languages up to which the ids of the sample are broadcast.
FEW_LANGUAGES = 2_000
#: Groups that the documents of one language are dealt to where there are more languages than that.
SALTS = 64
#: Code points of a window when texts are scored.
SCORED_WINDOW = 500
_FRAME = b"<<0123456789=ABCDEFGH"
#: Relative margin of the best over the second language below which a prediction counts as rejected.
NARROW = 0.004
UNDECIDED = "und"
#: Runs of letters, and of characters such as fractions and Roman numerals, which the pattern can't tell from letters.
_WORD = re.compile(r"[^\W\d_]+")


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for run in _WORD.finditer(text or "") for c in run[0])


def words(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    runs = _WORD.findall(text.lower())
    if "".join(runs).isalpha():
        return runs
    out: list[str] = []
    for run in runs:
        if run.isalpha():
            out.append(run)
        else:
            out += "".join(c if c.isalpha() else " " for c in run).split()
    return out


def windows(text: str) -> set[bytes]:
    """The distinct windows of a whole text with letters."""
    plain = " ".join(words(text))
    return {_FRAME + f" {plain[i : i + SCORED_WINDOW]} ".encode("utf-8", "replace") for i in range(0, len(plain), SCORED_WINDOW)}


def fit(documents: DataFrame, modulus: int = 5, remainder: int = 0) -> dict[str, bytes]:
    """Dictionary content for each language, from documents that are not held out and have a language, an id and a text.

    A language gives DOCUMENTS_PER_LANGUAGE documents at most, one window of each at a place given by its id, and WINDOWS of these, all in hash order.
    Documents are thinned by a hash threshold before any are ranked, so no task or driver holds more than a small multiple of those, also of a
    language that most documents have; texts are read for the chosen ids only. Null languages, ids and texts are passed over; repeated rows may give
    repeated windows; an empty table gives no language, and then every text is undecided.
    """
    ids = documents.select("doc_id", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(modulus, remainder))
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    sizes = ids.groupBy("lang").agg(F.count("*").alias("n"))
    few = sizes.count() <= FEW_LANGUAGES  # then a row or a sample of each language is little enough to go to every task
    if few:
        sized = ids.join(F.broadcast(sizes), "lang")
    else:  # a language that many documents have is dealt to SALTS groups
        salts = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        sized = ids.withColumn("_salt", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(SALTS)).cast("int")).join(salts, ["lang", "_salt"]).drop("_salt")
    thinned = sized.withColumn("_order", order).where(F.col("_order") * F.col("n") < 2 * DOCUMENTS_PER_LANGUAGE + 50)
    chosen = thinned.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_order", "doc_id"))).where(F.col("_rank") <= DOCUMENTS_PER_LANGUAGE).select("doc_id", "lang")
    if few:
        chosen = F.broadcast(chosen)
    ranked = documents.select("doc_id", "text").where(F.length("text") > 0).join(chosen, "doc_id")
    place = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.ceil(F.length("text") / WINDOW)).cast("int")
    pieces = ranked.select("lang", "doc_id", F.substr("text", place * WINDOW + 1, F.lit(WINDOW)).alias("piece"))
    chosen = pieces.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "piece"), "doc_id", "piece"))).where(F.col("_rank") <= WINDOWS)
    out: dict[str, list[str]] = {}
    for row in chosen.orderBy("lang", "_rank").collect():
        out.setdefault(row["lang"], []).append(" ".join(words(row["piece"])))
    return {lang: " ".join(pieces).encode("utf-8", "replace") for lang, pieces in out.items()}


class Identifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        settings = zstandard.ZstdCompressionParameters(
            window_log=18, chain_log=17, hash_log=17, search_log=7, min_match=4, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False
        )
        self.languages = sorted(dictionaries)
        self.compressors = []
        for lang in self.languages:
            content = zstandard.ZstdCompressionDict(dictionaries[lang] + b" " + _FRAME, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=settings)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=content, compression_params=settings))

    def __call__(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and relative margin of a whole text."""
        if not has_letter(text) or not self.languages:
            return UNDECIDED, 0.0, 0.0
        sizes = [0] * len(self.languages)
        for window in windows(text):
            for k, compressor in enumerate(self.compressors):
                sizes[k] += len(compressor.compress(window))
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        best = order[0]
        if len(order) == 1:
            return self.languages[best], 1.0, 1.0
        margin = (sizes[order[1]] - sizes[best]) / sizes[order[1]]
        return self.languages[best], 1 / (1 + math.exp(-50 * margin)), margin


def identify(documents: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, margin and rejected (the margin is narrow) of each row.

    Texts that are null, empty or without a letter get `und`, score 0, rejected. Ties go to the first language by name. Repeated rows give repeated
    rows; other columns are dropped; an empty table gives none. Texts of any length are compressed whole, window by window.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(dictionaries)
        for batch in batches:
            if batch.num_rows:
                found = [identifier(t.as_py()) for t in batch["text"]]
                langs, scores, margins = ([f[k] for f in found] for k in range(3))
                columns = [batch["doc_id"], pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64()), pa.array([m < NARROW for m in margins], pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "margin", "rejected"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double, margin double, rejected boolean")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return identify(documents, fit(documents)).select("doc_id", held_out(5, 0).alias("held_out"), "lang_pred", "score", "margin", "rejected")
