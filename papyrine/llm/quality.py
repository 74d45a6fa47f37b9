"""Quality classifier: histogram gradient-boosted trees over document statistics, scored as flat arrays in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm import boosting
from papyrine.llm.common import held_out, labelled_ids, map_arrow, sample_texts, table

#: Labelled rows of each class that the fit reads at most.
SAMPLE_PER_CLASS = 12_000
#: Score from which a document counts as good.
THRESHOLD = 0.3

#: Byte classes whose shares are features.
CLASSES = {
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "blank": b" \t\r\x0b\x0c",
    "line": b"\n",
    "stop": b".?",
    "comma": b",;:",
    "bang": b"!",
    "bar": b"|",
    "mark": b"#$%&*@^~_=+<>\\/",
    "bracket": b"()[]{}\"'`-",
    "high": bytes(range(128, 256)),
}
FEATURES = [*CLASSES, "log_bytes", "log_words", "word_mean", "word_kinds", "longest_word", "line_kinds", "line_mean", "top_byte", "byte_entropy", "run", "caps_start", "ends_stop"]
_MASK = np.zeros((256, len(CLASSES)))
for _k, _bytes in enumerate(CLASSES.values()):
    _MASK[list(_bytes), _k] = 1


def statistics(text: str | None) -> np.ndarray:
    """FEATURES of one whole text; of a null or empty text all are 0."""
    if not text:
        return np.zeros(len(FEATURES))
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    words = text.split()
    lines = text.split("\n")
    share = counts[counts > 0] / n
    kinds = len(set(words))
    repeated = sum(map(str.__eq__, words, words[1:]))
    many = max(1, len(words))
    return np.array(
        [
            *(counts @ _MASK / n),
            np.log1p(n),
            np.log1p(len(words)),
            n / many,
            kinds / many,
            max(map(len, words), default=0),
            len(set(lines)) / len(lines),
            np.log1p(n / len(lines)),
            counts.max() / n,
            float(-(share * np.log2(share)).sum()),
            repeated / many,
            sum(w[0].isupper() for w in words) / many,
            sum(w[-1] == "." for w in words) / many,
        ]
    )


def _matrix(texts: pa.Array) -> np.ndarray:
    return np.stack([statistics(t.as_py()) for t in texts])


def fit(documents: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, per_class: int = SAMPLE_PER_CLASS, **settings) -> boosting.FlatTrees:
    """The model, from the statistics of at most 2 * per_class labelled rows that are not held out. Only statistics reach the driver."""
    sampled = sample_texts(documents, labelled_ids(labels, "quality", modulus, remainder, per_class))

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column("text"))
        return pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column("label").cast(pa.int32())], ["x", "label"])

    rows = map_arrow(sampled, per_batch, "x array<double>, label int").toPandas()
    if rows.empty:
        return boosting.constant(0.5)
    order = np.lexsort(np.stack(rows["x"].to_list()).T)  # whatever order the rows came in
    return boosting.fit(np.stack(rows["x"].to_list())[order], rows["label"].to_numpy(dtype=float)[order], **settings)


def score(documents: DataFrame, model: boosting.FlatTrees) -> DataFrame:
    """Columns doc_id, score (0 to 1) and statistics of each row; one output row for each input row.

    Null and empty texts have statistics of 0 and so one score; repeated rows give repeated rows; other columns are dropped; an empty table gives none.
    Texts of any length are read whole.
    """

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = _matrix(batch.column("text"))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.probability(x)), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "score", "statistics"])

    return map_arrow(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), per_batch, "doc_id bigint, score double, statistics array<double>")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"))
    return score(documents, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
