"""Corpus statistics: TF-IDF, term selection, phrases, pooled entity vectors."""

from __future__ import annotations

from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators import blocks
from papyrine.sources.shared import stored

#: Accented small letters and what they are without accents.
ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def terms(documents: DataFrame, grams: int = 2, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term) of each occurrence: lower-case words of two characters or more without accents, and runs of up to `grams` of them."""
    rows = documents.select(doc, words_of(text).alias("_w"))
    return rows.select(doc, F.explode(runs_of("_w", grams)).alias("term"))


def words_of(text: str = "text") -> Column:
    """The lower-case words of two characters or more without accents."""
    return F.regexp_extract_all(F.translate(F.lower(text), ACCENTED, PLAIN), F.lit(r"([\p{L}\p{N}_]{2,})"), F.lit(1))


def runs_of(words: str, grams: int) -> Column:
    """Words and runs of up to `grams` of them."""
    run = lambda n: F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))).otherwise(F.array())
    return F.concat(words, *(run(n) for n in range(2, grams + 1)))


def tfidf(found: DataFrame, doc: str = "doc_id") -> DataFrame:
    """L1: (doc_id, term, weight): tf times ln((1 + n) / (1 + df)) + 1, each document scaled to length 1.

    n counts the documents that have terms. The document count is one row; document frequencies are joined by term.
    """
    counts = found.groupBy(doc, "term").agg(F.count("*").alias("tf"))
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    n = counts.groupBy(doc).agg(F.lit(1).alias("_one")).agg(F.count("*").alias("n"))
    raw = counts.join(df, "term").join(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + 1))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc)))
    return raw.withColumn("weight", F.col("w") / length).select(doc, "term", "weight")


def anova_f(weights: DataFrame, labels: DataFrame, doc: str = "doc_id") -> DataFrame:
    """L2: (term, f): the F statistic of each term's weight between two or more classes, absent terms counting as 0; null where it has none.

    Only sums over present terms are shuffled: zeros add nothing to sums, and class sizes are a small table.
    """
    by_class = weights.join(labels, doc).groupBy("term", "label").agg(F.sum("weight").alias("_s"), F.sum(F.col("weight") * F.col("weight")).alias("_q"))
    return anova_f_of_sums(by_class, labels)


def anova_f_of_sums(by_class: DataFrame, labels: DataFrame) -> DataFrame:
    """L2 from the sums _s of weights and _q of their squares of each term and label."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_total"), F.count("*").alias("_k"))
    terms_ = by_class.join(F.broadcast(sizes), "label").groupBy("term").agg(F.sum("_s").alias("s"), F.sum("_q").alias("q"), F.sum(F.col("_s") * F.col("_s") / F.col("_n")).alias("b"))
    between = F.col("b") - F.col("s") * F.col("s") / F.col("_total")
    inside = F.col("q") - F.col("b")
    return terms_.join(F.broadcast(total)).select("term", F.try_divide(F.try_divide(between, F.col("_k") - 1), F.try_divide(inside, F.col("_total") - F.col("_k"))).alias("f"))


def phrase_scores(tokens: DataFrame, least: int = 75, threshold: float = 60.0, doc: str = "doc_id", position: str = "pos") -> DataFrame:
    """(a, b, n, score) of neighbouring tokens with (n_ab - least) * |V| / (n_a * n_b) above the threshold; V holds tokens and pairs."""
    pairs = tokens.withColumn("b", F.lead("token").over(Window.partitionBy(doc).orderBy(position))).withColumnRenamed("token", "a")
    return _scored(pairs, least, threshold)


def _neighbours(text: str = "text") -> Column:
    """Structs (a, b) of the blank-separated tokens of a text and the next ones, null after the last."""
    words = F.split(text, " ")
    return F.arrays_zip(words, F.slice(words, F.lit(2), F.size(words)))


def text_phrase_scores(texts: DataFrame, least: int = 75, threshold: float = 60.0, text: str = "text") -> DataFrame:
    """phrase_scores of the blank-separated tokens of whole texts, one a row: neighbours are found in the row, only counts are shuffled."""
    return _scored(texts.select(F.inline(_neighbours(text)).alias("a", "b")), least, threshold)


def _scored(pairs: DataFrame, least: int, threshold: float) -> DataFrame:
    """Pairs are counted once, with those of no next token; what a token alone counts is the sum over its pairs."""
    counts = stored(pairs.groupBy("a", "b").agg(F.count("*").alias("n")))
    single = counts.groupBy("a").agg(F.sum("n").alias("n_a"))
    double = counts.where(F.col("b").isNotNull())
    size = single.agg(F.count("*").alias("_v1")).join(double.agg(F.count("*").alias("_v2")))
    scored = double.where(F.col("n") > least).join(single, "a").join(single.select(F.col("a").alias("b"), F.col("n_a").alias("n_b")), "b").join(F.broadcast(size))
    score = (F.col("n") - least) * (F.col("_v1") + F.col("_v2")) / (F.col("n_a").cast("double") * F.col("n_b"))
    return scored.select("a", "b", "n", score.alias("score")).where(F.col("score") > threshold)


def apply_phrases(tokens: DataFrame, phrases: DataFrame, doc: str = "doc_id", position: str = "pos") -> DataFrame:
    """Tokens (doc_id, pos, token) with neighbours that are a phrase (a, b) joined by `_`, greedily from the left.

    In a run of places where phrases start, the first, third, fifth ... win: a window over the marked places tells them. No dictionary is sent to
    tasks; phrases meet tokens in an equi-join.
    """
    order = Window.partitionBy(doc).orderBy(position)
    nexts = tokens.withColumn("_b", F.lead("token").over(order))
    known = phrases.select(F.col("a").alias("token"), F.col("b").alias("_b")).distinct().withColumn("_start", F.lit(True))
    marked = nexts.join(known, ["token", "_b"], "left").withColumn("_start", F.coalesce("_start", F.lit(False)))
    run = F.col(position) - F.sum(F.col("_start").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    in_run = F.row_number().over(Window.partitionBy(doc, "_start", "_run").orderBy(position))
    wins = marked.withColumn("_run", run).withColumn("_wins", F.col("_start") & (in_run % 2 == 1))
    taken = F.coalesce(F.lag("_wins").over(order), F.lit(False))
    out = wins.withColumn("_taken", taken).where(~F.col("_taken"))
    return out.select(doc, position, F.when(F.col("_wins"), F.concat("token", F.lit("_"), "_b")).otherwise(F.col("token")).alias("token"))


def joined(line: list[str], phrases: set[tuple[str, str]]) -> list[str]:
    """Tokens with neighbours that are a phrase joined by `_`, greedily from the left."""
    out, at = [], 0
    while at < len(line):
        met = at + 1 < len(line) and (line[at], line[at + 1]) in phrases
        out.append(f"{line[at]}_{line[at + 1]}" if met else line[at])
        at += 1 + met
    return out


def _phrased_lines(texts: pa.Table, facts: pa.Table) -> pa.Table:
    phrases = set(zip(facts["a"].to_pylist(), facts["b"].to_pylist(), strict=True))
    lines = [(key, joined(line, phrases)) for key, line in blocks.lines_of(texts)]
    digests = [md5(" ".join(line).encode()).hexdigest() for _, line in lines]
    return pa.table([pa.array([k for k, _ in lines], texts.schema.field("doc_id").type), pa.array([len(x) for _, x in lines], pa.int64()), pa.array(digests, pa.string())], ["doc_id", "tokens", "text"])


def phrased_texts(texts: DataFrame, phrases: DataFrame) -> DataFrame:
    """L17, Q17 on whole texts (doc_id, text): (doc_id, tokens, text), the number of tokens that apply_phrases leaves and the MD5 of their line.

    Texts meet only the phrases (a, b) that their own neighbours are, block by block.
    """
    known = stored(phrases.select("a", "b").distinct())
    doc = texts.schema["doc_id"].dataType.simpleString()
    return blocks.with_facts(texts, _neighbours(), known, ["a", "b"], _phrased_lines, f"doc_id {doc}, tokens bigint, text string")


def _entries(vec: str, width: int) -> list[Column]:
    """The entries of an array column as columns; null beyond its end."""
    return [F.get(vec, F.lit(k)).cast("double") for k in range(width)]


def _by_entry(rows: DataFrame, values: list[Column], *keys: str) -> DataFrame:
    """(keys, i, value): a row for each value that isn't null."""
    return rows.select(*keys, F.posexplode(F.array(*values)).alias("i", "value")).where("value is not null")


def pooled_means(occurrences: DataFrame, width: int, doc: str = "doc_id") -> DataFrame:
    """(token, i, value): each occurrence of an entity in a document gets the mean vector of all of them there; values average over occurrences.

    occurrences: (doc_id, token, vec) with vectors of at most `width` entries, a bound of the model, not of the data. A token that occurs twice counts
    twice. An entry counts where a vector has it. Entries are summed side by side in one row a document and one a token, map-side first.
    """
    return _pooled(_pooled_sums(occurrences, width, doc), width)


def _pooled_sums(occurrences: DataFrame, width: int, doc: str) -> DataFrame:
    """(token, _s0, _d0, ..): sums of the documents' means by occurrence, and of the occurrences that have one."""
    pooled = occurrences.groupBy(doc).agg(*(F.avg(x).alias(f"_p{k}") for k, x in enumerate(_entries("vec", width))))
    times = occurrences.groupBy(doc, "token").agg(F.count("*").alias("_c"))
    sums = [[F.sum(F.col(f"_p{k}") * F.col("_c")).alias(f"_s{k}"), F.sum(F.when(F.col(f"_p{k}").isNotNull(), F.col("_c"))).cast("double").alias(f"_d{k}")] for k in range(width)]
    return times.join(pooled, doc).groupBy("token").agg(*(c for pair in sums for c in pair))


def _pooled(sums: DataFrame, width: int) -> DataFrame:
    out = sums.groupBy("token").agg(*(F.try_divide(F.sum(f"_s{k}"), F.sum(f"_d{k}")).alias(f"_m{k}") for k in range(width)))
    return _by_entry(out, [F.col(f"_m{k}") for k in range(width)], "token")


def pooled_means_by_id(mentions: DataFrame, vectors: DataFrame, width: int, doc: str = "doc_id") -> DataFrame:
    """pooled_means of mentions (doc_id, token, vec_id) of vectors (vec_id, vec); those of unknown ids don't count.

    A token's sum of means is a weighted sum of vectors: weights are added up by token and id, and vectors meet them only then, so none travels with a
    mention. Documents of more than `width` mentions, whose pairs of tokens and ids would outnumber their entries, and those with a vector that is
    short or holds a null are pooled entry by entry.
    """
    whole = F.coalesce((F.size("vec") == width) & ~F.exists("vec", lambda x: x.isNull()), F.lit(False))
    known = vectors.groupBy("vec_id").agg(F.count("*").alias("_k"), F.bool_and(whole).alias("_whole"))
    lines = mentions.join(known, "vec_id").select(doc, "token", "vec_id", "_k", "_whole")
    kinds = lines.groupBy(doc).agg(F.sum("_k").alias("_n"), (F.bool_and("_whole") & (F.count("*") <= width)).alias("_narrow"))
    times = lines.groupBy(doc, "token").agg(F.sum("_k").alias("_c"))
    ids = lines.groupBy(doc, "vec_id").agg(F.count("*").alias("_m"))
    weights = times.join(kinds.where("_narrow"), doc).join(ids, doc).groupBy("token", "vec_id").agg(F.sum(F.col("_c") * F.col("_m") / F.col("_n")).alias("_w"))
    met = weights.join(vectors.select("vec_id", "vec"), "vec_id")
    narrow = met.groupBy("token").agg(*(c for k, x in enumerate(_entries("vec", width)) for c in (F.sum(x * F.col("_w")).alias(f"_s{k}"), F.sum("_w").alias(f"_d{k}"))))
    wide = lines.join(kinds.where("not _narrow").select(doc), doc, "left_semi").join(vectors.select("vec_id", "vec"), "vec_id").select(doc, "token", "vec")
    return _pooled(narrow.unionByName(_pooled_sums(wide, width, doc)), width)


def attention_pool(occurrences: DataFrame, weights: Column, width: int, doc: str = "doc_id") -> DataFrame:
    """(doc_id, i, value): vectors of `width` entries weighted by the softmax of their product with `weights`.

    One row a document: entries are summed side by side, map-side first. Exponents are taken from the document's largest product.
    """
    from papyrine.functions.vectors import dot

    scored = occurrences.select(doc, "vec", dot(F.col("vec"), weights).alias("_s"))
    top = scored.groupBy(doc).agg(F.max("_s").alias("_top"))
    shares = scored.join(top, doc).withColumn("_e", F.exp(F.col("_s") - F.col("_top")))
    sums = shares.groupBy(doc).agg(F.sum("_e").alias("_all"), *(F.sum(x * F.col("_e")).alias(f"_t{k}") for k, x in enumerate(_entries("vec", width))))
    return _by_entry(sums, [F.col(f"_t{k}") / F.col("_all") for k in range(width)], doc)
