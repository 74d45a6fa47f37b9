"""Trained models on stand-in features. Results depend on a training run, so these have no SQL twin; seeds are fixed."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.operators import boosted, graph, learning, metrics, packed, pairfits, pairs, pairtrees, relevance, sampling, skipgram
from papyrine.plans import splits
from papyrine.plans.base import query, table
from papyrine.plans.graphs import sparse_edges
from papyrine.plans.scores import _EDGES, _VEC, joined_pairs, stored_vectors, vector_edges
from papyrine.sources.shared import stored


@query("relevance_lr")
def relevance_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relevance classifier of words and pairs of words, fitted on four fifths of the labelled texts; one row for each held-out text."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit(learning.SEED)), F.lit(5))
    model = relevance.fit(documents, labels.where(fold != 0), relevance.Settings(selected=300))
    asked = documents.join(labels.where(fold == 0), "doc_id", "left_semi")  # only these are asked for
    return relevance.score(asked, model).join(labels.where(fold == 0), "doc_id").select("doc_id", F.col("label").cast("int").alias("label"), "score", (F.col("score") > 0.5).cast("int").alias("prediction"))


@query("relevance_finetuned")
def relevance_finetuned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on the labelled texts of all languages but one, then tuned by short steps on half of that one's; every text of its other half, by both models."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = documents.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id").select("doc_id", "label", "lang")
    half = F.pmod(F.xxhash64("doc_id", F.lit(learning.SEED)), F.lit(2))
    shared = relevance.fit(documents, labels.where("lang <> 'de'"), relevance.Settings(selected=300))
    tuned = relevance.tune(shared, documents, labels.where(F.col("lang").eqNullSafe("de") & (half == 0)), steps=20)
    asked = documents.where(F.col("lang").eqNullSafe("de") & (half == 1))
    both = relevance.score(asked, shared).withColumnRenamed("score", "before").join(relevance.score(asked, tuned), "doc_id")
    return both.join(labels, "doc_id", "left").select("doc_id", F.col("label").cast("int").alias("label"), "before", "score")


_PAIR = "features array<double>, la int, lb int"


def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of vectors; a pair counts as linked if their labels, which aren't among the features, agree."""
    met = joined_pairs(spark, sf_dir, pairs.features_of, _PAIR).withColumn("label", (F.col("la") == F.col("lb")).cast("double"))
    return met.withColumn("features", array_to_vector("features")).withColumn("id", F.xxhash64("a", "b", F.lit(learning.SEED))).select("id", "a", "b", "features", "label")


def packed_pairs(spark: SparkSession, sf_dir: str) -> packed.Packed:
    """The rows of labelled_pairs as chunks; the quarter whose id is a multiple of 4 is the test set (fold -1)."""
    edges = vector_edges(spark, sf_dir)
    fold = F.when(F.pmod(F.xxhash64("a", "b", F.lit(learning.SEED)), F.lit(4)) == 0, -1).otherwise(0)
    return packed.pack(edges.select("a", "b", fold.alias("fold"), F.xxhash64("a", "b").alias("draw"), F.lit(None).alias("mark")), stored_vectors(spark, sf_dir))


def tested(found: DataFrame) -> DataFrame:
    return found.select("a", "b", "label", "score")


@query("gbt_pairs")
def gbt_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 trees of depth 6 at a rate of 0.05 on four fifths of rows and features."""
    rows = packed_pairs(spark, sf_dir)
    return tested(pairtrees.score(rows, pairtrees.fit(rows, boosted.Settings()), keep=lambda c: c.fold < 0))


#: 20 trees of depth 5, each node asks the best of the square root of the number of features.
FOREST = boosted.Settings(trees=1, rate=1.0, depth=5, bins=32, rows=1.0, columns=1.0, l2=0.0, objective="squared")


@query("rf_pairs")
def rf_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L9"""
    rows = packed_pairs(spark, sf_dir)
    model = pairtrees.fit(rows, FOREST, forest=pairtrees.Forest(20, math.ceil(math.sqrt(2 * rows.width))))
    return tested(pairtrees.score(rows, model, forest=True, keep=lambda c: c.fold < 0))


@query("svm_pairs")
def svm_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear kernel stands in for a radial one."""
    rows = packed_pairs(spark, sf_dir)
    return tested(pairfits.score(rows, pairfits.linear(rows, pairfits.hinge_loss, 0.01, 20, standard=True), lambda c: c.fold < 0))


@query("mlp_pairs")
def mlp_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L3, L9"""
    rows = packed_pairs(spark, sf_dir)
    return tested(pairfits.score(rows, pairfits.perceptron(rows, 16, 20, learning.SEED), lambda c: c.fold < 0))


@query(
    "random_baseline",
    f"WITH {_VEC}, {_EDGES} SELECT a, b, CAST(x.label = y.label AS INT) AS label, {splits.d('a', 'b', str(learning.SEED))} / {sampling.DRAWS} AS score FROM e JOIN v x ON x.vec_id = a JOIN v y ON y.vec_id = b",
)
def random_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """scores by chance, reproducible by key."""
    score = sampling.draw(F.col("a"), F.col("b"), F.lit(learning.SEED)) / F.lit(sampling.DRAWS)
    return labelled_pairs(spark, sf_dir).select("a", "b", F.col("label").cast("int").alias("label"), score.alias("score"))


@query("model_metrics")
def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under ROC and average precision of a forest on held-out pairs."""
    found = rf_pairs(spark, sf_dir)
    return metrics.auc(found).join(metrics.average_precision(found))


@query("expression_gbt")
def expression_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expression predicted from vectors, correlations on the held-out tenth. A vector's first component stands for expression and is no feature."""
    vec = F.col("embedding").cast("array<double>")
    e = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.slice(vec, F.lit(2), F.size(vec) - 1)).alias("features"), F.element_at(vec, 1).alias("label"))
    model = learning.boosted_regression(maxIter=10).fit(e.where("vec_id % 10 <> 0"))
    return metrics.correlations(model.transform(e.where("vec_id % 10 = 0")), "label", "prediction")


@query("word_vectors")
def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skip-gram vectors of frequent words."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), F.lit(1))
    sentences = table(spark, sf_dir, "documents").select(words.alias("words"))
    model = learning.word_vectors(sentences, size=16, window=5, least=50, epochs=1)
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


@query("node_vectors")
def node_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of nodes from random walks."""
    walks = graph.random_walks(sparse_edges(spark, sf_dir), 5)
    return skipgram.fit(walks, skipgram.Settings(size=16)).select(F.col("node").cast("string").alias("word"), "vector")


def vector_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))


@query("kmeans_clusters")
def kmeans_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V7"""
    rows = vector_rows(spark, sf_dir)
    return learning.clusters(rows, 5).transform(rows).select("vec_id", F.col("prediction").alias("cluster"))


@query("pca_plane")
def pca_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V6, V8"""
    rows = vector_rows(spark, sf_dir)
    xy = vector_to_array("plane")
    return learning.plane(rows).transform(rows).select("vec_id", xy[0].alias("x"), xy[1].alias("y"))


@query("best_regularisation")
def best_regularisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L4: grid search over folds; one row for each setting with its mean F1."""
    edges = vector_edges(spark, sf_dir).select("a", "b", F.pmod(F.xxhash64("a", "b", F.lit(learning.SEED)), F.lit(3)).alias("fold"), F.lit(0).alias("draw"), F.lit(None).alias("mark"))
    rows, out = packed.pack(edges, stored_vectors(spark, sf_dir)), []
    for penalty in (0.001, 0.1):
        found = []
        for k in range(3):
            model = pairfits.linear(rows, pairfits.logistic_loss, penalty, 10, standard=False, own=lambda c, k=k: pairfits.usable(c) & (c.fold != k))
            found.append(pairfits.f1(rows, model, lambda c, k=k: pairfits.usable(c) & (c.fold == k)))
        out.append((penalty, sum(found) / 3))
    return spark.createDataFrame(out, "reg_param double, f1 double")


#: What the queries below grow; the operator's defaults are 300 trees of depth 6 at a rate of 0.05.
BOOSTED = boosted.Settings(trees=10, depth=3, rate=0.3, bins=32)


def dated_pairs(spark: SparkSession, sf_dir: str, fold: Column) -> packed.Packed:
    """All pairs of vectors as chunks, marked by the first year that a line has them; fold may ask for `a`, `b` and `year`. Labels aren't among the features."""
    ids = table(spark, sf_dir, "embeddings").agg((F.max("vec_id") + 1).alias("z"))
    lines = table(spark, sf_dir, "lineitem").join(F.broadcast(ids)).select((F.col("l_partkey") % F.col("z")).alias("a"), (F.col("l_suppkey") % F.col("z")).alias("b"), F.year("l_shipdate").alias("year"))
    first = lines.groupBy("a", "b").agg(F.min("year").alias("year"))
    return packed.pack(first.select("a", "b", fold.alias("fold"), F.xxhash64("a", "b").alias("draw"), F.col("year").alias("mark")), stored_vectors(spark, sf_dir))


@query("boosted_pairs")
def boosted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds by the hash of both ends, grown together; each pair is scored by the model that left it out."""
    rows = dated_pairs(spark, sf_dir, F.pmod(F.xxhash64("a", "b", F.lit(learning.SEED)), F.lit(5)))
    return pairtrees.score(rows, pairtrees.fit(rows, BOOSTED, folds=5)).select("a", "b", "label", "fold", "score")


@query("boosted_future")
def boosted_future(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on pairs known by 1995, tested on those of each later year: pairs, share of positives, area under ROC, average precision."""
    rows = dated_pairs(spark, sf_dir, F.when(F.col("year") <= 1995, 0).otherwise(-1))
    found = pairtrees.score(rows, pairtrees.fit(rows, BOOSTED), keep=lambda c: c.fold < 0).select(F.col("mark").cast("int").alias("year"), "label", F.round("score", 4).alias("score"))
    found = stored(found)
    sizes = found.groupBy("year").agg(F.count("*").alias("n"), F.avg("label").alias("positives"))
    return sizes.join(metrics.auc(found, "year"), "year").join(metrics.average_precision(found, "year"), "year")


@query("boosted_importance")
def boosted_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute Shapley value of each component of a pair's vectors, over all pairs."""
    rows = dated_pairs(spark, sf_dir, F.lit(0))
    return pairtrees.importance(rows, pairtrees.fit(rows, BOOSTED))
