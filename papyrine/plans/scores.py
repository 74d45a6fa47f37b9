"""Vector features, rankings, metrics and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.functions import vectors as V
from papyrine.operators import corpus, graph, metrics, pairs
from papyrine.operators.sampling import hash_of
from papyrine.plans.base import query, table
from papyrine.plans.splits import h
from papyrine.plans.texts import _TOKENS


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, vec as doubles)"""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vec"))


_VEC = "v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)"
_EDGES = "e AS (SELECT DISTINCT l_partkey % z AS a, l_suppkey % z AS b FROM lineitem, (SELECT max(vec_id) + 1 AS z FROM embeddings))"


def vector_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b): parts and suppliers of all lines, as ids of the whole range of vectors; the range is one row."""
    ids = table(spark, sf_dir, "embeddings").agg((F.max("vec_id") + 1).alias("z"))
    return table(spark, sf_dir, "lineitem").join(F.broadcast(ids)).select((F.col("l_partkey") % F.col("z")).alias("a"), (F.col("l_suppkey") % F.col("z")).alias("b")).distinct()


def stored_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, vec as the table has it): half the bytes of doubles."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("vec"))


def joined_pairs(spark: SparkSession, sf_dir: str, values, schema: str) -> DataFrame:
    """(a, b, schema) for pairs whose ends both have vectors: what `values` gives of both, where their blocks meet."""
    return pairs.join_vectors(vector_edges(spark, sf_dir), stored_vectors(spark, sf_dir), values, schema)


@query("pair_features", f"WITH {_VEC}, {_EDGES} SELECT a, b, len(list_concat(x.vec, y.vec)) AS width, round(x.vec[1], 6) AS first, round(y.vec[-1], 6) AS last FROM e JOIN v x ON x.vec_id = a JOIN v y ON y.vec_id = b")
def pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J12, D10"""
    return metrics.rounded(joined_pairs(spark, sf_dir, pairs.ends_of, "width bigint, first double, last double"), "first", "last")


@query("context_prob", f"WITH {_VEC}, {_EDGES} SELECT a, b, round(1 / (1 + exp(-list_inner_product(x.vec, y.vec))), 6) AS p FROM e JOIN v x ON x.vec_id = a JOIN v y ON y.vec_id = b")
def context_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1"""
    return joined_pairs(spark, sf_dir, pairs.dot_of, "d double").select("a", "b", F.round(V.sigmoid(F.col("d")), 6).alias("p"))


@query("pair_cosine", f"WITH {_VEC}, {_EDGES} SELECT a, b, round(list_cosine_similarity(x.vec, y.vec), 6) AS cosine FROM e JOIN v x ON x.vec_id = a JOIN v y ON y.vec_id = b")
def pair_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V2"""
    return joined_pairs(spark, sf_dir, pairs.cosine_of, "c double").select("a", "b", F.round("c", 6).alias("cosine"))


_MEAN = "c AS (SELECT list(m ORDER BY i) AS vec FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM v WHERE label = 3) GROUP BY i))"


def mean_vector(rows: DataFrame) -> DataFrame:
    """One row, ref: the mean of each component."""
    parts = rows.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"))
    return parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("ref"))


@query("cosine_topk", f"WITH {_VEC}, {_MEAN} SELECT vec_id, round(list_cosine_similarity(v.vec, c.vec), 6) AS score FROM v, c ORDER BY round(list_cosine_similarity(v.vec, c.vec), 6) DESC, vec_id LIMIT 100")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 100 nearest to a reference vector (one row, so it is sent to every task)."""
    v = vectors(spark, sf_dir)
    scored = v.join(F.broadcast(mean_vector(v.where("label = 3")))).select("vec_id", F.round(V.cosine(F.col("vec"), F.col("ref")), 6).alias("score"))
    return metrics.top(scored, 100, F.col("score").desc(), "vec_id")


@query(
    "analogy",
    f"""WITH {_VEC}, u AS (SELECT vec_id, list_transform(vec, lambda x: x / sqrt(list_inner_product(vec, vec))) AS vec FROM v),
q AS (SELECT list_transform(list_zip(a.vec, b.vec, c.vec), lambda z: (z[1] + z[2] - z[3]) / 3) AS vec FROM u a, u b, u c WHERE a.vec_id = 1 AND b.vec_id = 2 AND c.vec_id = 3)
SELECT u.vec_id AS vec_id, round(list_cosine_similarity(u.vec, q.vec), 6) AS score FROM u, q WHERE u.vec_id NOT IN (1, 2, 3) ORDER BY round(list_cosine_similarity(u.vec, q.vec), 6) DESC, vec_id LIMIT 10""",
)
def analogy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: nearest to the mean of two unit vectors and the negative of a third, these left out."""
    u = vectors(spark, sf_dir).select("vec_id", V.unit(F.col("vec")).alias("vec"))
    one = lambda i, n: u.where(F.col("vec_id") == i).select(F.col("vec").alias(n))
    q = one(1, "p").join(one(2, "q")).join(one(3, "r")).select(F.transform(V.plus(V.plus(F.col("p"), F.col("q")), F.col("r"), -1.0), lambda x: x / 3).alias("ref"))
    scored = u.where(~F.col("vec_id").isin(1, 2, 3)).join(F.broadcast(q)).select("vec_id", F.round(V.cosine(F.col("vec"), F.col("ref")), 6).alias("score"))
    return metrics.top(scored, 10, F.col("score").desc(), "vec_id")


@query("collected_vectors", "SELECT w AS vec_id, label FROM (VALUES (1), (5), (999999)) t(w) JOIN embeddings ON vec_id = w")
def collected_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V5: vectors of listed words; unknown ones are missing."""
    listed = spark.createDataFrame([(1,), (5,), (999999,)], "vec_id int")
    return listed.join(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id")


_OCC = "o AS (SELECT l_orderkey AS doc_id, l_partkey % 50 AS token, vec FROM lineitem JOIN v ON vec_id = (l_linenumber * 1009 + l_suppkey) % (SELECT max(vec_id) + 1 FROM embeddings))"


#: Entries of a vector of the tables.
WIDTH = 64


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, token, vec_id): every line mentions a part in an order; its vector is any of the whole table (the range of ids is one row)."""
    ids = table(spark, sf_dir, "embeddings").agg((F.max("vec_id") + 1).alias("z"))
    lines = table(spark, sf_dir, "lineitem").join(F.broadcast(ids))
    return lines.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 50).alias("token"), ((F.col("l_linenumber") * 1009 + F.col("l_suppkey")) % F.col("z")).alias("vec_id"))


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, token, vec) of the mentions"""
    return mentions(spark, sf_dir).join(vectors(spark, sf_dir).select("vec_id", "vec"), "vec_id").select("doc_id", "token", "vec")


@query(
    "pooled_mean",
    f"""WITH {_VEC}, {_OCC}, x AS (SELECT doc_id, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS i FROM o), p AS (SELECT doc_id, i, avg(x) AS p FROM x GROUP BY doc_id, i),
t AS (SELECT doc_id, token, count(*) AS c FROM o GROUP BY doc_id, token) SELECT token, CAST(i AS INT) AS i, round(sum(p * c) / sum(c), 6) AS value FROM t JOIN p USING (doc_id) GROUP BY token, i""",
)
def pooled_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11"""
    return metrics.rounded(corpus.pooled_means_by_id(mentions(spark, sf_dir), stored_vectors(spark, sf_dir), WIDTH), "value")


@query(
    "attention_pool",
    f"""WITH {_VEC}, {_OCC}, s AS (SELECT doc_id, vec, list_inner_product(vec, list_transform(range(64), lambda k: (k % 5) * 1.0::DOUBLE - 2)) AS s FROM o), m AS (SELECT doc_id, max(s) AS m FROM s GROUP BY doc_id),
e AS (SELECT s.doc_id, exp(s - m) AS e, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS i FROM s JOIN m USING (doc_id)) SELECT doc_id, CAST(i AS INT) AS i, round(sum(x * e) / sum(e), 6) AS value FROM e GROUP BY doc_id, i""",
)
def attention_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12 with fixed weights."""
    weights = F.array(*(F.lit(float(k % 5) - 2) for k in range(WIDTH)))
    return metrics.rounded(corpus.attention_pool(occurrences(spark, sf_dir), weights, WIDTH), "value")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, score) with ties: short documents against their quality."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return labels.join(d, "doc_id").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), F.round(F.lit(1.0) / (F.col("n_chars") % 37 + 1), 6).alias("score"))


_SCORED = "s AS (SELECT doc_id AS id, quality AS label, round(1.0::DOUBLE / (n_chars % 37 + 1), 6) AS score FROM labels JOIN documents USING (doc_id))"
_CURVE = f"{_SCORED}, a AS (SELECT score, sum(label) AS t, count(*) AS k FROM s GROUP BY score), c AS (SELECT score, t, k, sum(t) OVER w AS tp, sum(k) OVER w AS n, sum(t) OVER () AS pos, sum(k) OVER () AS rows FROM a WINDOW w AS (ORDER BY score DESC))"


@query("roc_curve", f"WITH {_CURVE} SELECT score AS threshold, round((n - tp) / CAST(rows - pos AS DOUBLE), 6) AS fpr, round(tp / CAST(pos AS DOUBLE), 6) AS tpr FROM c")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, W3"""
    return metrics.rounded(metrics.roc(scored(spark, sf_dir)), "fpr", "tpr")


@query("roc_auc", f"WITH {_SCORED} SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0::DOUBLE WHEN a.score = b.score THEN 0.5::DOUBLE ELSE 0 END) / count(*), 6) AS auc FROM s a, s b WHERE a.label = 1 AND b.label = 0")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1; the twin compares all pairs."""
    return metrics.rounded(metrics.auc(scored(spark, sf_dir)), "auc")


@query("avg_precision", f"WITH {_CURVE} SELECT round(sum(t / CAST(pos AS DOUBLE) * (tp / CAST(n AS DOUBLE))), 6) AS average_precision FROM c")
def avg_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2"""
    return metrics.rounded(metrics.average_precision(scored(spark, sf_dir)), "average_precision")


@query("pr_curve", f"WITH {_CURVE} SELECT score AS threshold, round(tp / CAST(n AS DOUBLE), 6) AS precision, round(tp / CAST(pos AS DOUBLE), 6) AS recall FROM c")
def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3"""
    return metrics.rounded(metrics.precision_recall(scored(spark, sf_dir)), "precision", "recall")


@query(
    "f1_accuracy",
    f"WITH {_SCORED}, t AS (SELECT sum(CASE WHEN label = 1 AND score >= 0.05 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN label = 0 AND score >= 0.05 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN label = 1 AND score < 0.05 THEN 1 ELSE 0 END) AS fn, count(*) AS n FROM s) SELECT round((n - fp - fn) / CAST(n AS DOUBLE), 6) AS accuracy, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 6) AS f1 FROM t",
)
def f1_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M4"""
    return metrics.rounded(metrics.confusion(scored(spark, sf_dir), 0.05).select("accuracy", "f1"), "accuracy", "f1")


@query(
    "pearson_spearman",
    "WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), k AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0::DOUBLE AS ry FROM r) SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM k",
)
def pearson_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M5, W4"""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))
    return metrics.rounded(metrics.correlations(rows, "x", "y"), "pearson", "spearman")


@query("best_fit", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M6"""
    return metrics.rounded(metrics.best_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice"), "slope", "intercept", places=4)


@query(
    "vocabulary_by_dot",
    f"""WITH {_VEC}, p AS (SELECT vec AS ref FROM v WHERE vec_id = 12)
SELECT vec_id, round(list_inner_product(vec, ref) / sqrt(list_inner_product(ref, ref)), 6) AS dot FROM v, p WHERE contains(CAST(vec_id AS VARCHAR), '12') ORDER BY list_inner_product(vec, ref) DESC, vec_id LIMIT 20""",
)
def vocabulary_by_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that contain a part, ranked by the dot product with the part's unit vector (a top-k report); ids stand for words."""
    v = vectors(spark, sf_dir)
    part = v.where("vec_id = 12").select(F.col("vec").alias("ref"))
    dot = V.dot(F.col("vec"), F.col("ref"))
    found = v.where(F.col("vec_id").cast("string").contains("12")).join(F.broadcast(part)).withColumn("_raw", dot)
    best = found.orderBy(F.col("_raw").desc(), "vec_id").limit(20)
    return best.select("vec_id", F.round(F.col("_raw") / F.sqrt(V.dot(F.col("ref"), F.col("ref"))), 6).alias("dot"))


@query("paired_t", "SELECT round(avg(d) / (stddev_samp(d) / sqrt(count(d))), 6) AS t, count(d) - 1 AS df FROM (SELECT l_discount - l_tax AS d FROM lineitem)")
def paired_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7, Q22"""
    return metrics.rounded(metrics.paired_t(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax"), "t")


_DENSITY = "exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0) - 0.5 * ln(df * pi()) - (df + 1) / 2.0 * ln(1 + u * u / df))"
_AREA = "list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {f})) * {t} / 6000"  # Simpson's rule from 0 to t


def _area(t: str) -> str:
    return _AREA.format(f=_DENSITY.replace("u * u", f"({t} * i / 2000.0) ^ 2"), t=t)


@query(
    "paired_test",
    f"""WITH RECURSIVE s AS (
    SELECT l_suppkey, l_linenumber, avg(d) AS m, stddev_samp(d) AS sd, count(d) AS n FROM (SELECT l_suppkey, l_linenumber, l_discount - l_tax AS d FROM lineitem) GROUP BY ALL),
e AS (SELECT *, CASE WHEN n > 1 AND sd > 0 THEN sd / sqrt(n) END AS error, nullif(n - 1, 0)::DOUBLE AS df FROM s),
f AS (SELECT *, greatest(0, 1 - 2 * {_area("abs(m / error)")}) AS p FROM e),
q(df, t, k) AS (
    SELECT DISTINCT df, 0::DOUBLE, 0 FROM e WHERE error IS NOT NULL
    UNION ALL SELECT df, t + (0.475 - {_area("t")}) / {_DENSITY.replace("u * u", "t * t")}, k + 1 FROM q WHERE k < 25)
SELECT l_suppkey, l_linenumber, round(m, 6) AS mean_difference, round(m / error, 6) AS t, n - 1 AS df, round(p, 6) AS p_value,
       round(m - q.t * error, 6) AS low, round(m + q.t * error, 6) AS high
FROM f LEFT JOIN q ON q.df = f.df AND q.k = 25""",
)
def paired_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M7: discount against tax over the lines of each supplier and line number, with p-value and interval; the twin integrates the density instead."""
    found = metrics.paired_test(table(spark, sf_dir, "lineitem"), "l_discount", "l_tax", 0.95, "l_suppkey", "l_linenumber")
    return metrics.rounded(found, "mean_difference", "t", "p_value", "low", "high")


@query("prec_recall_at_k", f"WITH {_SCORED}, b AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 100) SELECT round(sum(label) / CAST(count(*) AS DOUBLE), 6) AS precision_at_k, round(sum(label) / CAST((SELECT sum(label) FROM s) AS DOUBLE), 6) AS recall_at_k FROM b")
def prec_recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O4"""
    return metrics.rounded(metrics.at_k(scored(spark, sf_dir), 100, "id"), "precision_at_k", "recall_at_k")


@query("ranked_predictions", f"WITH {_VEC}, {_EDGES}, p AS (SELECT a, b, round(1 / (1 + exp(-list_inner_product(x.vec, y.vec))), 6) AS s FROM e JOIN v x ON x.vec_id = a JOIN v y ON y.vec_id = b) SELECT a, b, printf('%.4f', s) AS score FROM p WHERE s > 0.5 ORDER BY s DESC, a, b LIMIT 10")
def ranked_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best edges above a threshold, four decimals (a top-k report)."""
    best = metrics.top(context_prob(spark, sf_dir).where("p > 0.5"), 10, F.col("p").desc(), "a", "b")
    return best.select("a", "b", F.printf(F.lit("%.4f"), "p").alias("score"))


@query("known_share", f"WITH {_VEC}, {_EDGES}, p AS (SELECT DISTINCT a FROM e JOIN v x ON x.vec_id = a JOIN v y ON y.vec_id = b WHERE 1 / (1 + exp(-list_inner_product(x.vec, y.vec))) > 0.5) SELECT count(*) AS predicted, count(*) FILTER (a % 3 = 0) AS known, round(count(*) FILTER (a % 3 = 0) / CAST(count(*) AS DOUBLE), 6) AS share FROM p")
def known_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M8, Q14"""
    predicted = context_prob(spark, sf_dir).where("p > 0.5").select("a")
    known = vectors(spark, sf_dir).where("vec_id % 3 = 0").select(F.col("vec_id").alias("a"))
    return metrics.rounded(metrics.share_known(predicted, known, "a"), "share")


@query("top_error", "SELECT upper(p_brand) AS brand, p_partkey, round(abs(log2(p_retailprice + 0.25) - p_size / 5.0::DOUBLE), 6) AS error FROM part WHERE p_size / 5.0::DOUBLE >= 1 ORDER BY round(abs(log2(p_retailprice + 0.25) - p_size / 5.0::DOUBLE), 6) DESC, p_partkey LIMIT 100")
def top_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest errors of a prediction on a log scale."""
    predicted = F.col("p_size") / F.lit(5.0)
    rows = table(spark, sf_dir, "part").where(predicted >= 1).select(F.upper("p_brand").alias("brand"), "p_partkey", F.round(F.abs(F.log2(F.col("p_retailprice") + 0.25) - predicted), 6).alias("error"))
    return metrics.top(rows, 100, F.col("error").desc(), "p_partkey")


@query("log_expression", "SELECT p_partkey, round(log2(p_retailprice + 0.25), 6) AS log_tpm FROM part")
def log_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F16, S14, D15"""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.log2(F.col("p_retailprice") + 0.25), 6).alias("log_tpm"))


@query("feature_importance", f"WITH {_VEC}, x AS (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS i FROM v) SELECT CAST(i AS INT) AS i, round(avg(abs(x)), 6) AS importance FROM x GROUP BY i ORDER BY importance DESC, i LIMIT 10")
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean size of each component, ten largest."""
    parts = vectors(spark, sf_dir).select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(F.round(F.avg(F.abs("x")), 6).alias("importance"))
    return metrics.top(parts, 10, F.col("importance").desc(), "i")


@query("column_means", f"WITH {_VEC}, x AS (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS i FROM v) SELECT label, CAST(i AS INT) AS i, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS sd FROM x GROUP BY label, i")
def column_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A15, V9"""
    parts = vectors(spark, sf_dir).select("label", F.posexplode("vec").alias("i", "x"))
    return parts.groupBy("label", "i").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("sd"))


@query("standardized", f"WITH {_VEC}, x AS (SELECT vec_id, unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS i FROM v), m AS (SELECT i, avg(x) AS a, stddev_pop(x) AS s FROM x GROUP BY i) SELECT vec_id, CAST(i AS INT) AS i, round((x - a) / s, 5) AS z FROM x JOIN m USING (i)")
def standardized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V9: population standard deviation."""
    parts = vectors(spark, sf_dir).select("vec_id", F.posexplode("vec").alias("i", "x"))
    stats = parts.groupBy("i").agg(F.avg("x").alias("a"), F.stddev_pop("x").alias("s"))
    return parts.join(F.broadcast(stats), "i").select("vec_id", "i", F.round((F.col("x") - F.col("a")) / F.col("s"), 5).alias("z"))


@query("run_statistics", "SELECT l_returnflag, round(avg(l_discount), 6) AS mean, round(stddev_pop(l_discount), 6) AS sd, round(stddev_samp(l_discount), 6) AS sd1, round(quantile_cont(l_discount, 0.05), 6) AS low, round(quantile_cont(l_discount, 0.95), 6) AS high FROM lineitem GROUP BY l_returnflag")
def run_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13"""
    r = table(spark, sf_dir, "lineitem").groupBy("l_returnflag")
    return r.agg(*(F.round(F.expr(e), 6).alias(n) for n, e in {"mean": "avg(l_discount)", "sd": "stddev_pop(l_discount)", "sd1": "stddev_samp(l_discount)", "low": "percentile(l_discount, 0.05)", "high": "percentile(l_discount, 0.95)"}.items()))


@query("unique_classes", "SELECT count(DISTINCT toxic) AS classes, count(DISTINCT toxic) = 2 AS both FROM labels")
def unique_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A16"""
    return table(spark, sf_dir, "labels").agg(F.count_distinct("toxic").alias("classes"), (F.count_distinct("toxic") == 2).alias("both"))


_NODES = f"n AS (SELECT vec_id AS g, vec FROM v WHERE label IN (1, 2)), k AS (SELECT least(a, b) AS src, greatest(a, b) AS dst FROM e)"


@query("unseen_pairs", f"WITH {_VEC}, {_EDGES}, {_NODES} SELECT x.g AS src, y.g AS dst, round(list_cosine_similarity(x.vec, y.vec), 6) AS p FROM n x JOIN n y ON x.g < y.g WHERE list_cosine_similarity(x.vec, y.vec) >= 0.2 AND (x.g, y.g) NOT IN (SELECT (src, dst) FROM k)")
def unseen_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored pairs of two classes of entities that no edge joins in either orientation.

    Scoring every pair is what is asked for; entities are dealt to blocks, so a task meets two blocks of bounded size.
    """
    nodes = stored_vectors(spark, sf_dir).where("label in (1, 2)")
    found = pairs.near_pairs(nodes, nodes, 0.2, ordered=True)
    known = graph.distinct_undirected(vector_edges(spark, sf_dir), "a", "b").toDF("src", "dst")
    return found.join(known, ["src", "dst"], "left_anti").select("src", "dst", F.round("c", 6).alias("p"))


@query("gda_candidates", f"WITH {_VEC}, {_EDGES} SELECT x.vec_id AS gene, y.vec_id AS disease, round(list_cosine_similarity(x.vec, y.vec), 6) AS p FROM v x, v y WHERE x.label = 4 AND y.label = 5 AND list_cosine_similarity(x.vec, y.vec) > 0.1 AND (x.vec_id, y.vec_id) NOT IN (SELECT (a, b) FROM e)")
def gda_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J10, J8 (directed), F12: genes by diseases, blocks against blocks."""
    v = stored_vectors(spark, sf_dir)
    found = pairs.near_pairs(v.where("label = 4"), v.where("label = 5"), 0.1).where("c > 0.1").toDF("gene", "disease", "c")
    return found.join(vector_edges(spark, sf_dir).toDF("gene", "disease"), ["gene", "disease"], "left_anti").select("gene", "disease", F.round("c", 6).alias("p"))


@query(
    "random_members",
    f"""WITH {_EDGES}, {_VEC}, n AS (SELECT vec_id AS g, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM v), z AS (SELECT count(*) AS z FROM n),
d AS (SELECT a, b, k, ({h('a', 'b')} + k) % z AS i FROM e, z, (SELECT unnest(range(0, 3)) AS k)) SELECT a, b, arg_min(g, k) AS g FROM d JOIN n USING (i) WHERE g <> a AND g <> b GROUP BY a, b""",
)
def random_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each pair another member, at the hashed place of the pair among all members or, where that is one of the pair, at the places after it."""
    pool = graph.dense_index(vectors(spark, sf_dir).select(F.col("vec_id").alias("g")), "g", "_place")
    sizes = pool.agg(F.count("*").alias("_z"))
    asked = vector_edges(spark, sf_dir).join(F.broadcast(sizes)).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    drawn = asked.withColumn("_place", F.pmod(hash_of(F.col("a"), F.col("b")) + F.col("_k"), F.col("_z")).cast("bigint")).join(pool, "_place").where("g <> a and g <> b")
    return drawn.groupBy("a", "b").agg(F.min_by("g", "_k").alias("g"))


_TERMS_SQL = "t AS (SELECT doc_id, unnest(regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM c GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS n FROM c), w AS (SELECT doc_id, term, tf * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS w FROM c JOIN d USING (term), n), x AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)"


def weights(spark: SparkSession, sf_dir: str, grams: int = 1) -> DataFrame:
    return corpus.tfidf(corpus.terms(table(spark, sf_dir, "documents"), grams))


@query("tfidf_l2", f"WITH {_TERMS_SQL} SELECT term, count(*) AS documents, round(sum(weight), 4) AS total FROM x GROUP BY term HAVING count(*) > 3")
def tfidf_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: total weight of each term of more than three documents."""
    total = weights(spark, sf_dir).groupBy("term").agg(F.count("*").alias("documents"), F.sum("weight").alias("w"))
    return total.where("documents > 3").select("term", "documents", F.round("w", 4).alias("total"))


@query("bigram_counts", "WITH t AS (SELECT doc_id, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}_]{2,}') AS w FROM documents), b AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM t) SELECT term, count(*) AS n FROM b GROUP BY term HAVING count(*) > 5")
def bigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1: neighbouring words as terms."""
    return corpus.terms(table(spark, sf_dir, "documents"), 2).where(F.col("term").contains(" ")).groupBy("term").agg(F.count("*").alias("n")).where("n > 5")


@query(
    "anova_f_topk",
    f"""WITH {_TERMS_SQL}, l AS (SELECT doc_id, quality AS label FROM labels), z AS (SELECT label, count(*) AS n FROM l GROUP BY label), k AS (SELECT sum(n) AS total, count(*) AS k FROM z),
b AS (SELECT term, label, sum(weight) AS s, sum(weight * weight) AS q FROM x JOIN l USING (doc_id) GROUP BY term, label), g AS (SELECT term, sum(s) AS s, sum(q) AS q, sum(s * s / n) AS b FROM b JOIN z USING (label) GROUP BY term)
SELECT term, round(((b - s * s / total) / (k - 1)) / ((q - b) / (total - k)), 4) AS f FROM g, k ORDER BY round(((b - s * s / total) / (k - 1)) / ((q - b) / (total - k)), 4) DESC, term LIMIT 50""",
)
def anova_f_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L2: the 50 terms that best tell classes apart (a top-k report)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    f = corpus.anova_f(weights(spark, sf_dir), labels).select("term", F.round("f", 4).alias("f"))
    return metrics.top(f, 50, F.col("f").desc(), "term")


@query(
    "phrase_scores",
    f"""WITH {_TOKENS}, p AS (SELECT token AS a, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM t), s AS (SELECT a, count(*) AS n FROM p GROUP BY a), d AS (SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY a, b),
v AS (SELECT (SELECT count(*) FROM s) + (SELECT count(*) FROM d) AS v) SELECT d.a AS a, d.b AS b, d.n AS n, round((d.n - 5) * v / (CAST(x.n AS DOUBLE) * y.n), 4) AS score FROM d JOIN s x ON x.a = d.a JOIN s y ON y.a = d.b, v WHERE d.n > 5 AND (d.n - 5) * v / (CAST(x.n AS DOUBLE) * y.n) > 10""",
)
def phrase_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L17"""
    return metrics.rounded(corpus.text_phrase_scores(table(spark, sf_dir, "documents"), 5, 10.0), "score", places=4)


_PHRASES = f"""{_TOKENS}, p AS (SELECT doc_id, pos, token AS a, lead(token) OVER (PARTITION BY doc_id ORDER BY pos) AS b FROM t), s AS (SELECT a, count(*) AS n FROM p GROUP BY a), d AS (SELECT a, b, count(*) AS n FROM p WHERE b IS NOT NULL GROUP BY a, b),
v AS (SELECT (SELECT count(*) FROM s) + (SELECT count(*) FROM d) AS v), ph AS (SELECT d.a AS a, d.b AS b FROM d JOIN s x ON x.a = d.a JOIN s y ON y.a = d.b, v WHERE d.n > 5 AND (d.n - 5) * v / (CAST(x.n AS DOUBLE) * y.n) > 10)"""


@query(
    "phrased_corpus",
    f"""WITH {_PHRASES}, m AS (SELECT p.*, ph.a IS NOT NULL AS hit FROM p LEFT JOIN ph ON ph.a = p.a AND ph.b = p.b), r AS (SELECT *, pos - sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM m),
w AS (SELECT *, hit AND row_number() OVER (PARTITION BY doc_id, hit, run ORDER BY pos) % 2 = 1 AS wins FROM r), k AS (SELECT *, coalesce(lag(wins) OVER (PARTITION BY doc_id ORDER BY pos), false) AS taken FROM w)
SELECT doc_id, count(*) AS tokens, md5(string_agg(CASE WHEN wins THEN a || '_' || b ELSE a END, ' ' ORDER BY pos)) AS text FROM k WHERE NOT taken GROUP BY doc_id""",
)
def phrased_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with phrases joined."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    return corpus.phrased_texts(texts, corpus.text_phrase_scores(texts, 5, 10.0))


@query("early_stopping", "SELECT o_custkey % 20 AS epoch, round(avg(o_totalprice), 4) AS loss, round(min(avg(o_totalprice)) OVER (ORDER BY o_custkey % 20), 4) AS best FROM orders GROUP BY o_custkey % 20")
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best value so far; the window sees one row an epoch."""
    losses = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20).alias("epoch")).agg(F.avg("o_totalprice").alias("l"))
    so_far = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, 0)
    return losses.select("epoch", F.round("l", 4).alias("loss"), F.round(F.min("l").over(so_far), 4).alias("best"))
