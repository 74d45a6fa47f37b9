"""Train and test sets by year and chance, without leaks; negatives by anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.functions import patterns as P
from papyrine.functions import vectors as V
from papyrine.operators import entities, graph, metrics, sampling
from papyrine.plans.base import query, table
from papyrine.plans.graphs import MENTIONS, mentions



def h(*keys: str) -> str:
    """sampling.hash_of in SQL."""
    factors = (2654435761, 40503, 2246822519)
    return "(" + " + ".join(f"(({k}) % 1000003) * {f}" for k, f in zip(keys, factors, strict=False)) + ") % 1000003"


_FACTS = f"{MENTIONS}, facts AS (SELECT gene, year FROM m GROUP BY gene, year)"


def facts(spark: SparkSession, sf_dir: str, until: int | None = None) -> DataFrame:
    """(gene, year): a gene may have several years."""
    return mentions(spark, sf_dir, until).select("gene", "year").distinct()


@query("horizon_split", f"WITH {_FACTS} SELECT DISTINCT gene, CASE WHEN year <= 1996 THEN 'train' ELSE 'test' END AS side FROM facts WHERE year <= 1998")
def horizon_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """known by 1996, and first or again seen within a horizon of two years."""
    f = facts(spark, sf_dir, 1998)
    return f.select("gene", F.when(F.col("year") <= 1996, F.lit("train")).otherwise(F.lit("test")).alias("side")).distinct()


_SETS = f"""{_FACTS}, emb AS (SELECT p_partkey AS gene FROM part WHERE p_partkey % 3 <> 0), known AS (SELECT p_partkey AS gene FROM part WHERE p_size < 10),
pos AS (SELECT DISTINCT gene FROM facts WHERE year <= 1995 AND gene IN (SELECT gene FROM emb)),
ever AS (SELECT DISTINCT gene FROM facts),
ptest AS (SELECT DISTINCT gene FROM facts WHERE year > 1995 AND year <= 1997 AND gene IN (SELECT gene FROM emb)),
nt AS (SELECT gene FROM emb WHERE gene NOT IN (SELECT gene FROM pos) AND gene NOT IN (SELECT gene FROM known)),
ne AS (SELECT gene FROM emb WHERE gene NOT IN (SELECT gene FROM ever) AND gene NOT IN (SELECT gene FROM known))"""


@query(
    "cancer_sets",
    f"""WITH {_SETS} SELECT gene, 'pos_train' AS role FROM pos UNION ALL SELECT gene, 'pos_test' FROM ptest
UNION ALL (SELECT gene, 'neg_train' FROM nt ORDER BY {h("gene")}, gene LIMIT (SELECT count(*) FROM pos)) UNION ALL (SELECT gene, 'neg_test' FROM ne ORDER BY {h("gene")}, gene LIMIT (SELECT count(*) FROM ptest))""",
)
def cancer_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positives by year, as many negatives of either side by hash order."""
    f = facts(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), "p_size")
    emb, known = parts.where("gene % 3 <> 0").select("gene"), parts.where("p_size < 10").select("gene")
    with_vector = lambda d: d.select("gene").distinct().join(emb, "gene", "left_semi")
    pos, test = with_vector(f.where("year <= 1995")), with_vector(f.where("year > 1995 and year <= 1997"))
    other = emb.join(known, "gene", "left_anti")
    negative = lambda d, out, n: sampling.ordered_index(d.join(out, "gene", "left_anti"), ["gene"]).join(F.broadcast(n.agg(F.count("*").alias("n")))).where("_row < n").select("gene")
    sets = {"pos_train": pos, "pos_test": test, "neg_train": negative(other, pos, pos), "neg_test": negative(other, f.select("gene").distinct(), test)}
    out = None
    for role, rows in sets.items():
        rows = rows.select("gene", F.lit(role).alias("role"))
        out = rows if out is None else out.unionByName(rows)
    return out


_PAIRS = "p AS (SELECT l_partkey AS a, l_suppkey AS b, l_shipdate < TIMESTAMP '1998-01-01' AS train FROM lineitem)"


def timed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp")).alias("train"))


@query("prior_knowledge_anti", f"WITH {_PAIRS} SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM p WHERE NOT train EXCEPT SELECT least(a, b), greatest(a, b) FROM p WHERE train")
def prior_knowledge_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test pairs that aren't known in either orientation."""
    p = timed_pairs(spark, sf_dir)
    return graph.distinct_undirected(p.where(~F.col("train"))).join(graph.distinct_undirected(p.where("train")), ["src", "dst"], "left_anti")


@query(
    "negative_leak_anti",
    f"WITH {_PAIRS}, t AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM p WHERE NOT train), n AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM p WHERE train) SELECT src, dst, 'test' AS side FROM t UNION ALL SELECT src, dst, 'train' FROM n WHERE (src, dst) NOT IN (SELECT (src, dst) FROM t)",
)
def negative_leak_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of the test set never train."""
    p = timed_pairs(spark, sf_dir)
    test, train = graph.distinct_undirected(p.where(~F.col("train"))), graph.distinct_undirected(p.where("train"))
    return test.withColumn("side", F.lit("test")).unionByName(train.join(test, ["src", "dst"], "left_anti").withColumn("side", F.lit("train")))


def d(*keys: str) -> str:
    """sampling.draw in SQL."""
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 13) AS BIGINT)"


@query(
    "negative_sample_gda",
    f"""WITH {MENTIONS}, known AS (SELECT DISTINCT gene AS src, disease AS dst FROM m), l AS (SELECT DISTINCT gene AS src FROM m),
r AS (SELECT dst, row_number() OVER (ORDER BY dst) - 1 AS place FROM (SELECT DISTINCT disease AS dst FROM m)),
n AS (SELECT there, least(there, CAST(ceil((8000 + known) / sources) AS BIGINT)) AS per FROM (SELECT (SELECT count(*) FROM r) AS there, (SELECT count(*) FROM l) AS sources, (SELECT count(*) FROM known) AS known)),
a AS (SELECT src, there, per, unnest(range(per)) AS draw FROM l, n),
p AS (SELECT DISTINCT src, dst FROM a JOIN r ON place = ({h("src")} + draw * greatest(1, there // per)) % there)
SELECT src, dst FROM p WHERE (src, dst) NOT IN (SELECT (src, dst) FROM known) ORDER BY {h("src", "dst")}, src, dst LIMIT 2000""",
)
def negative_sample_gda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct pairs of a bipartite graph that aren't in it."""
    m = mentions(spark, sf_dir)
    known = m.select(F.col("gene").alias("src"), F.col("disease").alias("dst")).distinct()
    return sampling.negative_pairs(m.select(F.col("gene").alias("src")), m.select(F.col("disease").alias("dst")), known, 2_000)


@query(
    "negative_draws",
    f"""WITH {MENTIONS}, known AS (SELECT DISTINCT gene AS src, disease AS dst FROM m),
l AS (SELECT src, row_number() OVER (ORDER BY src) - 1 AS place FROM (SELECT DISTINCT gene AS src FROM m)), r AS (SELECT dst, row_number() OVER (ORDER BY dst) - 1 AS place FROM (SELECT DISTINCT disease AS dst FROM m)),
n AS (SELECT a, b, a * b - x AS free FROM (SELECT (SELECT count(*) FROM l) AS a, (SELECT count(*) FROM r) AS b, (SELECT count(*) FROM known) AS x)),
drawn AS (SELECT a, b, unnest(range((3 * 2000 * a * b + 2 * free - 1) // (2 * free) + 100)) AS draw FROM n WHERE free > 0)
SELECT draw, src, dst FROM drawn JOIN l ON l.place = {d("'l'", "draw")} % a JOIN r ON r.place = {d("'r'", "draw")} % b WHERE (src, dst) NOT IN (SELECT (src, dst) FROM known) ORDER BY draw LIMIT 2000""",
)
def negative_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws with replacement that reject known pairs only (a sampling operator: the limit is its feature)."""
    m = mentions(spark, sf_dir).select(F.col("gene").alias("src"), F.col("disease").alias("dst"))
    return sampling.negative_draws(m, m, m, 2_000)


@query(
    "negative_sample_ppi",
    f"""WITH {MENTIONS}, g AS (SELECT DISTINCT doc_id, gene FROM m), w AS (SELECT p_partkey % 23 AS chrom, p_partkey AS g, p_partkey * 1000 AS s, p_partkey * 1000 + 500 AS e FROM part),
o AS (SELECT a.gene AS src, b.gene AS dst FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.gene < b.gene UNION SELECT least(a.g, b.g), greatest(a.g, b.g) FROM w a JOIN w b ON a.chrom = b.chrom AND b.s < a.e + 100000 AND b.e > a.s - 100000),
both_ways AS (SELECT src, dst FROM o UNION ALL SELECT dst, src FROM o), x AS (SELECT p_partkey AS src, p_partkey + 7 AS dst FROM part WHERE p_size = 1 AND (p_partkey, p_partkey + 7) NOT IN (SELECT (src, dst) FROM both_ways)),
r AS (SELECT dst, row_number() OVER (ORDER BY dst) - 1 AS place FROM (SELECT DISTINCT gene AS dst FROM m)),
n AS (SELECT there, least(there, CAST(ceil((12000 + known) / there) AS BIGINT)) AS per FROM (SELECT (SELECT count(*) FROM r) AS there, (SELECT count(*) FROM both_ways) AS known)),
a AS (SELECT dst AS src, there, per, unnest(range(per)) AS draw FROM r, n), p AS (SELECT DISTINCT src, dst FROM a JOIN r ON place = ({h("src")} + draw * greatest(1, there // per)) % there),
drawn AS (SELECT src, dst FROM p WHERE (src, dst) NOT IN (SELECT (src, dst) FROM both_ways) ORDER BY {h("src", "dst")}, src, dst LIMIT 3000)
SELECT src, dst, 0 AS origin FROM x UNION ALL SELECT DISTINCT least(src, dst), greatest(src, dst), 1 FROM drawn WHERE src <> dst AND (least(src, dst), greatest(src, dst)) NOT IN (SELECT (src, dst) FROM x)""",
)
def negative_sample_ppi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experimental negatives first, then drawn pairs; neither in the positives nor too near on a chromosome, in either orientation."""
    m = mentions(spark, sf_dir)
    positives = graph.pairs_within(m.select("doc_id", "gene").distinct(), "doc_id", "gene").select("src", "dst").distinct()
    places = table(spark, sf_dir, "part").select((F.col("p_partkey") % 23).alias("chrom"), F.col("p_partkey").alias("g"), (F.col("p_partkey") * 1000).alias("s"))
    left = places.select("chrom", F.col("g").alias("a"), F.col("s").alias("a_start"), (F.col("s") + 500).alias("a_end"))
    right = places.select("chrom", F.col("g").alias("b"), F.col("s").alias("b_start"), (F.col("s") + 500).alias("b_end"))
    near = graph.range_join(left, right, "chrom", 100_000).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    out = graph.distinct_undirected(positives.union(near))
    both = out.union(out.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    experimental = table(spark, sf_dir, "part").where("p_size = 1").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") + 7).alias("dst")).join(both, ["src", "dst"], "left_anti")
    genes = m.select("gene").distinct()
    drawn = graph.distinct_undirected(sampling.negative_pairs(genes.select(F.col("gene").alias("src")), genes.select(F.col("gene").alias("dst")), both, 3_000).where("src <> dst"))
    return experimental.withColumn("origin", F.lit(0)).unionByName(drawn.join(experimental, ["src", "dst"], "left_anti").withColumn("origin", F.lit(1)))


@query("split_70_15_15", f"WITH n AS (SELECT s_suppkey, row_number() OVER (ORDER BY {h('s_suppkey')}, s_suppkey) - 1 AS r, count(*) OVER () AS c FROM supplier) SELECT s_suppkey, CASE WHEN r < floor(c * 0.7) THEN 'train' WHEN r < floor(c * 0.7) + floor(c * 0.15) THEN 'validation' ELSE 'test' END AS split FROM n")
def split_70_15_15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N6"""
    return sampling.three_way(table(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"])


@query("half_split", f"WITH n AS (SELECT c_custkey, row_number() OVER (ORDER BY {h('c_custkey')}, c_custkey) - 1 AS r, count(*) OVER () AS c FROM customer) SELECT c_custkey, CASE WHEN r >= c // 2 THEN 1 ELSE 0 END AS half FROM n")
def half_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N8"""
    return sampling.halves(table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"])


@query("kfold", f"SELECT p_partkey, p_type, CAST((row_number() OVER (PARTITION BY p_type ORDER BY {h('p_partkey')}, p_partkey) - 1) % 5 AS INT) AS fold FROM part")
def kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N10, L4, L6"""
    return sampling.folds(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", ["p_partkey"])


@query("balance", f"WITH r AS (SELECT p_partkey, p_type, row_number() OVER (PARTITION BY p_type ORDER BY {h('p_partkey')}, p_partkey) AS k FROM part) SELECT p_partkey, p_type FROM r WHERE k <= (SELECT min(c) FROM (SELECT count(*) AS c FROM part GROUP BY p_type))")
def balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N2"""
    return sampling.balanced(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", ["p_partkey"])


@query("sample_without_replacement", f"SELECT o_orderkey FROM orders ORDER BY {h('o_orderkey')}, o_orderkey LIMIT 500")
def sample_without_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1 (a sampling operator: the limit is its feature)"""
    return sampling.sample(table(spark, sf_dir, "orders").select("o_orderkey"), 500, "o_orderkey")


@query(
    "stratified_by_source",
    f"""WITH p AS (SELECT DISTINCT p_partkey AS a, p_size AS b, unnest([p_brand[-1:], p_type[1:1]]) AS source FROM part),
n AS (SELECT a, b, row_number() OVER (ORDER BY {h("a", "b")}, a, b) - 1 AS r FROM (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem)),
t AS (SELECT count(*) AS total FROM n), need AS (SELECT source, count(*) AS c FROM p GROUP BY source),
runs AS (SELECT source, (ascii(source) * 7919) % total AS f, total, unnest(range(least(c, total))) AS draw FROM need, t)
SELECT a, b, source, 1 AS label FROM p UNION ALL SELECT a, b, source, 0 FROM runs JOIN n ON n.r = (f + draw) % total""",
)
def stratified_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N12"""
    part = table(spark, sf_dir, "part")
    sources = F.array_distinct(F.array(F.right("p_brand", F.lit(1)), F.left("p_type", F.lit(1))))
    positives = part.select(F.col("p_partkey").alias("a"), F.col("p_size").cast("bigint").alias("b"), sources.alias("sources")).distinct()
    negatives = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b")).distinct()
    return sampling.by_source(positives, negatives, ["a", "b"])


@query(
    "bootstrap_intervals",
    f"""WITH b AS (SELECT p_type, p_retailprice, replicate, {d("p_partkey", "replicate", "42")} / {sampling.DRAWS} AS u FROM part, range(100) AS x(replicate)),
w AS (SELECT p_type, p_retailprice, replicate, {' + '.join(f"CAST(u > CAST({s} AS DOUBLE) AS INT)" for s in sampling.POISSON)} AS weight FROM b),
m AS (SELECT p_type, replicate, sum(CAST(p_retailprice AS DOUBLE) * weight) / sum(weight) AS m FROM w WHERE weight > 0 GROUP BY p_type, replicate)
SELECT p_type, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.05), 6) AS low, round(quantile_cont(m, 0.95), 6) AS high FROM m GROUP BY p_type""",
)
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean price by size with 5th and 95th percentile of 100 bootstrap replicates."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_type", "p_retailprice")
    means = sampling.bootstrap(rows, 100).groupBy("p_type", "replicate").agg((F.sum(F.col("p_retailprice").cast("double") * F.col("weight")) / F.sum("weight")).alias("m"))
    out = means.groupBy("p_type").agg(F.avg("m").alias("mean"), F.expr("percentile(m, 0.05)").alias("low"), F.expr("percentile(m, 0.95)").alias("high"))
    return metrics.rounded(out, "mean", "low", "high")


@query("chromosome_split", "SELECT s_suppkey, CASE WHEN 'chr' || s_nationkey = 'chr1' THEN 'test' ELSE 'train' END AS split FROM supplier")
def chromosome_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chromosome 1 is held out."""
    chrom = F.concat(F.lit("chr"), F.col("s_nationkey").cast("string"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.when(chrom == "chr1", F.lit("test")).otherwise(F.lit("train")).alias("split"))


@query("split_sizes", "SELECT CASE WHEN s_nationkey = 1 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM supplier GROUP BY 1")
def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10"""
    return chromosome_split(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))


@query("pairs_with_vectors", "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_partkey IN (SELECT vec_id FROM embeddings WHERE label < 5) AND l_suppkey IN (SELECT vec_id FROM embeddings)")
def pairs_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends have a vector."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()
    e = table(spark, sf_dir, "embeddings")
    return lines.join(e.where("label < 5").select(F.col("vec_id").alias("src")), "src", "left_semi").join(e.select(F.col("vec_id").alias("dst")), "dst", "left_semi").select("src", "dst")


_DISEASES = f"d AS (SELECT DISTINCT p_partkey AS gene, ({P.STOPPED_DISEASES + ['gout', 'asthma', 'rickets']!r})[1 + p_size % 13] AS disease FROM part)"


@query("stopped_diseases", f"WITH {_DISEASES} SELECT gene, disease FROM d WHERE disease NOT IN ({', '.join(map(repr, P.STOPPED_DISEASES))})")
def stopped_diseases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """associations without the diseases of the stop list."""
    names = F.array(*map(F.lit, [*P.STOPPED_DISEASES, "gout", "asthma", "rickets"]))
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("gene"), F.get(names, (F.col("p_size") % 13).cast("int")).alias("disease")).distinct()
    return entities.without_stopped(pairs)


@query("original_case", "WITH n AS (SELECT lower(p_brand) AS k, max(p_brand) AS name FROM part WHERE p_size > 5 GROUP BY 1) SELECT DISTINCT lower(p_brand || CASE WHEN p_size % 9 = 0 THEN 'x' ELSE '' END) AS k, coalesce(name, lower(p_brand || CASE WHEN p_size % 9 = 0 THEN 'x' ELSE '' END)) AS name FROM part LEFT JOIN n ON n.k = lower(p_brand || CASE WHEN p_size % 9 = 0 THEN 'x' ELSE '' END)")
def original_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folded names back in their original case, themselves where unknown."""
    part = table(spark, sf_dir, "part")
    names = part.where("p_size > 5").groupBy(F.lower("p_brand").alias("k")).agg(F.max("p_brand").alias("name"))
    keys = part.select(F.lower(F.concat("p_brand", F.when(F.col("p_size") % 9 == 0, F.lit("x")).otherwise(F.lit("")))).alias("k")).distinct()
    return keys.join(names, "k", "left").select("k", F.coalesce("name", "k").alias("name"))


@query("guarded_facts", "WITH r AS (SELECT lower(p_brand) AS gene, CASE WHEN p_size % 5 = 0 THEN 'unknown' ELSE CAST(1995 + p_size % 20 AS VARCHAR) END AS y FROM part) SELECT DISTINCT gene, TRY_CAST(y AS INT) AS year FROM r WHERE TRY_CAST(y AS INT) > 2003")
def guarded_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows whose year doesn't parse are passed over."""
    y = F.when(F.col("p_size") % 5 == 0, F.lit("unknown")).otherwise((F.lit(1995) + F.col("p_size") % 20).cast("string"))
    return table(spark, sf_dir, "part").select(F.lower("p_brand").alias("gene"), y.try_cast("int").alias("year")).where("year > 2003").distinct()


@query("nonzero_vectors", "SELECT vec_id FROM embeddings WHERE vec_id % 7 <> 0")
def nonzero_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero and null vectors go."""
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.when(F.col("vec_id") % 14 == 0, F.transform("embedding", lambda x: x * 0)).when(F.col("vec_id") % 7 != 0, F.col("embedding")))
    return e.where(V.is_nonzero(F.col("v"))).select("vec_id")
