"""Co-occurrence, association and source graphs. Orders stand for documents, parts and suppliers for two kinds of entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.operators import entities, graph
from papyrine.plans.base import query, table


#: Lines of one task, whatever the size of the table: what a task sorts and groups doesn't grow.
LINES_A_TASK = 200_000


def parts_of(spark: SparkSession, sf_dir: str) -> int:
    """Tasks that all lines are dealt to; the count comes from the file's footers."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, "lineitem").count() // LINES_A_TASK))


def mentions(spark: SparkSession, sf_dir: str, until: int | None = None, parts: int | None = None) -> DataFrame:
    """(doc_id, gene, disease, year), up to a year on demand; the bound is on the date itself, so the scan can skip by it.

    With parts, both tables are dealt by document to that many tasks, and what follows by document needs no other exchange.
    """
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("gene"), F.col("l_suppkey").alias("disease"))
    orders = table(spark, sf_dir, "orders")
    if until is not None:
        orders = orders.where(F.col("o_orderdate") < F.lit(f"{until + 1}-01-01").cast("timestamp_ntz"))
    orders = orders.select(F.col("o_orderkey").alias("doc_id"), F.year("o_orderdate").alias("year"))
    if parts:
        lines, orders = lines.repartition(parts, "doc_id"), orders.repartition(parts, "doc_id").hint("merge")
    return lines.join(orders, "doc_id")


MENTIONS = "m AS (SELECT l_orderkey AS doc_id, l_partkey AS gene, l_suppkey AS disease, CAST(year(o_orderdate) AS INT) AS year FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
EDGES = f"""{MENTIONS},
g AS (SELECT DISTINCT doc_id, gene, year FROM m WHERE doc_id IN (SELECT doc_id FROM m GROUP BY doc_id HAVING count(DISTINCT gene) > 2)),
e AS (SELECT a.gene AS src, b.gene AS dst, min(a.year) AS year FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.gene < b.gene GROUP BY ALL)"""


def edge_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First year of each edge: the edge is in the graph of every later model year, so no year is recomputed."""
    parts = parts_of(spark, sf_dir)
    enough = entities.groups_with(mentions(spark, sf_dir, None, parts).select("doc_id", "gene", "year"), "doc_id", "gene", dealt=True)
    edges = graph.pairs_within(enough, "doc_id", "gene", "year", dealt=True)
    return edges.select("src", "dst", "year").repartition(2 * parts, "src", "dst").groupBy("src", "dst").agg(F.min("year").alias("year"))


@query("cooc_edges_year", f"WITH {EDGES} SELECT src, dst, year FROM e")
def cooc_edges_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, A7, J2, F6"""
    return edge_years(spark, sf_dir)


@query("cooc_cumulative_counts", f"WITH {EDGES} SELECT year, count(*) AS new_edges, CAST(sum(count(*)) OVER (ORDER BY year) AS BIGINT) AS edges FROM e GROUP BY year")
def cooc_cumulative_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of each model year; the window runs over one row a year."""
    by_year = edge_years(spark, sf_dir).groupBy("year").agg(F.count("*").alias("new_edges"))
    return by_year.withColumn("edges", F.sum("new_edges").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))


@query("cooc_edges_by_1997", f"WITH {EDGES} SELECT src, dst FROM e WHERE year <= 1997")
def cooc_edges_by_1997(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the edge list of one model year; the year filter reaches the mentions."""
    parts = parts_of(spark, sf_dir)
    enough = entities.groups_with(mentions(spark, sf_dir, 1997, parts).select("doc_id", "gene"), "doc_id", "gene", dealt=True)
    return graph.pairs_within(enough, "doc_id", "gene", dealt=True).select("src", "dst").repartition(2 * parts, "src", "dst").distinct()


@query(
    "gda_edges",
    f"""WITH {MENTIONS},
g AS (SELECT DISTINCT doc_id, gene, year FROM m WHERE doc_id IN (SELECT doc_id FROM m GROUP BY doc_id HAVING count(DISTINCT gene) > 2)),
d AS (SELECT DISTINCT doc_id, disease FROM m WHERE doc_id IN (SELECT doc_id FROM m GROUP BY doc_id HAVING count(DISTINCT disease) > 2))
SELECT gene, disease, min(year) AS year FROM g JOIN d USING (doc_id) GROUP BY gene, disease""",
)
def gda_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of both kinds meet in the same document."""
    parts = parts_of(spark, sf_dir)
    m = mentions(spark, sf_dir, None, parts)
    left = entities.groups_with(m.select("doc_id", "gene", "year"), "doc_id", "gene", dealt=True)
    right = entities.groups_with(m.select("doc_id", "disease"), "doc_id", "disease", dealt=True)
    met = graph.bipartite_pairs(left, right, "doc_id").select("gene", "disease", "year")
    return met.repartition(2 * parts, "gene", "disease").groupBy("gene", "disease").agg(F.min("year").alias("year"))


def sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, source): edges of several sources; both ends are drawn from one range, so either orientation occurs."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.select((F.col("l_partkey") % 97).alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_returnflag").alias("source"), F.col("l_linenumber").alias("rel"))


SOURCED = "s AS (SELECT l_partkey % 97 AS src, l_suppkey AS dst, l_returnflag AS source, l_linenumber AS rel FROM lineitem)"


@query("edge_sources", f"WITH {SOURCED} SELECT least(src, dst) AS src, greatest(src, dst) AS dst, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM s GROUP BY ALL")
def edge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, G3"""
    return graph.with_sources(sourced(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


@query("dedupe_undirected", f"WITH {SOURCED} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM s")
def dedupe_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, G1, Q10"""
    return graph.distinct_undirected(sourced(spark, sf_dir))


@query("dedupe_labeled_min", f"WITH {SOURCED} SELECT r.src AS src, r.dst AS dst, r.rel AS rel FROM (SELECT min({{'rel': rel, 'src': src, 'dst': dst}}) AS r FROM s GROUP BY least(src, dst), greatest(src, dst))")
def dedupe_labeled_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3"""
    return graph.least_labelled(sourced(spark, sf_dir))


@query("unique_pair_count", f"WITH {SOURCED} SELECT count(*) AS unique_pairs FROM (SELECT DISTINCT least(src, dst), greatest(src, dst) FROM s)")
def unique_pair_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5"""
    return graph.count_undirected(sourced(spark, sf_dir))


@query("uniq_nodes", f"WITH {SOURCED} SELECT src AS node FROM s UNION SELECT dst FROM s")
def uniq_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6, Q11"""
    return graph.endpoints(sourced(spark, sf_dir))


@query("shared_term_graph", "WITH t AS (SELECT DISTINCT p_partkey AS g, p_type || p_brand || (p_size % 10) AS term FROM part WHERE p_size % 7 NOT IN (1, 3)) SELECT DISTINCT a.g AS src, b.g AS dst FROM t a JOIN t b ON a.term = b.term AND a.g < b.g")
def shared_term_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations without the excluded kinds of evidence, entities that share a term."""
    annotated = table(spark, sf_dir, "part").where(~(F.col("p_size") % 7).isin(1, 3))
    terms = annotated.select(F.concat("p_type", "p_brand", (F.col("p_size") % 10).cast("string")).alias("term"), F.col("p_partkey").alias("g"))
    return graph.distinct_pairs_within(terms, "term", "g")


@query(
    "semicolon_edges",
    """SELECT p_partkey, trim(a) AS src, trim(b) AS dst FROM (SELECT p_partkey, unnest(string_split(p_brand || '; ' || p_type, ';')) AS a, p_name FROM part),
LATERAL (SELECT unnest(string_split(replace(p_name, ' ', ' ; '), ';')) AS b)""",
)
def semicolon_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two columns of a sheet, several values to a cell."""
    cells = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("; ", "p_brand", "p_type").alias("src"), F.replace("p_name", F.lit(" "), F.lit(" ; ")).alias("dst"))
    return graph.split_ends(cells)


_INTERVALS = "i AS (SELECT event_id AS id, user_id AS chrom, CAST(floor(epoch(ts)) AS BIGINT) AS s, CAST(floor(epoch(ts)) AS BIGINT) + 60 + event_id % 600 AS e FROM events WHERE event_type <> 'error')"


@query("range_join_window", f"WITH {_INTERVALS} SELECT a.chrom AS chrom, a.id AS a, b.id AS b FROM i a JOIN i b ON a.chrom = b.chrom AND b.s < a.e + 3600 AND b.e > a.s - 3600")
def range_join_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of one chromosome within a window of each other, self pairs included."""
    start = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    spans = table(spark, sf_dir, "events").where("event_type <> 'error'").select(F.col("event_id").alias("id"), F.col("user_id").alias("chrom"), start.alias("s"), (start + 60 + F.col("event_id") % 600).alias("e"))
    left = spans.select("chrom", F.col("id").alias("a"), F.col("s").alias("a_start"), F.col("e").alias("a_end"))
    right = spans.select("chrom", F.col("id").alias("b"), F.col("s").alias("b_start"), F.col("e").alias("b_end"))
    return graph.range_join(left, right, "chrom", 3600).select("chrom", "a", "b")


_SPARSE = "p AS (SELECT p_partkey AS src, p_partkey - p_partkey % 64 + (p_partkey + 1 + p_size % 3) % 64 AS dst FROM part)"


def sparse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each part to a later one of its block of 64 keys, round the block's end."""
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("src"), (key - key % 64 + (key + 1 + F.col("p_size") % 3) % 64).alias("dst"))


@query(
    "component_prune",
    f"""WITH RECURSIVE {_SPARSE}, u AS (SELECT src AS x, dst AS y FROM p UNION SELECT dst, src FROM p),
r AS (SELECT DISTINCT p_partkey AS node FROM part WHERE p_partkey % 50 = 0 AND p_partkey IN (SELECT x FROM u) UNION SELECT y FROM r JOIN u ON x = node)
SELECT src, dst FROM p WHERE src IN (SELECT node FROM r)""",
)
def component_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4"""
    keep = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("node"))
    return graph.prune_components(sparse_edges(spark, sf_dir), keep)


@query("node_index", f"WITH {SOURCED}, n AS (SELECT src AS node FROM s UNION SELECT dst FROM s) SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM n")
def node_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G5"""
    return graph.dense_index(graph.endpoints(sourced(spark, sf_dir)))


@query(
    "catalogue_union",
    f"WITH {SOURCED} SELECT src AS node FROM s WHERE source = 'A' UNION SELECT dst FROM s WHERE source = 'A' UNION SELECT src FROM s WHERE source = 'R' UNION SELECT p_partkey FROM part WHERE p_size > 40",
)
def catalogue_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U1, U7"""
    s = sourced(spark, sf_dir)
    parts = table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").alias("node"))
    return graph.endpoints(s.where("source = 'A'")).union(s.where("source = 'R'").select("src")).union(parts).distinct()


@query("shared_and_own_nodes", f"WITH {SOURCED} SELECT node, 'both' AS side FROM (SELECT src AS node FROM s INTERSECT SELECT dst FROM s) UNION ALL SELECT node, 'dst' FROM (SELECT dst AS node FROM s EXCEPT SELECT src FROM s)")
def shared_and_own_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U2, U3, U4"""
    s = sourced(spark, sf_dir)
    src, dst = s.select(F.col("src").alias("node")), s.select(F.col("dst").alias("node"))
    return src.intersect(dst).withColumn("side", F.lit("both")).unionAll(dst.subtract(src).withColumn("side", F.lit("dst")))


@query("first_year_per_gene", f"WITH {MENTIONS} SELECT gene, min(year) AS year FROM m GROUP BY gene")
def first_year_per_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1"""
    return mentions(spark, sf_dir).groupBy("gene").agg(F.min("year").alias("year"))


@query("chromosome_genes", "SELECT s_nationkey AS chrom, count(*) AS genes, string_agg(s_name, ',' ORDER BY s_name) AS names FROM supplier GROUP BY s_nationkey")
def chromosome_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S13"""
    genes = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("chrom"), "s_name")
    return genes.groupBy("chrom").agg(F.count("*").alias("genes"), F.array_join(F.sort_array(F.collect_list("s_name")), ",").alias("names"))


@query(
    "mapped_edges",
    """SELECT DISTINCT least(a.n_name, b.n_name) AS src, greatest(a.n_name, b.n_name) AS dst FROM customer JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN nation b ON b.n_nationkey = s_nationkey""",
)
def mapped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends mapped to names, unmapped rows dropped, then G1."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    raw = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    raw = raw.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).select("c_nationkey", "s_nationkey").distinct()
    named = raw.join(nation.toDF("c_nationkey", "src"), "c_nationkey").join(nation.toDF("s_nationkey", "dst"), "s_nationkey")
    return graph.distinct_undirected(named)


@query(
    "sage_mean",
    """WITH e AS (SELECT DISTINCT (doc_id * 7) % z AS a, (doc_id * 13 + 1) % z AS b FROM labels, (SELECT max(vec_id) + 1 AS z FROM embeddings)), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
v AS (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT a AS node, CAST(i AS INT) AS i, round(avg(CAST(x AS DOUBLE)), 6) AS value FROM u JOIN v ON vec_id = b GROUP BY a, i""",
)
def sage_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hop of neighbourhood means over the whole range of vectors."""
    ids = table(spark, sf_dir, "embeddings").agg((F.max("vec_id") + 1).alias("z"))
    labels = table(spark, sf_dir, "labels").join(F.broadcast(ids))
    edges = labels.select(((F.col("doc_id") * 7) % F.col("z")).alias("src"), ((F.col("doc_id") * 13 + 1) % F.col("z")).alias("dst")).distinct()
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vec"))
    return graph.mean_neighbours(edges, vectors).withColumn("value", F.round("value", 6))


@query("node2vec_walks")
def node2vec_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walks that node embeddings are trained on."""
    walks = graph.random_walks(sparse_edges(spark, sf_dir), 5)
    return walks.select("start", F.array_join(F.transform("walk", lambda x: x.cast("string")), " ").alias("walk"))


@query("biased_walks")
def biased_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-order walks over all parts and their suppliers, which return seldom and stay near; hash draws, so the same on every run."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (-F.col("l_suppkey")).alias("dst")).distinct()
    walks = graph.biased_walks(lines, 4, back=4.0, away=2.0)
    return walks.select("start", "number", F.array_join(F.transform("walk", lambda x: x.cast("string")), " ").alias("walk"))
