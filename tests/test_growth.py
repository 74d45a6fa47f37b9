"""What one task holds doesn't grow with the tables."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from papyrine.operators import boosted, graph, learning, sampling
from papyrine.plans import graphs

DATA = "/root/testdata/sf0.001"


def tasks(df):
    return df.rdd.getNumPartitions()


def test_bootstrap_of_a_small_file_is_many_tasks(spark):
    rows = spark.createDataFrame([(i, 1.0) for i in range(100)], "id bigint, x double").coalesce(1)
    assert tasks(sampling.bootstrap(rows, 10)) > 1  # before: 1


def test_edges_are_dealt_by_the_number_of_lines(spark, monkeypatch):
    monkeypatch.setattr(graphs, "LINES_A_TASK", 100)
    for query in (graphs.cooc_edges_year, graphs.cooc_edges_by_1997, graphs.gda_edges):
        assert tasks(query(spark, DATA)) > 100  # before: as many as the session says


def test_pairs_of_one_group_need_no_exchange(spark):
    rows = [(g, m) for m in range(30) for g in {m % 4, m * m % 5}] + [(None, 1), (1, None), (2, 2), (2, 2)]
    df = spark.createDataFrame(rows, "term int, g int")
    want = {(r["src"], r["dst"]) for r in graph.pairs_within(df, "term", "g").collect()}
    got = [(r["src"], r["dst"]) for r in graph.distinct_pairs_within(df, "term", "g").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # a group of 300: before, all 44,850 pairs were shuffled to make them distinct
    one = graph.distinct_pairs_within(spark.range(300).select(F.lit(1).alias("term"), F.col("id").alias("g")), "term", "g")
    assert one.count() == 300 * 299 // 2
    assert "Union" in one._jdf.queryExecution().optimizedPlan().toString()


def test_bins_of_arrow_lists(spark):
    edges = [np.array([0.0, 1.0]), np.array([2.0])]
    rows = [[0.5, 3.0], [None, 2.0], [7.0, float("nan")]]
    arrow = pa.array([[9.0, 9.0], *rows], pa.list_(pa.float64())).slice(1)
    assert (boosted.binned(arrow, edges) == boosted.binned(rows, edges)).all()


def test_importance_gives_a_row_a_task_and_feature(spark):
    rows = spark.range(400).select("id", F.array((F.col("id") % 7).cast("double"), (F.col("id") % 3).cast("double")).alias("features"), (F.col("id") % 7 > 3).cast("double").alias("label"))
    model = boosted.fit(rows, ["id"], boosted.Settings(trees=2, depth=2, bins=8))
    each = boosted.shapley(rows, model, ["id"]).select(F.posexplode("shapley").alias("feature", "v")).groupBy("feature").agg(F.avg(F.abs("v")).alias("x"))
    want = {r["feature"]: r["x"] for r in each.collect()}
    found = boosted.importance(rows, model)
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()  # before: a row for each row and feature
    assert all(abs(r["importance"] - want[r["feature"]]) < 1e-12 for r in found.collect())


def test_training_tasks_grow_with_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(learning, "WORDS_A_TASK", 100)
    corpus = spark.range(90).select(F.array(*(F.concat(F.lit("w"), ((F.col("id") + k) % 9).cast("string")) for k in range(10))).alias("words"))
    assert learning.training_tasks(corpus) == 9 and learning.training_tasks(corpus.limit(0)) == 1
    model = learning.word_vectors(corpus, size=4, window=2, least=1, epochs=1)
    assert model.getNumPartitions() == 9  # before: 1
    assert model.getVectors().count() == 9


def test_walks_are_dealt_by_the_number_of_edges(spark, monkeypatch):
    pairs = [(k, (k * 7 + 1) % 60) for k in range(60)] + [(3, 3), (None, 1), (1, None), (0, 1)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    near = {(a, b) for x, y in pairs if None not in (x, y) and x != y for a, b in ((x, y), (y, x))}
    whole = graph.random_walks(edges, 3).collect()
    monkeypatch.setattr(graph, "ROWS_A_TASK", 10)  # before: no such bound, tasks by the session's settings
    dealt = graph.random_walks(edges, 3)
    assert tasks(dealt) >= len(near) // 10
    rows = dealt.collect()
    assert sorted(rows) == sorted(whole) and {r["start"] for r in rows} == {a for a, _ in near}
    assert all(len(r["walk"]) == 4 and set(zip(r["walk"], r["walk"][1:], strict=False)) <= near for r in rows)
