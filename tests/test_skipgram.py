"""Vectors of nodes: steps against the formula, planted neighbours over several blocks, nothing that holds all nodes."""

import numpy as np
from pyspark.sql import functions as F

from papyrine.operators import graph, skipgram
from papyrine.plans import models

DATA = "/root/testdata/sf0.001"


def test_steps_follow_the_gradient():
    rng = np.random.default_rng(1)
    u, v = rng.normal(size=(2, 40, 3))
    node, other, drawn = np.array([3, 9, 3]), np.array([5, 6, 7]), np.array([[1, 5], [6, 2], [8, 9]])
    want_u, want_v = u.copy(), v.copy()
    for a, b, others in zip(node, other, drawn, strict=True):
        for c, label in [(b, 1), *((d, 0) for d in others if d != b)]:
            pull = 0.1 * (label - 1 / (1 + np.exp(-u[a] @ v[c])))
            want_u[a] += pull * v[c]
            want_v[c] += pull * u[a]
    skipgram.step(u, v, node, other, drawn, 0.1)
    assert np.allclose(u, want_u) and np.allclose(v, want_v)
    hub = np.zeros(5000, np.int64)
    rows = np.zeros((2, 1))
    skipgram.add(rows, hub, np.ones((5000, 1)), 20)
    assert np.allclose(rows.ravel(), [20, 0])


def test_pairs_are_those_within_the_drawn_window(spark):
    walks = spark.createDataFrame([([1, 2, 3, 1, 4],), ([7],), ([],)], "walk array<bigint>")
    got = sorted(map(tuple, skipgram.pairs_of(walks, 1, 0).collect()))
    assert got == sorted([(1, 2), (2, 1), (2, 3), (3, 2), (3, 1), (1, 3), (1, 4), (4, 1)])
    far = spark.range(300).select(F.array(*(F.lit(10) * F.col("id") + k for k in range(6))).alias("walk"))
    steps = [abs(r["node"] - r["other"]) for r in skipgram.pairs_of(far, 3, 0).collect()]
    share = [steps.count(k) / (300 * 2 * (6 - k)) for k in (1, 2, 3)]
    assert max(steps) == 3 and share[0] == 1 and abs(share[1] - 2 / 3) < 0.05 and abs(share[2] - 1 / 3) < 0.05


def test_planted_neighbours_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(skipgram, "NUMBERS_A_BLOCK", 8 * 80)  # before: one vocabulary of all nodes on the driver
    monkeypatch.setattr(skipgram, "ROUNDS_A_PLAN", 4)
    edges = spark.range(300).select("id", F.explode(F.array(*map(F.lit, range(1, 6)))).alias("k"))
    edges = edges.select(F.col("id").alias("src"), (F.col("id") - F.col("id") % 10 + (F.col("id") + F.col("k")) % 10).alias("dst"))  # 30 groups of 10
    edges = edges.unionByName(spark.range(1, 300).select("id", F.lit(0)).toDF("src", "dst").where("src % 10 = 1"))  # and a hub
    walks = graph.random_walks(edges, 20)
    assert skipgram.blocks_for(300, 8, 4) == 4
    settings = skipgram.Settings(size=8, window=3, epochs=3, rate=0.2)
    rows = {r["node"]: r["vector"] for r in skipgram.fit(walks, settings).collect()}
    assert sorted(rows) == list(range(300))
    x = np.array([rows[k] for k in range(300)])
    assert np.isfinite(x).all()
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T - 2 * np.eye(300)
    assert np.mean(near.argmax(axis=1) // 10 == np.arange(300) // 10) > 0.9  # by chance 0.03
    again = {r["node"]: r["vector"] for r in skipgram.fit(walks.repartition(7), settings).collect()}
    assert again == rows


def test_blocks_are_bounded():
    assert skipgram.blocks_for(0, 16, 8) == 1 and skipgram.blocks_for(10_000, 16, 8) == 1
    assert skipgram.blocks_for(1_200_000, 16, 8) == 8
    for nodes in (10**7, 10**9):
        assert nodes / skipgram.blocks_for(nodes, 16, 8) * 16 <= skipgram.NUMBERS_A_BLOCK or nodes / 8 * 16 <= skipgram.NUMBERS_A_BLOCK


def test_no_walks_give_no_vectors(spark):
    edges = spark.createDataFrame([], "src long, dst long")
    assert skipgram.fit(graph.random_walks(edges, 2), skipgram.Settings(size=4, epochs=1)).count() == 0  # before: an error


def test_query_gives_each_node_a_vector(spark):
    edges = graph.both_ways(models.sparse_edges(spark, DATA))
    found = models.node_vectors(spark, DATA)
    assert found.dtypes == [("word", "string"), ("vector", "array<double>")]
    rows = found.collect()
    assert sorted(int(r["word"]) for r in rows) == sorted(r["src"] for r in edges.select("src").distinct().collect())
    assert {len(r["vector"]) for r in rows} == {16}


def test_query_trains_all_epochs(spark, monkeypatch):
    """F13; before: one pass with a window of 3."""
    asked = []
    monkeypatch.setattr(models.skipgram, "fit", lambda walks, settings: asked.append(settings) or walks.select(F.col("start").alias("node"), F.array(F.lit(0.0)).alias("vector")))
    models.node_vectors(spark, DATA)
    assert (asked[0].epochs, asked[0].window, asked[0].negatives) == (30, 5, 5)
