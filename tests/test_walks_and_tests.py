"""Second-order walks against exact transition probabilities; Student's distribution against closed forms and tables."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from papyrine.operators import graph, metrics
from papyrine.sources.shared import drop_stored, stored_by


def test_transitions_are_exact(spark):
    pairs = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (2, 1), (5, 5)] + [(3, k) for k in range(10, 30)]  # 3 is a hub; repeats and loops don't count
    edges = spark.createDataFrame(pairs, "src long, dst long")
    near = defaultdict(set)
    for a, b in pairs:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    back, away = 4.0, 0.5
    walks = graph.biased_walks(edges, 3, back, away, per_node=1500).collect()
    assert len(walks) == 1500 * len(near) and all(len(r["walk"]) == 4 for r in walks)
    seen = defaultdict(Counter)
    for r in walks:
        w = r["walk"]
        assert w[0] == r["start"] and all(b in near[a] for a, b in zip(w, w[1:], strict=False))
        seen[None, w[0]][w[1]] += 1
        for a, b, c in zip(w, w[1:], w[2:], strict=False):
            seen[a, b][c] += 1
    for (before, at), found in seen.items():
        weight = {c: 1.0 if before is None or (c in near[before] and c != before) else 1 / back if c == before else 1 / away for c in near[at]}
        n, total = found.total(), sum(weight.values())
        for c, w in weight.items():
            p = w / total
            assert abs(found[c] - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 1e-9, (before, at, c)


def test_walks_repeat_themselves(spark):
    edges = spark.createDataFrame([(k, (k * 7 + 1) % 50) for k in range(50)], "src long, dst long")
    held = lambda df: sorted(map(tuple, (r["walk"] for r in df.collect())))
    assert held(graph.biased_walks(edges, 3, 2.0, 2.0)) == held(graph.biased_walks(edges.repartition(7), 3, 2.0, 2.0))
    assert graph.biased_walks(edges.limit(0), 3).count() == 0


def test_tries_a_round_change_no_walk(spark):
    edges = spark.createDataFrame([(k, (k * 5 + j) % 24) for k in range(24) for j in (1, 2)], "src long, dst long")
    few, many = (sorted(graph.biased_walks(edges, 2, 4.0, 2.0, per_node=3, tries=k).collect()) for k in (2, 16))
    assert few == many and len(many) == 72


def test_tables_by_keys_are_read_as_they_lie(spark):
    held = stored_by(spark.range(1000).withColumn("x", F.col("id") * 2), 6, "id")  # before: edges were shuffled twice a round
    met = spark.range(0, 2000, 2).join(held.hint("merge"), "id")
    assert met.count() == 500 and sum(r["x"] for r in met.collect()) == sum(2 * k for k in range(0, 1000, 2))
    plan = met._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    drop_stored(held)


def test_student(spark):
    cases = [(0.0, 5, 1.0), (None, 5, None), (1.0, 0, None), (12.706204736432095, 1, 0.05), (2.2281388519649385, 10, 0.05), (3.1692726726169518, 10, 0.01), (2.042272456301238, 30, 0.05)]
    for t in (1e-3, 0.3, 1.7, 25.0):
        cases += [(t, 1, 1 - 2 / math.pi * math.atan(t)), (t, 2, 1 - t / math.sqrt(2 + t * t)), (-t, 4, 1 - t / math.sqrt(4 + t * t) * (1 + 2 / (4 + t * t)))]
    for t in (0.5, 2.0, 5.0):  # by Simpson's rule
        for df in (57, 600_000):
            scale = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) if df < 1000 else -0.25 / df - 0.5 * math.log(2 * math.pi)
            f = lambda u: math.exp(scale - (df + 1) / 2 * math.log1p(u * u / df))  # noqa: B023, E731
            area = sum((1 if i in (0, 4000) else 4 if i % 2 else 2) * f(t * i / 4000) for i in range(4001)) * t / 12000
            cases.append((t, df, 1 - 2 * area))
    df = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, t double, df int, want double")
    for r in df.withColumn("got", metrics.student_tails(F.col("t"), F.col("df"))).collect():
        assert r["got"] == (None if r["want"] is None else pytest.approx(r["want"], abs=1e-9)), r
    q = spark.createDataFrame([(1, 12.706204736432095), (2, 4.302652729911275), (10, 2.2281388519649385), (30, 2.042272456301238)], "df int, want double")
    for r in q.withColumn("got", metrics.student_quantile(0.95, F.col("df"))).collect():
        assert r["got"] == pytest.approx(r["want"], abs=1e-9)


def test_paired_test_cases(spark):
    rows = [("a", 1.0, 0.5), ("a", 2.0, 1.0), ("a", 3.0, 3.5), ("a", None, 1.0), ("one", 2.0, 1.0), ("same", 2.0, 1.0), ("same", 3.0, 2.0), ("none", None, 1.0)]
    got = {r["k"]: r for r in metrics.paired_test(spark.createDataFrame(rows, "k string, x double, y double"), "x", "y", 0.95, "k").collect()}
    d = [0.5, 1.0, -0.5]
    mean, sd = sum(d) / 3, math.sqrt(sum((x - sum(d) / 3) ** 2 for x in d) / 2)
    t = mean / (sd / math.sqrt(3))
    assert got["a"]["t"] == pytest.approx(t) and got["a"]["p_value"] == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-9)
    assert got["a"]["low"] == pytest.approx(mean - 4.302652729911275 * sd / math.sqrt(3)) and got["a"]["high"] == pytest.approx(mean + 4.302652729911275 * sd / math.sqrt(3))
    assert got["one"]["p_value"] is None and got["same"]["t"] is None and got["same"]["mean_difference"] == 1.0 and got["none"]["mean_difference"] is None
