"""Pairs meet their vectors block by block: the same rows as joins give, whatever the vectors."""

import math

from pyspark.sql import functions as F

from papyrine.functions import vectors as V
from papyrine.operators import pairs
from papyrine.plans import registry

DATA = "/root/testdata/sf0.001"


def odd_vectors(spark):
    rows = [(i, [math.sin(i * 7 + k) for k in range(4)], i % 3) for i in range(40)]
    rows += [(3, [1.0, 2.0, 3.0, 4.0], 9), (50, None, 1), (51, [1.0, None, 0.0, 2.0], 1), (52, [0.0] * 4, 2), (53, [1.0, 2.0], None), (None, [1.0] * 4, 1), (54, [float("nan")] * 4, 1)]
    return spark.createDataFrame(rows, "vec_id bigint, vec array<double>, label int")


def plain(rows):
    return sorted(repr([None if v is None else round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)


def test_pairs_as_by_joins(spark, monkeypatch):
    monkeypatch.setattr(pairs, "FINE", 8)  # several blocks
    v = odd_vectors(spark)
    ids = [*range(0, 40, 3), 3, 50, 51, 52, 53, 54, 99, None]
    asked = spark.createDataFrame([(a, b, (a or 0) + 1) for a in ids for b in ids], "a bigint, b bigint, year int")
    joined = asked.join(v.select(F.col("vec_id").alias("a"), F.col("vec").alias("va"), F.col("label").alias("la")), "a").join(v.select(F.col("vec_id").alias("b"), F.col("vec").alias("vb"), F.col("label").alias("lb")), "b")
    for values, schema, want in (
        (pairs.dot_of, "d double", [V.dot(F.col("va"), F.col("vb"))]),
        (pairs.cosine_of, "c double", [V.cosine(F.col("va"), F.col("vb"))]),
        (pairs.features_of, "f array<double>, la int, lb int", [F.concat("va", "vb"), "la", "lb"]),
        (pairs.ends_of, "w bigint, x double, y double", [F.size(F.concat("va", "vb")).cast("bigint"), F.element_at(F.concat("va", "vb"), 1), F.element_at(F.concat("va", "vb"), -1)]),
    ):
        got = pairs.join_vectors(asked, v, values, schema).collect()
        assert plain(got) == plain(joined.select("a", "b", "year", *want).collect())


def test_near_pairs_as_by_product(spark, monkeypatch):
    monkeypatch.setattr(pairs, "FINE", 8)
    v = odd_vectors(spark)
    side = lambda d, x: v.select(F.col("vec_id").alias(d), F.col("vec").alias(x))
    for ordered in (False, True):
        got = pairs.near_pairs(v, v, 0.3, ordered).collect()
        want = side("src", "x").crossJoin(side("dst", "y")).select("src", "dst", V.cosine(F.col("x"), F.col("y")).alias("c")).where("c >= 0.3 and src is not null and dst is not null")
        assert len(got) and plain(got) == plain((want.where("src < dst") if ordered else want).collect())


def test_no_vector_travels_with_a_pair(spark):
    """Before: the left vector went through the join by the right end, once for each pair."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name in ("pair_cosine", "context_prob", "pair_features", "unseen_pairs", "gda_candidates"):
            plan = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
            assert not [line for line in plan.splitlines() if "Join Inner, (" in line and " = " in line], name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
