"""Means by weights of ids equal means by entries, for whole, short and broken vectors, repeated and unknown ids, long documents."""

from papyrine.operators import corpus
from papyrine.plans import registry


def test_pooling_by_id_equals_pooling_of_vectors(spark):
    vectors = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, -1.0]), (2, [5.0, 0.5]), (2, [7.0, 0.25]), (3, [4.0]), (4, [None, 9.0]), (5, None)], "vec_id int, vec array<double>")
    rows = [(d, f"t{(d * 3 + k) % 4}", (d + k * k) % 7) for d in range(30) for k in range(1 + d % 5)] + [(None, "t0", 1), (1, None, 0)]
    mentions = spark.createDataFrame(rows, "doc_id int, token string, vec_id int")
    held = lambda df: {(r["token"], r["i"]): r["value"] for r in df.collect()}
    got, want = held(corpus.pooled_means_by_id(mentions, vectors, 2)), held(corpus.pooled_means(mentions.join(vectors, "vec_id"), 2))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_no_vector_travels_with_a_mention(spark):
    plan = registry.QUERIES["pooled_mean"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "_w#" in plan  # before: 64 entries a line, then 128 sums a document
