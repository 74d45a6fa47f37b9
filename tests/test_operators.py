"""Golden rows and invariants of the operators."""

import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from papyrine.functions import text as X
from papyrine.operators import corpus, entities, graph, learning, metrics, sampling
from papyrine.plans import registry


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_symbols_and_names(spark):
    assert one(spark, X.symbol_name, 'Type-2 (adult), "x"/y') == "Type_2_adult_x_y"
    assert one(spark, X.linked_name, "MESH:D007239/name=Infections") == "Infections"
    assert one(spark, X.linked_name, "no marker") is None
    assert one(spark, X.linked_name_or_self, "no marker") == "no marker"
    assert one(spark, X.synonyms, "A-b|c/d") == ["a b", "c d"]


def test_token_rules(spark):
    assert [one(spark, X.symbol_rule, t) for t in ("il-6", "42", "(", "α", "a,b", "tp53")] == ["il 6", "<nUm>", None, None, "a b", "tp53"]
    assert [one(spark, X.fine_rule, t) for t in ("42", ".", "?", "x")] == ["42", ".", None, "x"]


def test_cleaning(spark):
    assert one(spark, X.cleaned, None) == ""
    assert one(spark, X.cleaned, "Plain text stays. ") == "Plain text stays."
    assert one(spark, X.cleaned, "A result. It holds. Made © 2004 Press") == "A result. It holds."
    assert "http" not in one(spark, X.cleaned, "See http://a.example/b now")
    assert one(spark, X.cleaned, "Only © here") == "."


def test_chunks_and_back(spark):
    text = " ".join(f"w{i}" for i in range(513))
    pieces = one(spark, X.chunks, text)
    assert [len(p.split()) for p in pieces] == [400, 113] and " ".join(pieces) == text
    assert one(spark, X.chunks, "") == [""]
    assert one(spark, lambda v: X.detokenised(F.split(v, " ")), "a , b .") == "a, b."


def test_terms_and_numbers(spark):
    assert one(spark, lambda v: X.has_terms(v, ["a", "b"], 2), "a b a c") is True
    assert one(spark, lambda v: X.has_terms(v, ["a"], 1, ["c"]), "a b a c") is False
    assert one(spark, lambda v: X.has_terms(v, ["a"], 1, keep="remove"), "a b") is True
    assert [one(spark, X.is_number, t) for t in ("1", "1.5", " 2 ", "x", "")] == [True, True, True, False, False]


def test_mentions_need_three(spark):
    m = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (2, "c")], "doc int, e string").distinct()
    pairs = graph.pairs_within(entities.groups_with(m, "doc", "e"), "doc", "e")
    assert rows(pairs.select("src", "dst")) == [("a", "b"), ("a", "c"), ("b", "c")]


def test_labelled_and_sourced_edges(spark):
    e = spark.createDataFrame([("b", "a", "pos"), ("a", "b", "neg"), ("c", "c", "pos")], "src string, dst string, rel string")
    assert rows(graph.least_labelled(e)) == [("a", "b", "neg"), ("c", "c", "pos")]
    assert rows(graph.with_sources(e, "rel")) == [("a", "b", ["neg", "pos"]), ("c", "c", ["pos"])]
    assert graph.count_undirected(e).first()[0] == 2 and rows(graph.endpoints(e)) == [("a",), ("b",), ("c",)]
    assert graph.distinct_undirected(e.limit(0)).count() == 0


def test_semicolons(spark):
    e = spark.createDataFrame([("a; b", "x;y"), (None, "z")], "src string, dst string")
    assert rows(graph.split_ends(e)) == [("a", "x"), ("a", "y"), ("b", "x"), ("b", "y")]


def test_range_join_against_brute_force(spark):
    import random

    rng = random.Random(3)
    data = [(k, rng.randrange(3), s := rng.randrange(5000), s + rng.randrange(1, 700)) for k in range(120)]
    df = spark.createDataFrame(data, "id int, chrom int, s long, e long")
    left = df.select("chrom", F.col("id").alias("a"), F.col("s").alias("a_start"), F.col("e").alias("a_end"))
    right = df.select("chrom", F.col("id").alias("b"), F.col("s").alias("b_start"), F.col("e").alias("b_end"))
    for w in (0, 1, 100, 333):
        want = sorted((a[0], b[0]) for a in data for b in data if a[1] == b[1] and b[2] < a[3] + w and b[3] > a[2] - w)
        assert rows(graph.range_join(left, right, "chrom", w).select("a", "b")) == want


def test_components_and_pruning(spark):
    import random

    rng = random.Random(5)
    data = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(400, 440)]
    up = list(range(500))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in data:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    e = spark.createDataFrame(data, "src int, dst int")
    nodes = {x for p in data if p[0] != p[1] for x in p}
    assert rows(graph.components(e, "src", "dst")) == sorted((x, root(x)) for x in nodes)
    keep = spark.createDataFrame([(405,)], "node int")
    assert rows(graph.prune_components(e, keep)) == [(k, k + 1) for k in range(400, 440)]


def test_dense_index(spark):
    df = spark.range(0, 1000).select((F.col("id") * 37 % 1000).alias("node")).union(spark.range(5).toDF("node"))
    assert rows(graph.dense_index(df)) == [(k, k) for k in range(1000)]


def test_walks_follow_edges(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src int, dst int")
    known = {(1, 2), (2, 3), (3, 1), (4, 5)}
    for start, walk in graph.random_walks(e, 4).collect():
        assert walk[0] == start and len(walk) == 5 and all((a, b) in known or (b, a) in known for a, b in zip(walk, walk[1:], strict=False))


def test_tiling_and_repeats(spark):
    assert entities.tiling("hiv_infections hiv_infections", {"hiv_infections"}) == ["hiv_infections"] * 2
    assert entities.tiling("abc", {"ab", "bc"}) == [] and entities.tiling("", {"a"}) == []
    assert entities.tiling("hiv_infections", {"hiv", "hiv_infections"}) == []
    t = spark.createDataFrame([(1, i, w) for i, w in enumerate("tp53 tp53 the the tp53".split())], "doc_id int, pos int, token string")
    e = spark.createDataFrame([("tp53",)], "token string")
    assert [r[2] for r in sorted(entities.drop_repeats(t, e).select("doc_id", "pos", "token").collect())] == ["tp53", "the", "the", "tp53"]
    assert rows(entities.tiled(t, e).select("token", "tiles")) == [("the", []), ("tp53", ["tp53"])]


def test_aliases(spark):
    s = spark.createDataFrame([("a", ["x", "y"]), ("b", ["y"])], "canonical string, aliases array<string>")
    assert rows(entities.invert_aliases(s)) == [("x", "a"), ("y", "a")]
    merged = entities.merge_symbols(s, spark.createDataFrame([("x",), ("b",), ("n",)], "symbol string"))
    assert rows(merged) == [("a", ["x", "y"]), ("b", ["b"]), ("n", ["n"])]


def test_splits(spark):
    df = spark.range(10).toDF("k")
    assert sorted(r[0] for r in sampling.three_way(df, ["k"]).groupBy("split").count().select("count").collect()) == [1, 2, 7]
    assert sampling.halves(df, ["k"]).where("half = 0").count() == 5
    labelled = df.withColumn("y", (F.col("k") < 3).cast("int"))
    assert rows(sampling.balanced(labelled, "y", ["k"]).groupBy("y").count()) == [(0, 3), (1, 3)]
    assert {r[0] for r in sampling.folds(labelled, "y", ["k"], 3).select("fold").collect()} == {0, 1, 2}
    assert sampling.bootstrap(df.withColumnRenamed("k", "id"), 200).agg(F.avg("weight")).first()[0] > 1


def test_negatives_are_new(spark):
    left, right = spark.range(40).toDF("src"), spark.range(30).toDF("dst")
    known = spark.createDataFrame([(k % 40, k % 30) for k in range(0, 400, 3)], "src long, dst long").distinct()
    drawn = sampling.negative_pairs(left, right, known, 200)
    assert drawn.count() == drawn.distinct().count() == 200
    assert drawn.join(known, ["src", "dst"]).count() == 0


def test_metrics_with_ties(spark):
    data = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (1, 0.1)]
    s = spark.createDataFrame(data, "label int, score double")
    pos, neg = [x for y, x in data if y], [x for y, x in data if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert abs(metrics.auc(s).first()[0] - want) < 1e-12
    assert abs(metrics.average_precision(s).first()[0] - (1 / 3 * 1 / 2 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)) < 1e-12
    r = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.5)], "x double, y double")
    assert abs(metrics.correlations(r, "x", "y").first()["spearman"] - 1) < 1e-12


def test_phrases(spark):
    t = spark.createDataFrame([(1, i, w) for i, w in enumerate("a b a b b c".split())], "doc_id int, pos int, token string")
    p = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "a string, b string")
    assert [r["token"] for r in corpus.apply_phrases(t, p).orderBy("pos").collect()] == ["a_b", "a_b", "b_c"]


def test_pooling(spark):
    o = spark.createDataFrame([(1, "a", [1.0]), (1, "a", [3.0]), (1, "b", [5.0]), (2, "a", [7.0])], "doc_id int, token string, vec array<double>")
    assert rows(corpus.pooled_means(o, 2)) == [("a", 0, (3.0 + 3.0 + 7.0) / 3), ("b", 0, 3.0)]


def test_steps():
    assert learning.total_steps(1000, 5, 32, 2) == 78


def test_ratios_without_a_denominator(spark):
    none = spark.createDataFrame([(0, 0.5), (0, 0.25)], "label int, score double")
    assert metrics.auc(none).first()[0] is None and metrics.average_precision(none).first()[0] is None
    assert metrics.roc(none).where("tpr is not null").count() == 0 and metrics.confusion(none).first()["recall"] is None
    assert metrics.at_k(none, 1).first()["recall_at_k"] is None
    empty = none.limit(0)
    assert metrics.auc(empty).first()[0] is None and metrics.roc(empty).count() == 0 and metrics.at_k(empty, 3).first()[0] is None


def test_samplers_on_empty_sides(spark):
    left, none = spark.range(3).toDF("src"), spark.range(0).toDF("dst")
    known = spark.createDataFrame([], "src long, dst long")
    assert sampling.negative_pairs(left, none, known, 5).count() == 0
    positives = spark.createDataFrame([(1, 2, ["x"])], "a long, b long, sources array<string>")
    out = sampling.by_source(positives, spark.createDataFrame([], "a long, b long"), ["a", "b"])
    assert [tuple(r) for r in out.collect()] == [(1, 2, "x", 1)]


def test_detokenize_takes_long_texts(spark, tmp_path):
    texts = ["a b.c , d", ". x", "one, two. " * 400, "a.\nb ,\nc", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r["line"] for r in registry.QUERIES["detokenize"](spark, str(tmp_path)).collect()}

    def plain(text):
        line, *rest = re.sub(r"([.,])", r" \1", text).split(" ")
        for t in rest:
            line += t if t in (".", ",") else " " + t
        return hashlib.md5(line.encode()).hexdigest()

    assert out == {k: t and plain(t) for k, t in enumerate(texts)}



def test_correlations_take_all_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    x, y = rng.integers(1, 20, 300).astype(float), rng.integers(1, 90, 300).astype(float)
    rows = [(k, a, b) for k, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True))]
    spark.createDataFrame(rows, "l_orderkey bigint, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    (out,) = registry.QUERIES["pearson_spearman"](spark, str(tmp_path)).collect()
    ranks = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    assert abs(out["pearson"] - np.corrcoef(x, y)[0, 1]) < 1e-6 and abs(out["spearman"] - np.corrcoef(ranks(x), ranks(y))[0, 1]) < 1e-6


def test_draws_with_replacement_reject_known_pairs_only(spark):
    left, right = spark.createDataFrame([(1,), (2,), (2,), (None,)], "src int"), spark.createDataFrame([(7,), (8,)], "dst int")
    known = spark.createDataFrame([(1, 7), (1, 7), (9, 9)], "src int, dst int")
    rows = sampling.negative_draws(left, right, known, 50).collect()
    assert len(rows) == 50 and {(r["src"], r["dst"]) for r in rows} == {(1, 8), (2, 7), (2, 8)}
    assert len({r["draw"] for r in rows}) == 50
    every = left.crossJoin(right)
    assert sampling.negative_draws(left, right, every, 5).count() == 0
    assert sampling.negative_draws(left.limit(0), right, known, 5).count() == 0


def test_retiled_drops_repeats_across_tokens(spark):
    rows = spark.createDataFrame([(1, 0, "abab"), (1, 1, "ab"), (1, 2, "x"), (1, 3, "x"), (1, 4, None), (1, 5, "abcd"), (1, 6, "cd"), (2, 0, "ab")], "doc_id int, pos int, token string")
    known = spark.createDataFrame([("ab",), ("cd",)], "token string")
    out = sorted((r["doc_id"], r["pos"], r["part"], r["token"]) for r in entities.retiled(rows, known).collect())
    assert out == [(1, 0, 0, "ab"), (1, 2, 0, "x"), (1, 3, 0, "x"), (1, 4, 0, None), (1, 5, 0, "ab"), (1, 5, 1, "cd"), (2, 0, 0, "ab")]
    assert entities.retiled(rows.limit(0), known).count() == 0


def test_stopped_diseases(spark):
    pairs = spark.createDataFrame([("g", "aniridia"), ("g", "gout"), ("h", None)], "gene string, disease string")
    assert sorted(r["gene"] for r in entities.without_stopped(pairs).collect()) == ["g", "h"]


def test_needed_literals_are_in_every_match(spark):
    assert X.needed(r"\(C\) [0-9]{4}") == ["(C) "]
    assert X.needed(r"( All|All) (rights reserved|rights kept)") == ["rights "]
    assert X.needed(r"(rights reserved|all kept)") == ["rights reserved", "all kept"]
    assert X.needed(r"(abc)?[a-z]+") == [] and X.needed(r"x*|") == []
    texts = ["", "ABC 12", "abc 12 abc", "no match", "　 kept \x85"]
    for pattern, flags in ((r"abc [0-9]+", ""), (r"abc [0-9]+", "(?i)"), (r"[0-9]|m", "")):
        got = [one(spark, lambda c, p=pattern, f=flags: X.delete(c, [p], f), t) for t in texts]
        assert got == [re.sub(pattern, "", t, flags=re.I if flags else 0) for t in texts]
    assert one(spark, X.strip, texts[-1]) == "kept"


def test_tiles_of_any_dictionary_equal_the_definition(spark):
    rng = np.random.default_rng(11)
    word = lambda least, most: "".join(rng.choice(list("aab\u00e9 "), rng.integers(least, most)))
    for size, spaces in ((3, False), (40, True), (400, False)):
        known = {word(1, 7) for _ in range(size)} | ({"a"} if size == 40 else set())
        found = sorted({word(0, 12) for _ in range(400)} | {"ab" * 3000, "a" * 5000 + "b"})
        t = spark.createDataFrame([(w, 1) for w in [*found, None, found[0]]], "token string, tiles int")
        e = spark.createDataFrame([(w, "x") for w in [*known, *known, None, ""]], "token string, key string")
        got = {r["token"]: r["tiles"] for r in entities.tiled(t, e, allow_spaces=spaces).collect()}
        assert got == {w: entities.tiling(w, known, spaces) for w in found}
    assert {tuple(r["tiles"]) for r in entities.tiled(t, e.limit(0)).collect()} == {()}


def test_dictionary_is_cut_into_ranges(spark):
    """Most entities begin with one letter, and each still lies in one of many ranges."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = 20_000
        e = spark.range(n).select(F.concat(F.lit("gene"), F.lpad(F.col("id").cast("string"), 6, "0"), F.lit("x")).alias("token"))
        core = entities.prefix_free(e.union(spark.createDataFrame([("gene000007",)], "token string")))
        assert core.count() == n and core.where("token = 'gene000007x'").count() == 0
        t = spark.range(0, n, 7).select(F.concat(F.lit("gene"), F.lpad(F.col("id").cast("string"), 6, "0"), F.when(F.col("id") % 2 == 0, "xgene000003x").otherwise("y")).alias("token"))
        got = entities.tiled(t, e).select(F.size("tiles").alias("n")).groupBy("n").count().collect()
        even = len(range(0, n, 14))
        assert {r["n"]: r["count"] for r in got} == {2: even, 0: len(range(0, n, 7)) - even}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
