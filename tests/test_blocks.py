"""Whole texts that meet tables block by block give what the operators on rows of tokens give."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from papyrine.operators import blocks, corpus, entities
from papyrine.plans import registry

DATA = "/root/testdata/sf0.001"


def random_texts(spark):
    rng = np.random.default_rng(7)
    words = ["ab", "cd", "abab", "abcd", "x", "abx", "", "é"]
    texts = [(i, " ".join(rng.choice(words, rng.integers(0, 40)))) for i in range(60)]
    return spark.createDataFrame([*texts, (60, None), (None, "ab ab x")], "doc_id long, text string")


def lines(df):
    """(doc_id, tokens, MD5) of rows (doc_id, order, token)."""
    held = {}
    for key, at, token in df.collect():
        held.setdefault(key, []).append((at, token))
    return {k: (len(v), hashlib.md5(" ".join(t for _, t in sorted(v)).encode()).hexdigest()) for k, v in held.items()}


def test_retiled_texts_equal_retiled_tokens(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_CHARS", 300)  # many blocks
    texts = random_texts(spark)
    known = spark.createDataFrame([("ab",), ("cd",), ("é",), ("x",)], "token string")
    tokens = texts.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "token"))
    want = lines(entities.retiled(tokens, known).select("doc_id", F.struct("pos", "part"), "token"))
    assert {r["doc_id"]: (r["tokens"], r["line"]) for r in entities.retiled_texts(texts, tokens, known).collect()} == want
    assert entities.retiled_texts(texts.limit(0), tokens.limit(0), known).count() == 0


def test_no_token_is_a_row_of_a_shuffle(spark):
    plan = registry.QUERIES["retiled_documents"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Window" not in plan  # before: two joins, two windows and a grouping of all tokens


def test_tokens_without_a_way_to_their_end_are_not_shuffled():
    known = {entities.crc32(w.encode()) for w in ("ab", "cd")}.__contains__
    assert entities.pieces_of("ababcd", [2], known) == ["ab", "cd"]
    assert entities.pieces_of("ababx", [2], known) == [] and entities.pieces_of("", [2], known) == []  # before: a window for each place


def test_phrased_texts_equal_phrased_tokens(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_CHARS", 300)
    texts = random_texts(spark)
    tokens = texts.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "token"))
    scored = corpus.text_phrase_scores(texts, 2, 0.01)
    held = lambda df: sorted((r["a"], r["b"], r["n"], round(r["score"], 9)) for r in df.collect())
    assert held(scored) == held(corpus.phrase_scores(tokens, 2, 0.01)) != []
    want = lines(corpus.apply_phrases(tokens, scored).select("doc_id", "pos", "token"))
    assert {r["doc_id"]: (r["tokens"], r["text"]) for r in corpus.phrased_texts(texts, scored).collect()} == want
    plan = registry.QUERIES["phrased_corpus"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Window" not in plan  # before: four windows and a join over all tokens
