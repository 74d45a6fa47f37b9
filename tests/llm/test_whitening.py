"""Whitening against numpy, exact sums, and small cases."""

import math
from collections import defaultdict

import numpy as np
import pytest

from papyrine.llm import whitening

SF = "/root/testdata/sf0.001"


def brute(rows, components):
    """rows: (vec_id, list). Plain numpy over the distinct whole-number vectors."""
    good = [(i, [math.floor(256 * float(np.float64(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in good}), dtype=np.int64)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, x in good:
        deviation = sum((n * a - int(b)) ** 2 for a, b in zip(x, s.tolist(), strict=True))
        for k in range(components):
            out[i, k + 1] = (n, deviation, float((np.array(x) - s / n) @ vectors[:, k] / math.sqrt(values[k])), values[k] / values.sum())
    return out


def held(spark, rows, width=64, components=4):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    return whitening.whiten(df, components).collect()


def test_contract_against_numpy(spark):
    found = whitening.op13_whitening(spark, SF).collect()
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = brute(rows, 4)
    assert len(found) == len(want) == 4 * len(rows)
    signs = defaultdict(set)
    for r in found:
        n, deviation, value, explained = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert abs(abs(r["whitened"]) - abs(value)) < 1e-8 and abs(r["explained"] - explained) < 1e-9
        assert r["identity_error"] < 1e-9
        if abs(value) > 1e-6:
            signs[r["component"]].add(r["whitened"] * value > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_copies_count_once_and_bad_rows_go(spark):
    rng = np.random.default_rng(3)
    good = [(k, rng.standard_normal(3).astype(np.float32).tolist()) for k in range(40)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0]), (105, [1.0, 2.0])]
    copies = [(200 + k, good[0][1]) for k in range(500)] + [(None, good[1][1]), (3, good[3][1])]
    found = held(spark, good + odd + copies, components=3)
    want = brute(good, 3)
    assert {r["n"] for r in found} == {40}
    assert len(found) == 3 * (40 + 502)
    for r in found:
        if r["vec_id"] is not None and r["vec_id"] < 40:
            assert r["deviation"] == want[r["vec_id"], r["component"]][1]
            assert abs(abs(r["whitened"]) - abs(want[r["vec_id"], r["component"]][2])) < 1e-8


def test_flat_directions_and_empty_tables(spark):
    assert held(spark, []) == []
    assert held(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])]) == []  # one distinct vector has no variance
    line = held(spark, [(k, [k / 8, 1.0]) for k in range(5)])
    assert {r["component"] for r in line} == {1}
    assert sorted(abs(r["whitened"]) for r in line) == pytest.approx(sorted(abs(k - 2) / math.sqrt(2) for k in range(5)))


def test_huge_entries_have_a_result(spark):
    found = held(spark, [(1, [3.0e38, 1.0]), (2, [-3.0e38, 2.0]), (3, [0.0, 3.0])])
    assert found and all(r["deviation"] is None for r in found if r["vec_id"] != 3)


def test_other_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(k, rng.standard_normal(6).astype(np.float32).tolist()) for k in range(30)]
    whole = held(spark, rows)
    monkeypatch.setattr(whitening, "TILE", 4)
    assert [(r["vec_id"], r["component"], round(r["whitened"], 9)) for r in held(spark, rows)] == [(r["vec_id"], r["component"], round(r["whitened"], 9)) for r in whole]


def test_clashing_columns(spark):
    df = spark.createDataFrame([(k, [k / 4, -k / 2, 1.0 * k * k], "x", 1) for k in range(9)], "vec_id bigint, embedding array<double>, whitened string, n int")
    assert whitening.whiten(df).count() == 9 * 2
