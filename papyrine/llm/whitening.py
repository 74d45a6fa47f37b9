"""Embedding whitening: one aggregation sums the centred products of every pair of dimensions, LAPACK decomposes the covariance, projections are SQL.

Vectors are counted in whole steps (floor of STEP times the entry), so sums, counts and deviations are exact. The fit list holds each distinct vector
once; what comes back to the driver are sums for dimensions and for pairs of dimensions, whatever the number of rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm.common import stored, table

#: Steps of an entry of 1.
STEP = 256
#: Dimensions of either side of a tile of pairs: its columns and sums have to stay under the 100 fields that Spark compiles as a whole stage. 2,080 sums in
#: one row took 34 seconds for 51,282 vectors of 64 entries.
TILE = 8
#: Share of the largest eigenvalue below which a direction has no variance that doubles could tell from rounding.
FLAT = 1e-12
#: Columns named so that they clash with none of the table's.
STEPS, _WIDTH = "__papyrine_steps", "__papyrine_width"


class Whitening(NamedTuple):
    """n distinct vectors of `width` whole numbers, their sums, and the directions kept: eigenvalues falling, eigenvectors as columns."""

    n: int
    width: int
    sums: list[int]
    trace: float
    eigenvalues: np.ndarray
    vectors: np.ndarray
    identity_error: float | None


def steps(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """embeddings, all their columns, with STEPS: floor(STEP * entry) as long. Rows whose vector is null, empty or holds null or non-finite entries go.

    Entries beyond the range of long divided by STEP count as its ends.
    """
    vector = F.col(f"`{column}`").cast("array<double>")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.where(vector.isNotNull() & finite & (F.size(vector) > 0))
    most = float(2**63 - 1024)
    whole = F.transform(vector, lambda x: F.floor(F.least(F.greatest(x * F.lit(float(STEP)), F.lit(-most)), F.lit(most))).cast("bigint"))
    return rows.withColumn(STEPS, whole)


def _number(x: float) -> str:
    return f"{float(x)!r}D" if np.isfinite(x) else f"double('{x}')"


def _centred(sums: list[int], n: int) -> list[str]:
    return [f"(get({STEPS}, {i}) - {_number(s / n)})" for i, s in enumerate(sums)]


def _projection(model: Whitening, k: int, centred: list[str]) -> str:
    """x - S / n, given by dimension, on component k, over the root of its eigenvalue."""
    parts = " + ".join(f"{_number(u)} * {c}" for u, c in zip(model.vectors[:, k], centred, strict=True))
    return f"({parts}) / {_number(float(np.sqrt(model.eigenvalues[k])))}"


def _products(centred: DataFrame, width: int) -> dict[tuple[int, int], float]:
    """The sum of c_i * c_j for each pair i <= j, from rows (c): one aggregation, in which each row meets every tile of pairs.

    Tiles are summed within tasks first, so one row a task and tile is shuffled.
    """
    starts = range(0, width, TILE)
    tiles = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in starts for b in starts if a <= b))
    rows = centred.select("c", F.explode(tiles).alias("t")).select("t.a", "t.b", F.expr(f"slice(c, t.a + 1, {TILE})").alias("x"), F.expr(f"slice(c, t.b + 1, {TILE})").alias("y"))
    sums = rows.groupBy("a", "b").agg(F.expr(f"array({', '.join(f'sum(get(x, {i}) * get(y, {j}))' for i in range(TILE) for j in range(TILE))})").alias("s"))
    return {(r["a"] + i, r["b"] + j): r["s"][i * TILE + j] for r in sums.collect() for i in range(TILE) for j in range(TILE) if r["a"] + i <= r["b"] + j < width}


def fit(rows: DataFrame, components: int = 4) -> Whitening | None:
    """The whitening of rows with STEPS, or None without any. Vectors of the commonest length count (of the longer, at a tie).

    Each distinct vector counts once. Directions without variance are left out, so there may be fewer than `components`.
    """
    once = stored(rows.select(STEPS).distinct().withColumn(_WIDTH, F.size(STEPS)))
    lengths = once.groupBy(_WIDTH).count().orderBy(F.col("count").desc(), F.col(_WIDTH).desc()).first()
    if lengths is None:
        return None
    width, n = int(lengths[0]), int(lengths[1])
    own = once.where(F.col(_WIDTH) == width)
    sums = [int(s) for s in own.agg(*(F.sum(F.get(F.col(STEPS), F.lit(i)).cast("decimal(20,0)")) for i in range(width))).first()]
    centred = stored(own.selectExpr(f"array({', '.join(_centred(sums, n))}) AS c"))
    covariance = np.empty((width, width))
    for (i, j), s in _products(centred, width).items():
        covariance[i, j] = covariance[j, i] = s / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(0.0, FLAT * values.max())]
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(order))] < 0, -1, 1)  # the largest entry is positive
    model = Whitening(n, width, sums, float(np.trace(covariance)), values[order], vectors, None)
    k = len(order)
    if not k:
        return model
    whitened = centred.selectExpr(*(f"{_projection(model, i, [f'get(c, {d})' for d in range(width)])} AS w{i}" for i in range(k)))
    upper = [(i, j) for i in range(k) for j in range(i, k)]
    found = whitened.agg(*(F.covar_pop(f"w{i}", f"w{j}") for i, j in upper)).first()
    return model._replace(identity_error=max(abs(c - (i == j)) for c, (i, j) in zip(found, upper, strict=True)))


def deviation(model: Whitening) -> Column:
    """The exact sum over dimensions of (n * x - S)^2 as long; null where it is beyond long."""
    apart = [f"({model.n}BD * get({STEPS}, {i}) - {s}BD)" for i, s in enumerate(model.sums)]
    sure = [f"try_cast({a} AS BIGINT)" for a in apart]
    far = " OR ".join(f"abs({a}) > 3037000499BD" for a in apart)  # its square alone is beyond long
    total = " + ".join(f"cast({s} * {s} AS DECIMAL(20,0))" for s in sure)
    return F.expr(f"CASE WHEN {far} THEN NULL ELSE try_cast({total} AS BIGINT) END")


def whitened(rows: DataFrame, model: Whitening, name: str = "__papyrine_whitened") -> DataFrame:
    """rows with STEPS, of the model's width, with their whitened components as an array of doubles."""
    own = rows.where(F.size(STEPS) == model.width)
    return own.withColumn(name, F.array(*(F.expr(_projection(model, k, _centred(model.sums, model.n))) for k in range(len(model.eigenvalues)))).cast("array<double>"))


def whiten(embeddings: DataFrame, components: int = 4, column: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each vector and direction.

    Vectors that are null, empty or hold null or non-finite entries go; so do vectors of another length than the commonest. Rows without vec_id and rows
    that repeat one stay, each by its own vector; equal vectors count once in the fit. Directions without variance (one distinct vector has none) give
    no rows, an empty table neither. Other columns are dropped, whatever their names.
    """
    rows = steps(embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(f"`{column}`").alias("embedding")))
    model = fit(rows.select(STEPS), components)
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    if model is None or not len(model.eigenvalues):
        return embeddings.sparkSession.createDataFrame([], schema)
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.eigenvalues))
    each = whitened(rows, model, "w").select("vec_id", deviation(model).alias("deviation"), F.posexplode("w").alias("k", "whitened"))
    return each.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("k") + 1).alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
