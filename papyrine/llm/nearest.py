"""Approximate nearest neighbours by collision counting: sorted single-projection arrays, query-centred windows, virtual rehashing.

Every block of vectors keeps PROJECTIONS arrays of its vectors, each sorted by one projection. A query opens a window around its own projection in every
array; vectors seen in a share COLLISIONS of the windows are verified with their exact cosine. All windows widen by a factor (virtual rehashing: the
same arrays serve every radius) until the collision rule ends the search: a vector as near as the k-th best verified one would by now have been seen
often enough. How many are verified follows from the data alone; there is no quota.
Queries go to every block, so each block's answer is about its own vectors, and the answers of all blocks are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.llm.common import stored, table

PROJECTIONS, SEED = 160, 20240611
#: Share of the windows that a vector has to be seen in to be verified.
COLLISIONS = 0.7
#: Standard deviations by which the collisions of a vector at the k-th distance have to lie over that share before a search ends.
CERTAINTY = 1.0
#: Half width of the first windows, the factor by which they widen, and the share of a query's last width that the next query starts with.
FIRST, WIDEN, AGAIN = 0.3, 1.15, 0.96
#: Share of all places by which windows have to grow before places are compared instead of members counted.
WIDE = 0.05
#: More than cosines of rounded unit vectors are off.
ROUNDING = 1e-12
#: Vectors of one block, and queries of one group, at most (blocks and groups are dealt by hash, so about).
BLOCK, GROUP = 16_000, 2_000


def projections(dimensions: int) -> np.ndarray:
    """Unit-variance directions, in sets that are orthogonal among themselves: their counts vary less than those of independent ones."""
    rng = np.random.default_rng(SEED)
    sets = [np.linalg.qr(rng.standard_normal((dimensions, dimensions)))[0] for _ in range(-(-PROJECTIONS // dimensions))]
    return np.concatenate(sets, 1)[:, :PROJECTIONS] * math.sqrt(dimensions)


def reach() -> float:
    """Half width, as a multiple of a distance, at which vectors of that distance collide often enough with CERTAINTY."""
    p = COLLISIONS
    for _ in range(30):
        p = COLLISIONS + CERTAINTY * math.sqrt(p * (1 - p) / PROJECTIONS)
    return NormalDist().inv_cdf((1 + p) / 2)


class Index:
    """Collision counting over one block of vectors: candidates by unit vectors, what is returned by the cosine of the vectors as given."""

    def __init__(self, ids: np.ndarray, given: np.ndarray):
        self.ids, self.given = ids, _scaled(given)
        self.vectors = vectors = _unit(given)
        self.lines = projections(vectors.shape[1])
        keys = (vectors @ self.lines).T
        order = np.argsort(keys, axis=1, kind="stable")
        # the sorted arrays one after another, each moved by its own distance: one search looks into all of them
        apart = 4 * np.abs(keys).max() + 1e3
        self.apart = np.arange(PROJECTIONS) * apart
        self.sorted = (np.take_along_axis(keys, order, 1) + self.apart[:, None]).ravel()
        self.order = order.ravel()
        # the place of each vector in each sorted array, in numbers of a width that stays in the cache
        self.place = np.argsort(order, axis=1).astype(np.uint16 if len(ids) < 1 << 15 else np.uint32)
        self.edges = np.arange(PROJECTIONS) * len(ids)
        self.half, self.reach = FIRST / AGAIN, reach()
        self.verified = 0

    def _members(self, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
        return [self.order[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]

    def _collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each vector the windows that hold it, by its place in each array: for wide windows faster than going through their members."""
        n, kind = len(self.ids), self.place.dtype.type
        out, some, place, inside = np.zeros(n, np.uint16), np.zeros(n, np.uint8), np.empty(n, kind), np.empty(n, bool)
        first, width = (low - self.edges).astype(kind), (high - low).astype(kind)
        for m in range(PROJECTIONS):
            np.subtract(self.place[m], first[m], out=place)  # below the window this wraps to a number above any width
            np.less(place, width[m], out=inside)
            np.add(some, inside.view(np.uint8), out=some)
            if m % 128 == 127 or m + 1 == PROJECTIONS:
                out += some
                some[:] = 0
        return out.astype(np.int64)

    def search(self, given: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the k nearest verified vectors besides the query's own. Windows start a little inside those of the query before."""
        n = len(self.ids)
        query = _unit(given[None])[0]
        centre = query @ self.lines + self.apart
        seen = self.ids == own
        found, score = np.zeros(0, np.int64), np.zeros(0)
        half, counts = self.half * AGAIN, np.zeros(n, np.int64)
        low = high = np.clip(np.searchsorted(self.sorted, centre), self.edges, self.edges + n)
        while True:
            new_low = np.maximum(np.searchsorted(self.sorted, centre - half, "left"), self.edges)
            new_high = np.minimum(np.searchsorted(self.sorted, centre + half, "right"), self.edges + n)
            new_low, new_high = np.minimum(new_low, low), np.maximum(new_high, high)
            if (new_high - new_low).sum() - (high - low).sum() > WIDE * len(self.order):
                counts = self._collisions(new_low, new_high)
            else:  # a window grows by what is new at either end
                counts += np.bincount(np.concatenate(self._members(new_low, low) + self._members(high, new_high)), minlength=n)
            low, high = new_low, new_high
            new = np.flatnonzero((counts >= COLLISIONS * PROJECTIONS) & ~seen)
            seen[new] = True
            self.verified += len(new)
            found = np.concatenate([found, new])
            score = np.concatenate([score, (self.vectors[new] * query).sum(1)])  # row by row in one order, so equal vectors get equal scores
            if (high - low).sum() == len(self.order):
                break
            if len(score) >= k:
                edge = np.partition(score, -k)[-k]
                enough = self.reach * math.sqrt(max(0.0, 2 - 2 * edge))
                if half >= enough:
                    break
                half = min(half * WIDEN, enough)
            else:
                half *= WIDEN
        self.half = max(half, FIRST)
        if len(score) > k:  # unit vectors are rounded: whatever they can't tell from the k-th is compared as given
            found = found[score >= np.partition(score, -k)[-k] - ROUNDING]
        score = cosines(self.given[found], _scaled(given[None])[0])
        order = np.lexsort((self.ids[found], -score))[:k]
        return self.ids[found][order], score[order]


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of rows that take part: an id and a vector without null or non-finite components that isn't zero."""
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def _scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors by a power of two each, so that squares don't overflow; this rounds nothing."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(1, keepdims=True))[1])


def cosines(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Products by lengths, each summed up row by row in one order, so that equal vectors get equal cosines."""
    length = lambda v: np.sqrt((v * v).sum(-1))
    return (vectors * query).sum(1) / (length(vectors) * length(query))


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def _matrix(rows: list) -> np.ndarray:
    return np.array(rows, np.float64)


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector whose id is divisible by `every`, its k nearest others by cosine in double precision.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without id. Vectors are compared with vectors of as
    many components only. Ties go to the smaller vec_id. Rows that repeat a vec_id count once, with the first vector in array order. A query with
    fewer than k others gets what there is; an empty table gives none. Other columns are dropped.
    """
    rows = stored(usable(embeddings).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("width", F.size("embedding")))
    total = rows.count()
    blocks = max(1, -(-total // BLOCK))
    groups = max(1, -(-(total // every + 1) // GROUP))
    base = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int"))
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).withColumn("group", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(groups)).cast("int"))
    # every group of queries meets every block once: groups x blocks tasks, each of bounded size
    left = base.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(vectors) and len(asked):
            widths = vectors["width"].to_numpy()
            for width in np.unique(widths):
                own = vectors.filter(pa.array(widths == width)).sort_by("vec_id")
                mine = asked.filter(pa.array(asked["width"].to_numpy() == width)).sort_by("vec_id")
                if not len(mine):
                    continue
                index = Index(own["vec_id"].to_numpy(), _matrix(own["embedding"].to_pylist()))
                for q, vector in zip(mine["vec_id"].to_pylist(), _matrix(mine["embedding"].to_pylist()), strict=True):
                    ids, score = index.search(vector, q, k)
                    out += [(q, int(i), float(s)) for i, s in zip(ids, score, strict=True)]
        return pa.table({"query_id": pa.array([r[0] for r in out], pa.int64()), "vec_id": pa.array([r[1] for r in out], pa.int64()), "score": pa.array([r[2] for r in out], pa.float64())})

    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(search, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
