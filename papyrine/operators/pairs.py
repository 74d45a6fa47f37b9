"""Pairs of vectors: pairs of ids meet both vectors, and all pairs of two tables are scored, block by block.

Vectors are dealt to blocks by the hash of their id and shipped once for each block of the other side; pairs of ids are shipped as ids to the task that has
both blocks. A row never travels with a vector. A task holds two blocks and a bounded batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Vectors of one block at most, in the mean; tables of up to SPREAD of these parts are cut finer, for more tasks.
BLOCK, FINE, SPREAD = 1 << 16, 2_048, 8
#: Numbers that a task gathers at once.
CELLS = 1 << 21
_LIST = pa.list_(pa.float64())


class Side:
    """The vectors of a block, sorted by id: values (short ones filled up), lengths, and which are null or hold a null."""

    def __init__(self, ids: np.ndarray, vectors: pa.Array, labels: pa.Array):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.labels = ids[order], vectors.take(pa.array(order)), labels.take(pa.array(order))
        self.null = self.vectors.is_null().to_numpy(zero_copy_only=False)
        self.size = self.vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = self.vectors.flatten()
        values = flat.fill_null(0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(order)), self.size)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.x = np.zeros((len(order), int(self.size.max(initial=0))), values.dtype if values.dtype.kind == "f" else np.float64)
        self.x[row, at] = values
        self.broken = self.null.copy()
        if flat.null_count:
            self.broken[row[flat.is_null().to_numpy(zero_copy_only=False)]] = True
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.x, self.x, dtype=np.float64))

    def values(self, at: np.ndarray, width: int) -> np.ndarray:
        out = self.x[at].astype(np.float64)
        return out if out.shape[1] == width else np.pad(out, ((0, 0), (0, width - out.shape[1])))


def met(left: Side, right: Side, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, row of left, row of right) of the pairs whose ends are known; an id that repeats meets as often."""
    fa, fb = np.searchsorted(left.ids, a, "left"), np.searchsorted(right.ids, b, "left")
    na, nb = np.searchsorted(left.ids, a, "right") - fa, np.searchsorted(right.ids, b, "right") - fb
    n = na * nb
    pair = np.repeat(np.arange(len(a)), n)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
    return pair, fa[pair] + k // np.maximum(nb[pair], 1), fb[pair] + k % np.maximum(nb[pair], 1)


def dots(left: Side, i: np.ndarray, right: Side, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inner products, and which are null: of null vectors, of those that hold a null and of vectors of unlike lengths."""
    width = max(left.x.shape[1], right.x.shape[1])
    return np.einsum("ij,ij->i", left.values(i, width), right.values(j, width)), left.broken[i] | right.broken[j] | (left.size[i] != right.size[j])


def dot_of(left: Side, i: np.ndarray, right: Side, j: np.ndarray) -> list[pa.Array]:
    """V1"""
    d, null = dots(left, i, right, j)
    return [pa.array(d, mask=null)]


def cosine_of(left: Side, i: np.ndarray, right: Side, j: np.ndarray) -> list[pa.Array]:
    """V2: 0 where either is a zero vector."""
    d, null = dots(left, i, right, j)
    size = left.norm[i] * right.norm[j]
    return [pa.array(np.where(size == 0, 0.0, d / np.where(size == 0, 1.0, size)), mask=left.broken[i] | right.broken[j] | null & (size != 0))]


def features_of(left: Side, i: np.ndarray, right: Side, j: np.ndarray) -> list[pa.Array]:
    """Both vectors one after the other and both labels; null if either vector is."""
    whole = ~(left.broken[i] | right.broken[j]) & (left.size[i] == left.x.shape[1]) & (right.size[j] == right.x.shape[1])
    width = left.x.shape[1] + right.x.shape[1]
    if whole.all():
        values = np.concatenate([left.values(i, left.x.shape[1]), right.values(j, right.x.shape[1])], 1)
        both = pa.ListArray.from_arrays(np.arange(0, len(i) * width + 1, width or 1, dtype=np.int32)[: len(i) + 1] if width else np.zeros(len(i) + 1, np.int32), pa.array(values.ravel()))
    else:
        lists = zip(left.vectors.take(pa.array(i)).to_pylist(), right.vectors.take(pa.array(j)).to_pylist(), strict=True)
        both = pa.array([None if x is None or y is None else [*x, *y] for x, y in lists], _LIST)
    return [both, left.labels.take(pa.array(i)), right.labels.take(pa.array(j))]


def ends_of(left: Side, i: np.ndarray, right: Side, j: np.ndarray) -> list[pa.Array]:
    """Length of both vectors one after the other, the first entry of the left and the last of the right one."""
    null = left.null[i] | right.null[j]
    if not (left.broken[i].any() or right.broken[j].any() or (left.size[i] == 0).any() or (right.size[j] == 0).any()):
        return [pa.array(left.size[i] + right.size[j]), pa.array(left.x[i, 0].astype(np.float64)), pa.array(right.x[j, right.size[j] - 1].astype(np.float64))]
    first, last = left.vectors.take(pa.array(i)).to_pylist(), right.vectors.take(pa.array(j)).to_pylist()
    return [
        pa.array(left.size[i] + right.size[j], mask=null),
        pa.array([x[0] if x and not n else None for x, n in zip(first, null, strict=True)], pa.float64()),
        pa.array([y[-1] if y and not n else None for y, n in zip(last, null, strict=True)], pa.float64()),
    ]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.RecordBatch]]:
    """Slices of the sorted rows of one block pair and kind."""
    for batch in batches:
        if batch.num_rows:
            keys = np.stack([batch[c].to_numpy(zero_copy_only=False) for c in ("_i", "_j", "_kind")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                yield tuple(keys[lo].tolist()), batch.slice(lo, hi - lo)


def _side(parts: list[pa.RecordBatch], key: str) -> Side:
    rows = pa.Table.from_batches(parts).combine_chunks()
    one = lambda c: rows[c].chunk(0)
    return Side(one(key).to_numpy(zero_copy_only=False), one("_vec"), one("_label"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Side, Side, pa.RecordBatch | None]]:
    """(left, right, pairs) for each batch of pairs of a block pair; without pairs among the rows, once for each block pair (pairs: None)."""
    at, sides, built, fresh = None, ([], []), None, False
    for (i, j, kind), rows in _runs(batches):
        if (i, j) != at:
            if fresh and all(sides):
                yield _side(sides[0], "a"), _side(sides[1], "b"), None
            at, sides, built, fresh = (i, j), ([], []), None, True
        if kind < 2:
            sides[kind].append(rows)
        else:
            fresh = False
            if all(sides):
                built = built or (_side(sides[0], "a"), _side(sides[1], "b"))
                yield *built, rows
    if fresh and all(sides):
        yield _side(sides[0], "a"), _side(sides[1], "b"), None


def _join(batches: Iterator[pa.RecordBatch], carried: list[str], values: Callable, names: list[str]) -> Iterator[pa.RecordBatch]:
    for left, right, rows in _blocks(batches):
        if rows is None:
            continue
        pair, i, j = met(left, right, rows["a"].to_numpy(), rows["b"].to_numpy())
        step = max(1, CELLS // max(1, 2 * (left.x.shape[1] + right.x.shape[1])))
        for k in range(0, len(pair), step):
            own = pa.array(pair[k : k + step])
            yield pa.RecordBatch.from_arrays([*(rows[c].take(own) for c in carried), *values(left, i[k : k + step], right, j[k : k + step])], names)


def _parts(rows: DataFrame) -> DataFrame:
    """One row, the number of blocks that rows are dealt to: few for a long table, as what is shipped grows with it."""
    n = F.count("*")
    return rows.agg(F.greatest(F.lit(1), F.ceil(n / BLOCK), F.least(F.lit(SPREAD), F.ceil(n / FINE))).cast("int").alias("_parts"))


def _dealt(left: DataFrame, right: DataFrame, pairs: DataFrame | None, carried: list[str]) -> DataFrame:
    """Rows (_i, _j, _kind, a, b, _vec, _label, carried) in the order of blocks and kinds: left vectors, right vectors, pairs."""
    sizes = F.broadcast(_parts(left).toDF("_rows").join(F.broadcast(_parts(right).toDF("_columns"))))
    block = lambda key, n: F.pmod(F.xxhash64(F.col(key).cast("bigint")), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = lambda t: F.lit(None).cast(t)
    vec, label = left.schema["vec"].dataType, left.schema["label"].dataType
    extra = [pairs.schema[c] for c in carried if c not in ("a", "b")] if pairs is not None else []

    def rows(df: DataFrame, i: Column, j: Column, kind: int, a: Column, b: Column) -> DataFrame:
        own = [F.col("vec"), F.col("label"), *(none(f.dataType) for f in extra)] if kind < 2 else [none(vec), none(label), *(F.col(f.name) for f in extra)]
        named = [c.alias(n) for c, n in zip(own, ["_vec", "_label", *(f.name for f in extra)], strict=True)]
        return df.join(sizes).select(i.alias("_i"), j.alias("_j"), F.lit(kind).alias("_kind"), a.cast("bigint").alias("a"), b.cast("bigint").alias("b"), *named)

    out = rows(left.where("vec_id is not null"), block("vec_id", "_rows"), every("_columns"), 0, F.col("vec_id"), none("bigint"))
    out = out.unionByName(rows(right.where("vec_id is not null"), every("_rows"), block("vec_id", "_columns"), 1, none("bigint"), F.col("vec_id")))
    if pairs is None:  # small blocks are much work: none are put together
        return out.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_i", "_j").sortWithinPartitions("_i", "_j", "_kind")
    out = out.unionByName(rows(pairs.where("a is not null and b is not null"), block("a", "_rows"), block("b", "_columns"), 2, F.col("a"), F.col("b")))
    return out.repartition("_i", "_j").sortWithinPartitions("_i", "_j", "_kind")


def join_vectors(pairs: DataFrame, vectors: DataFrame, values: Callable, schema: str) -> DataFrame:
    """pairs (a, b, ..: integers) whose ends both have vectors (vec_id, vec, label), with the columns (schema) that `values` gives of both; an equi-join on either end."""
    carried = pairs.columns
    out = T.StructType([*(T.StructField(f.name, T.LongType() if f.name in ("a", "b") else f.dataType) for f in pairs.schema), *T.StructType.fromDDL(schema)])
    return _dealt(vectors, vectors, pairs, carried).mapInArrow(partial(_join, carried=carried, values=values, names=out.names), out)


def _near(batches: Iterator[pa.RecordBatch], least: float, ordered: bool) -> Iterator[pa.RecordBatch]:
    for left, right, _ in _blocks(batches):
        step, width = max(1, CELLS // max(1, len(right.ids))), max(left.x.shape[1], right.x.shape[1])
        whole = right.values(np.arange(len(right.ids)), width).T
        for k in range(0, len(left.ids), step):
            rows = np.arange(k, min(len(left.ids), k + step))
            size = left.norm[rows][:, None] * right.norm
            raw = left.values(rows, width) @ whole
            able = ~(left.broken[rows][:, None] | right.broken) & (left.size[rows][:, None] == right.size)
            if ordered:
                able &= left.ids[rows][:, None] < right.ids
            # a product of matrices adds up in another order: what is near the bound is judged by the sum of its own pair
            i, j = np.nonzero(able & ~(raw < (least - 1e-9) * size))
            for m in range(0, len(i), max(1, CELLS // max(1, 2 * width))):
                own = slice(m, m + max(1, CELLS // max(1, 2 * width)))
                yield pa.RecordBatch.from_arrays([pa.array(left.ids[rows[i[own]]]), pa.array(right.ids[j[own]]), *cosine_of(left, rows[i[own]], right, j[own])], ["src", "dst", "c"])


def near_pairs(left: DataFrame, right: DataFrame, least: float, ordered: bool = False) -> DataFrame:
    """(src, dst, c): all pairs of left and right (vec_id, vec, label) whose cosine is `least` or more, on demand with src < dst; blocks against blocks.

    Scoring every pair is what is asked for: the work grows with left times right. NaN counts as more than any number, as in SQL.
    """
    return _dealt(left, right, None, []).mapInArrow(partial(_near, least=least, ordered=ordered), "src bigint, dst bigint, c double").where(F.col("c") >= least)
