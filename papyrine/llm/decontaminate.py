"""Benchmark decontamination by the q-gram lemma: shared q-grams counted in overlapping diagonal bands, verified by banded alignment.

An item of m characters that occurs with at most k edits shares at least m - q + 1 - k * q of its q-grams with the text, all on diagonals (text
position less item position) that span at most k. Bands of 2 * (k + 1) diagonals, starting every k + 1, hold any such span whole; a band with too few
distinct q-grams of the item can't hold an occurrence, and every other one is aligned.

Repetitive texts and items that share passages don't multiply: the places of a gram in a text are kept as runs, a run counts in a whole range of bands
at once, and runs meet the places of items in slices of EXPANDED at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm.common import stored, table, trim

#: Characters of a gram; share of an item that may be edited; characters below which an item is too short for grams and is sought as a whole line.
Q, EDITS, SHORTEST = 12, 0.08, 40
#: Characters of the shorter grams that a band is tested by before it is aligned.
FINE = 4
#: Bytes of benchmark text that one pass over the documents carries. A larger benchmark is searched in several passes.
ITEMS_AT_ONCE = 16_000_000
#: Characters of text hashed at once, pairs of a run and a place of an item held at once, and diagonals aligned at once.
SLICE, EXPANDED, DIAGONALS = 1_000_000, 1_000_000, 4_096
_BITS = 23

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32
_FOLD[255] = 254  # 255 stands between texts
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def lowered(text: str | None) -> str:
    """The text in lower case with as many code points: those whose lower case is longer stay."""
    text = text or ""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def normalise(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each character of the lowered text with runs of blanks as one space, and the character's place in the text.

    Characters up to 254 are their own byte, others share the upper bytes. Equal characters have equal bytes, so bytes serve to propose; points() tells
    characters apart.
    """
    low = lowered(text)
    try:
        folded = _FOLD[np.frombuffer(low.encode("latin-1"), np.uint8)]
    except UnicodeEncodeError:
        code = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), "<u4")
        folded = _FOLD[np.where(code < 256, code, 128 + code % 127).astype(np.uint8)]
    blank = folded == 32
    keep = np.flatnonzero(~(blank & np.concatenate([[True], blank[:-1]]))) if len(folded) else np.zeros(0, np.int64)
    return folded[keep], keep


def points(text: str | None, place: np.ndarray) -> np.ndarray:
    """The characters that normalise() has kept, as code points."""
    code = np.frombuffer(lowered(text).encode("utf-32-le", "surrogatepass"), "<u4")[place]
    return np.where((code >= 9) & (code <= 13), np.uint32(32), code)


def grams(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the Q bytes from each position."""
    if len(data) < Q:
        return np.zeros(0, np.uint64)
    data = np.ascontiguousarray(data)
    long = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    short = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
    n = len(data) - Q + 1
    h = (long[:n] * _M1) ^ (short[8 : 8 + n].astype(np.uint64) * _M2)
    return (h ^ (h >> np.uint64(29))) * _M1


@dataclass
class Items:
    """What a task searches for. gram, first: the distinct grams and where the places of each begin in (item, place), sorted by gram and item."""

    ids: list[int]
    texts: list[np.ndarray]
    budgets: np.ndarray
    least: np.ndarray
    gram: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    gap: np.ndarray
    bitmap: np.ndarray
    short: dict[str, list[int]]
    fine: list[np.ndarray]


def _fine(code: np.ndarray) -> np.ndarray:
    """A hash of the FINE characters from each position."""
    out = np.zeros(max(0, len(code) - FINE + 1), np.uint64)
    for i in range(FINE):
        out = out * _M1 + code[i : i + len(out)]
    return out


def prepare(items: list[tuple[int, str]]) -> Items:
    short: dict[str, list[int]] = {}
    for i, t in items:
        if len(t) < SHORTEST:
            short.setdefault(t, []).append(i)
    items = [x for x in items if len(x[1]) >= SHORTEST]
    ids, both = [i for i, _ in items], [normalise(t) for _, t in items]
    texts = [points(t, place) for (_, t), (_, place) in zip(items, both, strict=True)]
    m = np.array([len(t) for t in texts], np.int64)
    budgets = np.minimum((m * EDITS).astype(np.int64), np.maximum(m - Q, 0) // Q)
    h = [grams(t) for t, _ in both]
    item = np.repeat(np.arange(len(items)), [len(x) for x in h])
    place = np.concatenate([np.arange(len(x)) for x in h]) if h else np.zeros(0, np.int64)
    flat = np.concatenate(h) if h else np.zeros(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    gram, first = np.unique(flat[order], return_index=True)
    gap = np.minimum.reduceat(budgets[item[order]] + 1, first) if len(gram) else np.zeros(0, np.int64)
    bitmap = np.zeros(1 << _BITS, bool)
    bitmap[(gram >> np.uint64(64 - _BITS)).astype(np.int64)] = True
    return Items(ids, texts, budgets, m - Q + 1 - budgets * Q, gram, np.append(first, len(flat)), item[order], place[order], gap, bitmap, short, [_fine(t) for t in texts])


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, k: int, anchored: int | None = None) -> tuple[int, int]:
    """Least edit distance of the whole item to a stretch of text, over alignments on diagonals low to high, and where that stretch ends.

    Above k the distance may be reported as any larger number. anchored: the one diagonal that the alignment may start on; else any.
    """
    d = np.arange(low, high + 1)
    step = np.arange(len(d))
    far = k + 1 + len(item)
    cost = np.where(d >= 0, 0, far) if anchored is None else np.where(d == anchored, 0, far)
    if anchored is not None:
        cost = np.minimum.accumulate(cost - step) + step
    cost = np.where((d >= 0) & (d <= len(text)), cost, far)
    for i, byte in enumerate(item):
        at = i + d
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(len(d), bool)
        same[inside] = text[at[inside]] == byte
        new = np.where(inside, cost + ~same, far)
        new[:-1] = np.minimum(new[:-1], cost[1:] + 1)
        ends = i + 1 + d
        new = np.where((ends >= 0) & (ends <= len(text)), new, far)
        cost = np.minimum.accumulate(new - step) + step
        cost = np.where((ends >= 0) & (ends <= len(text)), cost, far)
        if cost.min() > k:
            return k + 1, -1
    best = int(cost.argmin())
    return int(cost[best]), len(item) + int(d[best])


def occurrence(item: np.ndarray, fine: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """Distance, start and end in text of the item's best occurrence on these diagonals, if within k edits. fine: the item's shorter grams.

    By the lemma again, the stretch that an occurrence can lie in holds all but FINE * k of the shorter grams; this spares most alignments.
    """
    from_, to = max(0, low - k), min(len(text), high + len(item) + 2 * k)
    if np.isin(fine, _fine(text[from_:to])).sum() < len(fine) - FINE * k:
        return None
    found = text[from_:to].tobytes().decode("utf-32-le", "surrogatepass").find(item.tobytes().decode("utf-32-le", "surrogatepass"))
    if found >= 0:
        return 0, from_ + found, from_ + found + len(item)
    if k == 0:
        return None
    distance, end = align(item, text, low - k, high + k, k)
    if distance > k:
        return None
    back, length = align(item[::-1], text[max(0, end - len(item) - k) : end][::-1], -k, k, k, anchored=0)
    return distance, end - (length if back <= k else len(item)), end


def _runs(texts: list[np.ndarray], items: Items) -> tuple[np.ndarray, ...]:
    """(text, gram, first, last) of the places of items' grams in the texts, sorted by text and gram: places no further apart than any band reaches."""
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    data = np.full(starts[-1], 255, np.uint8)
    for s, t in zip(starts, texts, strict=False):
        data[s : s + len(t)] = t
    parts = []
    for a in range(0, len(data), SLICE):
        h = grams(data[a : a + SLICE + Q - 1])
        maybe = np.flatnonzero(items.bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(maybe):
            continue
        at = np.searchsorted(items.gram, h[maybe])
        good = (at < len(items.gram)) & (items.gram[np.minimum(at, len(items.gram) - 1)] == h[maybe])
        where, gram = a + maybe[good], at[good]
        text = np.searchsorted(starts, where, side="right") - 1
        order = np.lexsort((where, gram, text))
        text, gram, where = text[order], gram[order], where[order] - starts[text[order]]
        if len(where):
            new = np.ones(len(where), bool)
            new[1:] = (text[1:] != text[:-1]) | (gram[1:] != gram[:-1]) | (where[1:] - where[:-1] > items.gap[gram[1:]])
            begin = np.flatnonzero(new)
            parts.append((text[begin], gram[begin], where[begin], where[np.append(begin[1:], len(where)) - 1]))
    if not parts:
        return (np.zeros(0, np.int64),) * 4
    text, gram, first, last = (np.concatenate([p[k] for p in parts]) for k in range(4))
    order = np.lexsort((first, gram, text))
    return text[order], gram[order], first[order], last[order]


def _dense(runs: tuple[np.ndarray, ...], items: Items, lo: int, hi: int) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first band, last band) with enough distinct grams, of the runs against items lo to hi - 1; at most EXPANDED pairs at once."""
    text, gram, first, last = runs
    if hi - lo == len(items.ids):
        a, b = items.first[gram], items.first[gram + 1]
    else:
        n = len(items.ids)
        ordered = np.repeat(np.arange(len(items.gram)), np.diff(items.first)) * n + items.item
        a, b = np.searchsorted(ordered, gram * n + lo), np.searchsorted(ordered, gram * n + hi)
    many = b - a
    total = np.cumsum(many)
    if not len(many) or not total[-1]:
        return
    if total[-1] > EXPANDED:
        if text[0] != text[-1]:  # text by text, as many as fit
            ends = np.append(np.flatnonzero(text[1:] != text[:-1]) + 1, len(text))
            begin = 0
            while begin < len(text):
                fit = np.searchsorted(total[ends - 1], (total[begin - 1] if begin else 0) + EXPANDED, side="right")
                end = max(ends[np.searchsorted(ends, begin, side="right")], ends[fit - 1] if fit else 0)
                yield from _dense(tuple(x[begin:end] for x in runs), items, lo, hi)
                begin = end
            return
        if hi - lo > 1:
            middle = (lo + hi) // 2
            yield from _dense(runs, items, lo, middle)
            yield from _dense(runs, items, middle, hi)
            return
        yield from _dense_pair(int(text[0]), lo, a, many, first, last, items)
        return
    index = np.repeat(a - np.cumsum(many) + many, many) + np.arange(total[-1])
    text, first, last = np.repeat(text, many), np.repeat(first, many), np.repeat(last, many)
    item, place = items.item[index], items.place[index]
    stride = items.budgets[item] + 1
    # a place counts in the band that starts at its stride and in the one before
    low, high = np.floor_divide(first - place, stride) - 1, np.floor_divide(last - place, stride)
    order = np.lexsort((low, place, item, text))
    text, item, place, low, high = text[order], item[order], place[order], low[order], high[order]
    again = (text[1:] == text[:-1]) & (item[1:] == item[:-1]) & (place[1:] == place[:-1])
    low[1:][again] = np.maximum(low[1:][again], high[:-1][again] + 1)  # each band once for a gram of the item
    keep = low <= high
    text, item, low, high = text[keep], item[keep], low[keep], high[keep]
    text, item = np.concatenate([text, text]), np.concatenate([item, item])
    band, step = np.concatenate([low, high + 1]), np.repeat([1, -1], len(low))
    order = np.lexsort((band, item, text))
    text, item, band, step = text[order], item[order], band[order], step[order]
    shared = np.cumsum(step)  # 0 again after each text and item
    enough = np.flatnonzero((shared >= items.least[item]) & (np.append(band[1:], band[-1]) > band))
    for x in enough:
        yield int(text[x]), int(item[x]), int(band[x]), int(band[x + 1]) - 1


def _dense_pair(text: int, item: int, a: np.ndarray, many: np.ndarray, first: np.ndarray, last: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, int]]:
    """As _dense, of one text and one item with very many pairs: counts of all bands, place by place. Runs that meet may count twice, so it proposes no less."""
    stride = int(items.budgets[item]) + 1
    lowest, highest = -(len(items.texts[item]) // stride) - 3, int(last.max()) // stride + 2
    step = np.zeros(highest - lowest + 2, np.int64)
    for one, n, begin, end in zip(a.tolist(), many.tolist(), first.tolist(), last.tolist(), strict=True):
        place = items.place[one : one + n]
        np.add.at(step, (begin - place) // stride - 1 - lowest, 1)
        np.add.at(step, (end - place) // stride + 1 - lowest, -1)
    enough = np.concatenate([[False], np.cumsum(step) >= items.least[item], [False]])
    edges = np.flatnonzero(enough[1:] != enough[:-1])
    for begin, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        yield text, item, begin + lowest, end - 1 + lowest


def search(texts: list[np.ndarray], items: Items, characters: Callable[[int], np.ndarray]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, start, end), the best occurrence of each item in each text. characters: the points of a text, asked for where needed."""
    if not len(items.gram):
        return []
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    held: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))
    for t, i, first, last in _dense(_runs(texts, items), items, 0, len(items.ids)):
        k = int(items.budgets[i])
        least = best.get((t, i), (k + 1, 0, 0))
        if held[0] != t:
            held = (t, characters(t))
        for band in range(first, last + 1, max(1, DIAGONALS // (k + 1))):
            if least[0] == 0:
                break
            to = min(last, band + max(1, DIAGONALS // (k + 1)) - 1)
            found = occurrence(items.texts[i], items.fine[i], held[1], band * (k + 1), (to + 2) * (k + 1) - 1, least[0] - 1)
            if found:  # bands come in order, so of equal distances the earliest stays
                least = best[t, i] = found
    return [(t, i, *found) for (t, i), found in sorted(best.items())]


def whole_lines(text: str | None, items: Items) -> Iterator[tuple[int, int, int]]:
    """(item id, start, end) of the short items that are a whole line or the whole text: the first occurrence of each."""
    seen: set[int] = set()
    at = 0
    for line in [*(text or "").split("\n"), None]:
        line, begin = (text or "", 0) if line is None else (line, at)
        for i in items.short.get(" ".join(lowered(line).split()), ()):
            if i not in seen:
                seen.add(i)
                yield i, begin + len(line) - len(line.lstrip()), begin + len(line.rstrip())
        at += len(line) + 1


def _slices(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[tuple[int, list[np.ndarray]]]:
    texts, size, first = [], 0, 0
    for i, value in enumerate(batch["text"]):
        texts.append(normalise(value.as_py())[0])
        size += len(texts[-1])
        if size >= most:
            yield first, texts
            texts, size, first = [], 0, i + 1
    if texts:
        yield first, texts


def benchmark_groups(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items as (item_id, text without outer blanks), in groups of ITEMS_AT_ONCE bytes about, one group at a time.

    Items without id or text and blank ones are passed over. Items of one id and different texts are all searched.
    """
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // ITEMS_AT_ONCE))
    for g in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == g).orderBy("item_id", "text").toPandas()
        # one space for a run of the blanks that texts are folded by
        plain = [(int(i), " ".join(lowered(t).translate(_BLANK).split(" "))) for i, t in zip(part["item_id"], part["text"], strict=True)]
        yield [(i, " ".join(x for x in t.split(" ") if x)) for i, t in plain if t.strip(" ")]


_BLANK = dict.fromkeys(range(9, 14), " ")


def _passes(rows: DataFrame, benchmark: DataFrame, work: Callable[[DataFrame, list], DataFrame]) -> Iterator[DataFrame]:
    """work of rows and each group of items. With several groups each pass is written at once, so the driver holds one group."""
    groups = benchmark_groups(benchmark)
    first = next(groups)
    second = next(groups, None)
    if second is None:
        yield work(rows, first)
        return
    yield stored(work(rows, first))
    while second is not None:
        yield stored(work(rows, second))
        second = next(groups, None)


def _found(batch: pa.RecordBatch, items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item id, distance, start, end) in code points of the text."""
    for first, texts in _slices(batch):
        places: dict[int, np.ndarray] = {}

        def characters(t: int, first: int = first, places: dict = places) -> np.ndarray:
            text = batch["text"][first + t].as_py()
            places[t] = normalise(text)[1]
            return points(text, places[t])

        for t, i, distance, start, end in search(texts, items, characters):
            yield first + t, items.ids[i], distance, int(places[t][start]), int(places[t][end - 1]) + 1
    if items.short:
        for row, text in enumerate(batch["text"]):
            for i, start, end in whole_lines(text.as_py(), items):
                yield row, i, 0, start, end


def _matches(batches: Iterator[pa.RecordBatch], group: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
    items = prepare(group)
    names = ["doc_id", "item_id", "distance", "start", "end"]
    for batch in batches:
        doc_ids = batch["doc_id"].to_pylist()
        rows = [(doc_ids[r], *found) for r, *found in _found(batch, items)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names)
    trim()


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, distance, start, end (code points of the text, end exclusive): the best occurrence of each item in each document.

    Items of SHORTEST characters or more are found anywhere within EDITS of their length; shorter ones only unedited, as a whole line or the whole text
    (anywhere else they could be chance). Case and runs of blanks don't matter. Null and empty texts match nothing; a repeated row gives repeated rows;
    ties go to the earliest occurrence; other columns are dropped. An empty table on either side gives no rows. Texts of any length are searched whole.
    """
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id bigint, item_id bigint, distance bigint, start bigint, end bigint"
    return reduce(DataFrame.unionByName, _passes(rows, benchmark, lambda r, g: r.mapInArrow(partial(_matches, group=g), schema)))


def _clean(batches: Iterator[pa.RecordBatch], group: list[tuple[int, str]]) -> Iterator[pa.RecordBatch]:
    items = prepare(group)
    for batch in batches:
        keep = np.ones(batch.num_rows, bool)
        for row, *_ in _found(batch, items):
            keep[row] = False
        yield batch.filter(pa.array(keep))
    trim()


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents, with all their columns, in which no benchmark item occurs.

    Rows with null or empty texts stay; rows that repeat are judged alike; columns of any names stay as they are; an empty benchmark removes nothing.
    """
    groups = benchmark_groups(benchmark)
    out, group = documents, next(groups)
    while group is not None:
        out, group = out.mapInArrow(partial(_clean, group=group), documents.schema), next(groups, None)
        if group is not None:  # so that the driver holds one group
            out = stored(out)
    return out


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
