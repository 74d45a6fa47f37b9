"""Byte-level BPE in DuckDB, one in-memory database per task: recursive contraction encodes, ordered aggregation decodes."""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import threading
import types
from collections.abc import Iterator
from functools import partial
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyrine.llm.common import table, trim

#: Words longer than this (bytes) are contracted by a heap instead: one round a merge over all their rows would cost the square of their length.
LONG_WORD = 200
#: Distinct words of one generation whose ids a task remembers (two generations are kept), and ids that one decoding statement takes.
REMEMBERED, DECODED_AT_ONCE = 220_000, 200_000
#: Words that one encoding statement takes, and the sum of their squared lengths in bytes at most: the recursive query keeps the rows of all its rounds.
LEARNT_AT_ONCE, SQUARES_AT_ONCE = 40_000, 2_000_000

#: A row is a token at a position of a word, with the position and the token after it. Each round joins rows and their successors to the merge
#: table, picks each word's pair of least rank, leftmost among equals, and contracts it; words without a pair have reached their fixpoint and drop out.
ENCODE = """
WITH RECURSIVE state(word, pos, token, next, after, round) AS (
    SELECT word, pos, token, next, after, 0 FROM start
    UNION ALL
    (WITH best AS (
        SELECT word, min(m.merged::BIGINT * 1024 + pos) AS best, arg_min(next, m.merged::BIGINT * 1024 + pos) AS gone
        FROM state JOIN merge m ON m.a = token AND m.b = after GROUP BY word),
    cut AS (
        SELECT b.word, (best % 1024)::INT AS spot, (best // 1024)::INT AS merged, gone, g.next, g.after
        FROM best b JOIN state g ON g.word = b.word AND g.pos = b.gone)
    SELECT s.word, s.pos, CASE WHEN s.pos = spot THEN merged ELSE s.token END, CASE WHEN s.pos = spot THEN c.next ELSE s.next END,
           CASE WHEN s.pos = spot THEN c.after WHEN s.next = spot THEN merged ELSE s.after END, round + 1
    FROM state s JOIN cut c USING (word) WHERE s.pos <> gone))
SELECT word, token
FROM state JOIN (SELECT word, max(round) AS round FROM state WHERE after IS NULL GROUP BY word) USING (word, round)
ORDER BY word, pos
"""

DECODE = """
SELECT row, string_agg(v.text, '' ORDER BY c.pos) AS text FROM coded c JOIN vocabulary v USING (token) GROUP BY row
"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


class Coder:
    """Encoder and decoder of one task at a time."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.split = regex.compile(pattern).findall
        self.database = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "200MB", "temp_directory": ""})  # nothing is spilled to a machine's own folder
        pairs = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        a, b, merged = (pa.array(x, pa.int32()) for x in zip(*pairs, strict=True))
        self._register("merge", {"a": a, "b": b, "merged": merged})
        self._register("vocabulary", {"token": pa.array(self.ranks.values(), pa.int32()), "text": pa.array([t.decode("latin-1") for t in self.ranks])})  # a code point for each byte
        self.single = np.array([self.ranks[bytes([k])] for k in range(256)])
        self.decimal = np.array([str(i) for i in range(max(self.ranks.values()) + 1)], object)
        self.known: dict[str, bytes] = {}  # ids as 32-bit integers
        self.before: dict[str, bytes] = {}

    def _register(self, name: str, columns: dict) -> None:
        source = pa.table(columns)  # noqa: F841  read by name below
        self.database.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM source")

    def close(self) -> None:
        """Gives the memory back: the worker lives on for other stages."""
        self.database.close()
        self.known, self.before = {}, {}

    def learn(self, words: set[str]) -> None:
        """Ids of new words."""
        raws = [(w, w.encode("utf-8", "replace")) for w in sorted(words)]
        for w, raw in raws:
            if len(raw) > LONG_WORD:
                self.known[w] = self._by_heap(raw).tobytes()
        raws = [x for x in raws if 0 < len(x[1]) <= LONG_WORD]
        first = squares = 0
        for k, (_, raw) in enumerate(raws):
            if k > first and (squares + len(raw) ** 2 > SQUARES_AT_ONCE or k - first == LEARNT_AT_ONCE):
                self._contract(raws[first:k])
                first, squares = k, 0
            squares += len(raw) ** 2
        if first < len(raws):
            self._contract(raws[first:])

    def _contract(self, raws: list[tuple[str, bytes]]) -> None:
        lengths = np.array([len(r) for _, r in raws])
        word = np.repeat(np.arange(len(raws)), lengths)
        pos = np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        token = self.single[np.frombuffer(b"".join(r for _, r in raws), np.uint8)]
        last = pos + 1 == np.repeat(lengths, lengths)
        after = pa.array(np.append(token[1:], 0), pa.int32(), mask=last)
        self._register("start", {"word": pa.array(word, pa.int32()), "pos": pa.array(pos, pa.int32()), "token": pa.array(token, pa.int32()), "next": pa.array(pos + 1, pa.int32()), "after": after})
        found = self.database.execute(ENCODE).fetchnumpy()
        tokens = np.asarray(found["token"], np.int32)
        ends = (4 * np.searchsorted(np.asarray(found["word"]), np.arange(len(raws) + 1))).tolist()
        flat = tokens.tobytes()
        self.known.update((w, flat[a:b]) for (w, _), a, b in zip(raws, ends[:-1], ends[1:], strict=True))

    def _by_heap(self, raw: bytes) -> np.ndarray:
        """The same rule for a long word: the leftmost pair of least rank first."""
        ranks, n = self.ranks, len(raw)
        part, after, before = [raw[i : i + 1] for i in range(n)], [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r, i, raw[i : i + 2]) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j < 0 or part[i] + part[j] != both:
                continue
            part[i], part[j], after[i] = both, None, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (r := ranks.get(pair := part[k] + part[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, pair))
        return np.array([ranks[p] for p in part if p is not None], np.int32)

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str]]:
        """Ids of each text, as numbers and joined by spaces."""
        split = [self.split(t or "") for t in texts]
        here = set(chain.from_iterable(split))
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        new = here.difference(self.known)
        again = new.intersection(self.before)
        self.known.update((w, self.before[w]) for w in again)
        self.learn(new - again)
        for words in split:
            ids = np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32)
            yield ids, " ".join(self.decimal[ids].tolist())

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each id list."""
        out = [b""] * len(ids)
        first = 0
        while first < len(ids):
            last, size = first, 0
            while last < len(ids) and (last == first or size + len(ids[last]) <= DECODED_AT_ONCE):
                size += len(ids[last])
                last += 1
            flat = np.concatenate(ids[first:last])
            row = np.repeat(np.arange(first, last), [len(x) for x in ids[first:last]])
            self._register("coded", {"row": pa.array(row, pa.int32()), "pos": pa.array(np.arange(len(flat)), pa.int32()), "token": pa.array(flat, pa.int32())})
            for k, text in self.database.execute(DECODE).fetchall():
                out[k] = text.encode("latin-1")
            first = last
        return out


#: Seconds that a Python worker keeps its coder for the next task of the stage.
KEPT_SECONDS = 4.0


def borrow(path: str, pattern: str) -> Coder:
    """The coder that the last task of this worker gave back, with the words it has seen, or a new one."""
    state = sys.modules.setdefault("papyrine_coder", types.ModuleType("papyrine_coder")).__dict__
    timer, coder = state.pop("timer", None), state.pop("coder", None)
    if timer is not None:
        timer.cancel()
    if coder is not None and state.get("key") == (path, pattern):
        return coder
    state["key"] = (path, pattern)
    return Coder(path, pattern)


def give_back(coder: Coder) -> None:
    """Keeps a coder for a moment; without a next task its memory goes, as the worker lives on for other stages."""
    state = sys.modules["papyrine_coder"].__dict__

    def drop() -> None:
        kept = state.pop("coder", None)
        if kept is not None:
            kept.close()
            trim()

    state["coder"] = coder
    state["timer"] = threading.Timer(KEPT_SECONDS, drop)
    state["timer"].daemon = True
    state["timer"].start()


def _pieces(batch: pa.RecordBatch, column: str, bytes_at_once: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    """A batch in slices of bounded text size (one row at least)."""
    size, first = 0, 0
    for i, value in enumerate(batch[column]):
        size += len(value.as_py() or "")
        if size >= bytes_at_once:
            yield batch.slice(first, i + 1 - first)
            size, first = 0, i + 1
    if first < batch.num_rows:
        yield batch.slice(first)


def _run(batches: Iterator[pa.RecordBatch], path: str, pattern: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    coder = None
    for batch in batches:
        for piece in _pieces(batch, "text"):
            coder = coder or borrow(path, pattern)
            coded = list(coder.encode(piece["text"].to_pylist()))
            ids = [x for x, _ in coded]
            decoded = coder.decode(ids)
            columns = {
                "doc_id": piece["doc_id"],
                "n_tokens": pa.array([len(x) for x in ids], pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(s.encode()).hexdigest() for _, s in coded]),
                "decoded_sha256": pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
            }
            if with_ids:
                columns |= {"ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array([d.decode("utf-8", "replace") for d in decoded])}
            yield pa.RecordBatch.from_pydict(columns)
        trim()
    if coder:
        give_back(coder)


def encode_decode(documents: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and on demand ids and decoded, for each row.

    Null and empty texts have no ids. Repeated rows give repeated rows; columns besides doc_id and text are dropped; an empty table gives none.
    Texts of any length are taken whole: a task holds the distinct words it has seen, up to a bound, and the ids of a few megabytes of text.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(partial(_run, path=path, pattern=pattern, with_ids=with_ids), schema)


def decode(coded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids decode to the empty text, ids outside the vocabulary are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in batches:
            coder = coder or Coder(path, pattern)
            ids = [np.array(x or [], np.int32) for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "text": pa.array([d.decode("utf-8", "replace") for d in coder.decode(ids)])})

    return coded.select("doc_id", "ids").mapInArrow(run, T.StructType([coded.schema["doc_id"], T.StructField("text", T.StringType())]))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
