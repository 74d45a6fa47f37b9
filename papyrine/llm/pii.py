"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust their score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.llm.common import map_arrow, table

#: Kinds in the order of listing; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "secret", "key")
BASE = KINDS[:4]
#: Code points on either side of a span in which context words count, and the words.
CONTEXT = 40
WORDS = {
    "email": ("mail", "contact", "write to", "reply"),
    "ip": ("address", "server", "host", "ip "),
    "card": ("card", "visa", "credit", "payment", "mastercard"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "secret": ("token", "key", "secret", "password"),
    "key": ("token", "key", "secret", "password"),
}
#: Score of a proposal, and what a passed checksum and a context word add.
PROPOSED, CHECKED, IN_CONTEXT = 0.6, 0.3, 0.1

# Runs are possessive and start where a run starts, which matches what the plain patterns match but never rescans a long run.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# The added kinds are also read by the SQL of the query, so their patterns keep to what its dialect knows.
IBAN = r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
NAMED = r"(?i:token|secret|passwd|password|api[_-]?key|access[_-]?key)[ \t]{0,3}[=:][ \t]{0,3}"
#: A quoted value counts as it is, a plain one if it has letters and digits.
QUOTED = NAMED + r"[\"']([A-Za-z0-9_+/=-]{16,256})[\"']"
PLAIN = NAMED + r"([A-Za-z0-9_+/=-]{12,256})"
#: Keys known by how they begin.
KEY = r"\b(?:AKIA[0-9A-Z]{16}|(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,64}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,72}|AIza[A-Za-z0-9_-]{35})\b"
_IBAN, _KEY, _QUOTED, _PLAIN = (re.compile(x, re.ASCII) for x in (IBAN, KEY, QUOTED, PLAIN))
_NAMES = ("token", "secret", "passw", "key")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    confirmed: bool
    in_context: bool


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 over the rearranged number, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int, bool]]:
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            done = m.end()
            yield start, done, False


def _proposals(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Kind, start, end and whether a checksum has confirmed it, of spans that pass their kind's checks."""
    if "@" in text:
        for start, end, checked in _emails(text):
            yield "email", start, end, checked
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            yield "ip", *m.span(), False
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span(), True
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(str.isdigit, m.group())) <= 15:
                yield "phone", *m.span(), False
    for m in _IBAN.finditer(text):
        number = m.group().replace(" ", "")
        if 15 <= len(number) <= 34 and mod97(number):
            yield "iban", *m.span(), True
    low = text.lower()
    if any(name in low for name in _NAMES):
        for m in _QUOTED.finditer(text):
            yield "secret", *m.span(1), False
        for m in _PLAIN.finditer(text):
            value = m.group(1)
            if any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
                yield "secret", *m.span(1), False
    for m in _KEY.finditer(text):
        yield "key", *m.span(), False


def find(text: str | None) -> list[Span]:
    """All spans of a whole text (null: empty), by kind as listed, then start; offsets are code points, end exclusive."""
    out = []
    for kind, start, end, checked in _proposals(text or ""):
        near = text[max(0, start - CONTEXT) : start].lower() + " " + text[end : end + CONTEXT].lower()
        named = any(w in near for w in WORDS[kind])
        out.append(Span(kind, start, end, round(PROPOSED + CHECKED * checked + IN_CONTEXT * named, 2), checked, named))
    return sorted(out, key=lambda s: (KINDS.index(s.kind), s.start))


def listing(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def scan(documents: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, score, confirmed by a checksum, in_context of a telling word) of each row.

    Null and empty texts have no spans; repeated rows give repeated rows; other columns are dropped; an empty table gives none. Long texts are scanned
    whole, in time linear in their length.
    """

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("confirmed", pa.bool_()), ("in_context", pa.bool_())]))
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([[s._asdict() for s in find(t.as_py())] for t in batch["text"]], kind)], ["doc_id", "spans"])

    return map_arrow(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), per_batch, "doc_id bigint, spans array<struct<kind:string,start:int,end:int,score:double,confirmed:boolean,in_context:boolean>>")


def redact(documents: DataFrame, least: float = PROPOSED) -> DataFrame:
    """doc_id and text with every span of at least this score replaced by its kind in angle brackets; where spans overlap, the first listed wins.

    Null texts stay null, empty ones empty; repeated rows give repeated rows; other columns are dropped; an empty table gives none. Time is linear in the
    text and its spans.
    """

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        free = bytearray(len(text))  # 1 where a span is taken
        taken: list[Span] = []
        for s in find(text):
            if s.score >= least and not any(free[s.start : s.end]):
                free[s.start : s.end] = b"\1" * (s.end - s.start)
                taken.append(s)
        out, at = [], 0
        for s in sorted(taken, key=lambda s: s.start):
            out += [text[at : s.start], f"<{s.kind}>"]
            at = s.end
        return "".join([*out, text[at:]])

    def per_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([clean(t.as_py()) for t in batch["text"]], pa.string())], ["doc_id", "text"])

    return map_arrow(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), per_batch, "doc_id bigint, text string")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scan(table(spark, sf_dir, "documents"))
    line = lambda array: F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda rule, name: F.size(F.filter("spans", rule)).cast("bigint").alias(name)
    of = lambda kind: lambda s: s["kind"] == kind
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return spans.select(
        "doc_id",
        *(count(of(k), f"n_{k}") for k in BASE),
        F.sha2(line(base), 256).alias("base_sha256"),
        line(F.col("spans")).alias("spans"),
        F.size("spans").cast("bigint").alias("n_spans"),
        count(lambda s: s["confirmed"], "n_confirmed"),
        count(lambda s: s["in_context"], "n_in_context"),
        F.round(F.array_max(F.transform("spans", lambda s: s["score"])) * 100).cast("bigint").alias("best_percent"),
    )
