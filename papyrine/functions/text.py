"""Text expressions: cleaning, symbol rules, sentences, chunks and back. All are built-in Column expressions."""

from __future__ import annotations

import re
from functools import reduce
from re import _parser

from pyspark.sql import Column
from pyspark.sql import functions as F

from papyrine.functions import patterns as P

#: `.` stops at line feeds only.
_DOT = "(?d)"


#: The characters of Unicode's White_Space property.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, then) -> Column:
    """then(value) with value computed once: conditions and branches share it instead of each repeating the whole expression."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def needed(pattern: str) -> list[str]:
    """Literals of which every match of the pattern holds at least one; empty if none is known. Repeated and optional parts promise nothing."""

    def best(found: list[list[str]]) -> list[str]:
        return max((f for f in found if f), key=lambda f: min(map(len, f)), default=[])

    def of(sequence) -> list[str]:
        found, run = [], ""
        for kind, value in sequence:
            kind = str(kind)
            if kind == "LITERAL":
                run += chr(value)
                continue
            found.append([run] if run else [])
            run = ""
            if kind == "SUBPATTERN":
                found.append(of(value[-1]))
            elif kind == "BRANCH":
                each = [of(branch) for branch in value[1]]
                found.append([literal for one in each for literal in one] if all(each) else [])
        return best([*found, [run] if run else []])

    return of(_parser.parse(pattern))


def delete(text: Column, found: list[str], flags: str = "") -> Column:
    """text without the matches of each pattern in turn. A pattern is tried only where a literal that it needs occurs, which is far cheaper to see."""

    def one(t: Column, pattern: str) -> Column:
        gone = lambda x: F.regexp_replace(x, F.lit(_DOT + flags + pattern), F.lit(""))
        literals = needed(pattern)
        if not literals:
            return gone(t)
        fold = (lambda x: x) if not flags else F.lower
        there = lambda x: reduce(lambda p, q: p | q, (F.contains(x, F.lit(literal.lower() if flags else literal)) for literal in dict.fromkeys(literals)))
        return let(t, lambda x: F.when(let(fold(x), there) if flags else there(x), gone(x)).otherwise(x))

    return reduce(one, found, text)


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.trim(text, F.lit(_WHITE))


def cleaned(text: Column) -> Column:
    """Publisher and licence notices out of an abstract; null gives the empty text.

    The steps that cut a notice in one of the last two sentences keep what stands before it and a full stop.
    """
    fourth = lambda t, ps: reduce(lambda x, p: F.regexp_replace(x, F.lit(_DOT + p), F.lit("$4")), ps, t)

    def without_notice(t: Column) -> Column:
        head = F.element_at(F.split(t, r"\. "), 1)
        leading = delete(fourth(t, P.LEADING_NOTICE), [P.NOTICE_TO_STOP])
        inside = delete(fourth(t, P.COPYRIGHT_NOTICE), [P.NOTICE_TO_AUTHORS], "(?i)")
        return F.when(head.startswith("©"), leading).when(head.contains("©"), inside).otherwise(t)

    def cut(back: int):
        def step(t: Column) -> Column:
            parts = F.split(t, r"\. ")
            ended = F.try_element_at(parts, F.lit(-back))
            before = F.concat(F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - back, F.lit(0))), ". "), F.lit("."))
            return F.when(F.coalesce(ended.contains("©"), F.lit(False)), before).otherwise(t)

        return step

    t = delete(delete(F.coalesce(text, F.lit("")), P.DELETED), P.DELETED_ANY_CASE, "(?i)")
    for step in (without_notice, cut(2), cut(1), lambda t: strip(delete(t, P.DELETED_LAST))):
        t = let(t, step)
    return t


def symbol_name(name: Column) -> Column:
    """R2: brackets, commas, quotes and colons out; hyphens, slashes and spaces to underscores (Q16: nothing else is left to do)."""
    return F.translate(name, '-/ (),":', "___")


def symbol_phrase(name: Column) -> Column:
    """As symbol_name, but hyphens and slashes become spaces and spaces stay."""
    return F.translate(name, '-/(),":', "  ")


def linked_name(label: Column) -> Column:
    """What stands between the first `/name=` and the next ` (`, as symbol_name; null without the marker."""
    rest = F.get(F.split(label, "/name=", 2), F.lit(1))
    return symbol_name(F.get(F.split(rest, r" \("), F.lit(0)))


def linked_name_or_self(label: Column) -> Column:
    """The label itself where there is no marker."""
    return F.coalesce(linked_name(label), label)


def synonyms(field: Column) -> Column:
    """The `|`-separated parts of a lower-cased symbol_phrase."""
    return F.split(F.lower(symbol_phrase(field)), r"\|")


_EXTRA = "(" + "|".join(re.escape(x) for x in sorted(P.SYMBOLS, key=lambda x: (-len(x), x))) + ")"


def symbol_rule(token: Column) -> Column:
    """A lower-cased token with symbols out and hyphens as spaces; numbers become P.NUMBER; null: dropped."""
    t = F.regexp_replace(token, "[-/‐−]", " ")
    t = F.regexp_replace(t, r"(?U)(\w),(\w)", "$1 $2")
    t = F.regexp_replace(t, r"(?U)(\w),\s+(\w)", "$1 $2")
    t = F.regexp_replace(t, _EXTRA, "")
    t = strip(F.regexp_replace(t, r"(?U)\s+", " "))
    return F.when(t.isin(*P.SYMBOLS), F.lit(None)).when(t.rlike("[a-zA-Z]"), t).when(t.rlike("[0-9]"), F.lit(P.NUMBER))


def fine_rule(token: Column) -> Column:
    """Full stops, commas, words and numbers as they are; null: dropped."""
    return F.when(token.isin(*P.SYMBOLS_FINE), F.lit(None)).when(token.isin(".", ",") | token.rlike("[a-zA-Z0-9]"), token)


def sentences(text: Column) -> Column:
    """Sentences as arrays of tokens (words, numbers and single symbols), split after full stops, question and exclamation marks.

    A rule-based stand-in for a statistical tokeniser.
    """
    found = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
    return F.transform(found, lambda s: F.regexp_extract_all(s, F.lit(r"([\p{L}\p{N}_]+(?:[-/'][\p{L}\p{N}_]+)*|[^\s\p{L}\p{N}_])"), F.lit(1)))


def ruled_sentences(sents: Column) -> Column:
    """symbol_rule over sentences, pieces flattened; sentences stay even if empty."""
    piece = lambda t: F.split(symbol_rule(F.lower(t)), " ")
    return F.transform(sents, lambda s: F.flatten(F.filter(F.transform(s, piece), lambda x: x.isNotNull())))


def words(text: Column) -> Column:
    """White-space separated words, none empty."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def chunks(text: Column, longest: int = 512, size: int = 400) -> Column:
    """A text of more than `longest` words in pieces of `size` words; shorter ones whole."""
    w = words(text)
    starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(size))
    return F.when(F.size(w) <= longest, F.array(text)).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, F.lit(size)), " ")))


def detokenised(tokens: Column) -> Column:
    """K4: tokens joined by spaces; full stops and commas attach to the token before."""
    return F.regexp_replace(F.array_join(tokens, " "), r" ([.,])(?= |$)", "$1")


def replaced_spans(text: Column, spans: Column) -> Column:
    """Spans (start from 0, end, value) replaced from the right, so that earlier offsets hold."""
    step = lambda t, s: F.concat(F.substr(t, F.lit(1), s["start"]), s["value"], F.substr(t, s["end"] + 1))
    return F.aggregate(F.sort_array(spans, asc=False), text, step)


def has_terms(text: Column, terms: list[str], least: int = 1, without: list[str] = (), keep: str = "relevant") -> Column:
    """F8: at least `least` of the terms occur as words and none of `without`; keep="remove" (Q5) turns to at most `least`."""
    own = F.array_distinct(words(text))
    n = F.size(F.array_intersect(own, F.array(*map(F.lit, terms))))
    if keep == "remove":
        return n <= least
    if keep != "relevant":
        raise ValueError(f"keep is {keep!r}, not 'relevant' or 'remove'")
    return (n >= least) & ~F.arrays_overlap(own, F.array(*map(F.lit, without))) if without else n >= least


#: What reads as a number: digits (with single underscores between them), a point, an exponent, or the names of infinity and not-a-number.
NUMBER = r"^[+-]?((?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9](?:_?[0-9])*)?|(?i:nan|inf|infinity))$"


def is_number(entry: Column) -> Column:
    """whether the trimmed entry reads as a number. A cast would also take suffixes such as those of 1d and 2f."""
    return F.trim(entry).rlike(NUMBER)


def valid_utf8(raw: Column) -> Column:
    """Text without bytes that aren't UTF-8."""
    return F.regexp_replace(F.make_valid_utf8(raw), "�", "")


def year_of(medline: Column, year: Column) -> Column:
    """The year if there is one, else the first year in a free date, else N/A."""
    found = F.regexp_extract(medline, r"\b(19|20)\d{2}\b", 0)
    return F.coalesce(year.cast("string"), F.nullif(found, F.lit("")), F.lit("N/A"))
