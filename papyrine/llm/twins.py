"""SQL for the queries of this subpackage that SQL can express, written for an engine with regular expressions, lists and recursion."""

from __future__ import annotations

from papyrine.llm import linededup, pii, resampling, suffixes
from papyrine.llm.common import BLANKS

_WORD = "[^" + "".join(f"\\x{ord(c):02X}" for c in BLANKS) + "]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Base patterns as the contract gives them.
_BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def op6_sql() -> str:
    """Matches and the pieces between them give the places; checks and sums are list functions."""
    patterns = [*_BASE.items(), ("iban", pii.IBAN), ("secret", pii.QUOTED), ("plain", pii.PLAIN), ("key", pii.KEY)]
    proposed = " UNION ALL ".join(
        f"SELECT doc_id, text, '{kind}' AS rule, regexp_extract_all(text, {_quoted(p)}) AS m, string_split_regex(text, {_quoted(p)}) AS s FROM d" for kind, p in patterns
    )
    values = " ".join(f"WHEN '{rule}' THEN regexp_extract(hit, {_quoted(p)}, 1)" for rule, p in (("secret", pii.QUOTED), ("plain", pii.PLAIN)))
    context = " ".join(f"WHEN '{kind}' THEN {' OR '.join(f'contains(near, {_quoted(w)})' for w in words)}" for kind, words in pii.WORDS.items())
    rank = " ".join(f"WHEN '{kind}' THEN {n}" for n, kind in enumerate(pii.KINDS))
    base = ", ".join(f"'{k}'" for k in pii.BASE)
    listing = "kind || ':' || a || ':' || b, ',' ORDER BY rank, a"
    best = f"round(100 * ({pii.PROPOSED} + {pii.CHECKED} * confirmed::INT + {pii.IN_CONTEXT} * named::INT))"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
proposed AS ({proposed}),
placed AS (
    SELECT doc_id, text, rule, m[i] AS hit,
           (list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a
    FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM proposed)),
parts AS (
    SELECT *, regexp_replace(hit, '[^0-9]', '', 'g') AS digits, CASE rule {values} ELSE hit END AS value, replace(hit, ' ', '') AS iban,
           CASE rule WHEN 'plain' THEN 'secret' ELSE rule END AS kind
    FROM placed),
passed AS (
    SELECT doc_id, text, kind, rule IN ('card', 'iban') AS confirmed,
           (a + length(hit) - length(value) - (rule = 'secret')::INT)::BIGINT AS a, (a + length(hit) - (rule = 'secret')::INT)::BIGINT AS b
    FROM parts
    WHERE CASE rule
        WHEN 'ip' THEN len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3 OR try_cast('0' || right(ltrim(p, '0'), 3) AS INT) > 255)) = 0
        WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
            CASE WHEN (length(digits) - i) % 2 = 0 THEN digits[i]::INT WHEN digits[i]::INT > 4 THEN 2 * digits[i]::INT - 9 ELSE 2 * digits[i]::INT END)) % 10 = 0
        WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
        WHEN 'iban' THEN length(iban) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform(string_split(substr(iban, 5) || substr(iban, 1, 4), ''), lambda c:
            CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda x, y: (x * CASE WHEN y > 9 THEN 100 ELSE 10 END + y) % 97) = 1
        WHEN 'plain' THEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
        ELSE true END),
seen AS (
    SELECT *, lower(substr(text, greatest(1, a + 1 - {pii.CONTEXT}), least(a, {pii.CONTEXT}))) || ' ' || lower(substr(text, b + 1, {pii.CONTEXT})) AS near,
           CASE kind {rank} END AS rank
    FROM passed),
scored AS (SELECT *, CASE kind {context} END AS named FROM seen),
found AS (
    SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.BASE)}, string_agg({listing}) FILTER (kind IN ({base})) AS base, string_agg({listing}) AS spans,
           count(*) AS n_spans, count(*) FILTER (confirmed) AS n_confirmed, count(*) FILTER (named) AS n_in_context, max({best})::BIGINT AS best_percent
    FROM scored GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0)::BIGINT AS n_{k}' for k in pii.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_spans, 0)::BIGINT AS n_spans, coalesce(n_confirmed, 0)::BIGINT AS n_confirmed, coalesce(n_in_context, 0)::BIGINT AS n_in_context, best_percent
FROM (SELECT doc_id FROM documents) LEFT JOIN found USING (doc_id)
"""


def op7_sql(k: int = 3, percent: int = 85) -> str:
    """Shingles as joined words; every pair that shares one is counted exactly; components by recursion."""
    return f"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_quoted(_WORD)}) AS w FROM documents),
shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + {k - 1}], ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 2}, 2))) AS i FROM words WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared
    FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared >= {percent} * (x.n + y.n - shared)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, a FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, coalesce(l.component_id, d.doc_id)::BIGINT AS component_id, coalesce(l.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l USING (doc_id)
"""


def op9_sql(edits: int = linededup.EDITS, per_edit: int = linededup.PER_EDIT) -> str:
    """Lines in hexadecimal, so that pieces of bytes can be compared; whoever shares a piece of the shorter line near its place is measured."""
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    return f"""
WITH lines AS MATERIALIZED (
    SELECT doc_id, n, line, trim(line, {blanks}) AS raw
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL)),
firsts AS MATERIALIZED (
    SELECT raw, doc_id, min(n) AS n, count(*) AS copies FROM lines WHERE raw <> '' GROUP BY raw, doc_id),
kinds AS MATERIALIZED (
    SELECT *, least({edits}, bytes // {per_edit}) AS k
    FROM (SELECT raw, strlen(raw) AS bytes, hex(encode(raw)) AS h, min(doc_id) AS first, arg_min(n, doc_id) AS at FROM firsts GROUP BY raw)),
pieces AS (
    SELECT raw, bytes, k, i, s AS place, substr(h, 2 * s + 1, 2 * size) AS piece
    FROM (SELECT *, (i * (bytes // (k + 1)) + greatest(0, i - (k + 1 - bytes % (k + 1))))::BIGINT AS s, (bytes // (k + 1) + (i >= k + 1 - bytes % (k + 1))::INT)::BIGINT AS size
          FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM kinds WHERE k > 0))),
probes AS (
    SELECT DISTINCT x.raw, p.bytes, p.i, p.place, substr(x.h, 2 * (p.place + shift) + 1, 2 * p.size) AS piece
    FROM (SELECT DISTINCT bytes, k, i, place, (length(piece) // 2)::BIGINT AS size FROM pieces) p
    JOIN kinds x ON x.bytes BETWEEN p.bytes AND p.bytes + p.k, (SELECT unnest(range(-{edits}, {edits} + 1)) AS shift)
    WHERE p.place + shift >= 0 AND p.place + shift + p.size <= x.bytes),
near AS MATERIALIZED (
    SELECT DISTINCT p.raw AS a, q.raw AS b
    FROM pieces p JOIN probes q ON p.bytes = q.bytes AND p.i = q.i AND p.place = q.place AND p.piece = q.piece AND p.raw <> q.raw
    WHERE levenshtein(p.raw, q.raw) <= p.k),
links AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
linked AS (
    SELECT l.a AS raw, count(*) AS n_links, bool_or(y.first < x.first OR (y.first = x.first AND y.at < x.at)) AS later
    FROM links l JOIN kinds x ON x.raw = l.a JOIN kinds y ON y.raw = l.b GROUP BY l.a),
judged AS (
    SELECT t.doc_id, t.n, t.line, t.raw, f.n = t.n AS is_first, coalesce(k.n_links, 0) AS n_links,
           t.raw <> '' AND (f.n <> t.n OR c.first <> t.doc_id OR coalesce(k.later, false)) AS gone
    FROM lines t LEFT JOIN firsts f ON f.raw = t.raw AND f.doc_id = t.doc_id LEFT JOIN kinds c ON c.raw = t.raw LEFT JOIN linked k ON k.raw = t.raw),
done AS (
    SELECT doc_id, count(*) FILTER (raw <> '') AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(sum(n_links) FILTER (is_first), 0) AS n_links,
           coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '') AS text
    FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(o.n_lines, 0)::BIGINT AS n_lines, coalesce(o.n_removed, 0)::BIGINT AS n_removed, coalesce(o.n_links, 0)::BIGINT AS n_links, o.text
FROM documents d LEFT JOIN done o USING (doc_id)
"""


def op11_sql() -> str:
    """Buckets by a CRC over the bytes of each distinct word, from a table of 256 remainders made by its rule."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
WITH remainders AS MATERIALIZED (
    SELECT list(list_reduce(list_prepend(n, range(0, 8)), lambda c, i: {step}) ORDER BY n) AS r FROM (SELECT unnest(range(0, 256))::BIGINT AS n)),
texts AS (SELECT 's' AS side, doc_id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 't', NULL, coalesce(text, '') FROM benchmark),
found AS MATERIALIZED (
    SELECT side, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
counts AS MATERIALIZED (SELECT side, doc_id, word, count(*) AS n FROM (SELECT side, doc_id, unnest(w) AS word FROM found) GROUP BY ALL),
kinds AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM counts),
placed AS MATERIALIZED (
    SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
           lambda c, b: xor(c >> 8, r[(xor(c, b) & 255) + 1])), 4294967295) % {resampling.BUCKETS} AS bucket FROM kinds, remainders),
totals AS (
    SELECT bucket, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t FROM counts JOIN placed USING (word) GROUP BY bucket),
gained AS (
    SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (a + {resampling.BUCKETS})::DOUBLE) / ((s + 1)::DOUBLE * (b + {resampling.BUCKETS})::DOUBLE)))::BIGINT AS gain
    FROM totals, (SELECT sum(s) AS a, sum(t) AS b FROM totals)),
summed AS (
    SELECT doc_id, sum(n * gain)::BIGINT AS total FROM counts JOIN placed USING (word) JOIN gained USING (bucket) WHERE side = 's' GROUP BY doc_id),
weights AS (
    SELECT f.doc_id, len(w)::BIGINT AS n_features,
           CASE WHEN len(w) > 0 THEN (total - ((total % len(w)) + len(w)) % len(w)) // len(w) ELSE 0 END::BIGINT AS weight,
           ('0x' || substr(sha256('{resampling.SEED}:' || f.doc_id), 1, 8))::BIGINT AS h
    FROM found f LEFT JOIN summed x ON x.doc_id = f.doc_id WHERE side = 's'),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM weights),
drawn AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= {resampling.LEAST})
SELECT s.doc_id, n_features, weight, score, CASE WHEN rank <= {resampling.PERCENT} * n // 100 THEN rank END::BIGINT AS rank
FROM scored s LEFT JOIN drawn USING (doc_id)
"""


def op12_sql(length: int = suffixes.LENGTH) -> str:
    """Every string of `length` bytes as hexadecimal digits, grouped by itself; what covers a byte follows from the last repeated start before it."""
    return f"""
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, p, substr(h, 2 * p + 1, {2 * length}) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {length - 1})) AS p FROM d)),
keyed AS MATERIALIZED (SELECT doc_id, p, md5(s) AS s FROM starts),
twice AS (SELECT s FROM keyed GROUP BY s HAVING count(*) > 1),
hits AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM keyed SEMI JOIN twice USING (s)),
islands AS (SELECT doc_id, p, sum((q IS NULL OR p > q + {length})::INT) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM hits),
spans AS MATERIALIZED (SELECT doc_id, k, min(p) AS a, max(p) + {length} AS b FROM islands GROUP BY doc_id, k),
gaps AS (
    SELECT doc_id, coalesce(lag(b) OVER w, 0) AS a, a AS b FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
    UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (
    SELECT doc_id, string_agg(CASE WHEN g.b IS NULL THEN substr(h, 2 * g.a + 1) ELSE substr(h, 2 * g.a + 1, 2 * (g.b - g.a)) END, '' ORDER BY g.a) AS h
    FROM gaps g JOIN d USING (doc_id) GROUP BY doc_id),
summed AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id) LEFT JOIN summed s USING (doc_id)
"""


ORACLES = {"op12_suffixes": op12_sql(), "op11_resampling": op11_sql(), "op6_pii": op6_sql(), "op7_neardup": op7_sql(), "op9_linededup": op9_sql()}
