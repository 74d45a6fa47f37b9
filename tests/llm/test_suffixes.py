"""Repeated strings of bytes against plain counting, and small cases."""

import random
from collections import Counter

import pytest

from papyrine.llm import suffixes
from papyrine.llm.suffixes import KEPT, SPANS

DOCS = "doc_id bigint, text string, spans string, h int, t1 string"


def plain(texts, length):
    raws = [(t or "").encode() for t in texts]
    found = Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for p in range(len(r) - length + 1):
            if found[r[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        out.append((sum(gone), sum(g and not b for g, b in zip(gone, [False, *gone], strict=False)), bytes(c for c, g in zip(r, gone, strict=True) if not g)))
    return out


def held(spark, texts, ids=None, **options):
    ids = list(range(len(texts))) if ids is None else ids
    df = spark.createDataFrame([(i, t, str(k), k, "x") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOCS)
    out = suffixes.dedup_suffixes(df, **options)
    assert out.columns == [*df.columns, SPANS, KEPT]
    rows = sorted(out.collect(), key=lambda r: r["h"])
    assert [(r["doc_id"], r["text"]) for r in rows] == list(zip(ids, texts, strict=True))
    return [(sum(s["end"] - s["start"] for s in r[SPANS]), len(r[SPANS]), bytes(r[KEPT])) for r in rows]


def prose(rng, n):
    return "".join(rng.choice("abcdefgh é日") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    one, two, line = prose(rng, 900), prose(rng, 700), prose(rng, 260)
    edited = one[:300] + "#" + one[301:650] + "##" + one[650:]
    edges = [prose(rng, rng.randrange(300)) + line + prose(rng, rng.randrange(300)) for _ in range(40)]  # a hot passage in many surroundings
    short = [prose(rng, 100) + line[20 + k : 20 + k + 150] + prose(rng, 90) for k in range(20)]  # less than a string in common
    return [None, "", "x", one, edited, two, two, two[100:600], one[100:250] + two[:250], "ab" * 400, "the the " * 90, "q" * 199, "q" * 200, "q" * 201, "z" * 201, *edges, *short, line * 3]


def test_against_plain(spark, texts):
    assert held(spark, texts) == plain(texts, 200)


def test_large_buckets(spark, texts, monkeypatch):
    monkeypatch.setattr(suffixes, "TOGETHER", 1)  # each bucket is refined by rounds of shuffles
    assert held(spark, texts) == plain(texts, 200)


def test_other_lengths_and_chunks(spark, texts, monkeypatch):
    assert held(spark, texts, length=130, q=16) == plain(texts, 130)
    monkeypatch.setattr(suffixes, "CHUNK", 256)
    for text in texts:  # in this process, where the smaller chunk holds
        raw = (text or "").encode()
        h, g, at, low, high = suffixes.runs(raw, suffixes.Hashes(256 + 200), 200, 48)
        assert sum(high - low + 1) == max(len(raw) - 199, 0)
        assert sorted(p for a, x, y in zip(at, low, high, strict=True) for p in range(a - y, a - x + 1)) == list(range(max(len(raw) - 199, 0)))


def test_rows_that_repeat(spark):
    rng = random.Random(1)
    text = prose(rng, 500)
    got = held(spark, [text, text, prose(rng, 500), text], [None, 3, 3, 3])
    assert [n for n, _, _ in got] == [len(text.encode()), len(text.encode()), 0, len(text.encode())]
    assert [k for _, _, k in got][0] == b""


def test_empty_table(spark):
    assert held(spark, []) == []


def test_long_text(spark):
    rng = random.Random(2)
    part = prose(rng, 3_000)
    text = "".join(prose(rng, 40_000) for _ in range(20)) + part + prose(rng, 500_000) + part
    (n, spans, kept), (m, _, _) = held(spark, [text, part[:1_000]])
    assert (n, spans, len(kept)) == (2 * len(part.encode()), 2, len(text.encode()) - n) and m == len(part[:1_000].encode())
