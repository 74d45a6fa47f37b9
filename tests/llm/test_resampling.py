"""Importance resampling against a plain version, and small cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

from papyrine.llm import resampling

DOCS = "doc_id bigint, text string, score string, rank int, weight string"


def plain(documents, benchmark, most=1):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def counts(text):
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(low))
        runs = [" ".join(own[i : i + n]) for n in range(1, most + 1) for i in range(len(own) - n + 1)]
        return len(own), Counter(zlib.crc32(f.encode()) % 10_000 for f in runs)

    own, asked = [(i, *counts(t)) for i, t in documents], [counts(t)[1] for t in benchmark]
    s, t = sum((c for *_, c in own), Counter()), sum(asked, Counter())
    size, aim = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (size + 10_000) / ((s[b] + 1) * (aim + 10_000)))) for b in s}
    rows = []
    for i, n, c in own:
        weight = sum(k * gain[b] for b, k in c.items()) // c.total() if c else 0
        h = int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, c.total(), weight, None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= 20 and r[0] is not None), key=lambda r: (-r[4], r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: 10 * len(able) // 100])}
    return sorted((str((i, m, w, x, ranks.get(id(r)))) for r in rows for i, n, m, w, x in [r]))


TEXTS = [None, "", " \t\n", "Ünder DIE ÀÉ über 日本語 x_y-z 12", "the " * 50_000, *(f"word{k % 7} and thE {'target' if k % 3 else 'other'} Word{k} " * (k % 11 + 1) for k in range(120))]


def rows(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "s", 1, "w") for i, t in zip(ids, texts, strict=True)], DOCS)


def held(df):
    return sorted(str((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"])) for r in df.collect())


def test_against_plain(spark):
    target = ["the target word3 and word5", "target target", None, ""]
    bench = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    documents = rows(spark, TEXTS)
    assert held(resampling.resample(documents, bench)) == plain(enumerate(TEXTS), target)
    assert held(resampling.resample(documents, bench, most=2)) == plain(enumerate(TEXTS), target, most=2)
    assert held(resampling.resample(documents, bench.limit(0))) == plain(enumerate(TEXTS), [])


def test_ids_that_repeat_or_lack(spark):
    bench = spark.createDataFrame([("target",)], "text string")
    texts = [f"target word{k} " * 15 for k in range(40)]
    ids = [None, None, *range(2, 38), 5, 5]
    got = resampling.resample(rows(spark, texts, ids), bench).collect()
    assert len(got) == 40
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2, 3]
    assert all((r["score"] is None) == (r["doc_id"] is None) for r in got)


def test_empty_tables(spark):
    bench = spark.createDataFrame([("target",)], "text string")
    assert resampling.resample(rows(spark, []), bench).count() == 0
    assert resampling.resample(rows(spark, [None, ""]), bench).count() == 2
