"""The pipeline, stage by stage and as a whole, against plain Python on one machine."""

import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from papyrine.llm import bpe, linededup, toxicity

from .test_small_cases import PATH, TOKENIZER, WORDS, brute_components, distance, edited, sentence

BAD = ["wretchedfool", "vilescoundrel", "filthyrat", "baseknave"]


def fixture(spark, folder):
    rng = random.Random(21)
    items = [" ".join(sentence(rng, 9) for _ in range(3)) for _ in range(3)]
    texts, toxic = [], []
    footer = "All of this is offered as it is, without warranty."
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    for k in range(260):
        body = [sentence(rng, 14) for _ in range(rng.randrange(2, 6))]
        bad = k % 5 == 0
        if bad:
            body[0] = body[0][:-1] + " " + rng.choice(BAD) + "."
        if k % 7 == 3:
            body.append(footer if k % 2 else footer[:-1] + "!")
        if k % 29 == 4:
            body.insert(1, rng.choice(items))
        if k % 11 == 6:
            body = [" ".join(edited(rng, base, rng.randrange(0, 4)))]
        texts.append("\n".join(body)), toxic.append(int(bad and k % 11 != 6))
    texts += [None, "", texts[1], texts[2]]
    toxic += [0] * 4
    rows = [(k, t, "en", f"s{k % 3}", len(t or ""), 0.5) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score double").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, y) for k, y in enumerate(toxic)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return {r[0]: r[1] for r in rows}, items


def plain_lines(docs):
    first = {}
    for d in sorted(docs):
        for n, raw in linededup.units(docs[d]):
            first.setdefault(raw, (d, n))
    near = {raw: [o for o in first if o != raw and abs(len(o) - len(raw)) <= 2 and distance(o, raw, 2) <= linededup.budget(min(len(o), len(raw)))] for raw in first}
    out = {}
    for d, t in docs.items():
        if t is None:
            out[d] = t
            continue
        seen, kept, lost = set(), [], False
        for line in t.split("\n"):
            raw = line.strip().encode()
            if raw:
                gone = raw in seen or first[raw][0] != d or any(first[o] < first[raw] for o in near[raw])
                seen.add(raw)
                lost |= gone
                if gone:
                    continue
            kept.append(line)
        if not lost or "\n".join(kept).strip():
            out[d] = "\n".join(kept)
    return out


def brute_groups(rows, k, percent):
    """The least doc_id that each doc_id is linked with through any of its texts."""
    ids = [d for d, _ in rows]
    linked = brute_components([(n, t) for n, (_, t) in enumerate(rows)], k, percent)
    up = {d: d for d in ids}
    for _ in ids:
        least = {}
        for n, d in enumerate(ids):
            least[linked[n][1]] = min(least.get(linked[n][1], d), up[d])
        after = {}
        for n, d in enumerate(ids):
            after[d] = min(after.get(d, d), up[d], least[linked[n][1]])
        if after == up:
            return up
        up = after
    return up


def test_stages_and_run(spark, tmp_path):
    folder = f"file://{tmp_path}"
    docs, items = fixture(spark, folder)
    read = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    table = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)

    first = stages["toxicity"](spark, table, folder)
    model = toxicity.fit(table, spark.read.parquet(f"{folder}/labels.parquet"))
    measure = toxicity.Distance(*model["dictionaries"])
    import numpy as np

    scores = {d: float(model["trees"].probability(np.array([toxicity.evidence(t, measure)]))[0]) for d, t in docs.items()}
    want = {d: t for d, t in docs.items() if scores[d] < toxicity.THRESHOLD}
    assert read(first) == want and first.columns == table.columns and len(want) < len(docs)
    assert not any(re.search("|".join(BAD), t or "") for t in want.values())

    second = stages["line dedup"](spark, first, folder)
    want = plain_lines(want)
    assert read(second) == want and second.columns == table.columns
    assert second.where("n_chars <> length(text)").count() == 0

    third = stages["near-duplicates"](spark, second, folder)
    groups = brute_groups([*want.items(), *((d, docs[d]) for d, t in want.items() if len(t or "") < len(docs[d] or ""))], 5, 80)  # as they are and as they were
    want = {d: t for d, t in want.items() if groups[d] == d}
    assert read(third) == want and third.columns == table.columns

    fourth = stages["decontamination"](spark, third, folder)
    plain = lambda t: " ".join((t or "").lower().split())
    want = {d: t for d, t in want.items() if not any(plain(i) in plain(t) for i in items)}
    assert read(fourth) == want and fourth.columns == table.columns

    import tiktoken

    reference = tiktoken.Encoding("own", pat_str=TOKENIZER.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    last = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(last) == set(want)
    for d, t in want.items():
        ids = reference.encode_ordinary(t or "")
        assert last[d]["n_tokens"] == len(ids) and last[d]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert last[d]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_copies_that_lost_few_lines_are_still_copies(spark, tmp_path):
    """A copy with two of ten lines repeated and a word changed in each other loses under a fifth, yet too much to be similar as it is then."""
    import numpy as np

    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(900)]
    lines = [[str(w) for w in rng.choice(words, 60 if k < 8 else 56)] for k in range(10)]
    copy = [["otherword" + str(k), *x[1:]] if k < 8 else x for k, x in enumerate(lines)]
    texts = ["\n".join(" ".join(x) for x in t) for t in (lines, copy)]
    texts.append(" ".join(str(w) for w in rng.choice(words, 200)))
    folder = f"file://{tmp_path}"
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    cut = corpus_pipeline.drop_repeated_lines(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    left = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert 0.8 * len(texts[1]) < len(left[1]) < len(texts[1])
    assert brute_groups(list(left.items()), 5, 80)[1] == 1 and brute_groups(list(enumerate(texts)), 5, 80)[1] == 0
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, cut, folder).collect()} == {0, 2}


def test_empty_tables(spark, tmp_path):
    folder = f"file://{tmp_path}"
    fixture(spark, folder)
    empty = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, folder)
        assert out.count() == 0 and (name == "encoding" or out.columns == empty.columns)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_on_the_tables(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    ids = {r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id")).collect()}
    found = {r["doc_id"] for r in out.collect()}
    assert found < ids and len(found) > 0.6 * len(ids)
