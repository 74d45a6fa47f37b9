"""Reproducible sampling and splits: rows are ordered by a portable arithmetic hash of their key, never by partition order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.operators.graph import dense_index

_MODULUS = 1_000_003


def hash_of(*keys: Column) -> Column:
    """A hash of integer keys that any SQL engine can compute: for equal distribution, not for secrecy."""
    factors = (2_654_435_761, 40_503, 2_246_822_519)
    return sum((F.pmod(k.cast("bigint"), F.lit(_MODULUS)) * f for k, f in zip(keys, factors, strict=False)), F.lit(0)) % _MODULUS


#: Hexadecimal digits of a digest that make a draw, and the number of draws they can tell apart.
_DIGITS = 13
DRAWS = 16**_DIGITS


def draw(*keys: Column) -> Column:
    """A draw from 0 to DRAWS - 1 for the keys: leading digits of an MD5 digest, so other engines draw alike and neighbouring keys don't correlate."""
    text = F.concat_ws("|", *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _DIGITS), 16, 10).cast("bigint")


def sample(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """N rows without replacement, in hash order."""
    return rows.orderBy(hash_of(*map(F.col, keys)), *keys).limit(n)


def ranked_in(rows: DataFrame, groups: list[str], keys: list[str], name: str = "_rank") -> DataFrame:
    """Place of each row within its group in hash order, from 1."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(hash_of(*map(F.col, keys)), *keys)))


def ordered_index(rows: DataFrame, keys: list[str], name: str = "_row") -> DataFrame:
    """Place of each row in hash order, from 0, numbered partition by partition (no task holds all rows). Keys identify rows."""
    keyed = rows.withColumn("_order", F.struct(hash_of(*map(F.col, keys)).alias("h"), *keys))
    return keyed.join(dense_index(keyed, "_order", name), "_order").drop("_order")


def three_way(rows: DataFrame, keys: list[str], train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Rows with `split`: int(n * train) train, int(n * validation) validation, the rest test."""
    sizes = rows.agg(F.floor(F.count("*") * train).alias("_a"), F.floor(F.count("*") * validation).alias("_b"))
    numbered = ordered_index(rows, keys).join(F.broadcast(sizes))
    split = F.when(F.col("_row") < F.col("_a"), F.lit("train")).when(F.col("_row") < F.col("_a") + F.col("_b"), F.lit("validation")).otherwise(F.lit("test"))
    return numbered.withColumn("split", split).drop("_row", "_a", "_b")


def halves(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with `half`: 0 for the first n // 2 in hash order, else 1."""
    size = rows.agg(F.floor(F.count("*") / 2).alias("_n"))
    return ordered_index(rows, keys).join(F.broadcast(size)).withColumn("half", (F.col("_row") >= F.col("_n")).cast("int")).drop("_row", "_n")


def folds(rows: DataFrame, label: str, keys: list[str], k: int = 5) -> DataFrame:
    """Rows with `fold`, stratified by label: hash order within each label, dealt round robin."""
    return ranked_in(rows, [label], keys).withColumn("fold", ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def balanced(rows: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """As many rows of each label as the rarest has."""
    least = rows.groupBy(label).agg(F.count("*").alias("_n")).agg(F.min("_n").alias("_least"))
    return ranked_in(rows, [label], keys).join(F.broadcast(least)).where(F.col("_rank") <= F.col("_least")).drop("_rank", "_least")


def negative_pairs(left: DataFrame, right: DataFrame, excluded: DataFrame, n: int, rounds: int = 4) -> DataFrame:
    """N pairs (src, dst) of left (src) and right (dst) that aren't excluded (src, dst), without ever forming their product.

    Each src is dealt `per` hashed places of the right side, enough for n pairs and those that are excluded; excluded pairs go by an anti join. A
    place is an index into right, so the candidates are left x per rows. Fewer than n come back only if the places run out.
    """
    sides = left.select("src").distinct(), dense_index(right.select("dst").distinct(), "dst", "_place")
    sizes = sides[0].agg(F.count("*").alias("_left")).join(sides[1].agg(F.count("*").alias("_right"))).join(excluded.agg(F.count("*").alias("_out")))
    there = F.greatest(F.col("_right"), F.lit(1))  # an empty side gives no pairs, but no error either
    per = F.least(there, F.ceil((F.lit(rounds * n) + F.col("_out")) / F.greatest(F.col("_left"), F.lit(1))))
    asked = sides[0].join(F.broadcast(sizes)).withColumn("_draw", F.explode(F.sequence(F.lit(0), per.cast("int") - 1)))
    place = F.pmod(hash_of(F.col("src")) + F.col("_draw") * F.greatest(F.lit(1), F.floor(there / per)).cast("bigint"), there)
    pairs = asked.withColumn("_place", place.cast("bigint")).join(sides[1], "_place").select("src", "dst").distinct()
    return sample(pairs.join(excluded.select("src", "dst").distinct(), ["src", "dst"], "left_anti"), n, "src", "dst")


def negative_draws(left: DataFrame, right: DataFrame, excluded: DataFrame, n: int) -> DataFrame:
    """N draws (draw, src, dst) with replacement from the pairs of left (src) and right (dst); only excluded pairs (src, dst) are rejected, repeats stay.

    Each draw picks a place of either side by its digest, so it is two equi-joins on places and an anti join. Draws are half as many again as the
    share of excluded pairs asks for, and 100; nothing comes back where a side is empty or every pair is excluded. Only three counts reach the driver.
    """
    sides = dense_index(left.select("src").where("src is not null"), "src", "_left"), dense_index(right.select("dst").where("dst is not null"), "dst", "_right")
    out = excluded.select("src", "dst").distinct().join(sides[0].select("src"), "src", "left_semi").join(sides[1].select("dst"), "dst", "left_semi").select("src", "dst")
    a, b, x = sides[0].count(), sides[1].count(), out.count()
    draws = negative_draw_count(n, a, b, x)
    drawn = left.sparkSession.range(draws).withColumnRenamed("id", "draw")
    drawn = drawn.withColumn("_left", F.pmod(draw(F.lit("l"), F.col("draw")), F.lit(max(a, 1)))).withColumn("_right", F.pmod(draw(F.lit("r"), F.col("draw")), F.lit(max(b, 1))))
    pairs = drawn.join(sides[0], "_left").join(sides[1], "_right").select("draw", "src", "dst")
    return pairs.join(out, ["src", "dst"], "left_anti").select("draw", "src", "dst").orderBy("draw").limit(n)


def negative_draw_count(n: int, left: int, right: int, excluded: int) -> int:
    """Draws that negative_draws makes: none where every pair is excluded."""
    free = left * right - excluded
    return -(-3 * n * left * right // (2 * free)) + 100 if free > 0 else 0


def by_source(positives: DataFrame, negatives: DataFrame, keys: list[str]) -> DataFrame:
    """For each source (positives hold an array `sources`) its positives and as many negatives, drawn by source without replacement.

    Draws for a source take a run of the hash-ordered negatives that starts at a place of the source's own, around the end if need be.
    """
    tagged = positives.withColumn("source", F.explode("sources")).drop("sources").withColumn("label", F.lit(1))
    need = tagged.groupBy("source").agg(F.count("*").alias("_need"))
    numbered = ordered_index(negatives, keys)
    total = negatives.agg(F.greatest(F.count("*"), F.lit(1)).alias("_total"))
    runs = need.join(F.broadcast(total)).withColumn("_from", F.pmod(F.ascii("source") * 7919, F.col("_total"))).withColumn("_draw", F.explode(F.sequence(F.lit(0), (F.least("_need", "_total") - 1).cast("int"))))
    drawn = runs.withColumn("_row", F.pmod(F.col("_from") + F.col("_draw"), F.col("_total")).cast("bigint")).join(numbered, "_row")
    columns = [*keys, "source", "label"]
    return tagged.select(*columns).unionByName(drawn.withColumn("label", F.lit(0)).select(*columns))


#: Where the distribution function of Poisson(1) steps.
POISSON = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676)


def bootstrap(rows: DataFrame, replicates: int, seed: int = 42) -> DataFrame:
    """Rows with replicate and weight, Poisson(1) draws from a hash of row and replicate: a bootstrap in one pass.

    rows need a key column `id`; weights of 0 are left out. Rows are dealt by their key first: a small file is one task, its replicates aren't.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    u = draw(F.col("id"), F.col("replicate"), F.lit(seed)) / F.lit(DRAWS)
    weight = sum((F.when(F.col("_u") > s, F.lit(1)).otherwise(F.lit(0)) for s in POISSON), F.lit(0))
    drawn = rows.repartition(parts, "id").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_u", u)
    return drawn.withColumn("weight", weight).where("weight > 0").drop("_u")
