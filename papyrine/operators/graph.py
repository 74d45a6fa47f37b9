"""Edge tables: pairs within groups, undirected normalisation, provenance, range joins, components, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.sources.shared import drop_stored, stored, stored_by


def canonical(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """G1: each edge with its lesser end first; other columns stay."""
    return edges.withColumns({a: F.least(a, b), b: F.greatest(a, b)})


def distinct_undirected(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """A4: distinct unordered pairs (an empty table gives none)."""
    return canonical(edges.select(a, b), a, b).distinct()


def count_undirected(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """A5: one row, unique_pairs."""
    return edges.agg(F.count_distinct(F.least(a, b), F.greatest(a, b)).alias("unique_pairs"))


def endpoints(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """Distinct ends; Q11: only ends, never the source list of an edge."""
    return edges.select(F.explode(F.array(a, b)).alias("node")).distinct()


def least_labelled(edges: DataFrame, label: str = "rel", a: str = "src", b: str = "dst") -> DataFrame:
    """A3: of each unordered pair the row of least label, in its own orientation; ties by orientation."""
    pick = F.min(F.struct(label, a, b)).alias("row")
    return edges.groupBy(F.least(a, b).alias("_x"), F.greatest(a, b).alias("_y")).agg(pick).select(f"row.{a}", f"row.{b}", f"row.{label}")


def with_sources(edges: DataFrame, source: str = "source", a: str = "src", b: str = "dst") -> DataFrame:
    """A2: each unordered pair with its sorted distinct sources."""
    return canonical(edges, a, b).groupBy(a, b).agg(F.sort_array(F.collect_set(source)).alias("sources"))


def pairs_within(mentions: DataFrame, group: str, member: str, *carried: str, dealt: bool = False) -> DataFrame:
    """Unordered pairs of distinct members of each group (Q10: lesser first), with columns that depend on the group alone.

    One exchange by group serves the removal of repeats and both sides of the self-join. A group of n members gives n (n - 1) / 2 rows by definition.
    None is needed where mentions are `dealt` by group.
    """
    rows = mentions.select(group, member, *carried)
    once = (rows if dealt else rows.repartition(group)).distinct()
    one = once.withColumnRenamed(member, "src")
    two = once.select(group, F.col(member).alias("dst"))
    return one.join(two, group).where(F.col("src") < F.col("dst"))


def distinct_pairs_within(mentions: DataFrame, group: str, member: str) -> DataFrame:
    """The distinct pairs (src, dst) of pairs_within. Only pairs whose ends both are in several groups can repeat, so only these are shuffled."""
    once = mentions.select(group, member).where(F.col(group).isNotNull() & F.col(member).isNotNull()).distinct()
    known = once.withColumn("_n", F.count("*").over(Window.partitionBy(member)))
    two = known.select(group, F.col(member).alias("dst"), F.col("_n").alias("_m"))
    met = known.withColumnRenamed(member, "src").join(two, group).where(F.col("src") < F.col("dst"))
    several = (F.col("_n") > 1) & (F.col("_m") > 1)
    return met.where(~several).select("src", "dst").unionByName(met.where(several).select("src", "dst").distinct())


def bipartite_pairs(left: DataFrame, right: DataFrame, group: str) -> DataFrame:
    """Pairs of left and right members of the same group (Q9: joined on the group, never by position)."""
    return left.join(right, group)


def range_join(left: DataFrame, right: DataFrame, key: str, within: int) -> DataFrame:
    """Rows a, b of equal key with b.start < a.end + within and b.end > a.start - within.

    left: (key, a, a_start, a_end); right: (key, b, b_start, b_end). Both sides are dealt to bins as wide as the window or as most intervals, whichever
    is more, so the join is an equi-join on key and bin, few bins hold an interval, and a long key isn't one nested loop; a pair counts in the first
    bin that both sides share.
    """
    lengths = left.select((F.col("a_end") - F.col("a_start")).alias("n")).unionByName(right.select((F.col("b_end") - F.col("b_start")).alias("n")))
    common = F.broadcast(lengths.agg(F.greatest(F.coalesce(F.percentile_approx("n", 0.95).cast("bigint"), F.lit(1)), F.lit(max(1, within)).cast("bigint")).alias("_width")))
    left, right, width = left.join(common), right.join(common), F.col("_width")
    first_a, last_a = F.floor((F.col("a_start") - within) / width), F.floor((F.col("a_end") + within) / width)
    first_b, last_b = F.floor(F.col("b_start") / width), F.floor(F.col("b_end") / width)
    a = left.withColumn("_first_a", first_a).withColumn("_bin", F.explode(F.sequence(first_a, last_a))).drop("_width")
    b = right.withColumn("_first_b", first_b).withColumn("_bin", F.explode(F.sequence(first_b, last_b))).drop("_width")
    touch = (F.col("b_start") < F.col("a_end") + within) & (F.col("b_end") > F.col("a_start") - within)
    once = F.col("_bin") == F.greatest("_first_a", "_first_b")
    return a.join(b, [key, "_bin"]).where(touch & once).drop("_bin", "_first_a", "_first_b")


def split_ends(edges: DataFrame, a: str = "src", b: str = "dst", by: str = ";") -> DataFrame:
    """The product of the trimmed parts of both ends; edges with a null end give none."""
    part = lambda c: F.explode(F.transform(F.split(c, by), lambda x: F.trim(x)))
    known = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return known.withColumn(a, part(a)).withColumn(b, part(b))


def dense_index(nodes: DataFrame, by: str = "node", name: str = "idx") -> DataFrame:
    """Position of each distinct value in sorted order, from 0.

    Values are range-partitioned and numbered inside partitions; only one row a partition is summed up for the offsets, so no task sees all rows.
    """
    ranged = stored(nodes.select(by).distinct().repartitionByRange(F.col(by)).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    local = ranged.withColumn("_row", F.row_number().over(Window.partitionBy("_part").orderBy(by)))
    return local.join(F.broadcast(offsets.select("_part", "_offset")), "_part").select(by, (F.col("_offset") + F.col("_row") - 1).cast("bigint").alias(name))


def mean_neighbours(edges: DataFrame, vectors: DataFrame, node: str = "node", vec: str = "vec") -> DataFrame:
    """(node, i, value): the mean of each component over a node's neighbours, edges taken both ways; aggregated by component, map-side first."""
    both = edges.select(F.col("src").alias(node), F.col("dst").alias("_other")).unionByName(edges.select(F.col("dst").alias(node), F.col("src").alias("_other"))).distinct()
    parts = vectors.select(F.col(node).alias("_other"), F.posexplode(vec).alias("i", "x"))
    return both.join(parts, "_other").groupBy(node, "i").agg(F.avg(F.col("x").cast("double")).alias("value"))


def prune_components(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """The edges of components that hold at least one node of keep (node)."""
    linked = components(edges, "src", "dst")
    wanted = linked.join(keep.select("node").distinct(), "node", "left_semi").select("component").distinct()
    return edges.join(linked.withColumnRenamed("node", "src").join(wanted, "component", "left_semi").select("src"), "src", "left_semi")


#: Rows of one task, whatever the size of the graph: what a task sorts doesn't grow.
ROWS_A_TASK = 200_000


def both_ways(edges: DataFrame) -> DataFrame:
    """(src, dst): each edge once from either end; loops and edges with a null end go. Only pairs are shuffled to be made distinct, not both directions."""
    once = distinct_undirected(edges.where("src <> dst"))
    return once.unionByName(once.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def random_walks(edges: DataFrame, steps: int, seed: int = 42) -> DataFrame:
    """(start, walk): one walk of `steps` steps from each node, each step one join; the neighbour is picked by the hash of walk and step.

    Neighbours are numbered by hash order, and each walk looks up one number: no adjacency list is gathered. A numbered neighbour brings its own number of
    neighbours along, so that the next number is known. Rows are dealt to tasks of ROWS_A_TASK by node and number.
    """
    both = stored(both_ways(edges))
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, -(-both.count() // ROWS_A_TASK))
    numbered = stored(both.repartition(parts, "src").withColumn("k", F.row_number().over(Window.partitionBy("src").orderBy(F.xxhash64("dst"), "dst")) - 1))
    degrees = stored(numbered.groupBy("src").agg(F.count("*").alias("n")))
    ends = degrees.select(F.col("src").alias("dst"), F.col("n").alias("_n")).repartition(parts, "dst")
    known = stored(numbered.repartition(parts, "dst").join(ends, "dst").select(F.col("src").alias("at"), "k", "dst", "_n"))
    drop_stored(both)
    drop_stored(numbered)
    walks = degrees.select(F.col("src").alias("start"), F.col("src").alias("at"), "n", F.array("src").alias("walk"))
    for step in range(steps):
        pick = F.pmod(F.xxhash64("start", F.lit(seed), F.lit(step)), F.col("n")).cast("int")
        asked = walks.select("start", "at", "walk", pick.alias("k")).repartition(parts, "at", "k")
        met = asked.join(known.repartition(parts, "at", "k"), ["at", "k"])
        walks = met.select("start", F.col("dst").alias("at"), F.col("_n").alias("n"), F.concat("walk", F.array("dst")).alias("walk"))
    return walks.select("start", "walk")


def placed_neighbours(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(src, first, n) and (place, dst): each node's neighbours, edges taken both ways, lie at n places from `first` on.

    Directed edges are dealt by ranges of both ends and numbered within them, with offsets from one row a range: a hub's neighbours are many tasks' work.
    """
    ranged = both_ways(edges).repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").withColumn("_id", F.monotonically_increasing_id())
    ranged = stored(ranged)  # _id: the range in the upper bits, the row within it in the lower 33
    placed = ranged.select("src", "dst", F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    placed = placed.join(F.broadcast(stored(offsets)), "_part").select("src", "dst", (F.col("_offset") + F.col("_row")).cast("bigint").alias("place"))
    return placed.groupBy("src").agg(F.min("place").alias("first"), F.count("*").alias("n")), placed


def biased_walks(edges: DataFrame, steps: int, back: float = 1.0, away: float = 1.0, per_node: int = 1, seed: int = 42, tries: int = 16) -> DataFrame:
    """(start, number, walk): `per_node` second-order walks of `steps` steps from each node; edges count both ways and once, loops not at all.

    From `at`, reached from `before`, a neighbour weighs 1 / back if it is `before`, 1 if it is a neighbour of `before`, and 1 / away otherwise. Neighbours
    are drawn evenly by the hash of walk, step and try, by place; a join tells whether they neighbour `before`; they are taken with their weight over the
    largest one. Walks that took none of `tries` draw again, so the distribution is exact, and no list of neighbours is ever gathered. A walk from a node
    always can go on, as it can go back. An empty table gives no walks.

    Edges are dealt by place and by both ends once and kept so; a round shuffles walks only. Tries after one that any weight takes aren't drawn; the walks
    are the same for any number of tries a round.
    """
    degrees, placed = placed_neighbours(edges)
    degrees = stored(degrees)
    session = edges.sparkSession
    parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism, -(-placed.count() // (5 * ROWS_A_TASK)))
    at_place = stored_by(placed.select(F.col("place").alias("_place"), F.col("dst").alias("_next")), parts, "_place")
    known = stored_by(placed.select(F.col("src").alias("before"), F.col("dst").alias("_next")), parts, "before", "_next").withColumn("_near", F.lit(True))
    chance = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 40)) / F.lit(float(1 << 40))
    most, least = max(1.0, 1 / back, 1 / away), min(1.0, 1 / back, 1 / away)
    weight = F.when(F.col("before").isNull(), most).when(F.col("_next") == F.col("before"), 1 / back).when(F.col("_near"), 1.0).otherwise(1 / away)
    number = F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("number")
    walks = degrees.select(F.col("src").alias("start"), number, F.col("src").alias("at")).withColumns({"before": F.lit(None).cast(placed.schema["src"].dataType), "walk": F.array("at")})
    for step in range(steps):
        waiting, done, tried = walks, None, 0
        luck = lambda t, step=step: chance("start", "number", t, F.lit(step), F.lit(seed + 1)) * most
        surely = lambda t: luck(t) < F.when(F.col("before").isNull(), most).otherwise(least)  # noqa: B023, E731
        while done is None or waiting.limit(1).count():
            last = tried + tries - 1
            until = F.coalesce(F.array_min(F.filter(F.sequence(F.lit(tried), F.lit(last)), surely)), F.lit(last))
            places = waiting.join(degrees.select(F.col("src").alias("at"), "first", "n"), "at").select("start", "number", "before", "first", "n", until.alias("_until"))
            asked = places.select("start", "number", "before", "first", "n", F.explode(F.sequence(F.lit(tried), F.col("_until"))).alias("_try"))
            pick = F.col("first") + F.pmod(F.xxhash64("start", "number", "_try", F.lit(step), F.lit(seed)), F.col("n"))
            drawn = asked.select("start", "number", "before", "_try", pick.alias("_place")).join(at_place, "_place").join(known, ["before", "_next"], "left")
            first = drawn.where(luck("_try") < weight).groupBy("start", "number").agg(F.min_by("_next", "_try").alias("_next"))
            judged = stored(waiting.join(first, ["start", "number"], "left"))
            gone = judged.where("_next IS NOT NULL").select("start", "number", F.col("at").alias("before"), F.col("_next").alias("at"), F.concat("walk", F.array("_next")).alias("walk"))
            done = gone if done is None else done.unionByName(gone)
            waiting = judged.where("_next IS NULL").select("start", "number", "at", "before", "walk")
            tried += tries
        walks = done.select("start", "number", "at", "before", "walk")
    return walks.select("start", "number", "walk")


def edges_known_by(edges: DataFrame, year: Column | int) -> DataFrame:
    """F6 on edges with their first year: the graph of a model year is a filter, not a recomputation."""
    return edges.where(F.col("year") <= year)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component): connected components of an edge table, component being the least node of each.

    Alternating large-star and small-star steps: each is one join-free aggregation plus one equi-join, with map-side combination;
    no adjacency list is ever gathered in one row. Every round is written to the shared folder.
    """
    directed = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    current = stored(directed.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        # large star: each larger neighbour of u is linked to the least of u and its neighbours
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours are linked to the least of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        ends = F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        small = large.join(down, "u").select(F.inline(ends)).where("u <> v").distinct()
        after = stored(small)
        drop_stored(current)
        current = after
        seen = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if (seen["n"], seen["h"]) == state:
            break
        state = (seen["n"], seen["h"])
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
