"""Dictionaries of entities: alias maps, mentions, tiling of tokens, consecutive repeats."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import md5
from zlib import crc32

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrine.functions import patterns as P
from papyrine.operators import blocks
from papyrine.sources.shared import stored


def invert_aliases(synonyms: DataFrame) -> DataFrame:
    """(alias, canonical) from (canonical, aliases); an alias of several goes to the least canonical name."""
    return synonyms.select("canonical", F.explode("aliases").alias("alias")).groupBy("alias").agg(F.min("canonical").alias("canonical"))


def merge_symbols(synonyms: DataFrame, symbols: DataFrame) -> DataFrame:
    """Symbols (symbol) that are no alias yet become entries of their own and replace an entry of that name."""
    aliases = synonyms.select(F.explode("aliases").alias("symbol")).distinct()
    new = symbols.select("symbol").distinct().join(aliases, "symbol", "left_anti")
    kept = synonyms.join(new.withColumnRenamed("symbol", "canonical"), "canonical", "left_anti")
    return kept.unionByName(new.select(F.col("symbol").alias("canonical"), F.array("symbol").alias("aliases")))


def synonym_sets(rows: DataFrame, key: str, order: str, *fields: str) -> DataFrame:
    """(canonical, aliases) of each key's last row by `order`: the lower-cased parts of its `|`-separated fields and the key itself."""
    last = rows.groupBy(key).agg(*(F.max_by(f, order).alias(f) for f in fields))
    parts = F.concat(F.array(F.lower(key)), *(F.split(F.lower(F.coalesce(f, F.lit(""))), r"\|") for f in fields))
    return last.select(F.col(key).alias("canonical"), F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != ""))).alias("aliases"))


def unambiguous_names(rows: DataFrame, name: str = "name", symbol: str = "symbol", dropped: tuple[str, ...] = ("novel transcript", "")) -> DataFrame:
    """Name -> symbol for symbols of one name only; names lose symbols and underscores, double spaces close up, case folds."""
    clean = F.lower(F.regexp_replace(F.regexp_replace(name, r"(?U)[^\w\s]|_", ""), "  ", " "))
    pairs = rows.select(clean.alias("name"), F.col(symbol).alias("symbol"))
    single = pairs.groupBy("symbol").agg(F.count("*").alias("n"), F.min("name").alias("name")).where("n = 1")
    return single.where(~F.col("name").isin(*dropped)).select("name", "symbol")


def link_tokens(tokens: DataFrame, aliases: DataFrame, group: str = "doc_id", token: str = "token", *carried: str) -> DataFrame:
    """Distinct (group, canonical) of tokens that are aliases. Tokens are made distinct before the join; the planner picks its kind."""
    mentions = tokens.select(group, F.col(token).alias("alias"), *carried).distinct()
    return mentions.join(aliases, "alias").select(group, "canonical", *carried).distinct()


def groups_with(mentions: DataFrame, group: str, member: str, least: int = 3, dealt: bool = False) -> DataFrame:
    """Distinct mentions of groups with at least `least` distinct members (Q8: the documented default asks for more than two).

    One exchange by group serves the removal of repeats, the count, and a join on the group that follows; none is needed where mentions are `dealt` by it.
    """
    known = mentions.where(F.col(member).isNotNull())  # a null is no member
    once = (known if dealt else known.repartition(group)).distinct()
    by_group = Window.partitionBy(group)
    # the number of distinct members is the last dense rank among the sorted ones: nothing is gathered in a set
    ranked = once.withColumn("_r", F.dense_rank().over(by_group.orderBy(member))).withColumn("_n", F.max("_r").over(by_group))
    return ranked.where(F.col("_n") >= least).drop("_r", "_n")


def remove_tokens(tokens: Column, entities: Column) -> Column:
    """Tokens without entities; repeats and order stay. entities: an array small enough for a literal; else use without_entities."""
    return F.filter(tokens, lambda t: ~F.array_contains(entities, t))


def without_entities(tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """R13 for a dictionary of any size: rows (.., token) without those in entities (token)."""
    return tokens.join(entities.select("token").distinct(), "token", "left_anti")


def drop_repeats(tokens: DataFrame, entities: DataFrame, group: str = "doc_id", position: str = "pos", token: str = "token") -> DataFrame:
    """R12 on candidate tokens: an entity that equals the token before it in its group goes; other words may repeat.

    A dropped token equals its predecessor, so comparing with the unfiltered predecessor is exact.
    """
    known = entities.select(F.col("token").alias(token)).distinct().withColumn("_entity", F.lit(True))
    seen = tokens.withColumn("_before", F.lag(token).over(Window.partitionBy(group).orderBy(position))).join(known, token, "left")
    repeated = (F.col(token) == F.col("_before")) & F.col("_entity").isNotNull()
    return seen.where(~F.coalesce(repeated, F.lit(False))).drop("_before", "_entity")


def tiling(token: str, entities: frozenset[str] | set[str], allow_spaces: bool = False) -> list[str]:
    """Entities that cover the token without gap or overlap, the shortest first wherever several start (Q6), or none."""
    text = token if allow_spaces else token.replace(" ", "")
    out, at = [], 0
    while at < len(text):
        for end in range(at + 1, len(text) + 1):
            if text[at:end] in entities:
                out.append(text[at:end])
                at = end
                break
        else:
            return []
    return out


#: Parts that each prefix is dealt to when entities meet those that begin them.
PREFIX_PARTS = 8
#: Bits of the bitmap over hashed entities: a task is sent this many at most, however large the dictionary is.
ENTITY_BITS = 1 << 23


def prefix_free(entities: DataFrame) -> DataFrame:
    """(token): the distinct entities that no other entity begins. The shortest entity that starts at a place is always one of these.

    Proper prefixes meet entities in an equi-join. A prefix is dealt to PREFIX_PARTS parts by the hash of the longer entity, so that one that begins a
    third of the dictionary isn't one task. Null and empty entities go.
    """
    known = entities.select("token").where("token is not null and token <> ''").distinct()
    longer = known.where(F.length("token") > 1).withColumn("_deal", F.pmod(F.xxhash64("token"), F.lit(PREFIX_PARTS)))
    cuts = longer.select("token", "_deal", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("_n"))
    prefixes = cuts.select("token", "_deal", F.substring("token", F.lit(1), F.col("_n")).alias("_prefix"))
    starts = known.select(F.col("token").alias("_prefix"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PREFIX_PARTS - 1).cast("bigint"))).alias("_deal"))
    return known.join(prefixes.join(starts, ["_prefix", "_deal"]).select("token").distinct(), "token", "left_anti")


def _bits_of(core: DataFrame) -> bytes:
    """A bitmap over the hashes of core (token); always as long, so the driver may hold it."""
    words = core.select((F.crc32(F.col("token").cast("binary")) % ENTITY_BITS).alias("b")).groupBy(F.expr("int(b div 32)").alias("at")).agg(F.expr("bit_or(shiftleft(1L, int(b % 32)))").alias("bits"))
    out = bytearray(ENTITY_BITS // 8)
    for at, bits in words.collect():
        out[4 * at : 4 * at + 4] = bits.to_bytes(4, "little")
    return bytes(out)


def pieces_of(text: str, sizes: list[int], known: Callable[[int], bool]) -> list[str]:
    """The distinct pieces of the given sizes that may be entities and lie on a way from the start of text to its end; none without such a way.

    known: whether an entity may have this crc32 of its UTF-8 bytes. sizes: rising.
    """
    steps: dict[int, list[int]] = {}
    reached = {0}
    for at in range(len(text)):
        if at in reached:
            hashed, last, ends = 0, at, []
            for end in (at + n for n in sizes if at + n <= len(text)):
                hashed, last = crc32(text[last:end].encode(), hashed), end
                if known(hashed):
                    ends.append(end)
            reached.discard(at)
            reached.update(ends)
            steps[at] = ends
    leading, out = {len(text)}, set()
    for at in reversed(steps):
        if ends := [end for end in steps[at] if end in leading]:
            leading.add(at)
            out.update(text[at:end] for end in ends)
    return sorted(out) if 0 in leading else []


def _pieces(sizes: list[int], bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = bits.value
        known = lambda h: held[(b := h % ENTITY_BITS) >> 3] >> (b & 7) & 1 == 1
        for batch in batches:
            found = pa.array([pieces_of(t, sizes, known) for t in batch["text"].to_pylist()], pa.list_(pa.string()))
            out = pa.RecordBatch.from_arrays([batch["key"], batch["text"], found], ["key", "text", "pieces"])
            yield out.filter(pc.greater(pc.list_value_length(found), 0))

    return run


def chained(text: str, known: list[str]) -> list[str]:
    """The tiles from the start of text, all among known, of which none begins another; none if they miss its end."""
    held, sizes = set(known), sorted({len(k) for k in known})
    out, at = [], 0
    while at < len(text):
        if (piece := next((p for n in sizes if (p := text[at : at + n]) in held), None)) is None:
            return []
        out.append(piece)
        at += len(piece)
    return out


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tiles = [chained(t, known) for t, known in zip(batch["text"].to_pylist(), batch["known"].to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["key"], pa.array(tiles, pa.list_(pa.string()))], ["key", "tiles"])


def tiled(tokens: DataFrame, entities: DataFrame, token: str = "token", allow_spaces: bool = False) -> DataFrame:
    """(token, tiles) of the distinct tokens, as `tiling` defines tiles, for a dictionary (token) of any size.

    The dictionary stays a table: no task and not the driver holds it. Tasks hold a bitmap over hashed entities of fixed size; tokens that it leaves no way
    from start to end have no tiles and aren't shuffled, the pieces of the others meet the dictionary in an equi-join. Null tokens are left out; empty
    ones, and all where the dictionary is empty, have no tiles; null and empty entities are ignored. Other columns are dropped.
    """
    text = F.col("token") if allow_spaces else F.replace("token", F.lit(" "), F.lit(""))
    asked = tokens.select(F.col(token).alias("token")).where("token is not null").distinct()
    core = stored(prefix_free(entities))
    sizes = sorted(r[0] for r in core.select(F.length("token").alias("n")).distinct().collect())
    none = F.array().cast("array<string>")
    if not sizes:
        return asked.withColumn("tiles", none)
    bits = core.sparkSession.sparkContext.broadcast(_bits_of(core))
    texts = asked.select(F.md5("token").alias("key"), text.alias("text")).where("text <> ''")
    begun = stored(texts.mapInArrow(_pieces(sizes, bits), "key string, text string, pieces array<string>"))
    true = begun.select(F.explode("pieces").alias("token")).distinct().join(core, "token")
    known = begun.select("key", F.explode("pieces").alias("token")).join(true, "token").groupBy("key").agg(F.collect_list("token").alias("known"))
    found = begun.select("key", "text").join(known, "key").mapInArrow(_chains, "key string, tiles array<string>")
    return asked.withColumn("key", F.md5("token")).join(found, "key", "left").select("token", F.coalesce("tiles", none).alias("tiles"))


def candidates(tiles: Column, token: Column) -> Column:
    """What stands for a token: its one distinct tile once, its tiles in order if several, itself if none."""
    return F.when(F.size(tiles) == 0, F.array(token)).when(F.size(F.array_distinct(tiles)) == 1, F.slice(tiles, 1, 1)).otherwise(tiles)


def main_entities(symbols: DataFrame, others: DataFrame) -> DataFrame:
    """Distinct lower-case tokens of both, without symbols that are ordinary words (whether or not they are there)."""
    low = lambda d: d.select(F.lower("token").alias("token")).where("token is not null").distinct()
    return low(symbols).where(~F.col("token").isin(*P.NOT_ENTITIES)).union(low(others)).distinct()


def without_stopped(pairs: DataFrame, disease: str = "disease") -> DataFrame:
    """rows whose disease isn't on the stop list; rows without a disease stay."""
    return pairs.where(~F.coalesce(F.col(disease).isin(*P.STOPPED_DISEASES), F.lit(False)))


def retiled(tokens: DataFrame, entities: DataFrame, group: str = "doc_id", position: str = "pos") -> DataFrame:
    """(group, position, part, token): what stands for each token, in order, without entities that repeat the token emitted before them.

    Distinct tokens are tiled once and joined back; a repeat is judged among the emitted tokens of its whole group, across token bounds. Null tokens stay.
    """
    stands = tiled(tokens, entities).select("token", candidates(F.col("tiles"), F.col("token")).alias("_parts"))
    parts = F.posexplode(F.coalesce("_parts", F.array("token"))).alias("part", "_token")
    emitted = tokens.join(stands, "token", "left").select(group, position, parts).withColumnRenamed("_token", "token")
    ordered = emitted.withColumn("_at", F.struct(position, "part"))
    return drop_repeats(ordered, entities, group, "_at").select(group, position, "part", "token")


def _retiled_lines(texts: pa.Table, facts: pa.Table) -> pa.Table:
    stands = dict(zip(facts["token"].to_pylist(), facts["parts"].to_pylist(), strict=True))
    keys, sizes, digests = [], [], []
    for key, line in blocks.lines_of(texts):
        out: list[str] = []
        for token in line:
            parts = stands.get(token)
            if parts is None:
                out.append(token)
            else:
                for part in parts:
                    if not out or out[-1] != part:
                        out.append(part)
        keys.append(key)
        sizes.append(len(out))
        digests.append(md5(" ".join(out).encode()).hexdigest())
    return pa.table([pa.array(keys, texts.schema.field("doc_id").type), pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "tokens", "line"])


def retiled_texts(texts: DataFrame, tokens: DataFrame, entities: DataFrame) -> DataFrame:
    """R12 on whole texts (doc_id, text): (doc_id, tokens, line), the number of tokens that `retiled` emits for a text's blank-separated ones and the MD5 of their line.

    tokens (token): those of the texts, once or more. Texts meet only what their own tokens stand for, block by block; a part of a tiling always is an
    entity, so what stands for a token that isn't listed is itself and may repeat.
    """
    known = entities.select("token").where("token is not null").distinct()
    stands = tiled(tokens, entities).where(F.size("tiles") > 0).select("token", candidates(F.col("tiles"), F.col("token")).alias("parts"))
    facts = stored(known.join(stands, "token", "full").select("token", F.coalesce("parts", F.array("token")).alias("parts")))
    pieces = F.transform(F.array_distinct(F.split("text", " ")), lambda t: F.struct(t.alias("token")))
    doc = texts.schema["doc_id"].dataType.simpleString()
    return blocks.with_facts(texts, pieces, facts, ["token"], _retiled_lines, f"doc_id {doc}, tokens bigint, line string")


def link_with(texts: DataFrame, model, schema: str) -> DataFrame:
    """Spans that a user's model finds. model: an iterator of pandas frames to an iterator of frames of `schema` (it can load itself once a task)."""
    return texts.mapInPandas(model, schema)
