"""Corpus queries: cleaning, symbols, tokens, chunks, dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrine.functions import patterns as P
from papyrine.functions import text as X
from papyrine.operators import entities, graph
from papyrine.plans.base import query, table
from papyrine.sources.shared import stored


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Documents with the year of publication that their id stands for."""
    return table(spark, sf_dir, "documents").select("doc_id", *columns, (F.lit(2003) + F.col("doc_id") % 21).cast("int").alias("year"))


_RAW = "r AS (SELECT doc_id, 'Title ' || doc_id AS title, CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 7 = 1 THEN 'x' ELSE text END AS description, (2003 + doc_id % 21) || '-05-01' AS date, source FROM documents)"


def raw_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shape of search results: title, description (null or very short for some), date, journal."""
    d = documents(spark, sf_dir, "text", "source")
    description = F.when(F.col("doc_id") % 7 == 1, F.lit("x")).when(F.col("doc_id") % 7 != 0, F.col("text"))
    return d.select("doc_id", F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("title"), description.alias("description"), F.concat(F.col("year").cast("string"), F.lit("-05-01")).alias("date"), "source")


@query("search_results", f"WITH {_RAW} SELECT doc_id, md5(title || '. ' || description) AS combined FROM r WHERE length(description) > 1 AND year(CAST(date AS DATE)) > 2005 AND year(CAST(date AS DATE)) < 2010")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years strictly between two bounds, descriptions of more than one character."""
    r = raw_articles(spark, sf_dir).withColumn("year", F.year(F.to_date("date")))
    r = r.where((F.col("year") > 2005) & (F.col("year") < 2010) & (F.length("description") > 1))
    return r.select("doc_id", F.md5(F.concat("title", F.lit(". "), "description").cast("binary")).alias("combined"))


@query("compose_abstract", f"WITH {_RAW} SELECT doc_id, md5(title || ' ' || coalesce(description, '')) AS abstract, CAST(year(CAST(date AS DATE)) AS INT) AS year FROM r")
def compose_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3, D2"""
    r = raw_articles(spark, sf_dir)
    return r.select("doc_id", F.md5(F.concat("title", F.lit(" "), F.coalesce("description", F.lit(""))).cast("binary")).alias("abstract"), F.year(F.to_date("date")).alias("year"))


@query("journal_filter", f"WITH {_RAW} SELECT source, count(*) AS articles FROM r WHERE source IN ('src1', 'src4', 'src9', 'src16') GROUP BY source")
def journal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2"""
    return raw_articles(spark, sf_dir).where(F.col("source").isin("src1", "src4", "src9", "src16")).groupBy("source").agg(F.count("*").alias("articles"))


def _with_notices(text, doc_id):
    lead = F.concat(F.lit("© 2004 Some Press. "), text)
    inner = F.concat(F.lit("Copyright of © 2005 by Some House all rights reserved "), text)
    last = F.concat(text, F.lit(". Printed in print © 2011 Another Press"))
    web = F.concat(F.lit("See https://example.org/a1 and <sub>2</sub>. "), text)
    return F.when(doc_id % 5 == 0, lead).when(doc_id % 5 == 1, inner).when(doc_id % 5 == 2, last).when(doc_id % 5 == 3, web).otherwise(text)


def _clean_sql() -> str:
    def sub(t: str, patterns: list[str], flags: str = "g", by: str = "''") -> str:
        for p in patterns:
            t = f"regexp_replace({t}, {quoted(p)}, {by}, '{flags}')"
        return t

    steps = [
        ("a", "x0 AS t", "base"),
        ("b", sub("t", P.DELETED) + " AS t", "a"),
        ("c", sub("t", P.DELETED_ANY_CASE, "gi") + " AS t", "b"),
        (
            "d",
            f"CASE WHEN starts_with(string_split(t, '. ')[1], '©') THEN {sub(sub('t', P.LEADING_NOTICE, 'g', quoted(chr(92) + '4')), [P.NOTICE_TO_STOP])} "
            f"WHEN contains(string_split(t, '. ')[1], '©') THEN {sub(sub('t', P.COPYRIGHT_NOTICE, 'g', quoted(chr(92) + '4')), [P.NOTICE_TO_AUTHORS], 'gi')} ELSE t END AS t",
            "c",
        ),
        ("e", "CASE WHEN len(string_split(t, '. ')) >= 2 AND contains(string_split(t, '. ')[-2], '©') THEN array_to_string(string_split(t, '. ')[:-3], '. ') || '.' ELSE t END AS t", "d"),
        ("f", "CASE WHEN contains(string_split(t, '. ')[-1], '©') THEN array_to_string(string_split(t, '. ')[:-2], '. ') || '.' ELSE t END AS t", "e"),
        ("g", f"regexp_replace({sub('t', P.DELETED_LAST)}, '^\\s+|\\s+$', '', 'g') AS t", "f"),
    ]
    ctes = ", ".join(f"{n} AS MATERIALIZED (SELECT doc_id, {e} FROM {s})" for n, e, s in steps)
    base = """base AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '© 2004 Some Press. ' || text WHEN 1 THEN 'Copyright of © 2005 by Some House all rights reserved ' || text
WHEN 2 THEN text || '. Printed in print © 2011 Another Press' WHEN 3 THEN 'See https://example.org/a1 and <sub>2</sub>. ' || text ELSE text END AS x0 FROM documents)"""
    return f"WITH {base}, {ctes} SELECT doc_id, length(t) AS n, md5(t) AS cleaned FROM g WHERE t <> ''"


@query("clean_abstract", _clean_sql())
def clean_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned abstracts that aren't blank; the year stays available."""
    d = table(spark, sf_dir, "documents").select("doc_id", X.cleaned(_with_notices(F.col("text"), F.col("doc_id"))).alias("t"))
    return d.where("t <> ''").select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5(F.col("t").cast("binary")).alias("cleaned"))


@query("distinct_cleaned", "SELECT count(DISTINCT regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS texts FROM documents")
def distinct_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct texts of a corpus without years."""
    return table(spark, sf_dir, "documents").agg(F.count_distinct(X.strip(F.col("text"))).alias("texts"))


_NAMES = "n AS (SELECT p_partkey, p_name || ' (' || p_brand || '), ' || p_type || '/' || p_size || '-\"x\":y' AS name FROM part)"


@query("normalize_symbols", f"WITH {_NAMES} SELECT p_partkey, translate(name, '-/ (),\":', '___') AS r2, translate(name, '-/(),\":', '  ') AS r3 FROM n")
def normalize_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R2, R3"""
    name = F.concat("p_name", F.lit(" ("), "p_brand", F.lit("), "), "p_type", F.lit("/"), F.col("p_size").cast("string"), F.lit('-"x":y'))
    return table(spark, sf_dir, "part").select("p_partkey", X.symbol_name(name).alias("r2"), X.symbol_phrase(name).alias("r3"))


@query(
    "linked_name",
    """WITH l AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE 'MESH:D' || p_partkey || '/name=' || p_name || '-like, x (' || p_brand || ')' END AS label FROM part)
SELECT p_partkey, CASE WHEN contains(label, '/name=') THEN translate(string_split(string_split(label, '/name=')[2], ' (')[1], '-/ (),":', '___') ELSE label END AS name FROM l""",
)
def linked_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R4, R24"""
    label = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.concat(F.lit("MESH:D"), F.col("p_partkey").cast("string"), F.lit("/name="), "p_name", F.lit("-like, x ("), "p_brand", F.lit(")")))
    return table(spark, sf_dir, "part").select("p_partkey", X.linked_name_or_self(label).alias("name"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, pos, token): blank-separated words."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "token"))


_TOKENS = "t AS (SELECT doc_id, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos, unnest(string_split(text, ' ')) AS token FROM documents)"


def _rule_sql() -> str:
    extra = X._EXTRA
    t = "regexp_replace(token, '[-/‐−]', ' ', 'g')"
    t = f"regexp_replace({t}, '([\\p{{L}}\\p{{N}}_]),([\\p{{L}}\\p{{N}}_])', '\\1 \\2', 'g')"
    t = f"regexp_replace({t}, '([\\p{{L}}\\p{{N}}_]),\\s+([\\p{{L}}\\p{{N}}_])', '\\1 \\2', 'g')"
    t = f"regexp_replace({t}, {quoted(extra)}, '', 'g')"
    t = f"regexp_replace(regexp_replace({t}, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
    drop = ", ".join(map(quoted, P.SYMBOLS))
    return f"""WITH {_TOKENS}, d AS (SELECT DISTINCT lower(token) AS token FROM t), r AS (SELECT token, {t} AS x FROM d)
SELECT token, CASE WHEN x IN ({drop}) THEN NULL WHEN regexp_matches(x, '[a-zA-Z]') THEN x WHEN regexp_matches(x, '[0-9]') THEN '<nUm>' END AS ruled FROM r"""


@query("token_rules_w2v", _rule_sql())
def token_rules_w2v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R6 on distinct tokens"""
    distinct = tokens(spark, sf_dir).select(F.lower("token").alias("token")).distinct()
    return distinct.select("token", X.symbol_rule(F.col("token")).alias("ruled"))


@query(
    "token_rules_finetune",
    f"WITH {_TOKENS}, d AS (SELECT token, count(*) AS n FROM t GROUP BY token) SELECT token, n FROM d WHERE token NOT IN ({', '.join(map(quoted, P.SYMBOLS_FINE))}) AND (token IN ('.', ',') OR regexp_matches(token, '[a-zA-Z0-9]'))",
)
def token_rules_finetune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept tokens and their counts"""
    counted = tokens(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n"))
    return counted.where(X.fine_rule(F.col("token")).isNotNull())


@query("sentence_tokens")
def sentence_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences, tokens and tokens left by the rules, by document. Java's look-behind splits sentences, so there is no SQL twin."""
    s = table(spark, sf_dir, "documents").select("doc_id", X.sentences(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").alias("sentences"), F.size(F.flatten("s")).alias("tokens"), F.size(F.flatten(X.ruled_sentences(F.col("s")))).alias("ruled"))


@query("sentences_by_stop", "SELECT doc_id, len(string_split(text, '. ')) AS sentences, length(string_split(text, '. ')[1]) AS first_length FROM documents")
def sentences_by_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("text", r"\. ")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(parts).cast("bigint").alias("sentences"), F.length(F.element_at(parts, 1)).cast("bigint").alias("first_length"))


#: Entities: words of even length among those that documents repeat.
_ENTITIES = "en AS (SELECT token FROM t GROUP BY token HAVING count(*) > 20 AND length(token) % 2 = 0)"


def repeated(counts: DataFrame) -> DataFrame:
    return counts.where((F.col("n") > 20) & (F.length("token") % 2 == 0)).select("token")


def repeated_entities(found: DataFrame) -> DataFrame:
    return repeated(found.groupBy("token").agg(F.count("*").alias("n")))


@query(
    "dedupe_consecutive",
    f"""WITH {_TOKENS}, {_ENTITIES}, w AS (SELECT *, lag(token) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM t)
SELECT doc_id, count(*) AS tokens, CAST(sum(pos) AS BIGINT) AS places FROM w WHERE NOT (before IS NOT NULL AND token = before AND token IN (SELECT token FROM en)) GROUP BY doc_id""",
)
def dedupe_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last step of R12 (retiled_documents has both)."""
    found = tokens(spark, sf_dir)
    kept = entities.drop_repeats(found, repeated_entities(found))
    return kept.groupBy("doc_id").agg(F.count("*").alias("tokens"), F.sum("pos").alias("places"))


#: The shortest entity at each place of each token, and the chain of those from its start.
_TILES = f"""{_TOKENS}, {_ENTITIES}, s AS (SELECT token FROM en WHERE length(token) >= 2), k AS (SELECT DISTINCT length(token) AS n FROM s), u AS (SELECT DISTINCT token FROM t),
z AS (SELECT token, unnest(range(length(token))) AS place FROM u), nx AS (SELECT z.token AS token, place, min(n) AS n FROM z, k WHERE substr(z.token, place + 1, n) IN (SELECT token FROM s) AND place + n <= length(z.token) GROUP BY ALL),
c AS (SELECT token, 0 AS place, CAST([] AS VARCHAR[]) AS tiles FROM u UNION ALL SELECT c.token, c.place + nx.n, list_append(tiles, substr(c.token, c.place + 1, nx.n)) FROM c JOIN nx ON nx.token = c.token AND nx.place = c.place),
f AS (SELECT u.token AS token, coalesce(c.tiles, []) AS tiles FROM u LEFT JOIN c ON c.token = u.token AND c.place = length(u.token)),
st AS (SELECT token, tiles, CASE WHEN len(tiles) = 0 THEN [token] WHEN len(list_distinct(tiles)) = 1 THEN tiles[1:1] ELSE tiles END AS parts FROM f)"""


@query("exact_tiling", f"WITH RECURSIVE {_TILES} SELECT token, CAST(len(tiles) AS INT) AS n_tiles, array_to_string(parts, '|') AS candidates FROM st")
def exact_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens tiled by short frequent words, with what stands for each."""
    counts = stored(tokens(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n")))
    tiled = entities.tiled(counts, repeated(counts).where(F.length("token") >= 2))
    return tiled.select("token", F.size("tiles").alias("n_tiles"), F.array_join(entities.candidates(F.col("tiles"), F.col("token")), "|").alias("candidates"))


@query(
    "retiled_documents",
    f"""WITH RECURSIVE {_TILES}, x AS (SELECT doc_id, pos, generate_subscripts(parts, 1) AS part, unnest(parts) AS token FROM t JOIN st USING (token)),
w AS (SELECT *, lag(token) OVER (PARTITION BY doc_id ORDER BY pos, part) AS before FROM x)
SELECT doc_id, count(*) AS tokens, md5(string_agg(token, ' ' ORDER BY pos, part)) AS line FROM w WHERE NOT (before IS NOT NULL AND token = before AND token IN (SELECT token FROM s)) GROUP BY doc_id""",
)
def retiled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens tiled, then entities that repeat what was emitted before them dropped, by document."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = stored(tokens(spark, sf_dir).groupBy("token").agg(F.count("*").alias("n")))
    return entities.retiled_texts(texts, counts, repeated(counts).where(F.length("token") >= 2))


@query("remove_entities", f"WITH {_TOKENS}, {_ENTITIES} SELECT doc_id, md5(string_agg(token, ' ' ORDER BY pos)) AS rest FROM t WHERE token NOT IN (SELECT token FROM en) GROUP BY doc_id")
def remove_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order and the repeats of other tokens stay."""
    found = tokens(spark, sf_dir)
    rest = entities.without_entities(found, repeated_entities(found))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"])
    return rest.groupBy("doc_id").agg(F.md5(F.array_join(ordered, " ").cast("binary")).alias("rest"))


@query(
    "temporal_lines",
    """WITH s AS (SELECT 2003 + doc_id % 21 AS year, unnest(string_split(text, '. ')) AS line FROM documents), y AS (SELECT year, count(*) AS n, sum(length(line)) AS c FROM s GROUP BY year)
SELECT CAST(year AS INT) AS year, CAST(sum(n) OVER (ORDER BY year) AS BIGINT) AS lines, CAST(sum(c) OVER (ORDER BY year) AS BIGINT) AS chars FROM y""",
)
def temporal_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K3: sizes of the line corpora of all years; each is a prefix by year of one table."""
    lines = documents(spark, sf_dir, "text").select("year", F.explode(F.split("text", r"\. ")).alias("line"))
    by_year = lines.groupBy("year").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("c"))
    so_far = Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return by_year.select("year", F.sum("n").over(so_far).alias("lines"), F.sum("c").over(so_far).alias("chars"))


@query(
    "detokenize",
    r"""SELECT doc_id, md5(regexp_replace(text, '([.,])([^ .,])', ' \1\2', 'g')) AS line FROM documents""",
)
def detokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4; the twin says it the other way round: a space comes only before a point or comma that begins a longer token."""
    split = F.split(F.regexp_replace("text", "([.,])", " $1"), " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.detokenised(split).cast("binary")).alias("line"))


_WORDS = "w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents)"


@query(
    "chunk_tokens",
    f"""WITH {_WORDS}, c AS (SELECT doc_id, CASE WHEN len(ws) <= 512 THEN 1 ELSE CAST(ceil(len(ws) / 400) AS INT) END AS n, ws FROM w),
p AS (SELECT doc_id, n, ws, unnest(range(n)) AS piece FROM c)
SELECT doc_id, CAST(piece AS INT) AS piece, CASE WHEN n = 1 THEN len(ws) ELSE len(ws[piece * 400 + 1:piece * 400 + 400]) END AS words,
CASE WHEN n > 1 THEN md5(array_to_string(ws[piece * 400 + 1:piece * 400 + 400], ' ')) END AS digest FROM p""",
)
def chunk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of long texts in order."""
    pieces = table(spark, sf_dir, "documents").select("doc_id", X.chunks(F.col("text")).alias("c"))
    out = pieces.select("doc_id", F.size("c").alias("n"), F.posexplode("c").alias("piece", "t"))
    return out.select("doc_id", "piece", F.size(X.words(F.col("t"))).cast("bigint").alias("words"), F.when(F.col("n") > 1, F.md5(F.col("t").cast("binary"))).alias("digest"))


@query(
    "rebuild_chunks",
    f"WITH {_WORDS} SELECT doc_id, md5(array_to_string(ws, ' ')) AS rebuilt FROM w WHERE len(ws) > 512",
)
def rebuild_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces put together again in order."""
    pieces = table(spark, sf_dir, "documents").where(F.size(X.words(F.col("text"))) > 512).select("doc_id", F.posexplode(X.chunks(F.col("text"))).alias("piece", "t"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("piece", "t"))), lambda x: x["t"])
    return pieces.groupBy("doc_id").agg(F.md5(F.array_join(ordered, " ").cast("binary")).alias("rebuilt"))


@query("chunk_corpus", "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, CAST(ceil(count(*) OVER () / 20) AS BIGINT) AS size FROM documents) SELECT doc_id, CAST(r // size AS INT) AS part FROM n")
def chunk_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous parts of equal size, the last shorter."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    size = d.agg(F.ceil(F.count("*") / 20).cast("bigint").alias("size"))
    indexed = graph.dense_index(d, "doc_id", "r")
    return indexed.join(F.broadcast(size)).select("doc_id", F.floor(F.col("r") / F.col("size")).cast("int").alias("part"))


_TERMS = ["the", "and", "der", "que", "les", "thing"]


@query(
    "term_filter",
    f"WITH {_WORDS} SELECT doc_id FROM w WHERE len(list_intersect(list_distinct(ws), {_TERMS})) >= 2 AND len(list_intersect(ws, ['la', 'und'])) = 0",
)
def term_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8, Q5"""
    return table(spark, sf_dir, "documents").where(X.has_terms(F.col("text"), _TERMS, 2, ["la", "und"])).select("doc_id")


_SYN = "syn AS (SELECT p_brand AS canonical, list_distinct(list(p_type || '_' || (p_partkey % 5))) AS aliases FROM part GROUP BY p_brand)"


def synonym_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    alias = F.concat("p_type", F.lit("_"), (F.col("p_partkey") % 5).cast("string"))
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("canonical")).agg(F.collect_set(alias).alias("aliases"))


@query(
    "alias_merge",
    f"""WITH {_SYN}, a AS (SELECT DISTINCT unnest(aliases) AS alias FROM syn), sym AS (SELECT DISTINCT p_brand AS symbol FROM part WHERE p_partkey % 3 = 0 UNION SELECT 'ECONOMY_1' UNION SELECT 'new'),
n AS (SELECT symbol FROM sym WHERE symbol NOT IN (SELECT alias FROM a)),
m AS (SELECT canonical, unnest(aliases) AS alias FROM syn WHERE canonical NOT IN (SELECT symbol FROM n) UNION ALL SELECT symbol, symbol FROM n) SELECT alias, min(canonical) AS canonical FROM m GROUP BY alias""",
)
def alias_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U5, U6"""
    own = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_brand").alias("symbol"))
    symbols = own.union(spark.createDataFrame([("ECONOMY_1",), ("new",)], "symbol string"))
    return entities.invert_aliases(entities.merge_symbols(synonym_table(spark, sf_dir), symbols))


@query(
    "synonym_dict",
    """WITH r AS (SELECT p_brand AS k, arg_max(p_type || '|' || p_name, p_partkey) AS a, arg_max(p_name, p_partkey) AS b FROM part GROUP BY p_brand)
SELECT k AS canonical, array_to_string(list_sort(list_distinct(list_concat([lower(k)], string_split(lower(a), '|'), string_split(lower(b), '|')))), ',') AS aliases FROM r""",
)
def synonym_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last row of a key wins."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat_ws("|", "p_type", "p_name").alias("a"), F.col("p_name").alias("b"))
    return entities.synonym_sets(rows, "p_brand", "p_partkey", "a", "b").withColumn("aliases", F.array_join("aliases", ","))


@query(
    "name_symbol_dict",
    """WITH r AS (SELECT lower(replace(regexp_replace(p_name || ' - (' || (p_partkey % 40) || ')', '[^\\p{L}\\p{N}\\s]|_', '', 'g'), '  ', ' ')) AS name, p_brand || (p_partkey % 900) AS symbol FROM part)
SELECT min(name) AS name, symbol FROM r GROUP BY symbol HAVING count(*) = 1 AND min(name) NOT IN ('novel transcript', '')""",
)
def name_symbol_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R20, A8"""
    rows = table(spark, sf_dir, "part").select(F.concat("p_name", F.lit(" - ("), (F.col("p_partkey") % 40).cast("string"), F.lit(")")).alias("name"), F.concat("p_brand", (F.col("p_partkey") % 900).cast("string")).alias("symbol"))
    return entities.unambiguous_names(rows)


@query("average_length", "SELECT lang, round(coalesce(avg(length(text)), 0), 6) AS avg_len FROM documents GROUP BY lang")
def average_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R21"""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.round(F.coalesce(F.avg(F.length("text")), F.lit(0.0)), 6).alias("avg_len"))


@query("numeric_entries", f"WITH {_TOKENS}, d AS (SELECT DISTINCT token FROM t) SELECT count(*) AS entries, CAST(sum(CASE WHEN regexp_matches(trim(token), '{X.NUMBER}') THEN 1 ELSE 0 END) AS BIGINT) AS numeric FROM d")
def numeric_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F10"""
    d = tokens(spark, sf_dir).select("token").distinct()
    return d.agg(F.count("*").alias("entries"), F.sum(X.is_number(F.col("token")).cast("bigint")).alias("numeric"))


@query("span_replacement", "SELECT doc_id, md5('<a>' || text[4:6] || '<bb>' || text[9:]) AS replaced FROM documents WHERE length(text) > 10")
def span_replacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spans of each text, given out of order."""
    span = lambda a, b, v: F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(v).alias("value"))
    spans = F.array(span(0, 3, "<a>"), span(6, 8, "<bb>"))
    d = table(spark, sf_dir, "documents").where(F.length("text") > 10)
    return d.select("doc_id", F.md5(X.replaced_spans(F.col("text"), spans).cast("binary")).alias("replaced"))


@query("valid_utf8", "SELECT doc_id, md5(text || 'z') AS valid FROM documents")
def valid_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that aren't UTF-8 go."""
    raw = F.concat(F.col("text").cast("binary"), F.unhex(F.lit("FF")), F.lit("z").cast("binary")).cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(X.valid_utf8(raw).cast("binary")).alias("valid"))


@query(
    "publication_years",
    """WITH p AS (SELECT o_orderkey AS pmid, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS VARCHAR) END AS y, CASE WHEN o_orderkey % 10 = 0 THEN 'Winter' ELSE year(o_orderdate) || ' Jan-Feb' END AS m FROM orders WHERE o_orderkey % 3 <> 0),
q AS (SELECT DISTINCT l_orderkey AS pmid FROM lineitem)
SELECT q.pmid AS pmid, coalesce(y, nullif(regexp_extract(m, '\\b(19|20)\\d{2}\\b', 0), ''), 'N/A') AS year FROM q LEFT JOIN p USING (pmid)""",
)
def publication_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known year, else the year in a free date, else N/A; ids without a record get N/A."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0")
    y = F.year("o_orderdate").cast("string")
    p = o.select(F.col("o_orderkey").alias("pmid"), F.when(F.col("o_orderkey") % 5 != 0, y).alias("y"), F.when(F.col("o_orderkey") % 10 == 0, F.lit("Winter")).otherwise(F.concat(y, F.lit(" Jan-Feb"))).alias("m"))
    q = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pmid")).distinct()
    return q.join(p, "pmid", "left").select("pmid", X.year_of(F.col("m"), F.col("y")).alias("year"))


@query("symbol_replacements", "SELECT p_partkey, coalesce(r, b) AS symbol FROM (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'CAT' WHEN 1 THEN 'WAS' ELSE p_brand END AS b FROM part) LEFT JOIN (VALUES ('CAT', 'catgene'), ('WAS', 'wasgene')) v(s, r) ON b = s")
def symbol_replacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that are words get a replacement."""
    replaced = spark.createDataFrame(sorted(P.AMBIGUOUS_SYMBOLS.items()), "b string, r string")
    b = F.when(F.col("p_size") % 4 == 0, F.lit("CAT")).when(F.col("p_size") % 4 == 1, F.lit("WAS")).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", b.alias("b")).join(replaced, "b", "left").select("p_partkey", F.coalesce("r", "b").alias("symbol"))


@query("vocabulary_matches", f"WITH {_TOKENS} SELECT token, count(*) AS n FROM t WHERE contains(token, 'tion') GROUP BY token ORDER BY n DESC, token LIMIT 20")
def vocabulary_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that contain a part, best first (a top-k report)."""
    found = tokens(spark, sf_dir).where(F.col("token").contains("tion"))
    return found.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "token").limit(20)


@query("context_windows", f"WITH {_TOKENS}, {_ENTITIES}, p AS (SELECT doc_id, min(pos) AS spot FROM t WHERE token IN (SELECT token FROM en) GROUP BY doc_id) SELECT t.doc_id AS doc_id, count(*) AS words, CAST(min(pos) AS INT) AS first FROM t JOIN p ON t.doc_id = p.doc_id AND pos BETWEEN spot - 64 AND spot + 64 GROUP BY t.doc_id")
def context_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 tokens on either side of each text's first entity."""
    found = tokens(spark, sf_dir)
    at = found.join(repeated_entities(found), "token", "left_semi").groupBy("doc_id").agg(F.min("pos").alias("at"))
    near = found.join(at, "doc_id").where((F.col("pos") >= F.col("at") - 64) & (F.col("pos") <= F.col("at") + 64))
    return near.groupBy("doc_id").agg(F.count("*").alias("words"), F.min("pos").alias("first"))


@query("relevant_documents", "SELECT doc_id, source FROM documents JOIN labels USING (doc_id) WHERE quality = 1")
def relevant_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """texts predicted to be relevant."""
    relevant = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(relevant, "doc_id")


@query(
    "entity_union",
    "WITH g AS (SELECT DISTINCT lower(CASE p_size % 6 WHEN 0 THEN 'Mice' WHEN 1 THEN 'SKI' ELSE p_brand END) AS token FROM part) SELECT token FROM g WHERE token NOT IN ('mice', 'bad', 'insulin', 'camp', 'plasminogen', 'ski') UNION SELECT lower(p_type) FROM part",
)
def entity_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols without ordinary words, united with the other kind."""
    symbol = F.when(F.col("p_size") % 6 == 0, F.lit("Mice")).when(F.col("p_size") % 6 == 1, F.lit("SKI")).otherwise(F.col("p_brand"))
    part = table(spark, sf_dir, "part")
    return entities.main_entities(part.select(symbol.alias("token")), part.select(F.col("p_type").alias("token")))


@query("linked_entities", f"WITH {_TOKENS}, a AS (SELECT DISTINCT token AS alias, 'E' || length(token) AS canonical FROM t WHERE length(token) IN (3, 5) AND pos = 0) SELECT t.doc_id AS doc_id, CAST(t.pos AS INT) AS pos, canonical FROM t JOIN a ON a.alias = t.token")
def linked_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary linker in place of a trained one (entities.link_with takes a model of the user's)."""
    found = tokens(spark, sf_dir)
    names = found.where(F.length("token").isin(3, 5) & (F.col("pos") == 0)).select(F.col("token").alias("alias"), F.concat(F.lit("E"), F.length("token").cast("string")).alias("canonical")).distinct()
    return found.withColumnRenamed("token", "alias").join(names, "alias").select("doc_id", "pos", "canonical")


@query("line_counts", "SELECT source, count(*) AS lines FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY source")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each source that aren't blank."""
    lines = table(spark, sf_dir, "documents").select("source", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(F.trim("line") != "").groupBy("source").agg(F.count("*").alias("lines"))


@query("year_shards", "WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS c FROM documents) SELECT doc_id, CAST(least(r // (c // 7), 6) AS INT) AS shard FROM n")
def year_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguous shards of n // workers rows, the last taking the rest."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    size = d.agg(F.floor(F.count("*") / 7).cast("bigint").alias("size"))
    return graph.dense_index(d, "doc_id", "r").join(F.broadcast(size)).select("doc_id", F.least(F.floor(F.col("r") / F.col("size")), F.lit(6)).cast("int").alias("shard"))
