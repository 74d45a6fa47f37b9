"""Readers of the corpus, dictionaries, annotations, graphs and intervals, each with a fixed schema; all stay lazy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from papyrine.functions import patterns as P
from papyrine.functions import text as X

#: Evidence codes that annotations are not taken from.
EXCLUDED_EVIDENCE = ["IEA", "IEP", "IC", "ND"]


def tables(spark: SparkSession, *paths: str) -> DataFrame:
    """All tables under the paths (globs too), united by name; corrupt files are passed over; an error if nothing is there."""
    return spark.read.option("ignoreCorruptFiles", "true").option("mergeSchema", "true").parquet(*paths)


def tsv(spark: SparkSession, path: str, schema: str | None = None, header: bool = False, comment: str | None = None, sep: str = "\t", width: int | None = None) -> DataFrame:
    """Separated text; without a schema, columns _c0, _c1, ... as text (`width` of them where the first line may be shorter)."""
    if width is not None:
        schema = ", ".join(f"_c{i} string" for i in range(width))
    reader = spark.read.option("sep", sep).option("header", header).option("quote", "\u0000")
    if comment:
        reader = reader.option("comment", comment)
    return (reader.schema(schema) if schema else reader).csv(path)


def blank_separated(spark: SparkSession, path: str, *names: str) -> DataFrame:
    """Columns separated by runs of blanks."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).select(*(F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """A line corpus as token arrays; blank lines give none."""
    return spark.read.text(path).select("value", X.words(F.col("value")).alias("tokens"))


def token_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed lower-case lines."""
    return spark.read.text(path).select(F.lower(X.strip(F.col("value"))).alias("token")).where("token <> ''").distinct()


def articles(found: DataFrame, start: int, end: int | None = None, year: str = "year") -> DataFrame:
    """Years strictly between both bounds, or the one year."""
    return found.where(F.col(year) == start) if end is None else found.where((F.col(year) > start) & (F.col(year) < end))


def attribute(column: Column, name: str) -> Column:
    return F.regexp_extract(column, name + ' "([^"]*)"', 1)


def gtf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, feature, start, end, gene_name, gene_type) of an annotation file."""
    raw = tsv(spark, path, "chrom string, source string, feature string, start bigint, end bigint, score string, strand string, frame string, attributes string", comment="#")
    return raw.select("chrom", "feature", "start", "end", attribute(F.col("attributes"), "gene_name").alias("gene_name"), attribute(F.col("attributes"), "gene_type").alias("gene_type"))


def gene_symbols(annotation: DataFrame, replacements: dict[str, str] | None = None) -> DataFrame:
    """Distinct symbols, those that are also words replaced."""
    known = P.AMBIGUOUS_SYMBOLS if replacements is None else replacements
    named = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), F.col("gene_name")), F.col("gene_name")) if known else F.col("gene_name")
    return annotation.where("gene_name <> ''").select(named.alias("symbol")).distinct()


def protein_coding(annotation: DataFrame, autosomes: bool = False) -> DataFrame:
    """Protein-coding genes, without sex and mitochondrial chromosomes on demand."""
    genes = annotation.where("feature = 'gene' and gene_type = 'protein_coding'")
    return genes.where(~F.col("chrom").isin("chrX", "chrY", "chrM")) if autosomes else genes


def symbols_and_names(spark: SparkSession, path: str, hgnc: bool = False) -> DataFrame:
    """Distinct symbols and normalised names of a nomenclature table (columns 1 and 2 of one layout, 0 and 1 of the other)."""
    rows = tsv(spark, path, header=True)
    symbol, name = rows.columns[1:3] if hgnc else rows.columns[:2]
    names = rows.select(F.replace(F.translate(F.col(f"`{name}`"), "(),", ""), F.lit(" "), F.lit("_")).alias("gene"))
    return rows.select(F.col(f"`{symbol}`").alias("gene")).union(names).where("gene <> ''").distinct()


def disease_names(spark: SparkSession, path: str) -> DataFrame:
    """Distinct lower-case symbol_name of the first column."""
    return tsv(spark, path, comment="#").select(F.lower(X.symbol_name(F.col("_c0"))).alias("disease")).where("disease <> ''").distinct()


def bed(spark: SparkSession, path: str) -> DataFrame:
    """Intervals of genes; `coding` tells whether any field of the row says protein_coding."""
    rows = tsv(spark, path)
    coding = F.concat_ws("\t", *(F.col(f"`{c}`") for c in rows.columns)).contains("protein_coding")
    return rows.select(F.col("_c0").alias("chrom"), F.col("_c1").cast("bigint").alias("start"), F.col("_c2").cast("bigint").alias("end"), F.col("_c3").alias("gene"), coding.alias("coding"))


def bed_genes(intervals: DataFrame, coding: bool = True) -> DataFrame:
    """(gene) of the rows of bed() that aren't on a sex or mitochondrial chromosome, protein-coding ones only on demand; repeats stay."""
    genes = intervals.where(F.col("chrom").isNotNull() & ~F.col("chrom").isin("chrX", "chrY", "chrM"))
    return (genes.where("coding") if coding else genes).select("gene")


def expression(spark: SparkSession, path: str) -> DataFrame:
    """Rows of genes."""
    rows = tsv(spark, path, header=True)
    return rows.where(F.col(f"`{rows.columns[0]}`").contains("ENSG"))


def last_by_key(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value), the last row of a key winning."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def id_map(spark: SparkSession, path: str) -> DataFrame:
    """(id, symbol); `id` repeats go to the last line."""
    raw = tsv(spark, path).select(F.col("_c0").alias("id"), F.col("_c1").alias("symbol"), F.monotonically_increasing_id().alias("_n"))
    return last_by_key(raw, "id", "symbol", "_n")


def aliases(spark: SparkSession, path: str, source: str = "Ensembl_HGNC_symbol") -> DataFrame:
    """(id, symbol) of three-field rows of one source."""
    rows = tsv(spark, path).select("_c0", "_c1", "_c2").where(F.col("_c2") == source)
    return rows.select(F.col("_c0").alias("id"), F.col("_c1").alias("symbol")).distinct()


def mapped(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Both ends by name; edges with an unknown end (or named Unknown) go."""
    known = names.where("symbol <> 'Unknown'")
    one = known.select(F.col("id").alias("src"), F.col("symbol").alias("_a"))
    two = known.select(F.col("id").alias("dst"), F.col("symbol").alias("_b"))
    return edges.join(one, "src").join(two, "dst").select(F.col("_a").alias("src"), F.col("_b").alias("dst"))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """(id, term) without comment rows and excluded evidence."""
    rows = tsv(spark, path, width=17).where(~F.col("_c0").startswith("!"))
    return rows.where(~F.col("_c6").isin(*EXCLUDED_EVIDENCE)).select(F.col("_c1").alias("id"), F.col("_c4").alias("term"))


def edge_list(spark: SparkSession, path: str) -> DataFrame:
    """S24"""
    return tsv(spark, path, "src string, dst string")


def four_column_edges(spark: SparkSession, path: str) -> DataFrame:
    """Two edges a row."""
    rows = tsv(spark, path)
    return rows.select(F.expr("stack(2, _c0, _c1, _c2, _c3) as (src, dst)"))


def labelled_edges(spark: SparkSession, path: str, keep: str | None = None) -> DataFrame:
    """(src, dst, rel), of one relation on demand."""
    rows = tsv(spark, path, "src string, dst string, rel string")
    return rows.where(F.col("rel") == keep) if keep else rows


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, tokens), n from 0 without gaps in order of the file, so line n can be fetched by its number.

    Lines are numbered where they are read; offsets come from one row a partition, so no line moves and no task sees all.
    """
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("_at"), X.words(F.col("value")).alias("tokens"))
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return rows.join(offsets, "_part").select((F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).alias("n"), "tokens")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """Files and their sizes, without their content."""
    return spark.read.format("binaryFile").load(path).select("path", "length")


def exists(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.format("binaryFile").load(path).select("path").take(1))
    except AnalysisException:
        return False
