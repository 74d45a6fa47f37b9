"""Readers and writers over small files."""

from pyspark.sql import functions as F

from papyrine.sources import readers, writers


def write(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return f"file://{tmp_path}/{name}"


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_gtf(spark, tmp_path):
    gtf = '#c\nchr1\th\tgene\t1\t9\t.\t+\t.\tgene_id "g"; gene_name "WAS"; gene_type "protein_coding";\nchrX\th\tgene\t1\t9\t.\t+\t.\tgene_name "A"; gene_type "protein_coding";\n'
    a = readers.gtf(spark, write(tmp_path, "a.gtf", gtf))
    assert rows(readers.gene_symbols(a)) == [("A",), ("wasgene",)]
    assert readers.protein_coding(a, autosomes=True).count() == 1


def test_tables(spark, tmp_path):
    names = readers.symbols_and_names(spark, write(tmp_path, "n.tsv", "s\tn\nA\tan, (x) name\n"))
    assert rows(names) == [("A",), ("an_x_name",)]
    assert rows(readers.disease_names(spark, write(tmp_path, "d.tsv", "# c\nType-2 Y\tz\n"))) == [("type_2_y",)]
    assert rows(readers.token_list(spark, write(tmp_path, "t.txt", "A\n a \n\nb\n"))) == [("a",), ("b",)]
    goa = "!c\nd\ti1\tx\tx\tt1\tx\tIDA\nd\ti2\tx\tx\tt1\tx\tIEA\n"
    assert rows(readers.annotations(spark, write(tmp_path, "g.gaf", goa))) == [("i1", "t1")]
    assert rows(readers.id_map(spark, write(tmp_path, "m.tsv", "i\ta\ni\tb\n"))) == [("i", "b")]
    assert rows(readers.blank_separated(spark, write(tmp_path, "b.txt", "a  b\n c d \n"), "x", "y")) == [("a", "b"), ("c", "d")]
    assert rows(readers.four_column_edges(spark, write(tmp_path, "f.tsv", "a\tb\tc\td\n"))) == [("a", "b"), ("c", "d")]
    assert readers.labelled_edges(spark, write(tmp_path, "l.tsv", "a\tb\tpos\nc\td\tneg\n"), "pos").count() == 1


def test_mapped_edges(spark):
    e = spark.createDataFrame([("1", "2"), ("1", "3")], "src string, dst string")
    n = spark.createDataFrame([("1", "A"), ("2", "B"), ("3", "Unknown")], "id string, symbol string")
    assert rows(readers.mapped(e, n)) == [("A", "B")]


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(2003, [["a", "b"], ["c"]], ["x", ",", "y", "."]), (2005, [["d"]], ["z"])], "year int, sentences array<array<string>>, tokens array<string>")
    at = f"file://{tmp_path}"
    writers.year_lines(d, f"{at}/l", 2004)
    assert rows(readers.lines(spark, f"{at}/l").select("value")) == [("a b",), ("c",)]
    writers.text_lines(d, f"{at}/f")
    assert rows(spark.read.text(f"{at}/f")) == [("x, y.",), ("z",)]
    writers.by_year(d, f"{at}/y")
    assert readers.tables(spark, f"{at}/y").where("year <= 2003").count() == 1
    e = spark.createDataFrame([("a", "b", 0.25), ("c", "d", 0.5)], "src string, dst string, score double")
    writers.ranking_tsv(e, f"{at}/r", "src", "dst")
    assert rows(readers.tsv(spark, f"{at}/r")) == [("a", "b", "0.2500"), ("c", "d", "0.5000")]
    writers.with_year_tsv(spark.createDataFrame([("1", "g"), ("", "h"), ("2", "i")], "pmid string, gene string"), spark.createDataFrame([("1", 2001)], "pmid string, year int"), f"{at}/p")
    assert rows(readers.tsv(spark, f"{at}/p", header=True).select("pmid", "year")) == [("1", "2001"), ("2", "N/A")]
    assert readers.articles(d, 2003).count() == 1 and readers.articles(d, 2003, 2006).count() == 1
    assert d.select(F.size("tokens")).count() == 2


def test_bed_genes(spark, tmp_path):
    (tmp_path / "g.bed").write_text("chr1\t1\t9\tWAS\t.\t+\tprotein_coding\nchrX\t1\t9\tA\t.\t+\tprotein_coding\nchr2\t3\t7\tB\t.\t-\tlncRNA\n")
    rows = readers.bed(spark, str(tmp_path / "g.bed"))
    assert [r["gene"] for r in readers.bed_genes(rows).collect()] == ["WAS"]
    assert sorted(r["gene"] for r in readers.bed_genes(rows, coding=False).collect()) == ["B", "WAS"]


def test_numbered_lines_have_no_gaps(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("".join(f"line {k}\n" for k in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path / "lines.txt"))
        found = {r["n"]: r["tokens"] for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found == {k: ["line", str(k)] for k in range(500)}
