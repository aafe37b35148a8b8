"""Queries on inputs made by rule from the tables, for operators whose own kind of input the tables don't hold; their SQL states the expected rows."""

from __future__ import annotations

import io
import json
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import measure, text
from tessera.operators import dedup, quality, running, sequences, tables
from tessera.plans.catalog import register
from tessera.plans.corpus import _RECORDS, _records, table
from tessera.sources import papers, records, sinks
from tessera.sources.scratch import scratch_path

_CELL = """'"' || coalesce(text, '') || '",' || chr(10) || ' x"y '"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts among quotes, separators and line ends."""
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit('"'), F.coalesce("text", F.lit("")), F.lit('",\n x"y ')).alias("cell"))


def _digests(read: DataFrame) -> DataFrame:
    return read.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("cell").cast("binary")).alias("digest"))


# --- writers and readers -------------------------------------------------------------------------------------------


@register("k1_csv_round_trip", f"SELECT doc_id, md5({_CELL}) AS digest FROM documents")
def k1_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    sinks.write_csv(_cells(spark, sf_dir), path)
    return _digests(records.read_text_table(spark, path))


@register("k11_appended_csv", f"SELECT doc_id, md5({_CELL}) AS digest FROM documents UNION ALL SELECT doc_id, md5({_CELL}) FROM documents WHERE doc_id % 2 = 0")
def k11_appended_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    sinks.append_csv(_cells(spark, sf_dir), path)
    sinks.append_csv(_cells(spark, sf_dir).where("doc_id % 2 = 0"), path)
    return _digests(records.read_text_table(spark, path))


@register("k8_written_once", f"SELECT doc_id, md5({_CELL}) AS digest FROM documents WHERE doc_id % 3 = 1")
def k8_written_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, left alone, overwritten, left alone."""
    path, d = scratch_path(spark, "once"), _cells(spark, sf_dir)
    for mod, overwrite in ((0, False), (2, False), (1, True), (0, False)):
        sinks.write_once(d.where(f"doc_id % 3 = {mod}"), path, overwrite)
    return _digests(records.read_text_table(spark, path))


@register("k6_clipped", r"WITH d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS s FROM documents) SELECT doc_id, md5(CASE WHEN length(s) > 2000 THEN substr(s, 1, 2000) || '...<truncated>' ELSE s END) AS snippet, doc_id AS other FROM d")
def k6_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sinks.clipped(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("snippet"), F.col("doc_id").alias("other")))
    return c.select("doc_id", F.md5(F.col("snippet").cast("binary")).alias("snippet"), "other")


@register("k5_file_digests", "SELECT sha256(string_agg(r_name || chr(10), '' ORDER BY r_regionkey)) AS sha256 FROM region")
def k5_file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "digest")
    table(spark, sf_dir, "region").orderBy("r_regionkey").coalesce(1).select("r_name").write.text(path)
    return sinks.file_digests(spark, f"{path}/part-*").select("sha256")


@register("k3_catalogue", "SELECT CAST(n_nationkey AS VARCHAR) AS dataset_id, n_name AS project, 'level, \"two\"' AS level, 'train' AS split, '/x/' || n_nationkey AS file_path, 'csv' AS label_rule FROM nation")
def k3_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "catalogue")
    rows = table(spark, sf_dir, "nation").collect()  # a catalogue is a few descriptors, here one for each nation
    sinks.write_catalogue(spark, [{"dataset_id": str(r.n_nationkey), "project": r.n_name, "level": 'level, "two"', "split": "train", "file_path": f"/x/{r.n_nationkey}", "label_rule": "csv"} for r in rows], path)
    return records.read_text_table(spark, path)


@register(
    "s1_labelled_sources",
    """WITH n AS (SELECT n_nationkey AS k, replace(n_name, ' ', '') AS s FROM nation)
SELECT s AS sequence, 1 AS label, 'fasta' AS source_dataset, CAST(k AS VARCHAR) AS source_id FROM n UNION ALL SELECT s, k % 2, 'tokens', CAST(k AS VARCHAR) FROM n UNION ALL SELECT s, k % 2, 'table', 'row_' || row_number() OVER (ORDER BY k) - 1 FROM n""",
)
def s1_labelled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of three kinds as one table: a label for a whole file, in headers, and in a column."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.replace("n_name", F.lit(" "), F.lit("")).alias("sequence"), (F.col("n_nationkey") % 2).alias("label"))
    at = {name: scratch_path(spark, name) for name in ("fasta", "tokens", "table")}
    sinks.write_fasta(n, at["fasta"], "k")
    sinks.write_fasta(n.withColumn("head", F.concat_ws(" ", "k", F.col("label").cast("string"))), at["tokens"], "head")
    sinks.write_csv(n.orderBy(F.col("k").cast("int")).coalesce(1).select("sequence", "label"), at["table"])
    rules = {"fasta": "constant:1", "tokens": "last_token", "table": "csv"}
    specs = [{"dataset_id": name, "project": "p", "level": "l", "split": "s", "file_path": path, "label_rule": rules[name]} for name, path in at.items()]
    return records.load_sources(spark, specs).select("sequence", "label", "source_dataset", "source_id")


@register("s20_vector_scan", "SELECT vec_id, len(embedding) AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def s20_vector_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "vectors")
    table(spark, sf_dir, "embeddings").select("vec_id", "embedding").write.parquet(path)
    return spark.read.parquet(path).select("vec_id", F.size("embedding").cast("long").alias("n"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@register("s11_alignment_depth", "WITH a AS (SELECT p_brand AS b, p_partkey AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS r, p_size FROM part), w AS (SELECT *, first_value(p_size % 3) OVER (PARTITION BY b ORDER BY r) AS f FROM a) SELECT replace(b, '#', '') AS brand, count(*) AS n FROM w WHERE r < 30 AND p_size % 3 = f GROUP BY b")
def s11_alignment_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 30 rows of each file, and of these those of the first row's width."""
    path = scratch_path(spark, "a3m")
    p = table(spark, sf_dir, "part").select(F.replace("p_brand", F.lit("#"), F.lit("")).alias("p_brand"), "p_partkey", F.concat(F.lit(">x\nAC"), F.repeat(F.lit("D"), (F.col("p_size") % 3).cast("int")), F.lit("ef*")).alias("r"))
    lines = p.groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "r"))), lambda s: s["r"]), "\n").alias("value"))
    lines.write.partitionBy("p_brand").text(path)
    brands = [r.p_brand for r in lines.select("p_brand").collect()]  # a folder each
    one = lambda b: records.read_alignment(spark, f"{path}/p_brand={b}", most=30).select(F.lit(b).alias("brand"))
    out = one(brands[0])
    for b in brands[1:]:
        out = out.unionByName(one(b))
    return out.groupBy("brand").agg(F.count("*").alias("n"))


# --- literature ----------------------------------------------------------------------------------------------------


@register("s13_paper_catalogue", "SELECT 'PMC' || n_nationkey AS stem, CASE WHEN n_nationkey % 2 = 0 THEN '/papers/PMC' || n_nationkey || '.XML' END AS path FROM nation")
def s13_paper_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    stem = F.concat(F.lit("PMC"), "n_nationkey")
    n = table(spark, sf_dir, "nation")
    files = n.select(F.concat(F.lit("/papers/"), stem, F.when(F.col("n_nationkey") % 2 == 0, ".XML").otherwise(".pdf")).alias("path"))
    return papers.paper_catalogue(files, n.select(stem.alias("stem")))


@register("s15_article_ids", "SELECT p_partkey, '10.1/x' || p_partkey AS doi, CAST(p_size AS VARCHAR) AS pmid, CASE WHEN p_size % 2 = 0 THEN 'PMC' || p_partkey ELSE 'X' || p_partkey END AS pmcid, 'A title, ' || p_name AS title FROM part")
def s15_article_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda kind, *v: F.concat(F.lit(f'<article-id pub-id-type="{kind}">'), *v, F.lit("</article-id>"))
    key = F.when(F.col("p_size") % 2 == 0, F.col("p_partkey").cast("string")).otherwise(F.concat(F.lit("X"), "p_partkey"))
    xml = F.concat(F.lit("<article>"), tag("doi", F.lit("10.1/x"), "p_partkey"), tag("pmid", "p_size"), tag("pmc", key), tag("doi", F.lit("second")), F.lit("<title-group><article-title>A <i>title</i>,\n "), "p_name", F.lit("</article-title></title-group></article>"))
    return tables.articles(table(spark, sf_dir, "part").select("p_partkey", xml.alias("xml")), "xml", "p_partkey").select(F.col("doc").alias("p_partkey"), "article.doi", "article.pmid", "article.pmcid", "article.title")


def _docx(name: str, region: int) -> bytes:
    out = io.BytesIO()
    cell = lambda v: f"<w:tc><w:p><w:r><w:t>{v}</w:t></w:r></w:p></w:tc>"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="w"><w:tbl><w:tr>{cell("name")}{cell("region")}</w:tr><w:tr>{cell(name)}{cell(region)}</w:tr></w:tbl></w:document>')
    return out.getvalue()


def _xlsx(name: str, region: int) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst><si><t>name</t></si><si><t>region</t></si><si><t>{name}</t></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row><row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>{region}</v></c></row></sheetData></worksheet>')
    return out.getvalue()


@register(
    "s16_supplement_tables",
    """WITH k AS (SELECT unnest(['t.csv', 't.tsv', 't.docx#table0', 't.xlsx#S', 'z.zip/t.csv']) AS kind)
SELECT n_nationkey, kind, '[["name", "region"], ["' || n_name || '", "' || n_regionkey || '"]]' AS rows FROM nation, k""",
)
def s16_supplement_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small table as CSV, TSV, DOCX, XLSX and zipped CSV, each read back."""

    def run(names: pd.Series, regions: pd.Series) -> pd.Series:
        out = []
        for name, region in zip(names, regions, strict=True):
            plain = f"name,region\n{name},{region}\n".encode()
            packed = io.BytesIO()
            with zipfile.ZipFile(packed, "w") as z:
                z.writestr("t.csv", plain)
            files = {"t.csv": plain, "t.tsv": plain.replace(b",", b"\t"), "t.docx": _docx(name, region), "t.xlsx": _xlsx(name, region), "z.zip": packed.getvalue()}
            out.append([{"kind": place, "rows": json.dumps(rows)} for f, data in files.items() for place, rows in papers.supplement_tables(f, data)])
        return pd.Series(out, dtype=object)

    n = table(spark, sf_dir, "nation").select("n_nationkey", F.explode(F.pandas_udf(run, "array<struct<kind:string,rows:string>>")("n_name", "n_regionkey")).alias("t"))
    return n.select("n_nationkey", "t.kind", "t.rows")


@register(
    "s16_damaged_supplements",
    """WITH f AS (SELECT CAST(s_suppkey AS VARCHAR) AS doc, s_suppkey % 5 AS form FROM supplier)
SELECT doc, 't.csv' AS table_id, NULL AS problem, 2 AS n_rows FROM f WHERE form = 0 UNION ALL SELECT doc, 't.docx', 'BadZipFile', 0 FROM f WHERE form = 1 UNION ALL SELECT doc, 't.docx#table0', NULL, 2 FROM f WHERE form = 2
UNION ALL SELECT doc, 'z.zip/t.csv', NULL, 2 FROM f WHERE form = 3 UNION ALL SELECT doc, 'z.zip/t.docx', 'BadZipFile', 0 FROM f WHERE form = 3 UNION ALL SELECT doc, 'z.zip', 'BadZipFile', 0 FROM f WHERE form = 4""",
)
def s16_damaged_supplements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each supplier: whole or cut off, by itself or in an archive. What can't be read is told, not left out."""
    path = scratch_path(spark, "supplements")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        for batch in batches:
            for key, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                plain, document, packed = f"name,key\n{name},{key}\n".encode(), _docx(name, str(key)), io.BytesIO()
                with zipfile.ZipFile(packed, "w") as z:
                    z.writestr("t.csv", plain)
                    z.writestr("t.docx", document[:60])
                file, data = [("t.csv", plain), ("t.docx", document[:60]), ("t.docx", document), ("z.zip", packed.getvalue()), ("z.zip", packed.getvalue()[:60])][key % 5]
                where.create_dir(f"{root}/{key}", recursive=True)
                with where.open_output_stream(f"{root}/{key}/{file}", compression=None) as out:
                    out.write(data)
        yield from ()

    table(spark, sf_dir, "supplier").select("s_suppkey", "s_name").mapInArrow(write, "done int").write.format("noop").mode("overwrite").save()
    found = papers.read_supplements(spark, path, damaged=True)
    return found.select("doc", "table_id", F.regexp_extract("problem", r"^\w+", 0).alias("problem"), F.size("rows").alias("n_rows"))


@register("s26_archive_members", "SELECT 'a' || n_nationkey || '.tar.gz' AS archive, m AS member, CASE m WHEN 'a.pdf' THEN n_nationkey + 1 WHEN 'b.pdf' THEN 12 WHEN 'c.csv' THEN 3 ELSE 4 END AS size, CASE WHEN m = 'd.bin' THEN 'other' WHEN m = 'c.csv' OR (m = 'a.pdf') <> (n_nationkey >= 11) THEN 'supplement' ELSE 'main' END AS role FROM nation, (SELECT unnest(['a.pdf', 'b.pdf', 'c.csv', 'd.bin']) AS m)")
def s26_archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "packages")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        where.create_dir(root, recursive=True)
        for batch in batches:
            for k in batch.column(0).to_pylist():
                data = io.BytesIO()
                with tarfile.open(fileobj=data, mode="w:gz") as t:
                    for name, size in (("a.pdf", k + 1), ("b.pdf", 12), ("c.csv", 3), ("d.bin", 4)):
                        info = tarfile.TarInfo(name)
                        info.size = size
                        t.addfile(info, io.BytesIO(b"x" * size))
                with where.open_output_stream(f"{root}/a{k}.tar.gz", compression=None) as out:
                    out.write(data.getvalue())
            yield batch

    table(spark, sf_dir, "nation").select("n_nationkey").mapInArrow(pack, "n_nationkey int").count()
    return papers.archive_members(spark, path).select(F.element_at(F.split("archive", "/"), -1).alias("archive"), "member", "size", "role")


@register("s23_resolved_links", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'unpaywall' WHEN p_size % 3 = 0 THEN 'openalex' WHEN p_size % 5 = 0 THEN 'arxiv' END AS via, CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size % 4 = 0 THEN 'best' ELSE 'other' END || p_partkey WHEN p_size % 3 = 0 THEN 'open' || p_partkey WHEN p_size % 5 = 0 THEN 'https://arxiv.org/pdf/2101.0000' || p_size % 10 || '.pdf' END AS url FROM part")
def s23_resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of three resolvers that has a link, from saved answers."""
    z, k = F.col("p_size"), F.col("p_partkey")
    best = F.struct(F.when(z % 4 == 0, F.concat(F.lit("best"), k)).otherwise("").alias("url_for_pdf"))
    one = F.to_json(F.struct((z % 2 == 0).alias("is_oa"), best.alias("best_oa_location"), F.array(F.struct(F.lit(None).cast("string").alias("url_for_pdf")), F.struct(F.concat(F.lit("other"), k).alias("url_for_pdf"))).alias("oa_locations")))
    two = F.to_json(F.struct(F.struct((z % 3 == 0).alias("is_oa")).alias("open_access"), F.array(F.struct(F.concat(F.lit("open"), k).alias("pdf_url"))).alias("locations")))
    three = F.when(z % 5 == 0, F.concat(F.lit("arXiv:2101.0000"), z % 10)).otherwise("none")
    found = papers.first_resolved(papers.unpaywall_pdf(one), papers.openalex_pdf(two), papers.arxiv_pdf(three))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("f")).select("p_partkey", "f.via", "f.url")


@register("s27_absolute_links", """WITH l AS (SELECT unnest(['http://h.org/d/e/', 'http://h.org/d/', 'http://x.org/', 'http://h.org/d/e/p.html?q=', 'http://h.org/']) AS a, unnest(['.pdf', '.zip?a=1&b=2', '', '#f', '/suppl']) AS z) SELECT p_partkey, string_agg(a || p_partkey || z, ' ' ORDER BY a || z) AS links FROM part, l GROUP BY p_partkey""")
def s27_absolute_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unquoted, quoted and repeated links, references, dot segments and other attributes; the expected urls are written by hand."""
    k = F.col("p_partkey")
    html = F.concat(F.lit("<a href="), k, F.lit(".pdf>a</a><a data-href='no' href='../"), k, F.lit(".zip?a=1&amp;b=2'>b</a><A HREF=\"//x.org/"), k, F.lit('">c</A><a href="#f">d</a><a href='), k, F.lit(".pdf>e</a><a href='/"), k, F.lit("/./x/../suppl'>f</a><a>g</a>"))
    base = F.concat(F.lit("http://h.org/d/e/p.html?q="), k)
    strip = lambda u: F.regexp_replace(F.replace(u, k.cast("string"), F.lit("")), "^", "")
    linked = tables.dealt(table(spark, sf_dir, "part")).select("p_partkey", F.explode(papers.absolute_links(base, html)).alias("u"))
    return linked.groupBy("p_partkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(strip(F.col("u")).alias("s"), "u"))), lambda x: x["u"]), " ").alias("links"))


@register("s28_package_urls", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'https://h/pub/pmc/oa_package/' || p_partkey || '.tar.gz' END AS url FROM part")
def s28_package_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    scheme = F.when(F.col("p_size") % 3 == 1, "ftp").otherwise("http")
    xml = F.when(F.col("p_size") % 3 == 0, F.lit('<error code="none"/>')).otherwise(F.concat(F.lit('<link href="http://h/other/1"/><link format="tgz" href="'), scheme, F.lit("://h/pub/pmc/oa_package/"), "p_partkey", F.lit('.tar.gz"/>')))
    return table(spark, sf_dir, "part").select("p_partkey", papers.package_url(xml).alias("url"))


@register("s18_page_text", "SELECT conv_id AS doc, turn AS page, md5(coalesce(text, '')) AS digest FROM conversations WHERE turn < 3")
def s18_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = papers.page_text(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text"), 3)
    return p.select("doc", "page", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("digest"))


@register(
    "p10_open_access",
    """WITH r AS (SELECT *, 'PMC' || p_size AS pmcid, p_partkey % 7 AS score, CAST(2010 + p_partkey % 10 AS VARCHAR) AS y FROM part WHERE p_partkey % 3 <> 0), b AS (SELECT *, row_number() OVER (PARTITION BY pmcid ORDER BY score DESC, y, lpad(CAST(p_partkey AS VARCHAR), 9, '0')) AS i FROM r)
SELECT lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS id, pmcid, score FROM b WHERE i = 1 ORDER BY score DESC, y, pmcid LIMIT 20""",
)
def p10_open_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.lpad(k.cast("string"), 9, "0").alias("id"), F.concat(F.lit("PMC"), "p_size").alias("pmcid"), F.when(k % 3 == 0, "N").otherwise("y").alias("isOpenAccess"), F.lit("Y").alias("inPMC"), (k % 7).alias("score"), (2010 + k % 10).cast("string").alias("pubYear"))
    return papers.open_access(rows, 20).select("id", "pmcid", "score")


@register("p15_sniffed", "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'html' WHEN 2 THEN 'html' WHEN 3 THEN 'empty' ELSE 'other' END AS kind, p_size % 2 = 0 AS is_file FROM part")
def p15_sniffed(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("p_size")
    content = F.when(z % 5 == 0, "%PDF-1.7 x").when(z % 5 == 1, " \n<!DOCTYPE html>").when(z % 5 == 2, "<HEAD><title>").when(z % 5 == 3, "").otherwise("PK x <html>")
    url = F.concat(F.lit("http://h/a.html/"), "p_partkey", F.when(z % 2 == 0, ".CSV?x=.no").otherwise(".html#a.csv"))
    return table(spark, sf_dir, "part").select("p_partkey", papers.sniff(content.cast("binary")).alias("kind"), papers.looks_like_file(url).alias("is_file"))


@register("f40_built_urls", "SELECT p_partkey, 'http://h/bin/' || p_partkey || '%20a%2Fb.pdf' AS url, 'f' || p_partkey || '.tar.gz' AS name, CASE WHEN p_size % 2 = 0 THEN 'https://pmc.ncbi.nlm.nih.gov/articles/instance/' || p_partkey || '/bin/' END AS base FROM part")
def f40_built_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    made = papers.candidate_url(F.lit("http://h/bin//"), F.concat(k, F.lit(" a/b.pdf"))), papers.file_name(F.concat(F.lit("http://h/x/f"), k, F.lit(".tar.gz?y=/z"))), papers.article_files_base(F.concat(F.when(F.col("p_size") % 2 == 0, "pmc").otherwise("x"), k))
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for c, n in zip(made, ("url", "name", "base"), strict=True)])


# --- sequences, measurements ---------------------------------------------------------------------------------------


@register("p4_strict_sanitise", "SELECT p_partkey, CASE WHEN regexp_matches(upper(replace(p_name, ' ', '')), '^[ACDEFGHIKLMNPQRSTVWY]*$') THEN upper(replace(p_name, ' ', '')) END AS sequence FROM part UNION ALL SELECT -n_nationkey - 1, CASE WHEN regexp_matches(replace(n_name, ' ', ''), '^[ACDEFGHIKLMNPQRSTVWY]*$') THEN replace(n_name, ' ', '') END FROM nation")
def p4_strict_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("p_partkey"), F.concat(F.lit(" "), "p_name").alias("s")).unionByName(table(spark, sf_dir, "nation").select((-F.col("n_nationkey") - 1).cast("long").alias("p_partkey"), F.lower("n_name").alias("s")))
    return names.select("p_partkey", text.strict_sanitise(F.col("s"), raising=False).alias("sequence"))


@register("p7_numbered_ids", "SELECT doc_id, toxic, CASE toxic WHEN 1 THEN 'pos_' ELSE 'neg_' END || 'n' || lpad(CAST(row_number() OVER (PARTITION BY toxic ORDER BY doc_id) - 1 AS VARCHAR), 6, '0') AS seq_id FROM labels")
def p7_numbered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered within each label, and the labels' tables put together under prefixes."""
    numbered = dedup.number_rows(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "n", "doc_id", ["toxic"])
    named = lambda label, prefix: numbered.where(F.col("toxic") == label).withColumn("seq_id", F.concat(F.lit(prefix), "seq_id"))
    return named(0, "neg_").unionByName(named(1, "pos_"))


@register("a3_order_of_support", f"WITH {_RECORDS} SELECT sequence, row_number() OVER (ORDER BY count(DISTINCT source_dataset) DESC, count(*) DESC, sequence) - 1 AS position FROM r GROUP BY sequence")
def a3_order_of_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = dedup.by_support(dedup.dedup_with_conflicts(_records(spark, sf_dir))).withColumn("place", F.monotonically_increasing_id())
    path = scratch_path(spark, "support")
    ordered.select("sequence", "place").write.parquet(path)
    return running.number_by_place(spark.read.parquet(path), "place", "position").select("sequence", "position")


@register("l2_picked_cases", "SELECT p_partkey FROM part ORDER BY p_size DESC, p_partkey % 11, p_name DESC, p_partkey DESC LIMIT 25")
def l2_picked_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("p"), (F.col("p_partkey") % 11).alias("uncertainty"), F.concat("p_name", F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("sequence"))
    return sequences.pick_cases(p, 25).select("p_partkey")


@register("l4_top_positions", "SELECT vec_id, string_agg(i - 1, ',' ORDER BY v DESC, i) AS positions FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS r FROM (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings)) WHERE r <= 5 GROUP BY vec_id")
def l4_top_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = sequences.top_positions(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 5)
    return p.select("vec_id", F.array_join(F.transform("positions", lambda x: x.cast("string")), ",").alias("positions"))


@register("j13_features_by_key", "SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j13_features_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.align(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id")


@register("f13_table_hints", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'MIC' WHEN 1 THEN 'HC50' ELSE '' END AS endpoint, CASE p_size % 3 WHEN 0 THEN 'mg/L' WHEN 1 THEN 'µM' ELSE '' END AS unit FROM part")
def f13_table_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("p_size") % 3
    label, caption, foot = F.lit("Table 1"), F.when(z == 0, "Values of MIC").when(z == 1, "Activity").otherwise("Selectivity index of MIC"), F.when(z == 0, "in mg/L").when(z == 1, "HC50, µM").otherwise("µM")
    return table(spark, sf_dir, "part").select("p_partkey", measure.table_hint(label, caption, foot).alias("h")).select("p_partkey", "h.*")


@register("f16_endpoint_overrides", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'HEMOLYSIS' WHEN 1 THEN 'MBC' WHEN 2 THEN 'HEMOLYSIS' ELSE '' END AS endpoint, CASE p_size % 4 WHEN 1 THEN 'LC50,MBC' WHEN 2 THEN 'MIC' ELSE '' END AS every FROM part")
def f16_endpoint_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("p_size") % 4
    cell = F.when(z == 0, "% Hemolysis").when(z == 1, "mbc and, after, LC50").when(z == 2, "hemolytic MIC").otherwise("MICs, xMBC")
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(z == 1, "MBC").otherwise(measure.endpoint_override(cell)).alias("endpoint"), F.array_join(measure.endpoints_in(cell), ",").alias("every"))
    return p


@register("f39_safe_numbers", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN p_retailprice WHEN 1 THEN -1500.0 WHEN 2 THEN NULL ELSE NULL END AS x FROM part")
def f39_safe_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("p_size") % 4
    raw = F.when(z == 0, F.concat(F.lit(" "), F.col("p_retailprice").cast("string"))).when(z == 1, "-1.5e3").when(z == 2, "12 %").otherwise("")
    return table(spark, sf_dir, "part").select("p_partkey", text.to_double(raw).alias("x"))


# --- tables of articles --------------------------------------------------------------------------------------------

_TWO = "part"


def _row(*cells: object) -> object:
    cell = lambda c: F.concat(F.lit("<td>"), F.lit(c) if isinstance(c, str) else c, F.lit("</td>"))
    return F.concat(F.lit("<tr>"), *[cell(c) for c in cells], F.lit("</tr>"))


def _article(spark: SparkSession, sf_dir: str, *parts: object, caption: object = "Values") -> DataFrame:
    """Articles with a table of two sequences, and a further table of the rows given."""
    names = F.concat(F.lit('<article><table-wrap id="t1"><table>'), _row("Peptide name", "Sequence"), _row("Pep-A", "ACDKLLKWGG"), _row("Pep-B", "EFGKLLKWHH"), F.lit('</table></table-wrap><table-wrap id="t2"><caption>'))
    xml = F.concat(names, F.lit(caption) if isinstance(caption, str) else caption, F.lit("</caption><table>"), *parts, F.lit("</table></table-wrap></article>"))
    return tables.tables_of(tables.articles(table(spark, sf_dir, "part").select("p_partkey", xml.alias("xml")), "xml", "p_partkey"))


@register(
    "t3_transposed_tables",
    f"""WITH v AS (SELECT unnest(['pepa', 'pepb', 'pepa', 'pepb', 'pepa', 'pepb']) AS norm_id, unnest(['MIC', 'MIC', 'MBC', 'MBC', 'MBC', 'MBC']) AS endpoint, unnest([0, 1, 2, 3, 7, 8]) AS d, unnest(['MIC (µM)', 'MIC (µM)', 'MBC (µM)', 'MBC (µM)', 'E. coli', 'E. coli']) AS condition)
SELECT p_partkey AS doc, norm_id, endpoint, (p_size + d)::DOUBLE AS value, 'µM' AS unit, condition, 'transposed' AS layout, CASE norm_id WHEN 'pepa' THEN 'ACDKLLKWGG' ELSE 'EFGKLLKWHH' END AS sequence FROM {_TWO.replace('part', 'part, v', 1)}""",
)
def t3_transposed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in columns; a derived section, from its first row to the next endpoint, gives no records."""
    z = F.col("p_size")
    t = _article(spark, sf_dir, _row("Strain", "Pep-A", "Pep-B"), _row("MIC (µM)", z, z + 1), _row("Geometric mean", z, z), _row("Strain x", z, z), _row("MBC (µM)", z + 2, z + 3), _row("TI", z, z), _row("MBC (µM)", "", ""), _row("E. coli", z + 7, z + 8))
    return tables.experimental_records(t).select("doc", "norm_id", "endpoint", "value", "unit", "condition", "layout", "sequence")


@register("t7_id_column_by_agreement", "SELECT p_partkey AS doc, CASE i % 2 WHEN 0 THEN 'pepa' ELSE 'pepb' END AS norm_id, (p_size + i)::DOUBLE AS value FROM part, (SELECT unnest([0, 1, 2, 3]) AS i)")
def t7_id_column_by_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column named like ids holds other names; that whose cells are known ids is taken."""
    z = F.col("p_size")
    t = _article(spark, sf_dir, _row("Sample", "What", "IC50 (µM)"), _row("one", "Pep A", z), _row("two", "pep-b", z + 1), _row("three", "PEP-A", z + 2), _row("four", "Pep.B", z + 3), _row("five", "x", z + 4))
    return tables.experimental_records(t).select("doc", "norm_id", "value")


@register("p12_computational_tables", f"SELECT p_partkey AS doc, count(*) AS n FROM part, (SELECT unnest([1, 2]) AS i) WHERE p_size % 4 = 3 GROUP BY p_partkey")
def p12_computational_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of tables with the same cells those with a computational caption give no records."""
    z = F.col("p_size")
    caption = F.when(z % 4 == 0, "In silico values").when(z % 4 == 1, "Predictive model").when(z % 4 == 2, "by a web server").otherwise("Unpredicted values")
    t = _article(spark, sf_dir, _row("Peptide", "IC50 (µM)"), _row("Pep-A", z), _row("Pep-B", z), caption=caption)
    return tables.experimental_records(t).groupBy("doc").agg(F.count("*").alias("n"))


@register("t9_same_row_records", f"SELECT p_partkey AS doc, s AS sequence, e AS endpoint, v::DOUBLE AS value, 'µM' AS unit FROM part, (SELECT unnest(['ACDKLLKWGGHHKL', 'EFGKLLKWHHEEKL']) AS s), (SELECT unnest(['MIC', 'MBC']) AS e) CROSS JOIN LATERAL (SELECT CASE e WHEN 'MIC' THEN p_size ELSE p_size + 3 END AS v)")
def t9_same_row_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("p_size")
    t = _article(spark, sf_dir, _row("x", "ACDKLLKWGGHHKL", "EFGKLLKWHHEEKL", F.concat(F.lit("MIC "), z, F.lit(" µM")), F.concat(F.lit("MBC "), z + 3, F.lit(" µM"))), _row("no sequence", F.concat(F.lit("MIC "), z, F.lit(" µM")), "", "", ""))
    return tables.same_row_records(t).select("doc", "sequence", "endpoint", "value", "unit")


@register("t8_all_entities", f"SELECT p_partkey AS doc, unnest(['sequence', 'endpoint_value', 'condition']) AS kind, unnest(['ACDKLLKWGGHHKL', 'MIC ' || p_size || ' µM', 'pH 7.4']) AS entity FROM {_TWO}")
def t8_all_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _article(spark, sf_dir, _row("x", "ACDKLLKWGGHHKL", F.concat(F.lit("MIC "), F.col("p_size"), F.lit(" µM at pH 7.4"))))
    return tables.cell_entities(t).where("table_id = 't2'").select("doc", "kind", "entity")


@register("f20_numeric_columns", "SELECT p_partkey, p_size % 3 = 0 AS first, p_size % 3 <> 2 AS second FROM part")
def f20_numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """If a column has numbers under a hint of endpoint and unit."""
    z = F.col("p_size") % 3
    cells = F.array(F.array(F.lit("a"), F.lit("")), F.array(F.when(z == 0, "12").otherwise("x1"), F.when(z == 2, "none").otherwise("5 (>6)")))
    has = lambda c: F.pandas_udf(lambda s: s.map(lambda rows: tables.has_numbers([list(r) for r in rows], c, "MIC", "µM")), "boolean")(cells)
    return table(spark, sf_dir, "part").select("p_partkey", has(0).alias("first"), has(1).alias("second"))


@register("f36_skipped_rows", "SELECT p_partkey, p_size % 5 IN (0, 1, 2, 4) AS skipped, p_size % 5 IN (0, 1) AS derived FROM part")
def f36_skipped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("p_size") % 5
    label = F.when(z == 0, "TI**").when(z == 1, " Geometric  MEAN of all").when(z == 2, "95 % interval").when(z == 3, "S. aureus").otherwise(" ")
    run = lambda f: F.pandas_udf(lambda s: s.map(f), "boolean")(label)
    return table(spark, sf_dir, "part").select("p_partkey", run(tables.skipped_condition).alias("skipped"), run(tables.starts_derived).alias("derived"))
