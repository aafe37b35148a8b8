"""Queries whose operators read or write files: inputs are made from the tables, written, and read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import measure, text
from tessera.operators import quality, sequences, similarity, tables, vectors
from tessera.plans.catalog import register
from tessera.plans.corpus import table
from tessera.plans.literature import literature_run
from tessera.sources import papers, records, sinks
from tessera.sources.scratch import scratch_path
from tessera.streaming import latest

_LETTERS = "ACDEFGHIKL"  # for the digits of a key


def _spelled(key: Column) -> Column:
    return F.concat(F.translate(key.cast("string"), "0123456789", _LETTERS), F.lit("KLLKW"))


_SPELLED = "translate(CAST(p_partkey AS VARCHAR), '0123456789', 'ACDEFGHIKL') || 'KLLKW'"


@register("s2_fasta_round_trip", "SELECT CAST(doc_id AS VARCHAR) AS seq_id, md5(s) AS sequence FROM (SELECT doc_id, translate(regexp_replace(upper(replace(coalesce(text, ''), 'ß', 'SS')), '[^A-Z]', '', 'g'), 'UZOBJ', 'XXXXX') AS s FROM documents) WHERE s <> ''")
def s2_fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "fasta")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("seq_id"), text.ingest_normalise(F.col("text")).alias("sequence")).where(text.is_valid_ingest(F.col("sequence")))
    sinks.write_fasta(d, path)
    return records.read_fasta(spark, path).select(records.record_id(F.col("header")).alias("seq_id"), F.md5(F.col("sequence").cast("binary")).alias("sequence"))


@register("s4_header_labels", "SELECT p_partkey, p_partkey % 2 AS by_prefix, p_size % 2 AS by_suffix, CASE WHEN p_size % 3 < 2 THEN p_size % 3 END AS by_last_token FROM part")
def s4_header_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, z = F.col("p_partkey"), F.col("p_size")
    p = table(spark, sf_dir, "part").select(k, F.concat(F.when(k % 2 == 1, "Pos_").otherwise("neg"), k).alias("a"), F.concat(k, F.lit("|x|"), z % 2).alias("b"), F.concat(k, F.lit(" d "), z % 3).alias("c"))
    return p.select("p_partkey", records.LABELS["prefix"](F.col("a")).cast("long").alias("by_prefix"), records.LABELS["suffix"](F.col("b")).alias("by_suffix"), records.LABELS["last_token"](F.col("c")).alias("by_last_token"))


@register("s10_cluster_text", "SELECT 'c' || source AS cluster_id, 'd' || doc_id AS seq_id, doc_id = min(doc_id) OVER (PARTITION BY source) AS is_representative FROM documents")
def s10_cluster_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "clusters")
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.sort_array(F.collect_list("doc_id")).alias("ids"))
    line = lambda x, i: F.concat(i.cast("string"), F.lit("\t9aa, >d"), x.cast("string"), F.lit("... "), F.when(i == 0, "*").otherwise("at 91%"))
    d.select(F.concat(F.lit(">Cluster c"), "source", F.lit("\n"), F.array_join(F.transform("ids", line), "\n")).alias("value")).write.text(path)
    return similarity.parse_clusters(records.read_records(spark, path)).select("cluster_id", "seq_id", "is_representative")


@register("s11_alignment_rows", "SELECT p_partkey, regexp_replace(regexp_replace(upper(p_brand), '[^ACDEFGHIKLMNPQRSTVWY-]', '-', 'g'), '', '', 'g') AS aligned FROM part")
def s11_alignment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "alignment")
    table(spark, sf_dir, "part").coalesce(1).select(F.concat(F.lit(">"), "p_partkey", F.lit("\n"), F.upper("p_brand"), F.lit("xyz*")).alias("value")).write.text(path)
    a = records.read_alignment(spark, path, most=1 << 30, same_width=False)
    header = records.read_records(spark, path).select("file", "offset", records.record_id(F.col("header")).cast("long").alias("p_partkey"))
    rank = F.row_number().over(_by_offset()) - 1
    return a.join(header.withColumn("row", rank).select(F.col("file").alias("aln_id"), "row", "p_partkey"), ["aln_id", "row"]).select("p_partkey", "aligned")


def _by_offset():  # noqa: ANN202
    from pyspark.sql import Window as W

    return W.partitionBy("file").orderBy("offset")


@register(
    "t13_manifest_summary",
    """WITH e AS (SELECT 'PMC' || (user_id % 50) AS key, event_id, event_type FROM events), l AS (SELECT key, max(event_id) AS event_id FROM e GROUP BY key)
SELECT l.key, l.key AS input, '10.1/' || l.event_id AS doi, NULL AS pmid, false AS pdf_ok, e.event_type = 'click' AS xml_ok, l.event_id % 3 = 0 AS supp_ok, false AS package_ok, false AS pdf_extracted, CASE WHEN l.event_id % 3 = 0 THEN 2 ELSE 0 END AS supp_extracted, l.key AS stem FROM l JOIN e ON e.event_id = l.event_id""",
)
def t13_manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "manifest")
    e = table(spark, sf_dir, "events").withColumn("key", F.concat(F.lit("PMC"), F.col("user_id") % 50))
    action = F.struct(F.lit("xml").alias("kind"), F.struct(F.when(F.col("event_type") == "click", "ok").otherwise("failed").alias("status")).alias("download"), F.struct(F.concat(F.lit("10.1/"), "event_id").alias("doi")).alias("meta"), F.struct(F.when(F.col("event_id") % 3 == 0, 2).otherwise(0).alias("extracted_supp_files")).alias("extract"))
    # Several files, whose names are in the order of the events, as the manifest's later lines win.
    lines = e.repartitionByRange("event_id").sortWithinPartitions("event_id").select(F.to_json(F.struct(F.col("key").alias("input"), F.array(action).alias("actions"))).alias("value"))
    lines.union(spark.createDataFrame([("{broken",), ("",)], "value string").coalesce(1)).write.text(path)
    return papers.manifest_summary(papers.read_manifest(spark, path)).select("key", "input", "doi", "pmid", "pdf_ok", "xml_ok", "supp_ok", "package_ok", "pdf_extracted", "supp_extracted", "stem")


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.articles(_article_texts(spark, sf_dir), "xml", "doc")


def _article_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An article for each brand: a table of sequences, one of values by id, and one with ids in columns."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", _spelled(F.col("p_partkey")).alias("seq"))
    tag = lambda t, c: F.concat(F.lit(f"<{t}>"), c, F.lit(f"</{t}>"))
    name = F.concat(F.lit("Pep-"), F.col("p_partkey"))
    a = p.groupBy("p_brand").agg(
        F.concat_ws("", F.collect_list(tag("tr", F.concat(tag("td", name), tag("td", F.concat("seq", F.lit("-NH2"))))))).alias("s"),
        F.concat_ws("", F.collect_list(tag("tr", F.concat(tag("td", F.concat(F.lit("PEP "), F.col("p_partkey"))), tag("td", F.concat("p_size", F.lit(" (>"), F.col("p_size") * 2, F.lit(")"))), tag("td", F.col("p_size").cast("string")))))).alias("v"),
    )
    xml = F.concat(
        F.lit('<article><article-id pub-id-type="pmc">7</article-id><body><p>It is toxic if large. The end.</p></body><table-wrap id="t1"><caption>Peptides</caption><table><tr><th>Peptide name</th><th>Sequence</th></tr>'), "s",
        F.lit('</table></table-wrap><table-wrap id="t2"><caption>Activity</caption><table><tr><th>Peptide</th><th>MIC/MBC (µM)</th><th>n</th></tr>'), "v", F.lit("</table></table-wrap></article>"),
    )
    return a.select(F.col("p_brand").alias("doc"), xml.alias("xml"))


@register("t2_joined_records", f"SELECT p_brand AS doc, 'pep' || p_partkey AS norm_id, e AS endpoint, CASE WHEN e = 'MBC' THEN '>' ELSE '' END AS cmp, (CASE WHEN e = 'MBC' THEN 2 * p_size ELSE p_size END)::DOUBLE AS value, 'µM' AS unit, {_SPELLED} AS sequence FROM part, (VALUES ('MIC'), ('MBC')) AS t(e)")
def t2_joined_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.experimental_records(tables.tables_of(_articles(spark, sf_dir))).select("doc", "norm_id", "endpoint", "cmp", "value", "unit", "sequence")


@register("j7_sequence_map", f"SELECT p_brand AS doc, 'pep' || p_partkey AS norm_id, {_SPELLED} AS sequence FROM part")
def j7_sequence_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.sequence_map(tables.tables_of(_articles(spark, sf_dir))).select("doc", "norm_id", "sequence")


@register("s14_article_tables", "SELECT p_brand AS doc, t AS table_id, count(*) + 1 AS n_rows FROM part, (VALUES ('t1'), ('t2')) AS v(t) GROUP BY 1, 2")
def s14_article_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.tables_of(_articles(spark, sf_dir)).select("doc", "table_id", F.size("rows").cast("long").alias("n_rows"))


@register("t11_literature_run", "SELECT * FROM (SELECT 'sequences' AS name, count(*) AS n FROM part UNION ALL SELECT 'records', 2 * count(*) FROM part UNION ALL SELECT 'strict', count(*) FROM part UNION ALL SELECT 'thresholds', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'scores', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'without', 1) AS t")
def t11_literature_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole run over the articles and one without tables: rows of its results."""
    xml = _article_texts(spark, sf_dir).unionByName(spark.createDataFrame([("none", "<article><body><p>No tables.</p></body></article>")], "doc string, xml string"))
    run = literature_run(xml)
    of = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    out = of("strict", run["records"].where("train_ready_strict"))
    for name in ("sequences", "records", "thresholds", "scores", "without"):
        out = out.unionByName(of(name, run[name]))
    return out


@register("t10_threshold_sentences", "SELECT DISTINCT p_brand AS doc, 'It is toxic if large.' AS sentence FROM part")
def t10_threshold_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.threshold_sentences(_articles(spark, sf_dir)).select("doc", "sentence")


@register("a30_paper_scores", f"SELECT doc, (n >= 2)::INT AS seq_tables, 0 AS endpoint_tables, 0 AS value_cells, 'MBC,MIC' AS hints, 1 + 3 * (n >= 2)::INT AS score FROM (SELECT p_brand AS doc, count(*) FILTER (WHERE length({_SPELLED}) >= 8) AS n FROM part GROUP BY p_brand) AS t")
def a30_paper_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.paper_scores(tables.tables_of(_articles(spark, sf_dir))).withColumn("hints", F.array_join("hints", ","))


@register("f34_scored_cells", "SELECT p_partkey AS doc, 1 AS seq_tables, CASE WHEN p_size % 3 > 0 THEN 1 ELSE 0 END AS endpoint_tables, 2 + p_size % 7 AS value_cells_at_most, CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN 'IC50' ELSE 'hemolysis,toxicity' END AS hints, 3 + 3 * (p_size % 3 > 0)::INT + (2 + p_size % 7 >= 5)::INT + (p_size % 3 = 1)::INT AS score FROM part")
def f34_scored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of sequences and of values with units counted, all of them; soft words only where there is no endpoint."""
    z = F.col("p_size")
    row = lambda a, b: F.concat(F.lit("<tr><td>"), F.lit(a), F.lit("</td><td>"), F.lit(b), F.lit("</td></tr>"))
    values = F.array_join(F.transform(F.sequence(F.lit(1), (2 + z % 7).cast("int")), lambda i: F.concat(F.lit("<tr><td>ACDKLLKWGG</td><td>"), i.cast("string"), F.lit(" mg/L</td></tr>"))), "")
    caption = F.when(z % 3 == 0, "Yields").when(z % 3 == 1, "IC50 and toxicity").otherwise("toxicity, hemolysis")
    xml = F.concat(F.lit('<article><table-wrap id="t"><caption>'), caption, F.lit("</caption><table>"), row("Sequence", "Value"), values, F.lit("</table></table-wrap></article>"))
    scored = tables.paper_scores(tables.tables_of(tables.articles(table(spark, sf_dir, "part").select("p_partkey", xml.alias("xml")), "xml", "p_partkey")))
    return scored.select("doc", "seq_tables", "endpoint_tables", F.col("value_cells").alias("value_cells_at_most"), F.array_join("hints", ",").alias("hints"), "score")


@register("t8_cell_entities", f"SELECT p_brand AS doc, 't1' AS table_id, {_SPELLED} AS entity FROM part")
def t8_cell_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cell_entities(tables.tables_of(_articles(spark, sf_dir)), 6).where(F.col("kind") == "sequence").where(F.col("entity").endswith("KLLKW")).select("doc", "table_id", "entity")


@register("t1_span_matrices", "SELECT p_partkey, 'a' || p_size || ',b,b;a' || p_size || ',c,d' AS matrix FROM part")
def t1_span_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    html = F.concat(F.lit("<table><tr><td rowspan='2'>a"), "p_size", F.lit("</td><td colspan=2>b</td></tr><tr><td>c</td><td> d </td></tr><tr><td> </td></tr></table>"))
    parse = F.pandas_udf(lambda s: s.map(lambda h: ";".join(",".join(r) for r in tables.html_tables(h)[0])), "string")
    return tables.dealt(table(spark, sf_dir, "part")).select("p_partkey", parse(html).alias("matrix"))


@register("a31_title_scores", "SELECT p_partkey, 2 + 2 * (p_size % 2) + (p_size % 3 = 0)::INT + (p_size % 5 = 0)::INT AS score FROM part")
def a31_title_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("p_size")
    title = F.concat(F.lit("Antimicrobial study"), F.when(z % 2 == 1, F.lit(" IC50")).otherwise(F.lit("")), F.when(z % 3 == 0, F.lit(" of toxicity")).otherwise(F.lit("")))
    return table(spark, sf_dir, "part").select("p_partkey", tables.title_score(title, F.when(z % 5 == 0, "y").otherwise("N"), F.lit(None).cast("string")).alias("score"))


@register("f21_paired_values", "SELECT p_partkey, p_size::DOUBLE AS first, (p_size * 2)::DOUBLE AS second, CASE WHEN p_size % 2 = 0 THEN '>' ELSE '' END AS second_cmp FROM part")
def f21_paired_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("p_size")
    cell = F.when(z % 2 == 0, F.concat(z, F.lit(" (>"), z * 2, F.lit(")"))).otherwise(F.concat(z, F.lit("/"), z * 2))
    p = table(spark, sf_dir, "part").select("p_partkey", measure.paired_values(cell).alias("v"))
    return p.select("p_partkey", F.col("v")[0]["value"].alias("first"), F.col("v")[1]["value"].alias("second"), F.col("v")[1]["cmp"].alias("second_cmp"))


@register("f8_canonical_sequences", f"SELECT p_partkey, {_SPELLED} AS sequence FROM part")
def f8_canonical_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spelled(F.col("p_partkey"))
    cell = F.concat(F.lit("color=red>"), F.substring(s, F.lit(1), F.lit(2)), F.lit("- *"), F.substring(s, F.lit(3), F.length(s)), F.lit(" – NH2"))
    return table(spark, sf_dir, "part").select("p_partkey", text.canonical_sequence(cell, 5).alias("sequence"))


@register("f22_context_values", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS value FROM part")
def f22_context_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", text.context_value(F.concat(F.lit("a=1; k="), "p_size", F.lit(" ;k=9")), "k").alias("value"))


@register("p5_letter_codes", "WITH n AS (SELECT n_nationkey, unnest(string_split(regexp_replace(upper(n_name), '', '', 'g'), '')) AS c FROM nation) SELECT n_nationkey, CAST(sum(strpos('ACDEFGHIKLMNPQRSTVWY', c)) AS BIGINT) AS total FROM n WHERE c <> '' GROUP BY n_nationkey")
def p5_letter_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = text.encode_letters(F.upper("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.aggregate(codes, F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@register("f32_digest_join", "SELECT doc_id, min(doc_id) OVER (PARTITION BY substr(sha1(text), 1, 16)) AS first, count(*) OVER (PARTITION BY substr(sha1(text), 1, 16)) AS n FROM documents WHERE text IS NOT NULL")
def f32_digest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", text.short_digest(F.col("text")).alias("k"))
    return d.join(d.groupBy("k").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "k").select("doc_id", "first", "n")


@register("k7_split_export", "SELECT CASE WHEN doc_id % 3 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS total FROM labels GROUP BY 1")
def k7_split_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    sinks.write_by_split(table(spark, sf_dir, "labels").withColumn("split", F.when(F.col("doc_id") % 3 == 0, "test").otherwise("train")), path)
    back = spark.read.schema("doc_id long, quality int, toxic int, split string").option("header", True).csv(path)
    return back.groupBy("split").agg(F.count("*").alias("n"), F.sum("doc_id").alias("total"))


@register("k2_json_round_trip", "SELECT doc_id, md5(text) AS digest, source FROM documents")
def k2_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "json")
    d = table(spark, sf_dir, "documents").select("doc_id", F.struct("text", "source").alias("record"))
    sinks.write_jsonl(d, path)
    return spark.read.schema(d.schema).json(path).select("doc_id", F.md5(F.col("record.text").cast("binary")).alias("digest"), "record.source")


@register("a25_column_profile", """WITH p AS (SELECT p_brand, p_partkey, p_name, unnest(generate_series(1, length(p_name))) AS i FROM part), c AS (SELECT p_brand AS aln_id, i - 1 AS pos, replace(upper(substr(p_name, i, 1)), ' ', '-') AS letter, count(*) AS n FROM p GROUP BY 1, 2, 3)
SELECT aln_id, pos, letter, round(n / sum(n) OVER (PARTITION BY aln_id, pos), 9) AS freq FROM c WHERE letter <> '-'""")
def a25_column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("aln_id"), F.col("p_partkey").alias("row"), F.translate(F.upper("p_name"), " ", "-").alias("aligned"))
    return sequences.column_profile(p).select("aln_id", F.col("pos").cast("long").alias("pos"), "letter", F.round("freq", 9).alias("freq"))


@register("l3_graph_edges", "WITH s AS (SELECT l.lang AS src, r.lang AS dst, (abs(l.n - r.n) % 7) AS score FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang) l, (SELECT lang, count(*) AS n FROM documents GROUP BY lang) r) SELECT src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS k FROM s WHERE src <> dst) WHERE k <= least(2, greatest(1, (SELECT count(DISTINCT lang) FROM documents) - 1)) UNION ALL SELECT DISTINCT lang, lang FROM documents")
def l3_graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    s = n.select(F.col("lang").alias("src"), F.col("n").alias("a")).join(n.select(F.col("lang").alias("dst"), F.col("n").alias("b"))).select(F.lit(0).alias("graph_id"), "src", "dst", (F.abs(F.col("a") - F.col("b")) % 7).alias("score"))
    return vectors.top_neighbours(s, 2, self_loops=True).select("src", "dst")


@register("a29_coverage", "SELECT count(*) FILTER (doc_id % 4 = 0) AS found, count(*) FILTER (doc_id % 4 = 1) AS missing, count(*) FILTER (doc_id % 4 = 2) AS empty, count(*) FILTER (doc_id % 4 = 3) AS invalid FROM documents")
def a29_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.element_at(F.array(*[F.lit(s) for s in ("found", "missing", "empty", "invalid")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return quality.coverage(table(spark, sf_dir, "documents").select(state.alias("state")))


@register("l1_ranked_candidates", "SELECT l_partkey, l_orderkey, rank FROM (SELECT l_partkey, l_orderkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount, l_tax, CAST(l_orderkey AS VARCHAR) || '-' || l_linenumber) AS rank FROM lineitem) WHERE rank <= 3")
def l1_ranked_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", F.col("l_discount").alias("p"), F.col("l_tax").alias("uncertainty"), F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("variant"))
    return sequences.rank_candidates(scored, ["l_partkey"], 3).select("l_partkey", "l_orderkey", "rank")


@register("r5_hash_sample", "SELECT doc_id FROM documents ORDER BY md5('5:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def r5_hash_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.splits import sample_rows

    return sample_rows(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, 5)


@register("s12_latest_stream", "SELECT user_id, event_id, ts, event_type FROM (SELECT user_id, event_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def s12_latest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user, kept by a stream over the table's files, which is run twice."""
    out, checkpoint = scratch_path(spark, "latest"), scratch_path(spark, "checkpoint")
    at = f"{sf_dir}/{{events}}.parquet"  # a glob, as the table may be a file or a folder
    for _ in range(2):
        events = spark.readStream.schema(spark.read.parquet(at).schema).parquet(at).select("user_id", "ts", "event_id", "event_type")
        latest.keep_latest(events, "user_id", ["ts", "event_id"], out, checkpoint)
    return latest.read_latest(spark.read.parquet(out), "user_id")
