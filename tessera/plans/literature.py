"""A literature run as one job: articles to tables, records, screen and report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import quality, tables
from tessera.sources import papers, sinks
from tessera.sources.scratch import scratch_path


def literature_run(articles: DataFrame, manifest: DataFrame | None = None, supplements: DataFrame | None = None, out: str | None = None, include_computational: bool = False) -> dict[str, DataFrame]:
    """The tables of a run by name. articles: doc, xml; manifest: latest records of a manifest, by key; supplements: tables of further files.

    records: measurements joined to sequences, screened; sequences, entities, thresholds and scores as their operators give them; summary: what was
    downloaded, if a manifest is given; without: documents that gave no record. What several of them need is written down once. out: a
    folder for CSV files of the tables, and the report.
    """
    spark = articles.sparkSession
    held = lambda df, tag: _kept(spark, df, tag)
    parsed = held(tables.articles(articles, "xml", "doc"), "articles")
    found = tables.tables_of(parsed)
    if supplements is not None:
        found = found.unionByName(supplements.select(found.columns))
    found = held(found, "tables")
    run = {
        "sequences": tables.sequence_map(found), "records": held(quality.screen(tables.experimental_records(found, include_computational)), "records"),
        "entities": tables.cell_entities(found), "thresholds": tables.threshold_sentences(parsed), "scores": tables.paper_scores(found),
    }
    run["without"] = quality.without_records(parsed.select("doc"), run["records"], "doc")
    if manifest is not None:
        run["summary"] = papers.manifest_summary(manifest)
    if out:
        for name, df in run.items():
            flat = df.select(*[F.concat_ws(";", c).alias(c) if t.startswith("array<string") else F.col(c) for c, t in df.dtypes])
            sinks.write_once(sinks.clipped(flat), f"{out}/{name}", overwrite=True)
        spark.createDataFrame([(run_report(run),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/report")
    return run


def _kept(spark: object, df: DataFrame, tag: str) -> DataFrame:
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    return spark.read.parquet(path)


def run_report(run: dict[str, DataFrame], examples: int = 12) -> str:
    """Markdown: downloads, what was extracted, records by endpoint and document, documents without records, and a few rows to check by their places."""
    records, sections = run["records"], []
    if "summary" in run:
        s = run["summary"]
        n = s.agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in ("pdf_ok", "xml_ok", "supp_ok", "package_ok")]).first()
        sections.append(("Downloads", [f"Papers: {n.n}", f"PDF: {n.pdf_ok}", f"XML: {n.xml_ok}", f"Supplementary files: {n.supp_ok}", f"Packages: {n.package_ok}", s.select("key", "doi", "pmcid", "pdf_ok", "xml_ok", "supp_extracted").orderBy("key")]))
    sections.append(("Extraction", [f"Sequences: {run['sequences'].count()}", f"Threshold sentences: {run['thresholds'].count()}", quality.value_counts(run["entities"], "kind", 12)]))
    n = records.agg(F.count("*").alias("n"), F.count_distinct("sequence").alias("d"), F.count_if("train_ready_strict").alias("s"), F.count_if("train_ready_relaxed").alias("r")).first()
    sections.append(("Records", [f"Records: {n.n}", f"Sequences with records: {n.d}", f"Ready, strict: {n.s}", f"Ready, relaxed: {n.r}", quality.value_counts(records, "endpoint", 20), quality.value_counts(records, "doc", 30)]))
    sections.append(("Documents without records", [run["without"].orderBy("doc").limit(50)]))
    cells = ["doc", "peptide_id", "sequence", "endpoint", "condition", "value", "unit", "source_ref"]
    sections.append(("Examples", [quality.examples_per_group(records.select(cells), "endpoint", ["doc", "source_ref"], examples)]))
    return sinks.report("Extraction run", sections)
