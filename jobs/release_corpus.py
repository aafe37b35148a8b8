"""Release of a labelled corpus: documents and labels in, leakage-free training, validation and test sets out.

    spark-submit jobs/release_corpus.py --documents IN --labels IN --output OUT [--config jobs/release_corpus.json]

Reads documents (doc_id, text, source) and labels (doc_id, a label of 0 or 1), and writes below OUT

    counters/   per source: rows, kept, dropped without label or as too short, changed by normalising, by label      (JSON)
    resolved/   a row for each distinct normalised text: its labels, sources, first document, cluster               (Parquet, by conflict)
    corpus/     the release: a row for each text without a label conflict, with the text and its split               (Parquet, by split and label)
    report/     rows and clusters by split and label                                                                 (JSON)

Texts that agree in their letters alone are one cluster, and a cluster is in one split. Splits are stratified by the label of the cluster's first text and go by
the hash of the cluster, so a rerun, or a run on another cluster of machines, gives the same rows. Each folder is replaced as a whole: a
broken run is mended by running again, and readers take a folder that has _SUCCESS.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark import StorageLevel  # noqa: E402
from pyspark.sql import Column, DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tessera.functions.text import normalize_whitespace  # noqa: E402
from tessera.operators import dedup, splits  # noqa: E402

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "release_corpus.json")
CORPUS = "key string, doc_id long, cluster_id string, n_records long, n_source_datasets long, source_datasets string, text string, split string, label int"
log = logging.getLogger("release_corpus")


def load_config(path: str = CONFIG) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _digest(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, min_words: int) -> DataFrame:
    """Each document with its label (null without one), the digests of its normalised text and of the text as it is, its cluster, and whether it is long enough.

    Rows of `labels` without an id say nothing; of several for one id the least counts, so that no document is multiplied.
    """
    one = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"))
    plain = F.lower(normalize_whitespace(F.col("text")))
    rows = documents.select("doc_id", "text", F.coalesce("source", F.lit("unknown")).alias("source")).withColumn("plain", plain)
    rows = rows.select(
        "doc_id",
        "source",
        _digest(F.col("plain")).alias("key"),
        _digest(F.regexp_replace("plain", "[^a-z]", "")).alias("cluster_id"),
        _digest(F.coalesce("text", F.lit(""))).alias("text_key"),
        (F.when(F.col("plain") == "", 0).otherwise(F.size(F.split("plain", " "))) >= min_words).alias("long_enough"),
        (F.col("plain") != F.coalesce("text", F.lit(""))).alias("changed"),
    )
    return rows.join(one, "doc_id", "left")


def read_corpus(spark: SparkSession, output: str) -> DataFrame:
    """The release as written, an empty one too."""
    return spark.read.schema(CORPUS).parquet(f"{output}/corpus")


def release_corpus(spark: SparkSession, documents: str, labels: str, output: str, config: dict | None = None) -> dict:
    """Runs the job; gives the counts that it logged."""
    config = {**load_config(), **(config or {})}
    docs = spark.read.parquet(documents)
    log.info("reading %s and %s", documents, labels)
    # Normalised once: what follows reads the digests, not the texts, several times.
    rows = labelled_texts(docs, spark.read.parquet(labels), config["label"], config["min_words"]).persist(StorageLevel.DISK_ONLY)

    counters = dedup.ingest_counters(rows, "source", F.col("long_enough"), F.col("changed"))
    counters.coalesce(1).write.mode("overwrite").json(f"{output}/counters")

    kept = rows.where("label IS NOT NULL AND long_enough")
    first = kept.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("cluster_id").alias("cluster_id"))
    deduped = dedup.dedup_with_conflicts(kept, key="key", dataset="source", project=None).join(first, "key")
    deduped.write.mode("overwrite").partitionBy("conflict").parquet(f"{output}/resolved")
    held = spark.read.schema(deduped.schema).parquet(f"{output}/resolved")
    resolved = dedup.resolved(held)

    clusters = resolved.groupBy("cluster_id").agg(F.min_by("label", "key").alias("label"), F.count("*").alias("size"))
    clusters = splits.stratified_split(clusters, "cluster_id", "label", tuple(config["sizes"]), tuple(config["splits"]), config["seed"])
    placed = splits.propagate_split(resolved, clusters.select("cluster_id", "split"))
    placed = placed.select("key", "doc_id", "cluster_id", "split", "label", "n_records", "n_source_datasets", "source_datasets")
    # The text of the first document; rows repeated under one id with one text are one.
    picked = rows.join(placed.select("key", "doc_id"), ["key", "doc_id"], "left_semi").select("key", "doc_id", "text_key").distinct()
    texts = docs.select("doc_id", "text", _digest(F.coalesce("text", F.lit(""))).alias("text_key")).join(picked, ["doc_id", "text_key"]).groupBy("key").agg(F.min("text").alias("text"))
    corpus = placed.join(texts, "key")
    # Rebalanced, not repartitioned: a large split is written by many tasks, in files of the session's advisory size.
    corpus.hint("rebalance", F.col("split"), F.col("label")).write.mode("overwrite").partitionBy("split", "label").parquet(f"{output}/corpus")

    rows.unpersist()

    written = read_corpus(spark, output)
    report = written.groupBy("split", "label").agg(F.count("*").alias("texts"), F.count_distinct("cluster_id").alias("clusters"), F.sum("n_records").alias("records"))
    report.coalesce(1).write.mode("overwrite").json(f"{output}/report")

    read = spark.read.schema(counters.schema).json(f"{output}/counters").agg(F.sum("total"), F.sum("kept"), F.sum("dropped_label"), F.sum("dropped_invalid")).first()
    counts = dict(zip(("read", "kept", "without_label", "too_short"), (int(x or 0) for x in read), strict=True))
    counts["conflicts"] = held.where("conflict").count()
    for row in spark.read.schema(report.schema).json(f"{output}/report").orderBy("split", "label").collect():
        counts[f"{row['split']}/{row['label']}"] = row["texts"]
        log.info("wrote %s/corpus split=%s label=%s: %d texts of %d records in %d clusters", output, row["split"], row["label"], row["texts"], row["records"], row["clusters"])
    log.info("read %(read)d documents: %(kept)d kept, %(without_label)d without a label, %(too_short)d too short; %(conflicts)d texts with conflicting labels left out", counts)
    return counts


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "labels", "output"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=CONFIG)
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("release_corpus").getOrCreate()
    try:
        release_corpus(spark, args.documents, args.labels, args.output, load_config(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
