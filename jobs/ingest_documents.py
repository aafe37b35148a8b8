"""Incremental ingest: new document files are added to a catalogue of distinct texts with their sources and label conflicts.

    spark-submit jobs/ingest_documents.py --documents IN --labels IN --output OUT --checkpoint CHECKPOINT [--config jobs/ingest_documents.json]

IN is a folder to which Parquet files are added, or a glob of files and folders. A run takes the files that no earlier run has taken (a file stream with
its checkpoint; it ends when there are none left), and writes below OUT

    ledger/      what each batch brought, by normalised text, source and label                 (Parquet, by batch and bucket)
    counters/    per batch and source: rows, kept, without label, empty, by label              (Parquet, by batch)
    catalogue/   a row for each text seen so far: labels, conflict, records, sources, first id  (Parquet, by bucket)

The ledger is only added to. A text is always in the same bucket, so a batch rewrites those buckets of the catalogue in which it has texts, from their
ledger entries; a text whose second label arrives later turns into a conflict then. All that a batch writes is named by its number or is a function
of the ledger, so a batch that is run again after a failure replaces its own rows and counts nothing twice. Labels are looked up when a document arrives.
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tessera.functions.text import normalize_whitespace  # noqa: E402
from tessera.operators import dedup  # noqa: E402

CONFIG = os.path.join(os.path.dirname(os.path.abspath(__file__)), "ingest_documents.json")
LEDGER = "key string, source string, label int, n_records long, doc_id long, batch long, bucket int"
COUNTERS = "source string, total long, kept long, dropped_label long, dropped_invalid long, changed long, label_0 long, label_1 long, batch long"
CATALOGUE = "key string, doc_id long, labels array<int>, n_records long, n_source_datasets long, source_datasets string, conflict boolean, label int, bucket int"
log = logging.getLogger("ingest_documents")


def load_config(path: str = CONFIG) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def entries(documents: DataFrame, labels: DataFrame, label: str, buckets: int) -> DataFrame:
    """(key, source, label, n_records, doc_id, bucket): records of a normalised text by source and label, with the least document id.

    Counted before anything is written, so copies of one text, however many, are a row a source. An empty text has no key and is left out.
    """
    plain = F.lower(normalize_whitespace(F.col("text")))
    rows = documents.select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), F.md5(plain.cast("binary")).alias("key"), (plain != "").alias("valid"))
    one = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).alias("label"))
    grouped = rows.where("valid").join(one, "doc_id", "left").groupBy("key", "source", "label").agg(F.count("*").alias("n_records"), F.min("doc_id").alias("doc_id"))
    return grouped.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))


def catalogue(ledger: DataFrame) -> DataFrame:
    """A row for each text: labels, conflict, label (null on conflict or without one), records, sources, the first document."""
    return ledger.groupBy("bucket", "key").agg(
        F.min("doc_id").alias("doc_id"),
        F.array_sort(F.collect_set("label")).alias("labels"),
        F.sum("n_records").alias("n_records"),
        F.count_distinct("source").alias("n_source_datasets"),
        F.concat_ws(";", F.array_sort(F.collect_set("source"))).alias("source_datasets"),
    ).withColumns({"conflict": F.size("labels") > 1, "label": F.when(F.size("labels") == 1, F.get("labels", F.lit(0)))})


def read_catalogue(spark: SparkSession, output: str) -> DataFrame:
    """The catalogue as it stands, an empty one too."""
    return spark.read.schema(CATALOGUE).parquet(f"{output}/catalogue")


def _replace(df: DataFrame, path: str, *by: str) -> None:
    """Writes the partitions that df has rows of, in place of theirs; others stay. A large partition is written by several tasks."""
    df.hint("rebalance", *[F.col(c) for c in by]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def take_batch(batch: DataFrame, number: int, labels: str, output: str, config: dict) -> None:
    """Adds one batch; doing so again changes nothing."""
    spark = batch.sparkSession
    known = spark.read.parquet(labels)
    new = entries(batch, known, config["label"], config["buckets"]).withColumn("batch", F.lit(number).cast("long"))
    _replace(new, f"{output}/ledger", "batch", "bucket")

    one = known.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(config["label"]).alias("label"))
    plain = normalize_whitespace(F.col("text"))
    rows = batch.select("doc_id", F.coalesce("source", F.lit("unknown")).alias("source"), (plain != "").alias("valid"), (plain != F.coalesce("text", F.lit(""))).alias("changed")).join(one, "doc_id", "left")
    counters = dedup.ingest_counters(rows, "source", F.col("valid"), F.col("changed")).withColumn("batch", F.lit(number).cast("long"))
    _replace(counters, f"{output}/counters", "batch")

    held = spark.read.schema(LEDGER).parquet(f"{output}/ledger").where(F.col("batch") <= number)
    touched = [r["bucket"] for r in held.where(F.col("batch") == number).select("bucket").distinct().collect()]
    # Without a bucket nothing is written but the empty folder, so that a catalogue without texts can be read.
    _replace(catalogue(held.where(F.col("bucket").isin(touched))), f"{output}/catalogue", "bucket")
    added = spark.read.schema(COUNTERS).parquet(f"{output}/counters").where(F.col("batch") == number).agg(F.sum("total")).first()[0]
    log.info("batch %d: %d documents read, %d of %d buckets of %s/catalogue written", number, added or 0, len(touched), config["buckets"], output)


def ingest_documents(spark: SparkSession, documents: str, labels: str, output: str, checkpoint: str, config: dict | None = None) -> dict:
    """Takes the new files and waits until they are taken; gives the number of batches and of documents of this run."""
    config = {**load_config(), **(config or {})}
    stream = spark.readStream.schema(spark.read.parquet(documents).schema)
    if config["max_files_per_batch"]:
        stream = stream.option("maxFilesPerTrigger", config["max_files_per_batch"])
    log.info("reading new files of %s", documents)
    taken: list[int] = []

    def take(batch: DataFrame, number: int) -> None:
        take_batch(batch, number, labels, output, config)
        taken.append(number)

    stream.parquet(documents).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    if not taken:
        log.info("nothing new in %s", documents)
        return {"batches": 0, "documents": 0}
    read = spark.read.schema(COUNTERS).parquet(f"{output}/counters").where(F.col("batch").isin(taken)).agg(F.sum("total")).first()[0]
    log.info("%d batches, %d documents", len(taken), read or 0)
    return {"batches": len(taken), "documents": int(read or 0)}


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__.split("\n")[0])
    for name in ("documents", "labels", "output", "checkpoint"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", default=CONFIG)
    args = parser.parse_args()
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("ingest_documents").getOrCreate()
    try:
        ingest_documents(spark, args.documents, args.labels, args.output, args.checkpoint, load_config(args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
