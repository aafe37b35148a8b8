"""The jobs as queries: each runs twice into a new folder below spark.checkpoint.dir, which stays, and its output is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.catalog import register
from tessera.plans.corpus import _PLAIN
from tessera.sources.scratch import shared_folder


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register(
    "job1_release_corpus",
    rf"""WITH l AS (SELECT doc_id, min(toxic) AS label FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
p AS (SELECT doc_id, coalesce(source, 'unknown') AS source, lower({_PLAIN}) AS plain, text FROM documents),
r AS (SELECT p.doc_id, p.source, md5(plain) AS key, md5(regexp_replace(plain, '[^a-z]', '', 'g')) AS cluster_id, l.label, text FROM p JOIN l ON p.doc_id = l.doc_id
  WHERE label IS NOT NULL AND CASE WHEN plain = '' THEN 0 ELSE 1 + length(plain) - length(replace(plain, ' ', '')) END >= 3),
k AS (SELECT key, min(doc_id) AS doc_id, any_value(cluster_id) AS cluster_id, min(label) AS label, count(*) AS n_records, count(DISTINCT source) AS n_source_datasets, string_agg(DISTINCT source, ';' ORDER BY source) AS source_datasets
  FROM r GROUP BY key HAVING count(DISTINCT label) = 1),
c AS (SELECT cluster_id, arg_min(label, key) AS label FROM k GROUP BY cluster_id),
x AS (SELECT cluster_id, row_number() OVER (PARTITION BY label ORDER BY md5('69:' || cluster_id), cluster_id) AS i, count(*) OVER (PARTITION BY label) AS n FROM c),
s AS (SELECT cluster_id, CASE WHEN i <= floor(n * 0.8::DOUBLE + 0.5) THEN 'train' WHEN i <= floor(n * 0.9::DOUBLE + 0.5) THEN 'val' ELSE 'test' END AS split FROM x)
SELECT k.key, k.doc_id, k.cluster_id, s.split, k.label, k.n_records, k.n_source_datasets, k.source_datasets, (SELECT min(text) FROM r WHERE r.key = k.key AND r.doc_id = k.doc_id) AS text FROM k JOIN s ON k.cluster_id = s.cluster_id""",
)
def job1_release_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobs.release_corpus import read_corpus, release_corpus

    output = _folder(spark, "job1")
    for _ in range(2):
        release_corpus(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", output)
    return read_corpus(spark, output)


@register(
    "job2_ingest_documents",
    f"""WITH l AS (SELECT doc_id, min(toxic) AS label FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
r AS (SELECT d.doc_id, coalesce(source, 'unknown') AS source, md5(lower({_PLAIN})) AS key, l.label FROM documents d LEFT JOIN l ON d.doc_id = l.doc_id WHERE {_PLAIN} <> '')
SELECT key, min(doc_id) AS doc_id, count(*) AS n_records, count(DISTINCT source) AS n_source_datasets, string_agg(DISTINCT source, ';' ORDER BY source) AS source_datasets, coalesce(string_agg(DISTINCT CAST(label AS VARCHAR), ',' ORDER BY CAST(label AS VARCHAR)), '') AS labels,
  count(DISTINCT label) > 1 AS conflict, CASE WHEN count(DISTINCT label) = 1 THEN min(label) END AS label FROM r GROUP BY key""",
)
def job2_ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from jobs.ingest_documents import ingest_documents, read_catalogue

    folder = _folder(spark, "job2")
    for _ in range(2):  # a glob, as the table may be a file or a folder
        ingest_documents(spark, f"{sf_dir}/{{documents}}.parquet", f"{sf_dir}/labels.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return read_catalogue(spark, f"{folder}/out").withColumn("labels", F.concat_ws(",", F.col("labels").cast("array<string>"))).drop("bucket")
