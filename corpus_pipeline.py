"""A corpus from documents to a mix: toxic texts, copies, near copies and benchmark passages go, then sources are weighed.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, and returns the documents that stay with the
columns of documents; the last returns the mix: documents with at least one copy in it, with size, source_size, target
and taken (words taken, copies counted), which stand in place of columns of these names that documents may have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import materialize
from tessera.llm.decontaminate import decontaminate
from tessera.llm.exact_dedup import drop_copies
from tessera.llm.mixing import mix
from tessera.llm.near_dedup import drop_near_copies
from tessera.llm.toxicity import drop_toxic

#: Near copies of the pipeline: five-word shingles, Jaccard similarity of at least 80 %; bands that lose such a pair with probability 6e-7.
NEAR = {"percent": 80, "bands": 36, "rows": 5}


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold of the toxicity classifier."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return drop_copies(docs, keep="largest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id."""
    return drop_near_copies(docs, **NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated with benchmark passages."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: What the last stage adds.
MIX = ["size", "source_size", "target", "taken"]


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents of which at least one copy is taken."""
    mixed = mix(docs, carry=[c for c in docs.columns if c.lower() not in MIX]).where("taken > 0")
    return mixed.select("row.*", *MIX)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
]
#: The toxicity stage is a trained classifier: no SQL for the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name.split()[0].lower())
    return docs
