"""Exact nearest texts by TF-IDF without reading the postings of frequent grams.

Weights have unit length, so what the grams of a set N add to a similarity is at most |q_N| |d_N| (Cauchy and Schwarz). Grams are put into levels by
the power of two of the number of texts that hold them. A query's first neighbours are found by its rarest grams alone and scored whole; the k-th of these similarities is
a threshold. From some level on, the query's grams are together shorter than the threshold: a text that shares only such grams with the query cannot
be among the k best, so their postings are not read. Texts found by the other grams stay candidates if what they have, and at most can add by the frequent grams
(both lengths are known), reaches the threshold; these few are scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators.similarity import checkpointed

#: Texts that hold a gram which looks for first neighbours; first neighbours scored, a multiple of k. Both change the work, not the result.
SEED_TEXTS, SEEDS = 32, 4
LEVELS = 48
#: Similarities are rounded to 9 digits; bounds allow for it.
EPS = 1e-8


def level_of(df: Column) -> Column:
    return F.floor(F.log2(df.cast("double")) + 1e-9).cast("int")


def build_index(postings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(postings (gram, id, weight), levels (gram, df, level), texts (id, grams, weights, tails)) of TF-IDF postings of unit length.

    texts has a text's grams as numbers (64-bit hashes) with their weights, in the numbers' order, and tails: the length of its grams from each level on.
    """
    levels = postings.groupBy("gram").agg(F.count("*").alias("df")).withColumn("level", level_of(F.col("df")))
    held = F.array_sort(F.collect_list(F.struct(F.xxhash64("gram").alias("g"), F.col("weight").alias("w"), "level")))
    texts = postings.join(levels, "gram").groupBy("id").agg(held.alias("held"))
    tail = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda n: F.sqrt(F.aggregate("held", F.lit(0.0), lambda s, x: s + F.when(x["level"] >= n, x["w"] * x["w"]).otherwise(0.0))))
    return postings, levels, texts.select("id", F.col("held.g").alias("grams"), F.col("held.w").alias("weights"), tail.alias("tails"))


def _dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (query, neighbour, qg, qw, ng, nw) to whole similarities."""
    for batch in batches:
        lists = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("qg", "qw", "ng", "nw")]
        out = []
        for qg, qw, ng, nw in zip(*lists, strict=True):
            _, i, j = np.intersect1d(qg, ng, assume_unique=True, return_indices=True)
            out.append(round(float(qw[i] @ nw[j]), 9))
        yield pa.RecordBatch.from_arrays([batch.column("query"), batch.column("neighbour"), pa.array(out, pa.float64())], ["query", "neighbour", "similarity"])


def _scored(pairs: DataFrame, vectors: DataFrame, texts: DataFrame) -> DataFrame:
    """(query, neighbour, similarity) of candidate pairs, over all grams."""
    rows = pairs.select("query", "neighbour").join(vectors.select(F.col("id").alias("query"), F.col("grams").alias("qg"), F.col("weights").alias("qw")), "query")
    rows = rows.join(texts.select(F.col("id").alias("neighbour"), F.col("grams").alias("ng"), F.col("weights").alias("nw")), "neighbour").select("query", "neighbour", "qg", "qw", "ng", "nw")
    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.mapInArrow(_dot, f"query {kind('query')}, neighbour {kind('neighbour')}, similarity double")


def _without_same(pairs: DataFrame, exclude_same_id: bool, same: DataFrame | None) -> DataFrame:
    if exclude_same_id:
        pairs = pairs.where("query <> neighbour")
    if same is not None:
        key = lambda side: same.select(F.col("id").alias(side), F.col("key").alias(f"key_{side}"))
        pairs = pairs.join(key("query"), "query", "left").join(key("neighbour"), "neighbour", "left").where(~F.coalesce(F.col("key_query") == F.col("key_neighbour"), F.lit(False))).drop("key_query", "key_neighbour")
    return pairs


def _best(scored: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def bounded_knn(queries: DataFrame, index: tuple[DataFrame, DataFrame, DataFrame], k: int = 8, exclude_same_id: bool = True, same: DataFrame | None = None, read: dict | None = None) -> DataFrame:
    """(query, neighbour, similarity, rank): the k most similar texts with a positive similarity, ties by id; the same rows as grams.knn() gives.

    queries: (gram, id, weight) of unit length; index: of build_index(), best read from where it was written. same: (id, key); neighbours with the query's key are left
    out. A query with fewer than k first neighbours reads the postings of all its grams. read: filled with the postings that were read and those of all grams of the queries.
    Runs jobs when called.
    """
    postings, levels, texts = index
    q = checkpointed(queries.select("gram", F.col("id").alias("query"), F.col("weight").alias("qw")).join(levels, "gram"))
    held = F.array_sort(F.collect_list(F.struct(F.xxhash64("gram").alias("g"), F.col("qw").alias("w"))))
    vectors = q.groupBy(F.col("query").alias("id")).agg(held.alias("held")).select("id", F.col("held.g").alias("grams"), F.col("held.w").alias("weights"))
    p = postings.select("gram", F.col("id").alias("neighbour"), F.col("weight").alias("pw"))

    def by_grams(grams: DataFrame) -> DataFrame:
        found = grams.join(p, "gram").groupBy("query", "neighbour").agg(F.sum(F.col("qw") * F.col("pw")).alias("part"))
        return _without_same(found, exclude_same_id, same)

    seeds = by_grams(q.where(F.col("df") <= SEED_TEXTS))
    first = seeds.withColumn("r", F.row_number().over(W.partitionBy("query").orderBy(F.desc("part"), "neighbour"))).where(F.col("r") <= SEEDS * k)
    kth = _best(_scored(first, vectors, texts), k).groupBy("query").agg(F.when(F.count("*") == k, F.min("similarity")).alias("least"))

    lengths = q.groupBy("query", "level").agg(F.sum(F.col("qw") * F.col("qw")).alias("l2"))
    tails = lengths.select("query", "level", F.sqrt(F.sum("l2").over(W.partitionBy("query").orderBy(F.desc("level")))).alias("tail"))
    skipped = tails.join(kth, "query").where(F.col("tail") < F.col("least") - EPS)
    cut = skipped.groupBy("query").agg(F.min("level").alias("cut"), F.max_by("tail", -F.col("level")).alias("tail"), F.first("least").alias("least"))
    cut = checkpointed(q.select("query").distinct().join(cut, "query", "left").select("query", F.coalesce("cut", F.lit(LEVELS)).alias("cut"), F.coalesce("tail", F.lit(0.0)).alias("tail"), F.coalesce("least", F.lit(0.0)).alias("least")))
    wanted = q.join(cut.select("query", "cut"), "query").where(F.col("level") < F.col("cut"))
    if read is not None:
        read["postings"], read["read"] = (df.agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0] for df in (q, wanted))
    # What the frequent grams can add: at most the product of both lengths from that level on.
    more = F.col("tail") * F.coalesce(F.get("tails", F.col("cut")), F.lit(0.0))
    found = by_grams(wanted.select("gram", "query", "qw")).join(cut, "query").join(texts.select(F.col("id").alias("neighbour"), "tails"), "neighbour")
    candidates = checkpointed(found.where(F.col("part") + more >= F.col("least") - EPS).select("query", "neighbour"))
    if read is not None:
        read["candidates"] = candidates.count()
    return _best(_scored(candidates, vectors, texts), k)
