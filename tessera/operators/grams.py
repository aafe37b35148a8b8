"""Character n-grams: counting, discriminative motifs, TF-IDF and nearest neighbours over an inverted index."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gram_counts(df: DataFrame, id_col: str, text_col: str, sizes: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """(id, gram, tf): character n-grams of whole texts, counted per text in Arrow batches before anything is shuffled."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = rows.select("id", F.lit("").alias("gram"), F.lit(0).cast("int").alias("tf")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                where, grams, tf = [], [], []
                for i, text in enumerate(piece.column("text").to_pylist()):
                    c = Counter(text[k : k + n] for n in sizes for k in range(len(text) - n + 1)) if text else {}
                    where += [i] * len(c)
                    grams += c.keys()
                    tf += c.values()
                yield pa.RecordBatch.from_arrays([piece.column("id").take(pa.array(where, pa.int64())), pa.array(grams, pa.string()), pa.array(tf, pa.int32())], names=["id", "gram", "tf"])

    return rows.mapInArrow(run, schema)


def motif_table(grams: DataFrame, labels: DataFrame, min_df: int = 5, alpha: float = 0.5, top: int | None = 512) -> DataFrame:
    """Discriminative grams: motif, k, count_pos, count_neg, log_odds, direction.

    grams: (id, gram, tf); labels: (id, label). Grams in min_df texts or more; smoothed log odds over the totals of the kept
    vocabulary; the top // 2 most positive and the rest most negative (top None: all), ties by gram. Both classes must occur.
    """
    joined = grams.join(labels.select("id", "label"), "id")
    table = joined.groupBy("gram").agg(
        F.coalesce(F.sum(F.when(F.col("label") == 1, F.col("tf"))), F.lit(0)).alias("count_pos"), F.coalesce(F.sum(F.when(F.col("label") == 0, F.col("tf"))), F.lit(0)).alias("count_neg"), F.count("*").alias("df")
    )
    table = table.where(F.col("df") >= min_df)
    totals = table.agg(F.sum("count_pos").alias("tp"), F.sum("count_neg").alias("tn"), F.count("*").alias("v")).where("tp > 0 AND tn > 0")
    a = F.lit(float(alpha))
    odds = F.log((F.col("count_pos") + a) / (F.col("tp") + a * F.col("v"))) - F.log((F.col("count_neg") + a) / (F.col("tn") + a * F.col("v")))
    table = table.crossJoin(F.broadcast(totals)).select(F.col("gram").alias("motif"), F.length("gram").alias("k"), "count_pos", "count_neg", odds.alias("log_odds"))
    table = table.withColumn("direction", F.when(F.col("log_odds") >= 0, F.lit("pos")).otherwise(F.lit("neg")))
    if top is None:
        return table
    odds = F.round("log_odds", 9)  # equal odds stay equal whatever the order of the arithmetic
    high = table.orderBy(odds.desc(), "motif").limit(top // 2)
    low = table.orderBy(odds.asc(), "motif").limit(top - top // 2)
    return high.union(low).distinct().orderBy(odds.desc(), "motif")


def motif_counts(grams: DataFrame, lengths: DataFrame, motifs: DataFrame) -> DataFrame:
    """(id, motif, per_letter): counts of the vocabulary's motifs over the text's length. lengths: (id, n)."""
    return grams.join(motifs.select(F.col("motif").alias("gram")), "gram").join(lengths, "id").select("id", F.col("gram").alias("motif"), (F.col("tf") / F.greatest(F.lit(1), F.col("n"))).alias("per_letter"))


def tfidf_index(grams: DataFrame, n_docs: DataFrame, min_df: int = 2) -> tuple[DataFrame, DataFrame]:
    """(postings (gram, id, weight), idf (gram, idf)). n_docs: one row, column n. Rows have unit length.

    idf = ln((1 + n) / (1 + df)) + 1, tf raw.
    """
    idf = grams.groupBy("gram").agg(F.count("*").alias("df")).where(F.col("df") >= min_df).crossJoin(F.broadcast(n_docs))
    idf = idf.select("gram", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    return unit_weights(grams, idf), idf


def unit_weights(grams: DataFrame, idf: DataFrame) -> DataFrame:
    """TF-IDF of unit length; grams without an idf are left out before the length is taken."""
    w = grams.join(idf, "gram").select("gram", "id", (F.col("tf") * F.col("idf")).alias("w"))
    length = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(length, "id").select("gram", "id", (F.col("w") / F.greatest(F.col("norm"), F.lit(1e-12))).alias("weight"))


def knn(queries: DataFrame, postings: DataFrame, k: int = 8, exclude_same_id: bool = True, same: DataFrame | None = None) -> DataFrame:
    """(query, neighbour, similarity, rank): the k most similar texts with a positive similarity, ties by id.

    Equi-join on grams and a sum, then a ranking that Spark cuts to k before its shuffle. Frequent grams make the join
    skewed, which the adaptive skew join splits. same: (id, key), a row an id of either side; neighbours with the query's key,
    such as its text's digest, are left out, whatever their id.
    """
    q = queries.select("gram", F.col("id").alias("query"), F.col("weight").alias("qw"))
    p = postings.select("gram", F.col("id").alias("neighbour"), F.col("weight").alias("pw"))
    scores = q.join(p, "gram")
    if exclude_same_id:
        scores = scores.where("query <> neighbour")
    scores = scores.groupBy("query", "neighbour").agg(F.round(F.sum(F.col("qw") * F.col("pw")), 9).alias("similarity"))
    if same is not None:
        key = lambda side: same.select(F.col("id").alias(side), F.col("key").alias(f"key_{side}"))
        scores = scores.join(key("query"), "query", "left").join(key("neighbour"), "neighbour", "left").where(~F.coalesce(F.col("key_query") == F.col("key_neighbour"), F.lit(False))).select("query", "neighbour", "similarity")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("similarity"), "neighbour"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)
