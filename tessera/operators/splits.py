"""Stratified and leakage-free splits. Hash order stands for a seeded shuffle, so splits are stable and repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hash_order(id_col: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))


def stratified_split(df: DataFrame, id_col: str, label: str, sizes: tuple[float, ...] = (0.8, 0.1, 0.1), names: tuple[str, ...] = ("train", "val", "test"), seed: int = 69) -> DataFrame:
    """Adds split: per label, by rank in hash order against cumulative quotas rounded half up. sizes add up to 1."""
    if abs(sum(sizes) - 1) > 1e-9 or len(sizes) != len(names):
        raise ValueError("sizes must add up to 1, one for each name")
    # Counted by the first hex digits of the hash, so that a class is ranked in 4096 parts, not in one task.
    rows = df.withColumns({"_hash": hash_order(id_col, seed), "_known": F.col(label).isNotNull(), "_class": F.coalesce(F.col(label).cast("string"), F.lit(""))}).withColumn("_first", F.substring("_hash", 1, 3))
    on = ["_known", "_class", "_first"]
    counts = rows.groupBy(*on).agg(F.count("*").alias("_held"))
    parts = W.partitionBy("_known", "_class")
    counts = counts.select(*on, (F.sum("_held").over(parts.orderBy("_first")) - F.col("_held")).alias("_before"), F.sum("_held").over(parts).alias("_n"))
    rank = F.col("_before") + F.row_number().over(W.partitionBy(*on).orderBy("_hash", F.col(id_col)))
    n = F.col("_n")
    split, upto = F.lit(names[-1]), 1.0
    for name, size in reversed(list(zip(names[:-1], sizes[:-1], strict=True))):
        upto = sum(sizes[: names.index(name) + 1])
        split = F.when(rank <= F.floor(n * F.lit(upto) + 0.5), F.lit(name)).otherwise(split)
    return rows.join(counts, on).withColumn("split", split).select(*df.columns, "split")


def propagate_split(members: DataFrame, clusters: DataFrame, on: str = "cluster_id") -> DataFrame:
    """Members with their cluster's split. Raises if a cluster has two rows, or a member none."""
    one = clusters.groupBy(on).agg(F.when(F.count("*") == 1, F.first("split")).otherwise(F.raise_error(F.concat(F.lit("repeated cluster "), F.col(on).cast("string"))).cast("string")).alias("split"))
    joined = members.join(one, on, "left")
    return joined.withColumn("split", F.coalesce("split", F.raise_error(F.lit("member without a split")).cast("string")))


def holdout(df: DataFrame, id_col: str, label: str, share: float = 0.1, seed: int = 3407) -> DataFrame:
    return stratified_split(df, id_col, label, (1 - share, share), ("train", "val"), seed)


def priority_split(sets: Column, priority: tuple[str, ...] = ("independent", "test", "val", "train")) -> Column:
    """The first name of the priority list that the array has, else unknown."""
    return F.coalesce(*[F.when(F.array_contains(sets, p), F.lit(p)) for p in priority], F.lit("unknown"))


def split_counts(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows by split and label, by split, and in all (nulls stand for all)."""
    return df.rollup("split", label).agg(F.count("*").alias("n"))


def sample_rows(df: DataFrame, id_col: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, in hash order."""
    return df.orderBy(hash_order(id_col, seed), F.col(id_col)).limit(n)
