"""Row numbers and running sums over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.sources.scratch import scratch_path


def running_sums(df: DataFrame, order: list[str | Column], sums: dict[str, Column], by: list[str] | None = None, whole: dict[str, str] | None = None) -> DataFrame:
    """df with columns of sums up to and with each row in the given order, which should be a total one.

    by: sums start anew in each group of these columns (nulls are a group), which may be of any size. whole: names of further columns, each with
    the total of one of the sums in its group. Rows are sorted in ranges, written down when this is called (so that the ranges stay what they are),
    summed within each, and what earlier ranges hold, a row for each range and group, is added.
    """
    by = by or []
    spark = df.sparkSession
    path = scratch_path(spark, "running")
    named = df.select("*", *[c.alias(f"_{n}") for n, c in sums.items()])
    ranged = [*by, *order]
    named.repartitionByRange(*ranged).sortWithinPartitions(*ranged).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")).write.parquet(path)
    rows = spark.read.parquet(path)
    group = W.partitionBy(*by)
    earlier = group.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy("_part", *by).agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums])
    before = totals.select(
        F.col("_part").alias("_of"), *[F.col(f"`{c}`").alias(f"_by{i}") for i, c in enumerate(by)],
        *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums], *[F.sum(f"_{n}").over(group).alias(f"_whole_{w}") for w, n in (whole or {}).items()],
    )
    same = F.col("_part") == F.col("_of")
    for i, c in enumerate(by):
        same &= F.col(f"`{c}`").eqNullSafe(F.col(f"_by{i}"))
    within = W.partitionBy("_part", *by).orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    out = rows.join(before if by else F.broadcast(before), same)
    return out.select(*[F.col(f"`{c}`") for c in df.columns], *[(F.sum(f"_{n}").over(within) + F.col(f"_before_{n}")).alias(n) for n in sums], *[F.col(f"_whole_{w}").alias(w) for w in whole or {}])


def number_in_order(df: DataFrame, order: list[str | Column], name: str = "number") -> DataFrame:
    """Adds the row's number, from 0, in the given order."""
    return running_sums(df, order, {name: F.lit(1).cast("long")}).withColumn(name, F.col(name) - 1)


def number_by_place(df: DataFrame, place: str, name: str = "number") -> DataFrame:
    """Adds the row's number, from 0, in the order of a monotonically_increasing_id() column of a scan: a count by partition, no shuffle of rows."""
    part, nth = F.shiftright(place, 33), F.col(place).bitwiseAND(F.lit((1 << 33) - 1))
    rows = df.withColumn("_part", part)
    counts = rows.groupBy("_part").agg((F.max(nth) + 1).alias("_n"))
    before = counts.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + nth).drop("_part", "_before")
