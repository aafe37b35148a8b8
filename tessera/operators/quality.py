"""Screens of extracted records, roll-ups and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.measure import aggregate_flags
from tessera.functions.text import MODEL_ALPHABET, context_value, is_missing


def screen(records: DataFrame, least: int = 5) -> DataFrame:
    """Adds val_col_header, seq_len, flags, train_ready_strict and train_ready_relaxed. records: sequence, value, unit, cmp, condition, context."""
    header = context_value(F.col("context"), "val_col_header")
    seq = F.trim("sequence")
    flags = aggregate_flags(F.when(~is_missing(F.col("condition")), F.col("condition")), F.when(~is_missing(F.col("val_col_header")), F.col("val_col_header")))
    out = records.withColumn("val_col_header", header).withColumns({
        "seq_len": F.when(is_missing(F.col("sequence")), 0).otherwise(F.length(seq)),
        "seq_is_canonical20": ~is_missing(F.col("sequence")) & F.coalesce(F.upper(seq).rlike(f"^[{MODEL_ALPHABET}]+$"), F.lit(False)),
        "unit_missing": is_missing(F.col("unit")), "value_missing": is_missing(F.col("value")), "cmp_missing": is_missing(F.col("cmp")), "_agg": flags,
    })
    out = out.withColumns({"seq_ok_minlen": F.col("seq_len") >= least, "is_censored": ~F.col("cmp_missing"), "is_aggregate": F.col("_agg.any"), "is_aggregate_stat": F.col("_agg.statistic"), "is_aggregate_group": F.col("_agg.group")}).drop("_agg")
    relaxed = F.col("seq_ok_minlen") & F.col("seq_is_canonical20") & ~F.col("value_missing") & ~F.col("unit_missing") & ~F.col("is_aggregate")
    return out.withColumn("train_ready_strict", relaxed & ~F.col("is_censored")).withColumn("train_ready_relaxed", relaxed)


def flag_rollup(df: DataFrame, by: str, flags: list[str], distinct: str, top: int | None = 40) -> DataFrame:
    """Per key (null is one): rows, distinct values, sums of flags; the largest first."""
    out = df.groupBy(by).agg(F.count("*").alias("n"), F.count_distinct(distinct).alias(f"n_{distinct}"), *[F.sum(F.col(f).cast("long")).alias(f) for f in flags]).orderBy(F.desc("n"), F.col(by).asc_nulls_first())
    return out.limit(top) if top else out


def value_counts(df: DataFrame, column: str | Column, top: int | None = None) -> DataFrame:
    c = F.col(column) if isinstance(column, str) else column
    out = df.groupBy(c.alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col("value").asc_nulls_first())
    return out.limit(top) if top else out


def without_records(papers: DataFrame, records: DataFrame, on: str = "stem") -> DataFrame:
    return papers.join(records.select(on).distinct(), on, "left_anti")


def examples_per_group(df: DataFrame, by: str, order: list[str], most: int) -> DataFrame:
    """A few rows of each group: most // groups of each (one at least), most in all."""
    groups = df.select(by).distinct().agg(F.greatest(F.lit(1), F.floor(F.lit(most) / F.greatest(F.lit(1), F.count("*")))).alias("share"))
    ranked = df.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(*order)))
    return ranked.crossJoin(F.broadcast(groups)).where("r <= share").orderBy(by, "r").limit(most).drop("r", "share")


def coverage(df: DataFrame, state: str = "state") -> DataFrame:
    """Counts of found, missing, empty and invalid."""
    return df.agg(*[F.count_if(F.col(state) == s).alias(s) for s in ("found", "missing", "empty", "invalid")])


def align(base: DataFrame, features: DataFrame, on: str) -> DataFrame:
    """base with the features of the same key, by a join and never by position. Raises if features have a key twice; a key without features gets nulls."""
    once = features.groupBy(on).agg(F.when(F.count("*") == 1, F.first(F.struct(*[F.col(c) for c in features.columns if c != on]))).otherwise(F.raise_error(F.concat(F.lit("repeated key "), F.col(on).cast("string")))).alias("_f"))
    return base.join(once, on, "left").select(*base.columns, "_f.*")
