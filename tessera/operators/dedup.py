"""Exact dedup with label conflicts, provenance, counters and cluster roll-ups. One shuffle by key each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import split_set
from tessera.operators.running import number_in_order


def dedup_with_conflicts(records: DataFrame, key: str = "sequence", label: str = "label", dataset: str = "source_dataset", project: str | None = "source_project", provenance: list[str] | None = None) -> DataFrame:
    """A row for each key: sorted distinct labels, n_records, n_source_datasets, ;-joined sources, conflict, label (null on conflict).

    provenance: columns that are gathered as a sorted list of structs.
    """
    aggs = [
        F.array_sort(F.collect_set(label)).alias("labels"),
        F.count("*").alias("n_records"),
        F.count_distinct(dataset).alias("n_source_datasets"),
        F.concat_ws(";", F.array_sort(F.collect_set(F.col(dataset).cast("string")))).alias("source_datasets"),
    ]
    if project:
        aggs.append(F.concat_ws(";", F.array_sort(F.collect_set(F.col(project).cast("string")))).alias("source_projects"))
    if provenance:
        aggs.append(F.sort_array(F.collect_list(F.struct(*provenance))).alias("sources"))
    out = records.groupBy(key).agg(*aggs)
    conflict = F.size("labels") > 1
    return out.withColumn("conflict", conflict).withColumn("label", F.when(F.size("labels") == 1, F.get("labels", F.lit(0))))


def resolved(deduped: DataFrame) -> DataFrame:
    return deduped.where("NOT conflict").drop("conflict")


def conflicts(deduped: DataFrame) -> DataFrame:
    return deduped.where("conflict").drop("conflict", "label")


def by_support(deduped: DataFrame, key: str = "sequence") -> DataFrame:
    """Most source datasets first, then most records, ties by key."""
    return deduped.orderBy(F.desc("n_source_datasets"), F.desc("n_records"), key)


def ingest_counters(raw: DataFrame, by: str, valid: Column, changed: Column, label: str = "label") -> DataFrame:
    """Per source: total, kept, dropped without label, dropped invalid, changed, and kept by label 0 and 1."""
    has, ok = F.col(label).isNotNull(), F.coalesce(valid, F.lit(False))
    kept = has & ok
    return raw.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(kept).alias("kept"), F.count_if(~has).alias("dropped_label"), F.count_if(has & ~ok).alias("dropped_invalid"),
        F.count_if(kept & changed).alias("changed"), F.count_if(kept & (F.col(label) == 0)).alias("label_0"), F.count_if(kept & (F.col(label) == 1)).alias("label_1"),
    )


def corpus_stats(records: DataFrame, key: str, dataset: str) -> DataFrame:
    """One row: records, unique keys, records collapsed, keys of several datasets."""
    per = records.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct(dataset).alias("d"))
    return per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_unique"), (F.sum("n") - F.count("*")).alias("n_collapsed"), F.count_if(F.col("d") > 1).alias("n_cross_dataset"))


def cluster_rollup(members: DataFrame, order: str = "seq_id") -> DataFrame:
    """Per cluster: representative and label (first by order), size, records, union of the ;-joined source sets."""
    rolled = members.groupBy("cluster_id").agg(F.min(order).alias("rep_seq_id"), F.min_by("label", order).alias("label"), F.count("*").alias("cluster_size"), F.sum("n_records").alias("n_records_sum"))
    # A cluster's sources, distinct before they are gathered.
    sources = members.select("cluster_id", F.explode(split_set(F.col("source_datasets"))).alias("s")).groupBy("cluster_id").agg(F.array_sort(F.collect_set("s")).alias("s"))
    out = rolled.join(sources, "cluster_id", "left").withColumn("s", F.coalesce("s", F.array().cast("array<string>")))
    return out.select(*rolled.columns, F.size("s").alias("n_source_datasets_union"), F.concat_ws(";", "s").alias("source_datasets_union"))


def cluster_size_stats(clusters: DataFrame, size: str = "cluster_size", by: list[str] | None = None) -> DataFrame:
    """Count, min, median, 95th percentile (linear), max; truncated to whole numbers."""
    return clusters.groupBy(*(by or [])).agg(
        F.count("*").alias("clusters"), F.min(size).cast("long").alias("min"), F.percentile(size, 0.5).cast("long").alias("p50"), F.percentile(size, 0.95).cast("long").alias("p95"), F.max(size).cast("long").alias("max")
    )


def number_rows(df: DataFrame, prefix: str, order: str, by: list[str]) -> DataFrame:
    """Ids like prefix000000, from 0 within each group, in the order given."""
    rows = number_in_order(df, [*by, order], "_number")
    first = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("_number").alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    rows = rows.join(first, same) if by else rows.crossJoin(F.broadcast(first))
    return rows.withColumn("seq_id", F.format_string(f"{prefix}%06d", F.col("_number") - F.col("_first"))).select(*df.columns, "seq_id")
