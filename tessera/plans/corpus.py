"""Queries on documents, labels, embeddings, benchmark, pages and conversations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import evidential, measure, text
from tessera.operators import dedup, grams, metrics, quality, sequences, similarity, splits, vectors
from tessera.plans.catalog import register
from tessera.sources import papers


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, and a score made from the length, for the metrics."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    score = (F.col("n_chars") % 97) / F.lit(97.0)
    return d.select("doc_id", "lang", "source", F.col("toxic").alias("label"), score.alias("score"), ((F.col("n_chars") % 89) / F.lit(89.0)).alias("uncertainty"))


_LABELLED = "x AS (SELECT d.doc_id, d.lang, d.source, l.toxic AS label, (d.n_chars % 97) / 97.0::DOUBLE AS score, (d.n_chars % 89) / 89.0::DOUBLE AS uncertainty FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"
_PLAIN = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


# --- dedup ---------------------------------------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return d.select("doc_id", F.md5(F.lower(text.normalize_whitespace(F.col("text"))).cast("binary")).alias("sequence"), F.col("toxic").alias("label"), F.col("source").alias("source_dataset"), F.col("lang").alias("source_project"))


_RECORDS = f"r AS (SELECT d.doc_id, md5(lower({_PLAIN})) AS sequence, l.toxic AS label, d.source AS source_dataset, d.lang AS source_project FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


@register(
    "a1_exact_dedup_conflicts",
    f"""WITH {_RECORDS}
SELECT sequence, count(*) AS n_records, count(DISTINCT source_dataset) AS n_source_datasets, string_agg(DISTINCT source_dataset, ';' ORDER BY source_dataset) AS source_datasets,
  string_agg(DISTINCT source_project, ';' ORDER BY source_project) AS source_projects, count(DISTINCT label) AS n_labels, count(DISTINCT label) > 1 AS conflict,
  CASE WHEN count(DISTINCT label) = 1 THEN min(label) END AS label FROM r GROUP BY sequence""",
)
def a1_exact_dedup_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.dedup_with_conflicts(_records(spark, sf_dir))
    return out.select("sequence", "n_records", "n_source_datasets", "source_datasets", "source_projects", F.size("labels").cast("long").alias("n_labels"), "conflict", "label")


@register("a1_conflicts_by_source", f"SELECT md5({_PLAIN}) AS sequence, count(*) AS n_records, string_agg(DISTINCT source, ';' ORDER BY source) AS labels FROM documents GROUP BY md5({_PLAIN}) HAVING count(DISTINCT source) > 1")
def a1_conflicts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.md5(text.normalize_whitespace(F.col("text")).cast("binary")).alias("sequence"), F.col("source").alias("label"), F.col("lang").alias("source_dataset"))
    return dedup.conflicts(dedup.dedup_with_conflicts(d, project=None)).select("sequence", "n_records", F.concat_ws(";", "labels").alias("labels"))


@register("a2_provenance", f"WITH {_RECORDS} SELECT sequence, string_agg(CAST(doc_id AS VARCHAR) || '@' || source_dataset, ',' ORDER BY doc_id) AS sources FROM r GROUP BY sequence")
def a2_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup.dedup_with_conflicts(_records(spark, sf_dir), provenance=["doc_id", "source_dataset"])
    return out.select("sequence", F.array_join(F.transform("sources", lambda s: F.concat(s["doc_id"].cast("string"), F.lit("@"), s["source_dataset"])), ",").alias("sources"))


@register(
    "a4_ingest_counters",
    f"""WITH {_RECORDS}, c AS (SELECT r.*, regexp_replace(upper(d.text), '[^A-Z]', '', 'g') AS s, upper(trim(d.text)) AS u FROM r JOIN documents d ON r.doc_id = d.doc_id)
SELECT source_dataset, count(*) AS total, count(*) FILTER (label IS NOT NULL AND s <> '') AS kept, count(*) FILTER (label IS NULL) AS dropped_label, count(*) FILTER (label IS NOT NULL AND s = '') AS dropped_invalid,
 count(*) FILTER (label IS NOT NULL AND s <> '' AND translate(s, 'UZOBJ', 'XXXXX') <> u) AS changed, count(*) FILTER (label = 0 AND s <> '') AS label_0, count(*) FILTER (label = 1 AND s <> '') AS label_1 FROM c GROUP BY source_dataset""",
)
def a4_ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id", "left").withColumnRenamed("source", "source_dataset")
    return dedup.ingest_counters(d, "source_dataset", text.is_valid_ingest(text.ingest_normalise(F.col("text"))), text.changed_by_ingest(F.col("text")))


@register("a5_corpus_stats", f"WITH {_RECORDS}, k AS (SELECT sequence, count(*) AS n, count(DISTINCT source_dataset) AS d FROM r GROUP BY sequence) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_unique, CAST(sum(n) - count(*) AS BIGINT) AS n_collapsed, count(*) FILTER (d > 1) AS n_cross_dataset FROM k")
def a5_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.corpus_stats(_records(spark, sf_dir), "sequence", "source_dataset")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.by_support(dedup.dedup_with_conflicts(_records(spark, sf_dir))).select(F.col("sequence").alias("seq_id"), F.substring("sequence", 1, 2).alias("cluster_id"), F.coalesce("label", F.lit(-1)).alias("label"), "n_records", "source_datasets")


_MEMBERS = f"{_RECORDS}, m AS (SELECT sequence AS seq_id, substr(sequence, 1, 2) AS cluster_id, coalesce(CASE WHEN count(DISTINCT label) = 1 THEN min(label) END, -1) AS label, count(*) AS n_records FROM r GROUP BY sequence)"


@register(
    "a6_cluster_rollup",
    f"""WITH {_MEMBERS}, s AS (SELECT substr(sequence, 1, 2) AS cluster_id, count(DISTINCT source_dataset) AS n_source_datasets_union, string_agg(DISTINCT source_dataset, ';' ORDER BY source_dataset) AS source_datasets_union FROM r GROUP BY 1)
SELECT m.cluster_id, min(m.seq_id) AS rep_seq_id, arg_min(m.label, m.seq_id) AS label, count(*) AS cluster_size, CAST(sum(m.n_records) AS BIGINT) AS n_records_sum, any_value(s.n_source_datasets_union) AS n_source_datasets_union, any_value(s.source_datasets_union) AS source_datasets_union
FROM m JOIN s ON m.cluster_id = s.cluster_id GROUP BY m.cluster_id""",
)
def a6_cluster_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.cluster_rollup(_members(spark, sf_dir)).withColumn("n_source_datasets_union", F.col("n_source_datasets_union").cast("long"))


@register("a7_cluster_sizes", f"WITH {_MEMBERS}, c AS (SELECT cluster_id, count(*) AS z FROM m GROUP BY cluster_id) SELECT count(*) AS clusters, min(z) AS min, CAST(trunc(quantile_cont(z, 0.5)) AS BIGINT) AS p50, CAST(trunc(quantile_cont(z, 0.95)) AS BIGINT) AS p95, max(z) AS max FROM c")
def a7_cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.cluster_size_stats(dedup.cluster_rollup(_members(spark, sf_dir)))


@register(
    "r4_near_duplicate_clusters",
    r"""WITH RECURSIVE t AS (SELECT item_id, regexp_replace(coalesce(text, ''), '[^ -~]', '', 'g') AS s FROM benchmark),
x AS (SELECT item_id AS id, s, item_id % 2 AS l FROM t UNION ALL SELECT item_id + 100000, s || ' x', item_id % 2 FROM t UNION ALL SELECT item_id + 200000, 'yy' || substr(s, 4), item_id % 2 FROM t UNION ALL SELECT item_id + 300000, s, 1 - item_id % 2 FROM t),
o AS (SELECT *, length(s) AS n, row_number() OVER (ORDER BY length(s) DESC, id) AS k FROM x),
p AS (SELECT b.id, list(a.id ORDER BY a.k) AS near FROM o a JOIN o b ON a.l = b.l AND a.k < b.k AND b.n >= a.n * 0.9::DOUBLE AND levenshtein(a.s, b.s) <= floor(0.09999999999999998::DOUBLE * a.n + 1e-9::DOUBLE) GROUP BY b.id),
q AS (SELECT o.k, o.id, coalesce(p.near, []) AS near FROM o LEFT JOIN p ON p.id = o.id),
g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS reps UNION ALL SELECT q.k, CASE WHEN list_has_any(g.reps, q.near) THEN g.reps ELSE list_append(g.reps, q.id) END FROM g JOIN q ON q.k = g.k + 1),
r AS (SELECT reps FROM g ORDER BY k DESC LIMIT 1)
SELECT q.id AS seq_id, CASE WHEN list_contains(r.reps, q.id) THEN q.id ELSE list_filter(q.near, lambda a: list_contains(r.reps, a))[1] END AS cluster_id, list_contains(r.reps, q.id) AS is_representative FROM q, r""",
)
def r4_near_duplicate_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items, two edited copies of each, and an equal one under the other label."""
    t = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace(F.coalesce("text", F.lit("")), "[^ -~]", "").alias("s"))
    own = F.col("item_id") % 2
    kind = lambda add, s, label: t.select((F.col("item_id") + add).alias("seq_id"), s.alias("sequence"), label.alias("label"))
    items = kind(0, F.col("s"), own).unionByName(kind(100000, F.concat("s", F.lit(" x")), own)).unionByName(kind(200000, F.concat(F.lit("yy"), F.substring(F.col("s"), F.lit(4), F.length("s"))), own)).unionByName(kind(300000, F.col("s"), 1 - own))
    return similarity.greedy_clusters(items)


# --- splits --------------------------------------------------------------------------------------------------------


@register(
    "r1_stratified_split",
    """WITH x AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('69:' || CAST(doc_id AS VARCHAR)), doc_id) AS r, count(*) OVER (PARTITION BY toxic) AS n FROM labels)
SELECT doc_id, toxic, CASE WHEN r <= floor(n * 0.8::DOUBLE + 0.5) THEN 'train' WHEN r <= floor(n * 0.9::DOUBLE + 0.5) THEN 'val' ELSE 'test' END AS split FROM x""",
)
def r1_stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_split(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "toxic")


@register(
    "r2_split_by_cluster",
    f"""WITH {_MEMBERS}, c AS (SELECT cluster_id, max(label) AS label FROM m GROUP BY cluster_id), x AS (SELECT cluster_id, row_number() OVER (PARTITION BY label ORDER BY md5('69:' || cluster_id), cluster_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM c),
s AS (SELECT cluster_id, CASE WHEN r <= floor(n * 0.8::DOUBLE + 0.5) THEN 'train' WHEN r <= floor(n * 0.9::DOUBLE + 0.5) THEN 'val' ELSE 'test' END AS split FROM x)
SELECT m.seq_id, m.cluster_id, s.split FROM m JOIN s ON m.cluster_id = s.cluster_id""",
)
def r2_split_by_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _members(spark, sf_dir)
    clusters = splits.stratified_split(m.groupBy("cluster_id").agg(F.max("label").alias("label")), "cluster_id", "label")
    return splits.propagate_split(m, clusters).select("seq_id", "cluster_id", "split")


@register("a9_split_counts", "WITH x AS (SELECT doc_id, toxic AS label, row_number() OVER (PARTITION BY toxic ORDER BY md5('3407:' || CAST(doc_id AS VARCHAR)), doc_id) AS r, count(*) OVER (PARTITION BY toxic) AS n FROM labels), s AS (SELECT label, CASE WHEN r <= floor(n * 0.9::DOUBLE + 0.5) THEN 'train' ELSE 'val' END AS split FROM x) SELECT split, label, count(*) AS n FROM s GROUP BY ROLLUP (split, label)")
def a9_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_counts(splits.holdout(table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")), "doc_id", "label"))


@register("p6_priority_split", f"WITH {_RECORDS}, g AS (SELECT sequence, max((source_dataset = 'src1')::INT) AS a, max((source_dataset = 'src2')::INT) AS b, max((source_dataset = 'src3')::INT) AS c FROM r GROUP BY sequence) SELECT sequence, CASE WHEN a = 1 THEN 'src1' WHEN b = 1 THEN 'src2' WHEN c = 1 THEN 'src3' ELSE 'unknown' END AS split FROM g")
def p6_priority_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = dedup.dedup_with_conflicts(_records(spark, sf_dir))
    return d.select("sequence", splits.priority_split(text.split_set(F.col("source_datasets")), ("src1", "src2", "src3")).alias("split"))


# --- metrics -------------------------------------------------------------------------------------------------------


@register(
    "a18_ranking_metrics",
    f"""WITH {_LABELLED}, s AS (SELECT lang, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM x GROUP BY lang, score),
w AS (SELECT *, sum(p) OVER (PARTITION BY lang ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY lang ORDER BY score DESC) AS fp, sum(p) OVER (PARTITION BY lang) AS pos, sum(n) OVER (PARTITION BY lang) AS neg FROM s)
SELECT lang, CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN round(sum(p * (neg - fp + n / 2.0::DOUBLE)) / (max(pos) * max(neg)), 9) END AS auroc, CASE WHEN max(pos) > 0 THEN round(sum((p / pos::DOUBLE) * (tp / (tp + fp)::DOUBLE)), 9) END AS average_precision FROM w GROUP BY lang""",
)
def a18_ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranking_metrics(labelled(spark, sf_dir), ["lang"]).select("lang", F.round("auroc", 9).alias("auroc"), F.round("average_precision", 9).alias("average_precision"))


_CONFUSION = "count(*) FILTER (score >= 0.5 AND label = 1) AS tp, count(*) FILTER (score >= 0.5 AND label = 0) AS fp, count(*) FILTER (score < 0.5 AND label = 0) AS tn, count(*) FILTER (score < 0.5 AND label = 1) AS fn"


@register(
    "a17_metrics_at_threshold",
    f"""WITH {_LABELLED}, c AS (SELECT source, {_CONFUSION} FROM x GROUP BY source)
SELECT source, tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn)::DOUBLE, 9) AS accuracy, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END, 9) AS f1,
 round(((CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END) + (CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp)::DOUBLE END)) / 2, 9) AS balanced_accuracy,
 round(CASE WHEN (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END, 9) AS mcc FROM c""",
)
def a17_metrics_at_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = metrics.metrics_at(labelled(spark, sf_dir), 0.5, ["source"])
    return m.select("source", "tp", "fp", "tn", "fn", *[F.round(c, 9).alias(c) for c in ("accuracy", "f1", "balanced_accuracy", "mcc")])


_RATES = """CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS f1,
 ((CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END) + (CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp)::DOUBLE END)) / 2 AS balanced_accuracy,
 CASE WHEN (tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn) = 0 THEN 0 ELSE (tp::DOUBLE * tn - fp::DOUBLE * fn) / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) END AS mcc"""


@register(
    "w7_select_threshold",
    f"""WITH {_LABELLED}, t AS (SELECT DISTINCT lang, score AS thr FROM x UNION SELECT DISTINCT lang, v FROM x, (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) AS e(v)),
s AS (SELECT lang, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM x GROUP BY lang, score),
c AS (SELECT t.lang, t.thr, sum(CASE WHEN s.score >= t.thr THEN p ELSE 0 END) AS tp, sum(CASE WHEN s.score >= t.thr THEN n ELSE 0 END) AS fp, sum(CASE WHEN s.score < t.thr THEN n ELSE 0 END) AS tn, sum(CASE WHEN s.score < t.thr THEN p ELSE 0 END) AS fn FROM t JOIN s ON t.lang = s.lang GROUP BY t.lang, t.thr),
r AS (SELECT lang, thr, {_RATES} FROM c),
m AS (UNPIVOT r ON f1, mcc, balanced_accuracy INTO NAME metric VALUE v)
SELECT lang, metric, thr AS threshold, round(v, 9) AS value FROM (SELECT *, row_number() OVER (PARTITION BY lang, metric ORDER BY round(v, 12) DESC, thr) AS i FROM m) WHERE i = 1""",
)
def w7_select_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda m: metrics.select_threshold(labelled(spark, sf_dir), m, ["lang"]).select("lang", F.lit(m).alias("metric"), "threshold", F.round(m, 9).alias("value"))
    return one("f1").unionByName(one("mcc")).unionByName(one("balanced_accuracy"))


@register(
    "w7_threshold_of_all",
    f"""WITH {_LABELLED}, t AS (SELECT DISTINCT score AS thr FROM x UNION SELECT v FROM (VALUES (0.0::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) AS e(v)),
c AS (SELECT thr, count(*) FILTER (score >= thr AND label = 1) AS tp, count(*) FILTER (score >= thr AND label = 0) AS fp, count(*) FILTER (score < thr AND label = 0) AS tn, count(*) FILTER (score < thr AND label = 1) AS fn FROM t, x GROUP BY thr),
r AS (SELECT thr, {_RATES} FROM c) SELECT thr AS threshold, round(mcc, 9) AS mcc FROM r ORDER BY round(mcc, 12) DESC, thr LIMIT 1""",
)
def w7_threshold_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.select_threshold(labelled(spark, sf_dir)).select("threshold", F.round("mcc", 9).alias("mcc"))


@register(
    "a18_ranking_of_all",
    f"""WITH {_LABELLED}, s AS (SELECT score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM x GROUP BY score), w AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS pos, sum(n) OVER () AS neg FROM s)
SELECT round(sum(p * (neg - fp + n / 2.0::DOUBLE)) / (max(pos) * max(neg)), 9) AS auroc, round(sum((p / pos::DOUBLE) * (tp / (tp + fp)::DOUBLE)), 9) AS average_precision FROM w""",
)
def a18_ranking_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranking_metrics(labelled(spark, sf_dir)).select(F.round("auroc", 9).alias("auroc"), F.round("average_precision", 9).alias("average_precision"))


@register(
    "a19_calibration_error",
    f"""WITH {_LABELLED}, b AS (SELECT greatest(ceil(greatest(score, 1 - score) * 15) - 1, 0) AS bin, greatest(score, 1 - score) AS c, CASE WHEN (score >= 0.5)::INT = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r FROM x),
g AS (SELECT bin, count(*) AS k, avg(c) AS c, avg(r) AS r FROM b GROUP BY bin) SELECT round(sum(k * abs(c - r)) / sum(k), 9) AS ece FROM g""",
)
def a19_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calibration_error(labelled(spark, sf_dir)).select(F.round("ece", 9).alias("ece"))


@register(
    "a20_selective_accuracy",
    f"""WITH {_LABELLED}, o AS (SELECT ((score >= 0.5)::INT = label)::INT AS r, row_number() OVER (ORDER BY uncertainty, doc_id) AS i, count(*) OVER () AS n FROM x),
v AS (SELECT c FROM (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE), (0.8::DOUBLE), (1.0::DOUBLE)) AS t(c)),
k AS (SELECT c, greatest(1, CASE WHEN abs(n * c - floor(n * c) - 0.5) < 1e-9 THEN 2 * round(floor(n * c + 0.5) / 2) ELSE round(n * c) END) AS k FROM v, (SELECT max(n) AS n FROM o))
SELECT c AS coverage, CAST(k AS BIGINT) AS k, round(sum(r) / k, 9) AS accuracy FROM k JOIN o ON o.i <= k.k GROUP BY c, k""",
)
def a20_selective_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.selective_accuracy(labelled(spark, sf_dir), id_col="doc_id").select("coverage", "k", F.round("accuracy", 9).alias("accuracy"))


@register("a24_uncertainty_by_outcome", f'WITH {_LABELLED} SELECT round(coalesce(avg(uncertainty) FILTER ((score >= 0.5)::INT = label), 0), 9) AS "right", round(coalesce(avg(uncertainty) FILTER ((score >= 0.5)::INT <> label), 0), 9) AS wrong FROM x')
def a24_uncertainty_by_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.uncertainty_by_outcome(labelled(spark, sf_dir)).select(F.round("right", 9).alias("right"), F.round("wrong", 9).alias("wrong"))


@register("a32_class_weights", "SELECT 1.0::DOUBLE AS w0, count(*) FILTER (toxic = 0) / greatest(1, count(*) FILTER (toxic = 1))::DOUBLE AS w1 FROM labels")
def a32_class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.class_weights(table(spark, sf_dir, "labels"), "toxic")


_SPLIT = "h AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('69:' || CAST(doc_id AS VARCHAR)), doc_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM x), y AS (SELECT *, CASE WHEN r <= floor(n * 0.8::DOUBLE + 0.5) THEN 'train' WHEN r <= floor(n * 0.9::DOUBLE + 0.5) THEN 'val' ELSE 'test' END AS split FROM h)"


def _at(t: float, suffix: str) -> str:
    c = f"(SELECT split, count(*) FILTER (score >= {t} AND label = 1) AS tp, count(*) FILTER (score >= {t} AND label = 0) AS fp, count(*) FILTER (score < {t} AND label = 0) AS tn, count(*) FILTER (score < {t} AND label = 1) AS fn FROM y GROUP BY split)"
    return f"m_{suffix} AS (SELECT split, (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS accuracy, {_RATES} FROM {c})"


@register(
    "a34_split_report",
    f"""WITH {_LABELLED}, {_SPLIT}, s AS (SELECT split, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM y GROUP BY split, score),
w AS (SELECT *, sum(p) OVER (PARTITION BY split ORDER BY score DESC) AS tp, sum(n) OVER (PARTITION BY split ORDER BY score DESC) AS fp, sum(p) OVER (PARTITION BY split) AS pos, sum(n) OVER (PARTITION BY split) AS neg FROM s),
k AS (SELECT split, CAST(max(pos) AS BIGINT) AS n_pos, CAST(max(neg) AS BIGINT) AS n_neg, CASE WHEN max(pos) > 0 AND max(neg) > 0 THEN sum(p * (neg - fp + n / 2.0::DOUBLE)) / (max(pos) * max(neg)) END AS auroc, CASE WHEN max(pos) > 0 THEN sum((p / pos::DOUBLE) * (tp / (tp + fp)::DOUBLE)) END AS ap FROM w GROUP BY split),
{_at(0.5, "half")}, {_at(0.7, "best")}
SELECT k.split, n_pos + n_neg AS n, n_pos, n_neg, round(auroc, 9) AS auroc, round(ap, 9) AS average_precision, round(a.accuracy, 9) AS accuracy_half, round(a.f1, 9) AS f1_half, round(a.mcc, 9) AS mcc_half, round(b.accuracy, 9) AS accuracy_best, round(b.f1, 9) AS f1_best, round(b.mcc, 9) AS mcc_best
FROM k JOIN m_half a ON a.split = k.split JOIN m_best b ON b.split = k.split""",
)
def a34_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = metrics.split_report(splits.stratified_split(labelled(spark, sf_dir), "doc_id", "label"), 0.7)
    return r.select("split", "n", "n_pos", "n_neg", *[F.round(c, 9).alias(c) for c in r.columns[4:]])


@register("a34_prediction_table", f"WITH {_LABELLED} SELECT doc_id, label, score, (score >= 0.5)::INT AS pred_half, (score >= 0.7)::INT AS pred_best FROM x")
def a34_prediction_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.prediction_table(labelled(spark, sf_dir), 0.7, ["doc_id"])


# --- neighbours ----------------------------------------------------------------------------------------------------


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("label") >= 5).cast("int").alias("label"))
    q = e.where("id % 20 = 0")
    hits = vectors.cosine_knn(q, e, 8).join(e.select(F.col("id").alias("neighbour"), "label"), "neighbour")
    return hits, q.select(F.col("id").alias("query"), "label")


_HITS = """e AS (SELECT vec_id AS id, embedding, (label >= 5)::INT AS label FROM embeddings), u AS (SELECT id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS v FROM e),
n AS (SELECT id, i, v / greatest(sqrt(sum(v * v) OVER (PARTITION BY id)), 1e-12) AS v FROM u),
s AS (SELECT a.id AS query, b.id AS neighbour, round(sum(a.v * b.v), 9) AS similarity FROM n a JOIN n b ON a.i = b.i AND a.id <> b.id WHERE a.id % 20 = 0 GROUP BY a.id, b.id),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS rank FROM s),
h AS (SELECT k.*, e.label FROM k JOIN e ON e.id = k.neighbour WHERE rank <= 8)"""


@register("j11_cosine_knn", f"WITH {_HITS} SELECT query, neighbour, round(similarity, 7) AS similarity, label FROM h")
def j11_cosine_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir)[0].select("query", "neighbour", F.round("similarity", 7).alias("similarity"), "label")


@register("j12_other_labels_only", f"WITH {_HITS.replace('a.id <> b.id WHERE', 'a.id <> b.id WHERE (SELECT label FROM e WHERE id = a.id) <> (SELECT label FROM e WHERE id = b.id) AND')} SELECT query, neighbour, round(similarity, 7) AS similarity FROM h")
def j12_other_labels_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("label") >= 5).cast("int").alias("label"))
    return vectors.cosine_knn(e.where("id % 20 = 0"), e, 8, same_col="label").select("query", "neighbour", F.round("similarity", 7).alias("similarity"))


@register(
    "a13_neighbour_features",
    f"""WITH {_HITS} SELECT query, round(avg(similarity), 7) AS sim_mean, round(max(similarity), 7) AS sim_max, round(stddev_pop(similarity), 7) AS sim_std, round(median(similarity), 7) AS sim_median, avg(label)::DOUBLE AS pos_rate,
 round(sum(CASE WHEN label = 1 THEN greatest(similarity, 0) ELSE 0 END) / greatest(sum(greatest(similarity, 0)), 1e-8), 7) AS pos_rate_weighted, round(coalesce(max(similarity) FILTER (label = 1), 0), 7) AS sim_max_pos, round(coalesce(max(similarity) FILTER (label <> 1), 0), 7) AS sim_max_neg,
 round(coalesce(avg(similarity) FILTER (label = 1), 0), 7) AS sim_mean_pos, round(coalesce(avg(similarity) FILTER (label <> 1), 0), 7) AS sim_mean_neg, count(*) FILTER (label = 1)::DOUBLE AS n_pos, count(*)::DOUBLE AS n_hits FROM h GROUP BY query""",
)
def a13_neighbour_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = vectors.neighbour_features(*_hits(spark, sf_dir))
    return f.select("query", *[F.round(c, 7).alias(c) for c in ("sim_mean", "sim_max", "sim_std", "sim_median", "pos_rate", "pos_rate_weighted", "sim_max_pos", "sim_max_neg", "sim_mean_pos", "sim_mean_neg", "n_pos", "n_hits")])


@register("a14_evidence_report", f"WITH {_HITS} SELECT query, count(*) AS num_hits, round(max(similarity), 7) AS max_similarity, round(avg(similarity), 7) AS mean_similarity, avg(label)::DOUBLE AS pos_rate, string_agg(rank || ':' || neighbour || ':' || label, ',' ORDER BY rank) AS hits FROM h GROUP BY query")
def a14_evidence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = vectors.evidence_report(*_hits(spark, sf_dir), {"index": "embeddings"})
    return r.select("query", "num_hits", F.round("max_similarity", 7).alias("max_similarity"), F.round("mean_similarity", 7).alias("mean_similarity"), "pos_rate", F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["rank"].cast("string"), h["neighbour"].cast("string"), h["label"].cast("string"))), ",").alias("hits"))


@register(
    "a21_retrieval_accuracy",
    f"""WITH {_HITS}, q AS (SELECT id AS query, label AS truth FROM e WHERE id % 20 = 0), g AS (SELECT query, (avg(label) >= 0.5)::INT AS vote FROM h GROUP BY query)
SELECT count(*) AS n, avg(coalesce((f.label = truth)::INT, 0))::DOUBLE AS top1_accuracy, avg(coalesce((vote = truth)::INT, 0))::DOUBLE AS majority_accuracy, round(avg(f.similarity), 7) AS mean_top1_similarity
FROM q LEFT JOIN h f ON f.query = q.query AND f.rank = 1 LEFT JOIN g ON g.query = q.query""",
)
def a21_retrieval_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.retrieval_accuracy(*_hits(spark, sf_dir)).withColumn("mean_top1_similarity", F.round("mean_top1_similarity", 7))


# --- grams ---------------------------------------------------------------------------------------------------------


def _item_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grams.gram_counts(table(spark, sf_dir, "benchmark"), "item_id", "text")


_GRAMS = """p AS (SELECT item_id AS id, text, n, unnest(generate_series(1, length(text) - n + 1)) AS i FROM benchmark, (VALUES (3), (4), (5)) AS t(n) WHERE length(text) >= n),
g AS (SELECT id, substr(text, i, n) AS gram, count(*) AS tf FROM p GROUP BY 1, 2)"""


@register("f25_gram_counts", f"WITH {_GRAMS} SELECT gram, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM g GROUP BY gram")
def f25_gram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _item_grams(spark, sf_dir).groupBy("gram").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@register(
    "t4_motifs",
    f"""WITH {_GRAMS}, c AS (SELECT gram, coalesce(sum(tf) FILTER (id % 2 = 1), 0) AS cp, coalesce(sum(tf) FILTER (id % 2 = 0), 0) AS cn, count(*) AS df FROM g GROUP BY gram HAVING count(*) >= 5),
t AS (SELECT sum(cp) AS tp, sum(cn) AS tn, count(*) AS v FROM c)
SELECT gram AS motif, length(gram) AS k, CAST(cp AS BIGINT) AS count_pos, CAST(cn AS BIGINT) AS count_neg, round(ln((cp + 0.5::DOUBLE) / (tp + 0.5::DOUBLE * v)) - ln((cn + 0.5::DOUBLE) / (tn + 0.5::DOUBLE * v)), 7) AS log_odds FROM c, t WHERE tp > 0 AND tn > 0""",
)
def t4_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), (F.col("item_id") % 2).cast("int").alias("label"))
    return grams.motif_table(_item_grams(spark, sf_dir), labels, top=None).select("motif", "k", "count_pos", "count_neg", F.round("log_odds", 7).alias("log_odds"))


@register(
    "t4_top_motifs",
    f"""WITH {_GRAMS}, c AS (SELECT gram, coalesce(sum(tf) FILTER (id % 2 = 1), 0) AS cp, coalesce(sum(tf) FILTER (id % 2 = 0), 0) AS cn FROM g GROUP BY gram HAVING count(*) >= 5), t AS (SELECT sum(cp) AS tp, sum(cn) AS tn, count(*) AS v FROM c),
o AS (SELECT gram AS motif, ln((cp + 0.5::DOUBLE) / (tp + 0.5::DOUBLE * v)) - ln((cn + 0.5::DOUBLE) / (tn + 0.5::DOUBLE * v)) AS odds FROM c, t WHERE tp > 0 AND tn > 0),
r AS (SELECT *, row_number() OVER (ORDER BY round(odds, 9) DESC, motif) AS high, row_number() OVER (ORDER BY round(odds, 9), motif) AS low FROM o) SELECT motif, round(odds, 7) AS log_odds, CASE WHEN odds >= 0 THEN 'pos' ELSE 'neg' END AS direction FROM r WHERE high <= 20 OR low <= 21""",
)
def t4_top_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), (F.col("item_id") % 2).cast("int").alias("label"))
    return grams.motif_table(_item_grams(spark, sf_dir), labels, top=41).select("motif", F.round("log_odds", 7).alias("log_odds"), "direction")


@register(
    "f26_motif_counts",
    """WITH v AS (SELECT unnest(['the', 'and', 'ing', 'tion', 'ation']) AS motif), p AS (SELECT item_id, text, motif, unnest(generate_series(1, length(text) - length(motif) + 1)) AS i FROM benchmark, v WHERE length(text) >= length(motif))
SELECT item_id AS id, motif, round(count(*) / greatest(1, max(length(text)))::DOUBLE, 9) AS per_letter FROM p WHERE substr(text, i, length(motif)) = motif GROUP BY 1, 2""",
)
def f26_motif_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = spark.createDataFrame([(m,) for m in ("the", "and", "ing", "tion", "ation")], "motif string")
    lengths = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.length("text").alias("n"))
    return grams.motif_counts(_item_grams(spark, sf_dir), lengths, vocabulary).select("id", "motif", F.round("per_letter", 9).alias("per_letter"))


@register(
    "t5_tfidf_knn",
    f"""WITH {_GRAMS}, f AS (SELECT gram, ln((1 + (SELECT count(*) FROM benchmark)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM g GROUP BY gram HAVING count(*) >= 2),
w AS (SELECT g.id, g.gram, g.tf * f.idf AS w FROM g JOIN f ON g.gram = f.gram), l AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id), u AS (SELECT w.id, w.gram, w.w / greatest(l.norm, 1e-12) AS w FROM w JOIN l ON w.id = l.id),
s AS (SELECT a.id AS query, b.id AS neighbour, round(sum(a.w * b.w), 9) AS similarity FROM u a JOIN u b ON a.gram = b.gram AND a.id <> b.id WHERE a.id % 20 = 0 GROUP BY 1, 2)
SELECT query, neighbour, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS r FROM s) WHERE r <= 8""",
)
def t5_tfidf_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "benchmark").agg(F.count("*").alias("n"))
    postings, _ = grams.tfidf_index(_item_grams(spark, sf_dir), n)
    return grams.knn(postings.where("id % 20 = 0"), postings).select("query", "neighbour", F.round("similarity", 6).alias("similarity"))


@register(
    "j12_tfidf_without_equals",
    f"""WITH b AS (SELECT item_id, text FROM benchmark UNION ALL SELECT item_id + 1000, text FROM benchmark), {_GRAMS.replace("FROM benchmark", "FROM b")}, f AS (SELECT gram, ln((1 + (SELECT count(*) FROM b)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM g GROUP BY gram HAVING count(*) >= 2),
w AS (SELECT g.id, g.gram, g.tf * f.idf AS w FROM g JOIN f ON g.gram = f.gram), l AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id), u AS (SELECT w.id, w.gram, w.w / greatest(l.norm, 1e-12) AS w FROM w JOIN l ON w.id = l.id),
s AS (SELECT a.id AS query, b.id AS neighbour, round(sum(a.w * b.w), 9) AS similarity FROM u a JOIN u b ON a.gram = b.gram WHERE a.id % 20 = 0 GROUP BY 1, 2), k AS (SELECT s.* FROM s JOIN b x ON x.item_id = query JOIN b y ON y.item_id = neighbour WHERE x.text <> y.text)
SELECT query, neighbour, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, neighbour) AS r FROM k) WHERE r <= 4""",
)
def j12_tfidf_without_equals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text twice: neither itself nor its copy is its neighbour."""
    b = table(spark, sf_dir, "benchmark").select("item_id", "text")
    b = b.unionByName(b.select((F.col("item_id") + 1000).alias("item_id"), "text"))
    postings, _ = grams.tfidf_index(grams.gram_counts(b, "item_id", "text"), b.agg(F.count("*").alias("n")))
    same = b.select(F.col("item_id").alias("id"), F.sha1(F.col("text").cast("binary")).alias("key"))
    return grams.knn(postings.where("id % 20 = 0"), postings, 4, same=same).select("query", "neighbour", F.round("similarity", 6).alias("similarity"))


# --- evidential ----------------------------------------------------------------------------------------------------


@register(
    "f27_dirichlet_outputs",
    """WITH a AS (SELECT vec_id, greatest(embedding[1]::DOUBLE, 0) + ln(1 + exp(-abs(embedding[1]::DOUBLE))) + 1 AS a0, greatest(embedding[2]::DOUBLE, 0) + ln(1 + exp(-abs(embedding[2]::DOUBLE))) + 1 AS a1 FROM embeddings)
SELECT vec_id, round(a1 / (a0 + a1), 9) AS p_toxic, (a1 / (a0 + a1) >= 0.5)::INT AS pred_label, round(2 / (a0 + a1), 9) AS uncertainty, round(1 - 2 / (a0 + a1), 9) AS confidence, round(a0 + a1 - 2, 9) AS total_evidence FROM a""",
)
def f27_dirichlet_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    z = [evidential.softplus_evidence(F.get("embedding", F.lit(i)).cast("double")) for i in (0, 1)]
    d = e.select("vec_id", evidential.dirichlet(*z).alias("d"))
    return d.select("vec_id", F.round("d.p_toxic", 9).alias("p_toxic"), "d.pred_label", F.round("d.uncertainty", 9).alias("uncertainty"), F.round("d.confidence", 9).alias("confidence"), F.round("d.total_evidence", 9).alias("total_evidence"))


@register(
    "f29_evidential_loss",
    """WITH z AS (SELECT vec_id, (label >= 5)::INT AS y, greatest(embedding[1]::DOUBLE, 0) + ln(1 + exp(-abs(embedding[1]::DOUBLE))) + 1 AS a0, greatest(embedding[2]::DOUBLE, 0) + ln(1 + exp(-abs(embedding[2]::DOUBLE))) + 1 AS a1 FROM embeddings),
s AS (SELECT *, a0 + a1 AS s, CASE WHEN y = 1 THEN a1 ELSE a0 END AS own, CASE WHEN y = 1 THEN a0 ELSE a1 END AS other FROM z),
p AS (SELECT *, own / s AS p, other / s AS q FROM s)
SELECT vec_id, round(CASE WHEN y = 1 THEN 2.0 ELSE 1.0 END * (1 - p) * ((1 - p) ** 2 + q ** 2 + (p * (1 - p) + q * (1 - q)) / (s + 1)) + 0.5 * (ln(other) - (other - 1) / other), 9) AS loss FROM p""",
)
def f29_evidential_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") >= 5).cast("int").alias("y"), *[evidential.softplus_evidence(F.get("embedding", F.lit(i)).cast("double")).alias(f"a{i}") for i in (0, 1)])
    return e.select("vec_id", F.round(evidential.evidential_loss(F.col("a0"), F.col("a1"), F.col("y"), 0.5, (1.0, 2.0), 1.0), 9).alias("loss"))


def _fixed_model() -> list[tuple[np.ndarray, np.ndarray]]:
    r = np.random.default_rng(7)
    return [(r.normal(size=(64, 16)) / 8, r.normal(size=16)), (r.normal(size=(16, 2)) / 4, r.normal(size=2))]


def _mlp_sql() -> str:
    """The same arithmetic with the weights written out."""
    (w1, b1), (w2, b2) = _fixed_model()
    number = lambda v: f"{float(v)!r}::DOUBLE"
    h = ", ".join("greatest(0, " + " + ".join([number(b1[j]), *(f"embedding[{i + 1}] * {number(w1[i, j])}" for i in range(64))]) + f") AS h{j}" for j in range(16))
    z = ", ".join(" + ".join([number(b2[k]), *(f"h{j} * {number(w2[j, k])}" for j in range(16))]) + f" AS z{k}" for k in range(2))
    a = ", ".join(f"greatest(z{k}, 0) + ln(1 + exp(-abs(z{k}))) + 1 AS a{k}" for k in range(2))
    return f"WITH h AS (SELECT vec_id, {h} FROM embeddings), z AS (SELECT vec_id, {z} FROM h), a AS (SELECT vec_id, {a} FROM z) SELECT vec_id, round(a1 / (a0 + a1), 9) AS p_toxic, round(2 / (a0 + a1), 9) AS uncertainty, (a1 / (a0 + a1) >= 0.5)::INT AS pred_label FROM a"


@register("n2_batched_prediction", _mlp_sql())
def n2_batched_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return evidential.score_batches(e, evidential.mlp(_fixed_model())).select("vec_id", F.round("prediction.p_toxic", 9).alias("p_toxic"), F.round("prediction.uncertainty", 9).alias("uncertainty"), "prediction.pred_label")


# --- text ----------------------------------------------------------------------------------------------------------


@register("f1_text_functions", rf"""SELECT doc_id, md5({_PLAIN}) AS plain, length({_PLAIN}) AS n, CASE WHEN length({_PLAIN}) > 2000 THEN 2014 ELSE length({_PLAIN}) END AS clipped, substr(sha1(text), 1, 16) AS digest,
 md5(regexp_replace(lower(regexp_replace({_PLAIN}, '\([^)]*\)', '', 'g')), '[^\p{{L}}\p{{N}}\p{{M}}_]+', '', 'g')) AS plain_id, (text IS NULL OR trim(text) = '' OR lower(trim(text)) = 'nan') AS missing FROM documents""")
def f1_text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    plain = text.normalize_whitespace(t)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(plain.cast("binary")).alias("plain"), F.length(plain).alias("n"), F.length(text.clip(t)).alias("clipped"), text.short_digest(t).alias("digest"), F.md5(text.normalize_id(t).cast("binary")).alias("plain_id"), text.is_missing(t).alias("missing"))


@register("f4_sentences", rf"SELECT doc_id, CASE WHEN {_PLAIN} = '' THEN 0 ELSE 1 + length({_PLAIN}) - length(regexp_replace({_PLAIN}, '([.!?]) ', '\1', 'g')) END AS n_sentences FROM documents")
def f4_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.split_sentences(F.col("text"))).cast("long").alias("n_sentences"))


@register("p1_ingest_normalise", "SELECT doc_id, md5(translate(regexp_replace(upper(replace(coalesce(text, ''), 'ß', 'SS')), '[^A-Z]', '', 'g'), 'UZOBJ', 'XXXXX')) AS normalised, regexp_replace(upper(replace(coalesce(text, ''), 'ß', 'SS')), '[^A-Z]', '', 'g') <> '' AS valid FROM documents")
def p1_ingest_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.ingest_normalise(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.cast("binary")).alias("normalised"), text.is_valid_ingest(t).alias("valid"))


@register("f7_find_sequences", """WITH t AS (SELECT item_id, unnest(string_split(regexp_replace(upper(replace(coalesce(text, ''), 'ß', 'SS')), '[^ACDEFGHIKLMNPQRSTVWYBXZJUO]+', ' ', 'g'), ' ')) AS w FROM benchmark)
SELECT item_id, count(DISTINCT w) FILTER (length(w) >= 5 AND NOT (length(w) >= 10 AND length(regexp_replace(replace(replace(w, substr(w, 1, 1), ''), substr(replace(w, substr(w, 1, 1), ''), 1, 1), ''), '', '')) = 0)) AS n_sequences FROM t GROUP BY item_id""")
def f7_find_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(text.find_sequences(F.col("text"), 5)).cast("long").alias("n_sequences"))


_LETTERS = "ACDEFGHIKLMNPQRSTVWY"


def _composition_sql() -> str:
    n = {a: f"(length(s) - length(replace(s, '{a}', '')))" for a in _LETTERS}
    long = "length(s)::DOUBLE"
    total = lambda scale: "(" + " + ".join(f"{n[a]} * {v}::DOUBLE" for a, v in scale.items()) + ")"
    spread = lambda scale: f"sqrt(({total({a: v * v for a, v in scale.items()})}) / {long} - pow({total(scale)} / {long}, 2))"
    share = lambda letters: "(" + " + ".join(n[a] for a in letters) + f") / {long}"
    found = {
        "length": long, "log1p_length": f"ln(1 + {long})", "net_charge": total(sequences.CHARGE), "mean_charge": f"{total(sequences.CHARGE)} / {long}", "mean_hydrophobicity_kd": f"{total(sequences.HYDROPHOBICITY)} / {long}", "std_hydrophobicity_kd": spread(sequences.HYDROPHOBICITY),
        "mean_residue_mw": f"{total(sequences.MASS)} / {long}", "std_residue_mw": spread(sequences.MASS), "frac_aromatic": share("FWY"), "frac_polar": share("STNQHYC"), "frac_pos": share("KRH"), "frac_neg": share("DE"), "frac_hydrophobic_kd_pos": share("ACFILMV"), **{f"aa_frac_{a}": share(a) for a in _LETTERS},
    }
    columns = ", ".join(f"round({v}, 5) AS {k}" for k, v in found.items())
    return f"WITH s AS (SELECT doc_id, regexp_replace(upper(replace(coalesce(text, ''), 'ß', 'SS')), '[^{_LETTERS}]', '', 'g') AS s FROM documents) SELECT doc_id, {columns} FROM s WHERE s <> ''"


@register("f24_composition", _composition_sql())
def f24_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), f"[^{_LETTERS}]", "").alias("s")).where("s <> ''")
    f = sequences.composition(s, "s", ["doc_id"])
    return f.select("doc_id", *[F.round(c, 5).alias(c) for c in f.columns[1:]])


@register(
    "f9_measurements",
    """SELECT p_partkey, 'MIC ' || p_size || ' ± 2 µM' AS raw, 'MIC' AS endpoint, '' AS cmp, p_size::DOUBLE AS value, 2.0::DOUBLE AS error, NULL::DOUBLE AS range_low, NULL::DOUBLE AS range_high, 'µM' AS unit, 'pH 7.' || p_size % 10 AS conditions FROM part
UNION ALL SELECT p_partkey, '5-' || p_size + 6 || ' mg/mL', '', '', NULL, NULL, 5.0, (p_size + 6)::DOUBLE, 'mg/mL', 'pH 7.' || p_size % 10 FROM part""",
)
def f9_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("MIC "), F.col("p_size"), F.lit(" ± 2 µM at pH 7."), F.col("p_size") % 10, F.lit(", 5-"), F.col("p_size") + 6, F.lit(" mg/mL, x1")).alias("t"))
    m = p.select("p_partkey", F.explode(measure.measurements(F.col("t"))).alias("m"), F.concat_ws(";", measure.conditions(F.col("t"))).alias("conditions"))
    return m.select("p_partkey", "m.*", "conditions")


@register("f12_header_hints", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'IC50' WHEN p_size % 3 = 1 THEN '' ELSE 'MIC' END AS endpoint, CASE WHEN p_size % 3 = 1 THEN '' ELSE 'µM' END AS unit FROM part")
def f12_header_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.when(F.col("p_size") % 3 == 0, "IC50 (µM) of strain").when(F.col("p_size") % 3 == 1, "SI (CC50/IC50)").otherwise("MIC/MBC [µM]")
    return table(spark, sf_dir, "part").select("p_partkey", measure.header_hint(h).alias("h")).select("p_partkey", "h.*")


@register(
    "p11_threshold_sentences",
    rf"""WITH d AS (SELECT doc_id, lower({_PLAIN}) AS s FROM documents UNION ALL SELECT p_partkey + 1000000000, lower(CASE p_partkey % 5 WHEN 0 THEN 'Labelled  as toxic' WHEN 1 THEN 'was labeled as class 2' WHEN 2 THEN 'toxic IF large' WHEN 3 THEN 'a cut-off of 5' ELSE 'no threshold, labeled as positive' END) FROM part)
SELECT doc_id, CASE WHEN s = '' THEN false WHEN contains(s, 'toxic if') THEN true WHEN regexp_matches(s, 'threshold|cutoff|cut-off|cut off') THEN regexp_matches(s, '[0-9]') WHEN regexp_matches(regexp_replace(s, '\s+', ' ', 'g'), 'labelled as|labeled as') THEN regexp_matches(s, 'toxic|positive|negative') ELSE false END AS is_rule FROM d""",
)
def p11_threshold_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, and sentences for each of the rules."""
    k = F.col("p_partkey") % 5
    made = F.when(k == 0, "Labelled  as toxic").when(k == 1, "was labeled as class 2").when(k == 2, "toxic IF large").when(k == 3, "a cut-off of 5").otherwise("no threshold, labeled as positive")
    d = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(table(spark, sf_dir, "part").select((F.col("p_partkey") + 1000000000).alias("doc_id"), made.alias("text")))
    return d.select("doc_id", measure.is_threshold_sentence(F.col("text")).alias("is_rule"))


@register("s27_page_links", """WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM pages) SELECT page_id, count(DISTINCT href) AS n_links FROM l GROUP BY page_id""")
def s27_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", papers.page_links(F.col("html")).alias("links")).where(F.size("links") > 0)
    return p.select("page_id", F.size("links").cast("long").alias("n_links"))


@register(
    "s27_supplementary_links",
    r"""WITH l AS (SELECT page_id, url, replace(unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]+)"', 1, 'i')), '&amp;', '&') AS h FROM pages),
b AS (SELECT *, regexp_extract(url, '^[A-Za-z]+:') AS scheme, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') AS origin, regexp_replace(url, '[?#].*$', '') AS plain FROM l),
a AS (SELECT DISTINCT page_id, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN h LIKE '//%' THEN scheme || h WHEN h LIKE '/%' THEN origin || h WHEN h LIKE '#%' THEN regexp_replace(url, '#.*$', '') || h WHEN h LIKE '?%' THEN plain || h WHEN plain = origin THEN origin || '/' || h ELSE regexp_replace(plain, '[^/]*$', '') || h END AS u FROM b)
SELECT page_id, u AS url FROM a WHERE regexp_matches(lower(u), 'supplement|supporting|additional|moesm|esm|suppl|source-data|source_data|\.(zip|pdf|csv|tsv|txt|xlsx|xls|doc|docx|rtf|fa|fasta|json|xml|tif|tiff|png|jpg|jpeg|svg)$')""",
)
def s27_supplementary_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(papers.supplementary_links(F.col("url"), F.col("html"))).alias("url"))


@register("s22_classify_identifiers", r"SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'pmcid' WHEN page_id % 5 = 1 THEN 'pmid' WHEN page_id % 5 = 2 THEN 'doi' WHEN page_id % 5 = 3 THEN 'doi' ELSE 'url' END AS kind, CASE WHEN page_id % 5 = 0 THEN 'PMC' || page_id WHEN page_id % 5 = 1 THEN CAST(page_id AS VARCHAR) WHEN page_id % 5 = 2 THEN '10.1000/x' || page_id WHEN page_id % 5 = 3 THEN '10.1000/y' || page_id ELSE trim(url) END AS value FROM pages")
def s22_classify_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    k = F.col("page_id") % 5
    raw = F.when(k == 0, F.concat(F.lit("pmc"), i)).when(k == 1, i).when(k == 2, F.concat(F.lit("10.1000/x"), i)).when(k == 3, F.concat(F.lit("https://doi.org/10.1000/y"), i)).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", papers.classify_identifier(raw).alias("c")).select("page_id", "c.*")


@register("w9_sliding_windows", "WITH c AS (SELECT conv_id, turn, text, greatest(0, ceil((length(text) - 200) / 150.0::DOUBLE))::INT AS last FROM conversations), w AS (SELECT conv_id, turn, text, unnest(generate_series(0, last)) * 150 AS start FROM c) SELECT conv_id, turn, CAST(start AS BIGINT) AS start, md5(substr(text, start + 1, 200)) AS piece FROM w")
def w9_sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = vectors.window_texts(table(spark, sf_dir, "conversations"), "text", 200, 150)
    return w.select("conv_id", "turn", F.col("start").cast("long").alias("start"), F.md5(F.col("window").cast("binary")).alias("piece"))


@register("a27_weighted_pool", "WITH u AS (SELECT label, vec_id % 7 + 1 AS w, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label, i, round(sum(x * w) / sum(w), 7) AS x FROM u GROUP BY label, i")
def a27_weighted_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 7 + 1).alias("weight"), F.col("embedding").alias("vector"))
    return vectors.weighted_pool(e, "label").select("label", F.posexplode("vector").alias("i", "x")).select("label", (F.col("i") + 1).alias("i"), F.round("x", 7).alias("x"))


@register(
    "a26_alignment_summary",
    """WITH p AS (SELECT p_brand AS a, p_partkey AS r, replace(upper(p_name), ' ', '-') AS s FROM part), c AS (SELECT a, s, unnest(generate_series(1, length(s))) AS i FROM p), l AS (SELECT a, i, substr(s, i, 1) AS x, count(*) AS k FROM c GROUP BY 1, 2, 3),
f AS (SELECT a, i, k / sum(k) OVER (PARTITION BY a, i)::DOUBLE AS q FROM l WHERE x <> '-'), e AS (SELECT a, i, -sum(q * ln(q)) / ln(20.0::DOUBLE) AS h FROM f GROUP BY a, i),
w AS (SELECT a, count(*) AS depth, arg_min(s, r) AS first, max(length(s)) AS wide, avg((length(s) - length(replace(s, '-', ''))) / greatest(1, length(s))::DOUBLE) AS gaps FROM p GROUP BY a),
u AS (SELECT w.a, unnest(generate_series(1, wide)) AS i FROM w), t AS (SELECT u.a, coalesce(e.h, 0) AS h FROM u LEFT JOIN e ON e.a = u.a AND e.i = u.i),
g AS (SELECT a, avg(h) AS m, median(h) AS md, min(h) AS lo, max(h) AS hi, avg((h <= 0.3)::INT) AS k FROM t GROUP BY a)
SELECT w.a AS aln_id, CASE WHEN depth < 2 THEN 0 ELSE depth END::DOUBLE AS depth, CASE WHEN depth < 2 THEN 0 ELSE round(ln(1 + depth), 7) END AS log1p_depth, CASE WHEN depth < 2 THEN 0 ELSE round((length(first) - length(replace(first, '-', ''))) / greatest(1, length(first))::DOUBLE, 7) END AS gap_first,
 CASE WHEN depth < 2 THEN 0 ELSE round(gaps, 7) END AS gap_all, CASE WHEN depth < 2 THEN 0 ELSE round(m, 7) END AS h_mean, CASE WHEN depth < 2 THEN 0 ELSE round(md, 7) END AS h_median, CASE WHEN depth < 2 THEN 0 ELSE round(lo, 7) END AS h_min, CASE WHEN depth < 2 THEN 0 ELSE round(hi, 7) END AS h_max, CASE WHEN depth < 2 THEN 0 ELSE round(k, 7) END AS conserved
FROM w JOIN g ON g.a = w.a""",
)
def a26_alignment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("aln_id"), F.col("p_partkey").alias("row"), F.translate(F.upper("p_name"), " ", "-").alias("aligned"))
    s = sequences.alignment_summary(p)
    return s.select("aln_id", *[F.round(c, 7).alias(c) for c in s.columns[1:]])


@register("a28_graph_mean", f"WITH {_HITS} SELECT 0 AS graph_id, v.vec_id AS node, round(coalesce((SELECT avg(n.embedding[1]::DOUBLE) FROM h JOIN embeddings n ON n.vec_id = h.neighbour WHERE h.query = v.vec_id), 0), 9) AS mean FROM embeddings v")
def a28_graph_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, _ = _hits(spark, sf_dir)
    edges = hits.select(F.lit(0).alias("graph_id"), F.col("neighbour").alias("src"), F.col("query").alias("dst"))
    nodes = table(spark, sf_dir, "embeddings").select(F.lit(0).alias("graph_id"), F.col("vec_id").alias("node"), F.get("embedding", F.lit(0)).cast("double").alias("x"))
    return vectors.neighbour_mean(nodes, edges).withColumn("mean", F.round("mean", 9))


@register("f31_product_correction", "WITH s AS (SELECT lang AS i, source AS j, count(*)::DOUBLE AS score FROM documents GROUP BY 1, 2) SELECT i, j, round(score - avg(score) OVER (PARTITION BY i) * avg(score) OVER (PARTITION BY j) / greatest(avg(score) OVER (), 1e-12), 7) AS corrected FROM s")
def f31_product_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").groupBy(F.lit(0).alias("graph_id"), F.col("lang").alias("i"), F.col("source").alias("j")).agg(F.count("*").cast("double").alias("score"))
    return vectors.average_product_correction(s).select("i", "j", F.round("corrected", 7).alias("corrected"))


@register("f33_substitutions", "WITH s AS (SELECT n_nationkey, replace(n_name, ' ', '') AS s FROM nation), p AS (SELECT n_nationkey, s, unnest(generate_series(1, length(s))) AS i FROM s), a AS (SELECT unnest(string_split('A,C,D,E,F,G,H,I,K,L,M,N,P,Q,R,S,T,V,W,Y', ',')) AS new) SELECT n_nationkey, CAST(i - 1 AS INT) AS pos, new, substr(s, 1, i - 1) || new || substr(s, i + 1) AS variant FROM p, a WHERE substr(s, i, 1) <> new AND substr(s, i, 1) <> 'C' AND new <> 'C'")
def f33_substitutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.replace("n_name", F.lit(" "), F.lit("")).alias("sequence"))
    return sequences.substitutions(n, "sequence", forbid="C").select("n_nationkey", "pos", "new", "variant")


_FLAGS = {"flip_top1": "r <= 1 AND p < 0.5", "flip_topk": "r <= 10 AND p < 0.5", "reduce_top1": "r <= 1 AND bp - p >= 0.1", "reduce_topk": "r <= 10 AND bp - p >= 0.1"}
_SCORE = "(('0x' || substr(md5({}), 1, 4))::INT / 65536.0::DOUBLE)"


@register(
    "a23_strategy_summary",
    f"""WITH c AS (SELECT n_nationkey AS id, replace(n_name, ' ', '') AS s FROM nation), gd AS (SELECT a.id, arg_min(b.s, b.id) AS guide FROM c a JOIN c b ON a.id <> b.id AND b.id % 2 = 0 AND length(a.s) = length(b.s) GROUP BY a.id),
al AS (SELECT unnest(string_split('{",".join(_LETTERS)}', ',')) AS new), ps AS (SELECT id, s, unnest(generate_series(1, length(s))) AS i FROM c), scan AS (SELECT id, s, i, new FROM ps, al WHERE substr(s, i, 1) <> new AND substr(s, i, 1) <> 'C' AND new <> 'C'),
ev AS (SELECT ps.id, ps.s, ps.i, substr(guide, ps.i, 1) AS new FROM ps JOIN gd ON gd.id = ps.id WHERE substr(s, i, 1) <> substr(guide, i, 1) AND substr(s, i, 1) <> 'C' AND substr(guide, i, 1) <> 'C'),
k AS (SELECT 'evidence' AS st, * FROM ev UNION ALL SELECT 'attribution', * FROM scan WHERE i IN (1, 3) UNION ALL SELECT 'full_scan', * FROM scan), v AS (SELECT st, id, s, substr(s, 1, i - 1) || new || substr(s, i + 1) AS v FROM k),
sc AS (SELECT *, {_SCORE.format("v")} AS p, {_SCORE.format("reverse(v)")} AS u, {_SCORE.format("s")} AS bp, {_SCORE.format("reverse(s)")} AS bu FROM v), rk AS (SELECT *, row_number() OVER (PARTITION BY id, st ORDER BY p, u, v) AS r FROM sc),
h AS (SELECT st, id, {", ".join(f"max(({c} AND u <= bu + 0.05)::INT) AS {n}" for n, c in _FLAGS.items())}, min(p) FILTER (r = 1) AS top1 FROM rk GROUP BY st, id), gr AS (SELECT st, c.id FROM c, (SELECT unnest(['evidence', 'attribution', 'full_scan']) AS st))
SELECT gr.st AS strategy, round(avg((h.id IS NOT NULL)::INT), 9) AS coverage, {", ".join(f"round(avg(coalesce({n}, 0)), 9) AS {n}_rate, round(avg({n}), 9) AS {n}_rate_covered" for n in _FLAGS)}, round(avg(top1), 9) AS mean_top1_p FROM gr LEFT JOIN h ON h.id = gr.id AND h.st = gr.st GROUP BY gr.st""",
)
def a23_strategy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("case_id"), F.replace("n_name", F.lit(" "), F.lit("")).alias("sequence"), F.array(F.lit(0), F.lit(2)).alias("positions"))
    near = cases.select("case_id", "sequence").join(cases.select(F.col("case_id").alias("other"), F.col("sequence").alias("guide")), F.col("case_id") != F.col("other")).select("case_id", F.col("other").alias("rank"), F.col("guide").alias("sequence"), (F.col("other") % 2).alias("label"))
    c = sequences.expand(cases, near, positions="positions", forbid="C")
    score = lambda s: F.conv(F.substring(F.md5(s.cast("binary")), 1, 4), 16, 10).cast("int") / F.lit(65536.0)
    scored = c.withColumn("p", score(F.col("variant"))).withColumn("uncertainty", score(F.reverse("variant"))).join(cases.select("case_id", score(F.col("sequence")).alias("bp"), score(F.reverse("sequence")).alias("bu")), "case_id")
    hits = sequences.hit_metrics(sequences.rank_candidates(scored, ["case_id", "strategy"]), ["case_id", "strategy"], "bp", "bu")
    s = sequences.strategy_summary(cases, hits, ["evidence", "attribution", "full_scan"])
    return s.select("strategy", *[F.round(c, 9).alias(c) for c in s.columns[1:]])


@register(
    "p9_quality_screen",
    """WITH x AS (SELECT p_partkey, upper(replace(p_name, ' ', '')) AS sequence, p_size AS v, p_brand, p_partkey % 4 AS k FROM part)
SELECT p_brand, count(*) AS n, count(DISTINCT sequence) AS n_sequence, CAST(sum((regexp_matches(sequence, '^[ACDEFGHIKLMNPQRSTVWY]+$') AND length(sequence) >= 5 AND k <> 0 AND k <> 1 AND k <> 2)::INT) AS BIGINT) AS train_ready_strict,
 CAST(sum((regexp_matches(sequence, '^[ACDEFGHIKLMNPQRSTVWY]+$') AND length(sequence) >= 5 AND k <> 0 AND k <> 1)::INT) AS BIGINT) AS train_ready_relaxed FROM x GROUP BY p_brand""",
)
def p9_quality_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    r = table(spark, sf_dir, "part").select("p_brand", F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("sequence"), F.col("p_size").cast("string").alias("value"), F.when(k == 0, "nan").otherwise("µM").alias("unit"), F.when(k == 2, ">").otherwise("").alias("cmp"), F.lit(None).cast("string").alias("condition"), F.when(k == 1, "row=1;val_col_header=Geometric mean").otherwise("val_col_header=E. coli").alias("context"))
    return quality.flag_rollup(quality.screen(r), "p_brand", ["train_ready_strict", "train_ready_relaxed"], "sequence", None)


@register("a11_value_counts", "SELECT lang AS value, count(*) AS n FROM documents GROUP BY lang")
def a11_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.value_counts(table(spark, sf_dir, "documents"), "lang")


@register("j10_without_labels", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j10_without_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.without_records(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@register("a33_examples_per_group", "WITH g AS (SELECT greatest(1, floor(20.0 / count(DISTINCT source))) AS share FROM documents), r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) SELECT source, doc_id FROM r, g WHERE r <= share ORDER BY source, r LIMIT 20")
def a33_examples_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.examples_per_group(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", ["doc_id"], 20)
