"""URL rules by a sort-merge range join over reversed-host keys. DataFrame functions only.

A rule (host, path, verdict) covers its host and all subdomains where the url's path starts with its
path. A url becomes one point for each suffix of its host (no more labels than the longest rule host
has); a rule becomes the interval of keys that start with (reversed host, path). Intervals of this kind
are nested or apart, so the rules open at any point of the sorted order are a stack. Points and rule
starts are sorted together by range, and the sweep carries the stack of the last rule that started;
the open rule of greatest length on that stack is the url's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import lower_ascii, materialize, partitions

#: The rules of the query, (host, path, verdict).
QUERY_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
STACK = "array<struct<size:int,k_host:string,prefix:string,rule:string,verdict:string>>"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host between the first :// and /, ?, # or the end, A-Z lowered; path then up to ?, # or the end."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def _stacks(rules: DataFrame) -> DataFrame:
    """One row a rule: its key and the stack of rules open once it has started, itself last."""
    own = (
        rules.where("verdict in ('allow', 'block')")
        .select(lower_ascii(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))
        .select(
            F.array_join(F.reverse(F.split("host", r"\.")), ".").alias("k_host"),
            F.col("path").alias("prefix"),
            F.concat("host", "path").alias("rule"),
            "verdict",
        )
    )
    above = own.select("k_host", F.col("prefix").alias("k_path"), F.explode(F.sequence(F.lit(0), F.length("prefix"))).alias("cut"))
    above = above.select("k_host", "k_path", F.expr("substring(k_path, 1, cut)").alias("prefix"))
    return (
        above.join(own, ["k_host", "prefix"])
        .groupBy("k_host", "k_path")
        .agg(F.sort_array(F.collect_list(F.struct(F.length("prefix").alias("size"), "k_host", "prefix", "rule", "verdict"))).cast(STACK).alias("stack"))
    )


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: id, host, path, rule (host and path as text, or null), verdict.

    The rule of greatest length (of host and path together) wins; where allow and block have the same
    host and path, block does. A null url, or one without ``://``, has empty host and path and gets no rule
    unless one has an empty host. Null and repeated ids keep their rows; other columns are not read.
    Without rules, every row gets the default verdict; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    n = partitions(spark)
    host, path = split_url(F.col(url_col))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    stacks = _stacks(rules)
    most = stacks.agg(F.max(F.size(F.split("k_host", r"\.")))).first()[0] or 1

    labels = F.split("host", r"\.")
    count = F.size(labels)
    reverse = F.array_join(F.reverse(F.slice(labels, F.col("at"), count)), ".")
    points = urls.select("*", F.posexplode(F.sequence(F.greatest(F.lit(1), count - F.lit(most) + 1), count)).alias("nth", "at")).select(
        reverse.alias("k_host"), F.col("path").alias("k_path"), F.lit(1).alias("kind"), "id", "host", "path",
        (F.col("nth") == 0).cast("long").alias("own"), F.lit(None).cast(STACK).alias("stack"),
    )
    starts = stacks.select(
        "k_host", "k_path", F.lit(0).alias("kind"), F.lit(None).cast(urls.schema["id"].dataType).alias("id"),
        F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.lit(0).cast("long").alias("own"), "stack",
    )
    line = points.unionByName(starts).repartitionByRange(n, "k_host", "k_path", "kind", "id", "host", "path")
    line = materialize(line.withColumn("part", F.spark_partition_id()), "urls")

    # The stack on entering each range: of the last rule that started in an earlier one. A row for each range.
    last = line.where("kind = 0").groupBy("part").agg(F.max_by("stack", F.struct("k_host", "k_path")).alias("stack"))
    order = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    entry = spark.range(n).select(F.col("id").cast("int").alias("part")).join(last, "part", "left").select("part", F.last("stack", True).over(order).alias("entry"))

    sweep = W.partitionBy("part").orderBy("k_host", "k_path", "kind").rowsBetween(W.unboundedPreceding, 0)
    swept = line.join(F.broadcast(entry), "part", "left").withColumn("open", F.coalesce(F.last("stack", True).over(sweep), "entry")).where("kind = 1")
    swept = swept.withColumn("hit", F.expr("try_element_at(filter(open, r -> r.k_host = k_host AND startswith(k_path, r.prefix)), -1)"))
    best = swept.groupBy("id", "host", "path").agg(
        F.max_by("hit", F.when(F.col("hit").isNotNull(), F.struct(F.length("hit.rule"), F.length("k_host")))).alias("hit"), F.sum("own").alias("copies")
    )
    return best.select(F.explode(F.expr("sequence(1L, copies)")).alias("_"), "*").select(
        F.col("id").alias(id_col), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict")
    )


ORACLE = """
WITH u AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    END AS rule FROM h
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark, QUERY_RULES))
