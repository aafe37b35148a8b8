"""Relational queries on the star schema and the event table: extensions beyond the library's own operators, marked by the prefix x_."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.catalog import register
from tessera.streaming import events as stream

_TABLES = "region nation customer supplier part orders lineitem events".split()


def _sql(name: str, query: str, oracle: str | None = None) -> None:
    """A query that Spark and the oracle state alike."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        text = query
        for t in _TABLES:
            text = text.replace(f"{{{t}}}", f"parquet.`{sf_dir}/{t}.parquet`")
        return spark.sql(text)

    plain = query
    for t in _TABLES:
        plain = plain.replace(f"{{{t}}}", t)
    register(name, oracle or plain)(run)


_sql("x_pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
_sql("x_top_orders", "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM {customer} c JOIN {orders} o ON c_custkey = o_custkey JOIN {lineitem} l ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10")
_sql("x_revenue_by_nation", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} l JOIN {supplier} s ON l_suppkey = s_suppkey JOIN {nation} n ON s_nationkey = n_nationkey JOIN {region} r ON n_regionkey = r_regionkey GROUP BY n_name")
_sql("x_rollup_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_sql("x_window_frames", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS price_rank, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS previous FROM {orders}")
_sql("x_full_outer", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM {customer} WHERE c_nationkey < 12) c FULL OUTER JOIN (SELECT * FROM {orders} WHERE o_totalprice > 200000) o ON c_custkey = o_custkey")
_sql("x_semi_anti", "SELECT c_custkey, c_name FROM {customer} WHERE c_custkey NOT IN (SELECT o_custkey FROM {orders}) UNION ALL SELECT c_custkey, c_name FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P')")
_sql("x_set_operations", "(SELECT s_nationkey AS k FROM {supplier} INTERSECT SELECT c_nationkey FROM {customer}) EXCEPT SELECT n_nationkey FROM {nation} WHERE n_regionkey = 1")
_sql("x_correlated", "SELECT p_partkey, p_retailprice FROM {part} p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM {part} q WHERE q.p_brand = p.p_brand)")


@register("s12_latest_per_key", "SELECT user_id, event_id, ts FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def s12_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@register("x_tumbling_counts", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
def x_tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.tumbling_counts(spark.read.parquet(f"{sf_dir}/events.parquet")).withColumn("value", F.round("value", 6))


@register("x_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, new DESC ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def x_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"))


@register("x_json_properties", """SELECT event_id, key, json_extract_string(props, '$."' || key || '"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)""")
def x_json_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", F.explode(F.map_entries(F.from_json("props", "map<string,string>"))).alias("p")).select("event_id", "p.key", "p.value")
