"""Lookups beyond the broadcast bound, scratch tables."""

import pytest

from pyspark.sql import functions as F

from tessera.llm import common


def test_lookups_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 2)
    rows = spark.range(4000).select("id", F.when(F.col("id") < 2500, "hot").otherwise((F.col("id") % 300).cast("string")).alias("k"))
    groups = rows.groupBy("k").agg(F.count("*").alias("n")).where("n > 1 AND k <> '7'")
    got = common.lookup_skewed(rows, groups, "k", "n", 4000)
    assert got.count() == 4000 and got.where("k = 'hot' AND n = 2500").count() == 2500 and got.where("k = '7' AND n IS NULL").count() == 5
    assert common.lookup(rows, groups, ["k"], "inner").count() == 3995


def test_scratch_tables_go(spark):
    t = common.materialize(spark.range(5), "test")
    assert t.count() == 5
    path = spark._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert files.exists(path)
    common.discard(t)
    assert not files.exists(path)


def test_no_local_folder_on_a_cluster():
    """Without a shared folder a cluster's session raises; hosts must not write to folders of their own."""

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())


def test_batches_and_ids(spark):
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    common.small_batches(spark)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(common.BATCH_BYTES)
    with pytest.raises(TypeError, match="whole numbers"):
        common.whole_id(spark.createDataFrame([("x",)], "doc_id string"), "doc_id")
    assert spark.range(3).select(common.whole_id(spark.range(3), "id")).count() == 3


def test_heavy_keys_are_cut(spark):
    """A key with most of the rows is dealt over pieces; the join gives the rows of a plain one."""
    from tessera.llm.common import heavy_keys, join_heavy

    rows = spark.range(1_000).selectExpr("id AS a", "CASE WHEN id % 10 < 7 THEN 0 ELSE id % 50 END AS b")
    table = spark.range(40).selectExpr("id AS b", "id * 2 AS v")
    heavy = heavy_keys(rows, "b", 100)
    assert {(r.b, r.pieces) for r in heavy.collect()} == {(0, 7)}
    assert sorted(map(tuple, join_heavy(rows, table, "b", heavy).collect())) == sorted(map(tuple, rows.join(table, "b").collect()))
    none = heavy_keys(rows, "b")
    assert none.isEmpty() and join_heavy(rows, table, "b", none).count() == rows.join(table, "b").count()
