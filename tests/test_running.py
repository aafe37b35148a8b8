"""Running sums in groups of any size, and CSV files cut over tasks."""

import random

from pyspark.sql import functions as F

from tessera.operators.running import running_sums
from tessera.sources.records import read_labelled_csv


def test_running_sums_by_group(spark):
    """A group over several ranges, a group of nulls, groups of one row; ranges hold several groups."""
    r = random.Random(5)
    rows = [(r.choice(["hot"] * 8 + [None, "a", "b"]), k, r.randrange(5)) for k in range(3_000)] + [("one", 9, 4)]
    t = spark.createDataFrame(rows, "g string, at long, v long").repartition(4)
    got = running_sums(t, [F.desc("at")], {"upto": F.col("v")}, ["g"], {"total": "upto"}).collect()
    sums, want = {}, {}
    for g, at, v in sorted(rows, key=lambda x: -x[1]):
        sums[g] = sums.get(g, 0) + v
        want[(g, at, v)] = sums[g]
    assert len(got) == len(rows)
    assert all(want[(x.g, x.at, x.v)] == x.upto and x.total == sums[x.g] for x in got)
    assert running_sums(t.limit(0), ["at"], {"upto": F.col("v")}, ["g"]).count() == 0


def test_large_csv_is_cut(spark, tmp_path):
    path = str(tmp_path / "labels.csv")
    with open(path, "w", encoding="utf-8") as f:
        f.write("sequence,label\n" + "".join(f'"AC""D,{k}",{k % 2}\n' for k in range(20_000)))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        cut, one = read_labelled_csv(spark, path, multi_line=False), read_labelled_csv(spark, path)
        assert cut.rdd.getNumPartitions() > 2 and one.rdd.getNumPartitions() == 1
        assert cut.select("sequence", "label").exceptAll(one.select("sequence", "label")).count() == 0 and cut.count() == 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
