"""The last record of each key, streamed in several runs, against the batch."""

import datetime
import random

from pyspark.sql import functions as F
from tessera.streaming.latest import keep_latest, read_latest

SCHEMA = "name string, at timestamp_ntz, nth long, status string"


def made(n, seed):
    r = random.Random(seed)
    day = datetime.datetime(2024, 1, 1)
    return [(None if r.random() < 0.05 else f"p{r.randrange(30)}" if r.random() < 0.6 else "hot", day + datetime.timedelta(seconds=r.randrange(5000)), k, r.choice(["ok", "failed"])) for k in range(seed * 100_000, seed * 100_000 + n)]


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def run(spark, tmp_path):
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    keep_latest(stream, "name", ["at", "nth"], str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    return {r.name: tuple(r) for r in read_latest(spark.read.parquet(str(tmp_path / "out")), "name").collect()}


def want(rows):
    best = {}
    for row in rows:
        if row[0] not in best or row[1:3] > best[row[0]][1:3]:
            best[row[0]] = row
    return best


def test_three_runs_equal_the_batch(spark, tmp_path):
    parts = [made(400, 1), made(300, 2), made(5, 3)]
    for upto in range(1, 4):
        put(spark, tmp_path / "in", parts[upto - 1])
        assert run(spark, tmp_path) == want([r for p in parts[:upto] for r in p])
    assert run(spark, tmp_path) == want([r for p in parts for r in p])  # nothing new


def test_late_and_repeated_records_change_nothing(spark, tmp_path):
    rows = made(200, 4)
    put(spark, tmp_path / "in", rows)
    first = run(spark, tmp_path)
    put(spark, tmp_path / "in", rows)
    put(spark, tmp_path / "in", [(n, at - datetime.timedelta(days=9), nth, "late") for n, at, nth, _ in rows])
    assert run(spark, tmp_path) == first
    changed = spark.read.parquet(str(tmp_path / "out")).groupBy("batch").count().where(F.col("batch") > 0)
    assert changed.count() == 0  # no key was written again


def test_records_without_a_place_are_left_out(spark, tmp_path):
    put(spark, tmp_path / "in", [("a", None, 1, "ok"), ("b", datetime.datetime(2024, 1, 1), 2, "ok")])
    assert run(spark, tmp_path).keys() == {"b"}
