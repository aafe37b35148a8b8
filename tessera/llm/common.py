"""What the operators of this subpackage share: scratch tables, partition counts, skew-safe lookups."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

#: Rows that a lookup table may have to be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000
#: A group with more than 1 / HEAVY_SHARE of all rows is heavy, so there are at most HEAVY_SHARE heavy groups.
HEAVY_SHARE = 2_000

#: Rows and bytes of an Arrow batch.
BATCH_ROWS, BATCH_BYTES = 1_000, 16_000_000

#: The scratch folder of each application.
_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where that is unset: a local one if the master is local, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _hadoop(spark: SparkSession, path: str) -> tuple:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in this application's scratch folder, which the file system deletes when the driver's JVM ends, stopped session or not."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        folder = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
        target, where = _hadoop(spark, folder)
        where.mkdirs(target)
        where.deleteOnExit(target)
        _FOLDERS[app] = folder
    return f"{_FOLDERS[app]}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table that materialize() wrote and that nothing will read again."""
    target, where = _hadoop(table.sparkSession, table.scratch_path)
    where.delete(target, True)


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes at most: texts are long, and larger batches fill an executor.

    The settings stay after the query; smaller ones are left alone.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        held = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")
        if not held.isdigit() or not 0 < int(held) <= most:  # a size with a unit is replaced too
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def whole_id(df: DataFrame, name: str) -> Column:
    """The id column as long; an error if it does not hold whole numbers."""
    if df.select(F.col(f"`{name}`")).schema[0].dataType not in (ByteType(), ShortType(), IntegerType(), LongType()):
        raise TypeError(f"ids must be whole numbers: {name}")
    return F.col(f"`{name}`").cast("long")


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; once a partition is done its memory goes back to the system, as the worker lives on for other stages."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return go


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc32_mod(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lookup(rows: DataFrame, table: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a table of one row a key; broadcast only if it is counted to be small."""
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(table) if small else table, on, how)


def lookup_skewed(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left-join rows to their group's row (key, size, ...) where some groups hold much of the table.

    Few groups are broadcast. Else groups of more than total / HEAVY_SHARE rows, which number HEAVY_SHARE at most,
    are broadcast and the others are joined by shuffle, where no key is hot then.
    """
    if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), key, "left")
    limit = max(1_000, total // HEAVY_SHARE)
    heavy, light = groups.where(F.col(size) > limit), groups.where(F.col(size) <= limit)
    hot = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key, "left")
    return hot.unionByName(rest)


def heavy_keys(rows: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """Keys (key, pieces) of more than total / HEAVY_SHARE rows and more than `most`: HEAVY_SHARE at most, each to be cut into that many pieces."""
    limit = max(most, rows.count() // HEAVY_SHARE)
    counts = rows.groupBy(key).agg(F.count("*").alias("pieces")).where(F.col("pieces") > limit)
    return materialize(counts.select(key, F.ceil(F.col("pieces") / limit).cast("int").alias("pieces")), "heavy")


def join_heavy(rows: DataFrame, table: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    """Inner join of rows to a table of one row a key. Rows of heavy keys are dealt into pieces by their hash, and the key's row is copied to each."""
    if heavy.isEmpty():
        return rows.join(table, key)
    pieces = F.coalesce("pieces", F.lit(1))
    cut = rows.join(F.broadcast(heavy), key, "left").withColumn("piece", F.pmod(F.xxhash64(*rows.columns), pieces).cast("int")).drop("pieces")
    copied = table.join(F.broadcast(heavy), key, "left").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("pieces")
    return cut.join(copied, [key, "piece"]).drop("piece")
