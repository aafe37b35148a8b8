"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only.

Each row has a 36-bit hash of its id. Sizes are summed by source and hash bucket (12 bits); prefix sums
find the bucket in which a source's budget ends, and only that bucket is split by the next 12 bits, and
once more. What results is a threshold for each source, so rows are chosen by a filter and never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import lookup, materialize

BITS = 12
LEVELS = 3
#: Fixed values of the query: weights of the sources in order, repeating; share of all sizes; most repeats.
QUERY_WEIGHTS = (5, 2, 1)
QUERY_REPEATS = 3


def word_count(text: Column) -> Column:
    """Runs of anything but space and \\t \\n \\v \\f \\r; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")


def id_hash(id_col: Column) -> Column:
    """36 bits of the id's md5; equal ids stay together, a null id counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def cycled_weights(sources: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Weights dealt to the sources in code-point order, nulls last, repeating. sources: a row each."""
    rank = F.row_number().over(W.orderBy(F.col("key").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))


def targets(sources: DataFrame, repeats: float, share: float = 1.0) -> DataFrame:
    """Adds target: share of all sizes dealt by weight, none above repeats x its own size, the excess dealt again.

    With sources in the order of cap / weight, the capped ones are a prefix; the level of the others is what
    the prefix leaves over their weights. One row a source, so one small sorted window.
    """
    ratio = W.orderBy("ratio", F.col("key").asc_nulls_last())
    before = ratio.rowsBetween(W.unboundedPreceding, -1)
    filled = (
        sources.withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("all", F.sum("source_size").over(W.partitionBy()) * F.lit(float(share)))
        .withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(ratio.rowsBetween(0, W.unboundedFollowing)))
    )
    # The first that fits, in the window's order: of sources with one ratio the level counts of the first.
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col("key").isNull().alias("unnamed"), "key", "level"))
    return filled.withColumn("level", F.min(fits).over(W.partitionBy())["level"]).withColumn(
        "target", F.when(F.col("level").isNull() | (F.col("level") * F.col("weight") >= F.col("cap")), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    )


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] | DataFrame = QUERY_WEIGHTS,
    repeats: float = QUERY_REPEATS,
    share: float = 1.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: list[str] | None = None,
) -> DataFrame:
    """One row per input row: id, source, size, source_size, target, taken.

    taken is size times the copies of the row in the mix: the whole part of target / source_size, and one more
    for rows whose hash is below the source's threshold. weights: dealt to the sources in code-point order,
    or a table (source, weight > 0). A null source is a source of its own, the last; null or empty texts have
    size 0; a source of size 0 has target 0. Repeated ids share a hash and so are taken or left together.
    Columns beside the three named are not read, but those named in carry, which come back as struct `row`. An empty
    table gives an empty result; a very long text is one row whose size counts whole. The sources, a row each, are ranked in one small task.
    """
    named = [F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("key"), word_count(F.col(text_col)).alias("size"), id_hash(F.col(id_col)).alias("hash")]
    keyed = lambda df: df.withColumn("known", F.col("key").isNotNull()).withColumn("name", F.coalesce("key", F.lit("")))
    base = keyed(materialize(docs.select(*named), "mix"))
    on = ["known", "name"]
    sources = base.groupBy("known", "name", "key").agg(F.sum("size").alias("source_size"))
    if isinstance(weights, tuple):
        sources = cycled_weights(sources, weights)
    else:
        given = weights.select(F.col(source_col).isNotNull().alias("known"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name"), F.col("weight").cast("double"))
        sources = lookup(sources, given, on).withColumn("weight", F.coalesce("weight", F.lit(0.0)))
        sources = sources.where("weight > 0")
    table = targets(sources, repeats, share)
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    table = table.select(*on, "source_size", "target", copies.alias("copies"))
    table = materialize(table.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")), "mix-targets")

    edge = table.select(*on, F.lit(0).cast("long").alias("prefix"), "rest", F.lit(0).cast("long").alias("cell"))
    for level in range(LEVELS):
        above, below = BITS * (LEVELS - level), BITS * (LEVELS - level - 1)
        cells = (
            lookup(base, edge.select(*on, "prefix", "rest"), on, "inner")
            .where(F.shiftright("hash", above) == F.col("prefix"))
            .groupBy(*on, "prefix", "rest", F.shiftright("hash", below).alias("bucket"))
            .agg(F.sum("size").alias("cell"))
            .withColumn("sum", F.sum("cell").over(W.partitionBy(*on).orderBy("bucket")))
        )
        # The first bucket that the budget doesn't reach beyond; where all fit, none: prefix is then past them all.
        over = cells.where("sum > rest").groupBy(*on).agg(F.min(F.struct("bucket", (F.col("rest") - F.col("sum") + F.col("cell")).alias("rest"), "cell")).alias("at"))
        edge = table.select(*on).join(over, on, "left").select(*on, F.coalesce("at.bucket", F.lit(-1)).alias("prefix"), F.coalesce("at.rest", F.lit(0.0)).alias("rest"), F.coalesce("at.cell", F.lit(0)).alias("cell"))
        edge = materialize(edge, "mix-edge")
    end = edge.select(*on, F.col("prefix").alias("threshold"), (2 * F.col("rest") >= F.col("cell")).alias("with_edge"))
    rows = keyed(docs.select(*named, F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"))) if carry else base
    chosen = lookup(rows, table.join(end, on), on)
    extra = (F.col("rest") > 0) & ((F.col("threshold") < 0) | (F.col("hash") < F.col("threshold")) | ((F.col("hash") == F.col("threshold")) & F.col("with_edge")))
    taken = F.col("size") * (F.coalesce("copies", F.lit(0)) + F.coalesce(extra.cast("long"), F.lit(0)))
    return chosen.select(
        F.col("id").alias(id_col), F.col("key").alias(source_col), "size", F.coalesce("source_size", F.lit(0)).alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), taken.alias("taken"), *(["row"] if carry else [])
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


_MIX = """
d AS (SELECT doc_id, source, {size} AS size,
        CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 9) AS BIGINT) AS h FROM {docs}),
s AS (SELECT source, sum(size) AS source_size,
        CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS weight FROM d GROUP BY source),
c AS (SELECT *, source_size * CAST(3 AS DOUBLE) AS cap, CAST(weight AS DOUBLE) AS w FROM s),
l AS (SELECT *, cap / w AS ratio,
        (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM c),
e AS (SELECT min(lev) AS lev FROM (SELECT lev, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS i FROM l WHERE lev <= ratio) WHERE i = 1),
t AS (SELECT l.source, CAST(source_size AS BIGINT) AS source_size, CASE WHEN e.lev IS NULL OR e.lev * w >= cap THEN cap ELSE e.lev * w END AS target FROM l, e),
k AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
b AS (SELECT source, h, sum(size) AS cell FROM d GROUP BY source, h),
p AS (SELECT source, h, cell, sum(cell) OVER (PARTITION BY source ORDER BY h) AS upto FROM b),
x AS (SELECT p.source, p.h, k.target - k.copies * k.source_size AS rest, CASE
        WHEN p.upto <= k.target - k.copies * k.source_size THEN 1
        WHEN p.upto - p.cell <= k.target - k.copies * k.source_size AND 2 * (k.target - k.copies * k.source_size - (p.upto - p.cell)) >= p.cell THEN 1 ELSE 0 END AS extra
      FROM p JOIN k ON p.source IS NOT DISTINCT FROM k.source)
"""
_SIZE = r"length(regexp_replace(regexp_replace(coalesce(text, ''), '[^ \t\n\v\f\r]+', 'x', 'g'), '[ \t\n\v\f\r]+', '', 'g'))"
ORACLE = (
    "WITH " + _MIX.format(size=_SIZE, docs="documents") + "SELECT d.doc_id, d.size, k.source_size, k.target, CAST(d.size * (k.copies + CASE WHEN x.rest > 0 THEN x.extra ELSE 0 END) AS BIGINT) AS taken "
    "FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h"
)
