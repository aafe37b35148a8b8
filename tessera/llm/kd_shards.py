"""Sharding by a k-d tree over metadata. DataFrame functions only.

Rows are points: a coordinate for each dimension (numbers scaled to their range, categories hashed) and a weight, the text's bytes. A node
that has to become several shards is cut in its widest dimension at the weighted median (or the share of its left shards), until leaves are
of the target bytes. Cuts are found without sorting: weights are summed by node and the first 15 bits of the position, then by
the next 15 of the one bucket in which the median lies. What the driver holds is a row a node.

A position is the coordinate, the hash of the text, the hash of the id, the row's place in the input. Equal texts get one coordinate and so stay
together; only a group that lies across a cut and is heavier than a 64th of a shard is cut itself, by the hash of the id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.llm.common import lookup, lookup_skewed, materialize

BITS, STEPS = 15, 4
WIDTH = BITS * STEPS
COORD = (1 << BITS) - 1
#: A group of equal texts lighter than this share of a shard is never cut.
WHOLE_SHARE = 64
#: Rows of a cell in which slots are dealt by one task; larger cells (repeated ids) are dealt by place.
SLOT_CELL = 1_000_000
ANY = (1 << 63) - 1
#: Fixed values of the query.
QUERY_SHARDS, QUERY_DIMENSIONS = 8, ("lang", "source", "n_chars")

Cut = tuple[int, int, int, int, int, int]


def _hash(text: Column, bits: int) -> Column:
    """The first bits of the md5, at most 60."""
    hex_digits = -(-bits // 4)
    return F.shiftright(F.conv(F.substring(F.md5(F.coalesce(text, F.lit("")).cast("binary")), 1, hex_digits), 16, 10).cast("long"), hex_digits * 4 - bits)


def _coordinates(docs: DataFrame, dimensions: list[str]) -> list[Column]:
    """0 to COORD for each dimension: strings and booleans by hash, numbers from the least to the greatest; nulls and NaN are 0."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    numeric = [d for d in dimensions if kinds[d].typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")]
    finite = {d: F.when(~F.isnan(F.col(f"`{d}`").cast("double")) & (F.abs(F.col(f"`{d}`").cast("double")) < float("inf")), F.col(f"`{d}`").cast("double")) for d in numeric}
    ends = docs.agg(*[f(finite[d]).alias(f"{f.__name__}_{i}") for i, d in enumerate(numeric) for f in (F.min, F.max)]).first() if numeric else {}
    out = []
    for d in dimensions:
        if d not in numeric:
            text = F.col(f"`{d}`").cast(StringType())
            out.append(F.when(text.isNull(), F.lit(0)).otherwise(_hash(text, BITS)).cast("int"))
            continue
        low, high = ends[f"min_{numeric.index(d)}"], ends[f"max_{numeric.index(d)}"]
        if low is None or low == high:
            out.append(F.lit(0))
        else:
            out.append(F.coalesce(F.floor((finite[d] - F.lit(low)) * F.lit(float(COORD)) / F.lit(high - low)), F.lit(0)).cast("int"))
    return out


def _points(docs: DataFrame, id_col: str, text_col: str, dimensions: list[str]) -> tuple[DataFrame, int, int]:
    """Rows id, size, crc, grp, key, at and a coordinate c0, c1, ... for each dimension; rows and bytes in all. Each text is read once."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    coords = [c.alias(f"c{i}") for i, c in enumerate(_coordinates(docs, dimensions))]
    rows = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        _hash(text, WIDTH).alias("grp"),
        _hash(F.col(f"`{id_col}`").cast("string"), WIDTH).alias("key"),
        F.monotonically_increasing_id().alias("at"),
        *coords,
    )
    rows = materialize(rows, "shard-rows")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    names = [f"c{i}" for i in range(len(dimensions))]
    # Only groups whose rows differ in a coordinate need one from the group.
    groups = rows.groupBy("grp").agg(F.count("*").alias("held"), *[f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.min, F.max)])
    groups = groups.where(reduce(Column.__or__, [F.col(f"min_{c}") < F.col(f"max_{c}") for c in names])).select("grp", "held", *[f"min_{c}" for c in names])
    joined = lookup_skewed(rows, materialize(groups, "shard-groups"), "grp", "held", n)
    return materialize(joined.select("id", "size", "crc", "grp", "key", "at", *[F.coalesce(f"min_{c}", c).alias(c) for c in names]), "shard-points"), n, total


def _values(spark: SparkSession, rows: list[tuple[int, ...]], names: list[str]) -> DataFrame:
    """A small table of whole numbers, a row a node."""
    listed = ", ".join("(" + ", ".join(f"{x}L" for x in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {listed} AS t({', '.join(names)})")


def _position(dimensions: int) -> list[Column]:
    """The three parts of a row's position in the dimension `dim` of its node."""
    coord = F.element_at(F.array(*[F.col(f"c{i}") for i in range(dimensions)]), F.col("dim").cast("int") + 1).cast("long")
    return [F.shiftleft(coord, WIDTH - BITS) + F.shiftright("grp", BITS), F.col("key"), F.col("at")]


def _apply(points: DataFrame, cuts: list[Cut], dimensions: int) -> DataFrame:
    """Moves rows beyond their node's cut to the right node. cuts: node, right, dim and the last position on the left."""
    if not cuts:
        return points
    table = _values(points.sparkSession, cuts, ["node", "right", "dim", "t0", "t1", "t2"])
    a, b, c = _position(dimensions)
    left = (a < F.col("t0")) | ((a == F.col("t0")) & ((b < F.col("t1")) | ((b == F.col("t1")) & (c <= F.col("t2")))))
    rows = points.join(F.broadcast(table), "node", "left")
    return rows.withColumn("node", F.when(F.col("right").isNull() | left, F.col("node")).otherwise(F.col("right"))).select(*points.columns)


def _find(points: DataFrame, wanted: dict[int, tuple[int, int]], whole: int, dimensions: int) -> dict[int, tuple[int, int, int]]:
    """For each node, the last position on the left of the place where the sum of sizes reaches what is wanted. wanted: node to (dim, bytes).

    Position parts are searched one after the other, 15 bits at a time. A search ends at a part if the rows that share the part's value weigh
    `whole` or less (they go to the nearer side); else it goes on among these rows.
    """
    spark, found = points.sparkSession, {}
    fixed: dict[int, list[int]] = {n: [] for n in wanted}
    need = {n: b for n, (_, b) in wanted.items()}
    for part in range(3):
        open_nodes = [n for n in wanted if n not in found]
        if not open_nodes:
            break
        prefix, cell = dict.fromkeys(open_nodes, 0), dict.fromkeys(open_nodes, 0)
        for step in range(STEPS):
            above, below = WIDTH - BITS * step, WIDTH - BITS * (step + 1)
            state = _values(spark, [(n, wanted[n][0], need[n], prefix[n], *fixed[n], *[0] * (2 - len(fixed[n]))) for n in open_nodes], ["node", "dim", "need", "prefix", "f0", "f1"])
            keys = _position(dimensions)
            inside = reduce(Column.__and__, [keys[i] == F.col(f"f{i}") for i in range(part)], F.shiftright(keys[part], above) == F.col("prefix"))
            cells = points.join(F.broadcast(state), "node").where(inside).groupBy("node", "need", F.shiftright(keys[part], below).alias("bucket")).agg(F.sum("size").alias("cell"))
            upto = cells.withColumn("upto", F.sum("cell").over(W.partitionBy("node").orderBy("bucket")))
            first = upto.where("upto >= need").groupBy("node").agg(F.min(F.struct("bucket", "upto", "cell")).alias("at"))
            for row in first.collect():
                n = row["node"]
                prefix[n], cell[n] = row["at"]["bucket"], row["at"]["cell"]
                need[n] -= row["at"]["upto"] - row["at"]["cell"]
        for n in open_nodes:
            if cell[n] <= whole or part == 2:
                last = prefix[n] if 2 * need[n] >= cell[n] else prefix[n] - 1
                found[n] = (*fixed[n], last, *[ANY] * (2 - part))
            else:
                fixed[n].append(prefix[n])
    return found


def _tree(points: DataFrame, shards: int, total: int, dimensions: int) -> tuple[DataFrame, list[Cut]]:
    """Rows with their leaf as node, and the cuts. A node is named by the first of its shards."""
    rows, cuts = points.withColumn("node", F.lit(0).cast("long")), []
    leaves = {0: shards}
    while any(k > 1 for k in leaves.values()):
        ends = [f(f"c{i}").alias(f"{f.__name__}_{i}") for i in range(dimensions) for f in (F.min, F.max)]
        wanted = {}
        for node in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *ends).collect():
            k = leaves[node["node"]]
            if k > 1:
                widths = [node[f"max_{i}"] - node[f"min_{i}"] for i in range(dimensions)]
                wanted[node["node"]] = (widths.index(max(widths)), node["bytes"] * (k // 2) // k)
        level = [(n, n + leaves[n] // 2, wanted[n][0], *at) for n, at in _find(rows, wanted, total // shards // WHOLE_SHARE, dimensions).items()]
        rows, cuts = _apply(rows, level, dimensions), cuts + level
        leaves = {m: size for n, k in leaves.items() for m, size in (((n, k // 2), (n + k // 2, k - k // 2)) if k > 1 else ((n, k),))}
    return rows, cuts


def _slots(rows: DataFrame) -> DataFrame:
    """Adds slot, from 0 in each shard in the order of hashed ids: what earlier cells hold, and the row's number in its cell."""
    rows = rows.withColumn("cell", F.shiftright("key", WIDTH - 12))
    large = rows.groupBy("shard", "cell").agg(F.count("*").alias("held")).where(F.col("held") > SLOT_CELL).select("shard", "cell", F.lit(True).alias("large"))
    rows = lookup(rows, large, ["shard", "cell"]).withColumn("piece", F.when(F.col("large"), F.shiftright("at", 33) + 1).otherwise(F.lit(0)))
    on = ["shard", "cell", "piece"]
    counts = rows.groupBy(*on).agg(F.count("*").alias("held"))
    before = counts.select(*on, (F.sum("held").over(W.partitionBy("shard").orderBy("cell", "piece")) - F.col("held")).alias("before"))
    number = F.row_number().over(W.partitionBy(*on).orderBy("key", "at"))
    return lookup(rows, before, on).withColumn("slot", (F.col("before") + number - 1).cast("long"))


def kd_shards(docs: DataFrame, dimensions: list[str] | tuple[str, ...], shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    dimensions: columns of metadata, any numbers, strings or booleans. shards: their number, or target_bytes: what one should hold. Sizes of
    shards are near equal: a cut is off its place by half a 64th of a shard at most (or half a row, if one is larger). slot counts from 0 in each shard. law is
    `bytes`; grown_shard is null, as another number of shards gives another tree. Nulls: a null text counts as empty (size 1), a null id as
    empty text, a null or NaN coordinate as the least. Repeated rows and repeated ids are rows of their own and can be cut apart. Very long texts
    are one row. An empty table gives no rows; with fewer rows than shards some shards are empty. Columns beside those named are not read.
    """
    if (shards is None) == (target_bytes is None) or (target_bytes if shards is None else shards) < 1 or not dimensions:
        raise ValueError("a number of shards or the bytes of one, and a dimension")
    points, _, total = _points(docs, id_col, text_col, list(dimensions))
    rows, _ = _tree(points, shards or max(1, -(-total // target_bytes)), total, len(dimensions))
    placed = _slots(materialize(rows.withColumn("shard", F.col("node").cast("int")).select("id", "size", "crc", "key", "at", "shard"), "shard-leaves"))
    return placed.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), QUERY_DIMENSIONS, shards=QUERY_SHARDS)


def _sql_level(source: str, out: str) -> str:
    """One level of the tree: of each node the widest dimension, the position of each row, and the cut."""
    return f"""
{out}_w AS (SELECT node, sum(size) // 2 AS need, max(c0) - min(c0) AS w0, max(c1) - min(c1) AS w1, max(c2) - min(c2) AS w2 FROM {source} GROUP BY node),
{out}_p AS (SELECT p.*, need, CASE WHEN w0 >= w1 AND w0 >= w2 THEN c0 WHEN w1 >= w2 THEN c1 ELSE c2 END * (CAST(1 AS BIGINT) << 45) + (grp >> 15) AS pos FROM {source} p JOIN {out}_w USING (node)),
{out}_s AS (SELECT *, sum(size) OVER (PARTITION BY node ORDER BY pos, key) AS upto, sum(size) OVER (PARTITION BY node ORDER BY pos) AS group_upto, sum(size) OVER (PARTITION BY node, pos) AS group_size FROM {out}_p),
{out}_c AS (SELECT node, min(pos) FILTER (group_upto >= need) AS cut FROM {out}_s GROUP BY node),
{out}_k AS (SELECT s.node, s.cut, min(CASE WHEN upto >= need THEN key END) AS cut_key, min(need) AS need, min(group_size) AS group_size, min(group_upto - group_size) AS before FROM {out}_s p JOIN {out}_c s ON p.node = s.node AND p.pos = s.cut GROUP BY 1, 2),
{out}_t AS (SELECT k.*, (SELECT whole FROM total) AS whole, (SELECT size FROM {out}_s p WHERE p.node = k.node AND p.pos = k.cut AND p.key = k.cut_key) AS at_size,
  (SELECT upto FROM {out}_s p WHERE p.node = k.node AND p.pos = k.cut AND p.key = k.cut_key) AS at_upto FROM {out}_k k),
{out} AS (SELECT p.doc_id, p.size, p.crc, p.grp, p.key, p.c0, p.c1, p.c2, 2 * p.node + CASE WHEN pos < cut THEN 0 WHEN pos > cut THEN 1
  WHEN t.group_size <= whole THEN CASE WHEN 2 * (t.need - t.before) >= t.group_size THEN 0 ELSE 1 END
  WHEN p.key < cut_key THEN 0 WHEN p.key > cut_key THEN 1 WHEN 2 * (t.need - (at_upto - at_size)) >= at_size THEN 0 ELSE 1 END AS node
  FROM {out}_s p JOIN {out}_t t ON p.node = t.node)"""


_BITS15 = "CAST('0x' || substr(md5({c}), 1, 4) AS BIGINT) >> 1"
#: For eight shards and unique ids; a cut group goes by id, and no id's hash is shared.
ORACLE = f"""WITH crc AS (SELECT list(v ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) AS v FROM range(256) AS r(b))),
ends AS (SELECT CAST(min(n_chars) AS DOUBLE) AS low, CAST(max(n_chars) AS DOUBLE) AS high FROM documents),
d AS (SELECT doc_id, coalesce(text, '') AS text, lang, source, n_chars FROM documents),
summed AS (SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), CAST(4294967295 AS BIGINT)) AS crc FROM d, crc),
r AS (SELECT d.doc_id, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size, s.crc, CAST('0x' || substr(md5(text), 1, 15) AS BIGINT) AS grp, CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key,
  CASE WHEN lang IS NULL THEN 0 ELSE {_BITS15.format(c="lang")} END AS c0, CASE WHEN source IS NULL THEN 0 ELSE {_BITS15.format(c="source")} END AS c1,
  coalesce(CAST(floor((CAST(n_chars AS DOUBLE) - low) * 32767.0 / (high - low)) AS BIGINT), 0) AS c2 FROM d JOIN summed s ON d.doc_id = s.doc_id, ends),
total AS (SELECT sum(size) // 8 // 64 AS whole FROM r),
n0 AS (SELECT doc_id, size, crc, grp, key, min(c0) OVER g AS c0, min(c1) OVER g AS c1, min(c2) OVER g AS c2, CAST(0 AS BIGINT) AS node FROM r WINDOW g AS (PARTITION BY grp)),{_sql_level("n0", "n1")},{_sql_level("n1", "n2")},{_sql_level("n2", "n3")}
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, CAST(node AS INTEGER) AS shard, row_number() OVER (PARTITION BY node ORDER BY key) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM n3"""
