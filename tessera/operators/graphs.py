"""Message passing on graphs of any size: a join and a sum of vectors a layer, no graph in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.evidential import Layer
from tessera.operators.similarity import checkpointed

#: Edges of a node, out or in, that stay together; more are dealt over tasks.
EDGES = 10_000
_SUMS = "k string, total array<double>, n long"


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, int]]:
    """Sums of each run of equal keys in a batch (k, v, n) of sorted rows."""
    if not batch.num_rows:
        return
    keys = np.array(batch.column("k").to_pylist(), dtype=object)
    width = len(batch.column("v")[0])
    rows = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    counts = np.add.reduceat(batch.column("n").to_numpy(), starts)
    yield from zip(keys[starts].tolist(), np.add.reduceat(rows, starts, axis=0), counts.tolist(), strict=True)


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple[str, np.ndarray, int] | None = None

    def out(rows: list[tuple[str, np.ndarray, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1].tolist() for r in rows], pa.list_(pa.float64())), pa.array([r[2] for r in rows], pa.int64())], ["k", "total", "n"])

    for batch in batches:
        done = []
        for key, total, n in _runs(batch):
            if held is not None and held[0] == key:
                held = (key, held[1] + total, held[2] + n)
                continue
            if held is not None:
                done.append(held)
            held = (key, total, n)
        if done:
            yield out(done)
    if held is not None:
        yield out([held])


def vector_sums(rows: DataFrame, key: Column, vector: Column, spread: Column) -> DataFrame:
    """(k, total, n): sums of equally long vectors by a string key. spread: a number that deals the rows of a large key over tasks, whose sums are added up once more."""
    first = rows.select(key.alias("k"), vector.alias("v"), F.lit(1).cast("long").alias("n"), spread.cast("int").alias("s")).repartition("k", "s").sortWithinPartitions("k")
    sums = first.select("k", "v", "n").mapInArrow(_add_up, _SUMS)
    again = sums.select("k", F.col("total").alias("v"), "n").repartition("k").sortWithinPartitions("k")
    return again.mapInArrow(_add_up, _SUMS)


def _product(layer: Layer):  # noqa: ANN202
    w, b = layer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                m = batch.column("m").flatten().to_numpy(zero_copy_only=False).reshape(-1, w.shape[0])
                h = np.maximum(m @ w + b, 0)
                yield pa.RecordBatch.from_arrays([batch.column("graph_id"), batch.column("node"), pa.array(h.tolist(), pa.list_(pa.float64()))], ["graph_id", "node", "h"])

    return run


def _key(*columns: str) -> Column:
    return F.to_json(F.struct(*[F.col(c) for c in columns]))


def encode_large_graphs(nodes: DataFrame, edges: DataFrame, layers: list[Layer]) -> DataFrame:
    """(graph_id, vector), as evidential.encode_graphs() gives, for graphs that no task could hold.

    nodes: graph_id, node, x (array, equally long); edges: graph_id, src, dst; those of nodes that are not there are left out, repeated ones count each. In a layer a
    node's incoming neighbours are averaged (none: zeros; a graph without edges: the node itself), then linear and ReLU; at last the mean of
    the nodes. Nodes with many edges, out or in, are dealt over tasks. Each layer's vectors are written to the shared folder.
    """
    known = nodes.select("graph_id", "node")
    ends = edges.select("graph_id", "src", "dst").join(known.select("graph_id", F.col("node").alias("src")), ["graph_id", "src"], "left_semi")
    ends = ends.join(known.select("graph_id", F.col("node").alias("dst")), ["graph_id", "dst"], "left_semi")
    out = ends.groupBy("graph_id", "src").agg(F.ceil(F.count("*") / EDGES).cast("int").alias("parts"))
    into = ends.groupBy("graph_id", "dst").agg(F.ceil(F.count("*") / EDGES).cast("int").alias("sums"))
    # Only nodes of many edges are looked up: there are few of them.
    ends = ends.join(out.where("parts > 1"), ["graph_id", "src"], "left").join(into.where("sums > 1"), ["graph_id", "dst"], "left")
    ends = checkpointed(ends.select("graph_id", "src", "dst", F.pmod(F.xxhash64("dst"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.pmod(F.xxhash64("src"), F.coalesce("sums", F.lit(1))).cast("int").alias("sum")))
    parts = checkpointed(out.where("parts > 1").withColumnRenamed("src", "node"))
    joined = ends.select("graph_id").distinct().withColumn("joined", F.lit(True))
    h = nodes.select("graph_id", "node", F.col("x").cast("array<double>").alias("h"))
    for layer in layers:
        # A node whose edges are dealt out is there once for each part.
        copies = h.join(parts, ["graph_id", "node"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        sent = ends.join(copies.select("graph_id", F.col("node").alias("src"), "part", "h"), ["graph_id", "src", "part"])
        sums = vector_sums(sent, _key("graph_id", "dst"), F.col("h"), F.col("sum"))
        rows = h.withColumn("k", F.to_json(F.struct("graph_id", F.col("node").alias("dst")))).join(sums, "k", "left").join(joined, "graph_id", "left")
        none = F.transform("h", lambda _: F.lit(0.0))
        mean = F.when(F.col("joined").isNull(), F.col("h")).when(F.col("n").isNull(), none).otherwise(F.transform("total", lambda x: x / F.col("n")))
        h = checkpointed(rows.select("graph_id", "node", mean.alias("m")).mapInArrow(_product(layer), h.schema))
    whole = vector_sums(h, _key("graph_id"), F.col("h"), F.pmod(F.xxhash64("node"), F.lit(64)))
    names = nodes.select("graph_id").distinct().withColumn("k", _key("graph_id"))
    return names.join(whole, "k").select("graph_id", F.transform("total", lambda x: x / F.col("n")).alias("vector"))
