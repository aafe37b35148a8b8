"""Graphs encoded by joins against one encoder that holds a graph whole."""

import numpy as np

from pyspark.sql import functions as F
from tessera.functions.evidential import encode_graphs
from tessera.operators import graphs


def made(spark, seed=4):
    r = np.random.default_rng(seed)
    nodes, edges = [], []
    for g, (n, m) in enumerate([(1, 0), (5, 0), (30, 60), (200, 900), (3, 3)]):
        nodes += [(f"g{g}", int(k), r.normal(size=6).tolist()) for k in range(n)]
        edges += [(f"g{g}", int(a), int(b)) for a, b in r.integers(0, n, (m, 2))]
    edges += [("g3", 0, k) for k in range(200)] + [("g3", k, 1) for k in range(200)] + [("g3", 5, 6)] * 3  # much out, much in, repeated
    edges += [("g2", 0, 999), ("g2", 999, 0), ("none", 0, 1)]  # of nodes that are not there
    layers = [(r.normal(size=(6, 4)), r.normal(size=4)), (r.normal(size=(4, 3)), r.normal(size=3))]
    return spark.createDataFrame(nodes, "graph_id string, node long, x array<double>").repartition(6), spark.createDataFrame(edges, "graph_id string, src long, dst long").repartition(5), layers


def as_dict(df):
    return {r.graph_id: np.array(r.vector) for r in df.collect()}


def test_equals_the_encoder_of_whole_graphs(spark, monkeypatch):
    nodes, edges, layers = made(spark)
    want = as_dict(encode_graphs(nodes, edges, layers))
    for most in (10_000, 20):  # the second deals the edges of the large nodes over tasks
        monkeypatch.setattr(graphs, "EDGES", most)
        got = as_dict(graphs.encode_large_graphs(nodes, edges, layers))
        assert got.keys() == want.keys() == {"g0", "g1", "g2", "g3", "g4"}
        assert all(np.abs(got[g] - want[g]).max() < 1e-9 for g in want)


def test_sums_of_a_hot_key(spark):
    rows = spark.range(5000).select((F.col("id") % 7 == 0).cast("string").alias("key"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("v"), "id").repartition(9)
    for spread in (F.lit(0), F.col("id") % 13):
        got = {r.k: (r.total, r.n) for r in graphs.vector_sums(rows, F.col("key"), F.col("v"), spread).collect()}
        assert got == {k: ([float(sum(i for i in range(5000) if (i % 7 == 0) == (k == "true"))), float(n)], n) for k, n in (("true", 715), ("false", 4285))}


def test_no_nodes(spark):
    nodes, edges, layers = made(spark)
    assert graphs.encode_large_graphs(nodes.where("false"), edges, layers).count() == 0
    assert as_dict(graphs.encode_large_graphs(nodes, edges.where("false"), layers)).keys() == {"g0", "g1", "g2", "g3", "g4"}
