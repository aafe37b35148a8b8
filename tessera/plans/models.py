"""Queries of trained models on embeddings, and their SQL: training written out as joins and sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import attention, evidential
from tessera.operators import graphs, splits, training
from tessera.plans.catalog import register
from tessera.plans.corpus import _HITS, _hits

#: A linear model, which starts at zero.
SETTINGS = training.Settings(epochs=8, rate=0.02, decay=0.01, warmup=4, class_weights=(1.0, 1.5))
_FEATURES = 64


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Embeddings labelled 1 from label 5 on, a tenth of each class held out."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), (F.col("label") >= 5).cast("int").alias("label"))
    parts = splits.holdout(rows, "id", "label")
    return parts.where("split = 'train'").drop("split"), parts.where("split = 'val'").drop("split")


def _fitted(spark: SparkSession, sf_dir: str) -> tuple[training.Trained, DataFrame, DataFrame]:
    rows, valid = _parts(spark, sf_dir)
    start = [(np.zeros((_FEATURES, 2)), np.zeros(2))]
    return training.train(rows, valid, start, SETTINGS), rows, valid


def _epoch_sql(e: int) -> str:
    """Logits, slopes and the step of one epoch. State: a row a feature (0: the constant 1) with the weights and moments of both logits."""
    s, lam = SETTINGS, evidential.kl_warmup(e, SETTINGS.warmup)
    grad = lambda k: f"0.9::DOUBLE * m{k} + 0.1::DOUBLE * g{k} AS m{k}, 0.999::DOUBLE * v{k} + 0.001::DOUBLE * g{k} * g{k} AS v{k}"
    step = lambda k: f"w{k} * {1 - s.rate * s.decay!r}::DOUBLE - {s.rate!r}::DOUBLE * (m{k} / {1 - 0.9**e!r}::DOUBLE) / (sqrt(v{k}) / {float(np.sqrt(1 - 0.999**e))!r}::DOUBLE + 1e-8::DOUBLE) AS w{k}"
    return f""",
l{e} AS ({_loss_sql(f"s{e - 1}", lam)}),
g{e} AS (SELECT f.i, sum(f.x * CASE WHEN l.y = 0 THEN l.own ELSE l.other END * l.t0) / count(*) AS g0, sum(f.x * CASE WHEN l.y = 1 THEN l.own ELSE l.other END * l.t1) / count(*) AS g1 FROM l{e} l JOIN x f ON f.id = l.id WHERE l.split = 'train' GROUP BY f.i),
m{e} AS (SELECT i, w0, w1, {grad(0)}, {grad(1)} FROM s{e - 1} JOIN g{e} USING (i)),
s{e} AS (SELECT i, {step(0)}, {step(1)}, m0, m1, v0, v1 FROM m{e}),
h{e} AS (SELECT {e} AS epoch, {lam!r}::DOUBLE AS kl_weight, (SELECT avg(loss) FROM l{e} WHERE split = 'train') AS train_loss, (SELECT avg(loss) FROM ({_loss_sql(f"s{e}", 1.0)}) WHERE split = 'val') AS valid_loss)"""


def _loss_sql(state: str, lam: float) -> str:
    """For each row: loss, slopes by the evidence of its own and the other class, and the slopes of the evidence by the logits."""
    w0, w1 = SETTINGS.class_weights
    return f"""SELECT *, c * (2 * q * q + 2 * p * q / (s + 1)) + {lam!r}::DOUBLE * (ln(ao) - 1 + 1 / ao) AS loss,
  c * ((-4 * q + 2 * (1 - 2 * p) / (s + 1)) * q / s - 2 * p * q / ((s + 1) * (s + 1))) AS own, c * (-(-4 * q + 2 * (1 - 2 * p) / (s + 1)) * p / s - 2 * p * q / ((s + 1) * (s + 1))) + {lam!r}::DOUBLE * (ao - 1) / (ao * ao) AS other
  FROM (SELECT *, ay / s AS p, ao / s AS q FROM (SELECT *, ay + ao AS s FROM (SELECT id, y, split, 1 / (1 + exp(-z0)) AS t0, 1 / (1 + exp(-z1)) AS t1, CASE WHEN y = 1 THEN a1 ELSE a0 END AS ay, CASE WHEN y = 1 THEN a0 ELSE a1 END AS ao, CASE WHEN y = 1 THEN {w1!r}::DOUBLE ELSE {w0!r}::DOUBLE END AS c, a0, a1
  FROM (SELECT *, greatest(z0, 0) + ln(1 + exp(-abs(z0))) + 1 AS a0, greatest(z1, 0) + ln(1 + exp(-abs(z1))) + 1 AS a1 FROM (SELECT id, any_value(y) AS y, any_value(split) AS split, sum(x * w0) AS z0, sum(x * w1) AS z1 FROM x JOIN {state} USING (i) GROUP BY id)))))"""


_TRAINING = (
    """WITH e AS (SELECT vec_id AS id, (label >= 5)::INT AS y, embedding FROM embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5('3407:' || CAST(id AS VARCHAR)), id) AS k, count(*) OVER (PARTITION BY y) AS n FROM e),
p AS (SELECT id, y, embedding, CASE WHEN k <= floor(n * 0.9::DOUBLE + 0.5) THEN 'train' ELSE 'val' END AS split FROM r),
x AS (SELECT id, y, split, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM p UNION ALL SELECT id, y, split, 0, 1.0::DOUBLE FROM p),
s0 AS (SELECT DISTINCT i, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS w1, 0.0::DOUBLE AS m0, 0.0::DOUBLE AS m1, 0.0::DOUBLE AS v0, 0.0::DOUBLE AS v1 FROM x)"""
    + "".join(_epoch_sql(e) for e in range(1, SETTINGS.epochs + 1))
    + ",\nh AS ("
    + " UNION ALL ".join(f"SELECT * FROM h{e}" for e in range(1, SETTINGS.epochs + 1))
    + ")"
)
_STATES = " UNION ALL ".join(f"SELECT {e} AS epoch, i, w0, w1 FROM s{e}" for e in range(1, SETTINGS.epochs + 1))


@register("n8_training_run", f"{_TRAINING} SELECT epoch, round(kl_weight, 7) AS kl_weight, round(train_loss, 7) AS train_loss, round(valid_loss, 7) AS valid_loss FROM h")
def n8_training_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures of each epoch."""
    fitted, _, _ = _fitted(spark, sf_dir)
    rows = [(h["epoch"], h["kl_weight"], h["train_loss"], h["valid_loss"]) for h in fitted.history]
    return spark.createDataFrame(rows, "epoch int, kl_weight double, train_loss double, valid_loss double").select("epoch", *[F.round(c, 7).alias(c) for c in ("kl_weight", "train_loss", "valid_loss")])


@register(
    "n8_fitted_scores",
    f"""{_TRAINING}, best AS (SELECT epoch FROM h ORDER BY valid_loss, epoch LIMIT 1), w AS (SELECT i, w0, w1 FROM ({_STATES}) JOIN best USING (epoch)),
a AS (SELECT id, greatest(z0, 0) + ln(1 + exp(-abs(z0))) + 1 AS a0, greatest(z1, 0) + ln(1 + exp(-abs(z1))) + 1 AS a1, split FROM (SELECT id, any_value(split) AS split, sum(x * w0) AS z0, sum(x * w1) AS z1 FROM x JOIN w USING (i) GROUP BY id))
SELECT id, split, round(a1 / (a0 + a1), 6) AS p_toxic, round(2 / (a0 + a1), 6) AS uncertainty FROM a""",
)
def n8_fitted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows under the weights of the best epoch."""
    fitted, rows, valid = _fitted(spark, sf_dir)
    both = rows.withColumn("split", F.lit("train")).unionByName(valid.withColumn("split", F.lit("val")))
    return evidential.score_batches(both, evidential.mlp(fitted.layers)).select("id", "split", F.round("prediction.p_toxic", 6).alias("p_toxic"), F.round("prediction.uncertainty", 6).alias("uncertainty"))


# --- graphs --------------------------------------------------------------------------------------------------------


def _graph_layers() -> list[evidential.Layer]:
    r = np.random.default_rng(5)
    return [(np.round(r.normal(size=(_FEATURES, 4)), 4), np.round(r.normal(size=4), 4)), (np.round(r.normal(size=(4, 3)), 4), np.round(r.normal(size=3), 4))]


def _graph_sql() -> str:
    """Each layer: features times weights, averaged over the incoming neighbours, the bias, and ReLU."""
    (w1, b1), (w2, b2) = _graph_layers()
    n = lambda v: f"{float(v)!r}::DOUBLE"
    first = ", ".join(" + ".join(f"embedding[{i + 1}]::DOUBLE * {n(w1[i, j])}" for i in range(_FEATURES)) + f" AS p{j}" for j in range(4))
    mean = lambda table, columns, biases: f"SELECT v.vec_id, {', '.join(f'greatest(0, coalesce(m{j}, 0) + {n(b)}) AS h{j}' for j, b in enumerate(biases))} FROM embeddings v LEFT JOIN (SELECT h.query, {', '.join(f'avg(p{j}) AS m{j}' for j in range(columns))} FROM h JOIN {table} p ON p.vec_id = h.neighbour GROUP BY h.query) g ON g.query = v.vec_id"
    second = ", ".join(" + ".join(f"h{i} * {n(w2[i, j])}" for i in range(4)) + f" AS p{j}" for j in range(3))
    return f"""WITH {_HITS}, p1 AS (SELECT vec_id, {first} FROM embeddings), h1 AS ({mean("p1", 4, b1)}), p2 AS (SELECT vec_id, {second} FROM h1), h2 AS ({mean("p2", 3, b2)})
SELECT 0 AS graph_id, j, round(CASE j WHEN 0 THEN avg(h0) WHEN 1 THEN avg(h1) ELSE avg(h2) END, 7) AS x FROM h2, (SELECT unnest([0, 1, 2]) AS j) GROUP BY j"""


@register("n6_graph_vectors", _graph_sql())
def n6_graph_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph of nearest neighbours of the embeddings, encoded by two layers."""
    hits, _ = _hits(spark, sf_dir)
    edges = hits.select(F.lit(0).alias("graph_id"), F.col("neighbour").alias("src"), F.col("query").alias("dst"))
    nodes = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.lit(0).alias("graph_id"), F.col("vec_id").alias("node"), F.col("embedding").alias("x"))
    found = graphs.encode_large_graphs(nodes, edges, _graph_layers())
    return found.select("graph_id", F.posexplode("vector").alias("j", "x")).withColumn("x", F.round("x", 7))


# --- three-way attention -------------------------------------------------------------------------------------------

_PLACES = 12  # of each of three parts of an embedding


def _three_way() -> attention.ThreeWay:
    r = np.random.default_rng(8)
    net = lambda: [(np.round(r.normal(size=(1, 4)), 3), np.round(r.uniform(0, 1, 4), 3))]
    return attention.ThreeWay((net(), net(), net()), np.round(r.normal(size=(2, 4)), 3), 2, np.array([1.5, 0.5]), np.array([0.1, -0.2]))


def _three_way_sql() -> str:
    """Every triple of places with its scores, softmax by head, and the weighed products."""
    m = _three_way()
    n = lambda v: f"{float(v)!r}::DOUBLE"
    part = lambda p: f"SELECT vec_id, {', '.join(f'greatest(0, v * {n(w)} + {n(b)}) AS {chr(120 + p)}{k}' for k, (w, b) in enumerate(zip(m.nets[p][0][0][0], m.nets[p][0][1], strict=True)))} FROM (SELECT vec_id, unnest(embedding[{p * _PLACES + 1}:{(p + 1) * _PLACES}])::DOUBLE AS v FROM embeddings)"
    scores = ", ".join(" + ".join(f"{n(w[k])} * t{k}" for k in range(4)) + f" AS s{h}" for h, w in enumerate(m.heads))
    weighed = ", ".join("sum(t{0} * e0) / sum(e0) + sum(t{0} * e1) / sum(e1) AS o{0}".format(k) for k in range(4))
    return f"""WITH x AS ({part(0)}), y AS ({part(1)}), z AS ({part(2)}), t AS (SELECT x.vec_id, {', '.join(f'x{k} * y{k} * z{k} AS t{k}' for k in range(4))} FROM x JOIN y USING (vec_id) JOIN z USING (vec_id)),
s AS (SELECT *, {scores} FROM t), e AS (SELECT *, exp(s0 - max(s0) OVER (PARTITION BY vec_id)) AS e0, exp(s1 - max(s1) OVER (PARTITION BY vec_id)) AS e1 FROM s), o AS (SELECT vec_id, {weighed} FROM e GROUP BY vec_id)
SELECT vec_id, round((o0 + o1) * {n(m.scale[0])} + {n(m.shift[0])}, 7) AS a, round((o2 + o3) * {n(m.scale[1])} + {n(m.shift[1])}, 7) AS b FROM o"""


@register("n5_three_way_attention", _three_way_sql())
def n5_three_way_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three parts of each embedding, attended together by two heads."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", *[F.slice("embedding", p * _PLACES + 1, _PLACES).alias(c) for p, c in enumerate("xyz")])
    got = attention.attend_batches(e, ("x", "y", "z"), _three_way())
    return got.select("vec_id", F.round(F.get("attended", F.lit(0)), 7).alias("a"), F.round(F.get("attended", F.lit(1)), 7).alias("b"))
