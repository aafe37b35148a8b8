"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and texts of unknown class (U) give a logistic classifier. The risk of the
negative class is estimated as R_U- minus prior * R_P-, and, where that falls below 0, the step raises it
again instead (the non-negative estimator). Features are hashed words and word prefixes, present at all or
several times; those that set P apart from U are selected on the sample. The logits are then shifted so that the
decision threshold lies where the same corrected risk estimator counts fewest errors. Everything that is fitted
sees bounded samples of rows, whole texts of these; scoring sees every whole text. A sample's features stay on the executors; the driver gets their counts
(a row a hash at most) and, of each row, the selected ones.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import crc32_mod, materialize, small_batches, tidied
from tessera.llm.decontaminate import words

#: Most rows that the classifier is fitted on, chosen by hash: confirmed toxic, and unlabelled.
POSITIVES = 3_000
UNLABELLED = 6_000
HASH_BITS = 22
PREFIXES = (3, 4, 5, 6, 7, 8)
#: A feature that occurs this often in a text gives a second feature.
OFTEN = 3
#: Parameters of the model: most features, and evidence that each needs. Selected features are more frequent in P than among clean texts, beyond chance by this log-likelihood.
SELECTED, EVIDENCE = 4_096, 12
THRESHOLD = 0.7
#: A word's weight is kept once computed; the store is emptied at this many words.
CACHED_WORDS = 100_000


def word_features(word: bytes) -> list[int]:
    """Even hashes of the word and its prefixes."""
    mask = (1 << HASH_BITS) - 2
    return [zlib.crc32(b"w" + word) & mask] + [zlib.crc32(b"p" + word[:n]) & mask for n in PREFIXES if len(word) > n]


def text_features(text: str | None) -> np.ndarray:
    """Hashes of what occurs; plus 1 (odd) for what occurs often. Sorted."""
    found: Counter[int] = Counter()
    for word, n in Counter(words(text)).items():
        for f in word_features(word):
            found[f] += n
    return np.array(sorted([*found, *(f + 1 for f, n in found.items() if n >= OFTEN)]), np.int32)


@dataclass
class Model:
    features: np.ndarray  # selected hashes, sorted
    weights: np.ndarray
    bias: float
    prior: float

    def scorer(self) -> Callable[[str | None], float]:
        weight_of = dict(zip(self.features.tolist(), self.weights.tolist(), strict=True))
        known: dict[bytes, tuple[int, ...]] = {}

        def score(text: str | None) -> float:
            hits: Counter[int] = Counter()
            for word, n in Counter(words(text)).items():
                got = known.get(word)
                if got is None:
                    if len(known) >= CACHED_WORDS:
                        known.clear()
                    got = known[word] = tuple(f for f in word_features(word) if f in weight_of or f + 1 in weight_of)
                for f in got:
                    hits[f] += n
            z = self.bias + sum(weight_of.get(f, 0.0) + (weight_of.get(f + 1, 0.0) if hits[f] >= OFTEN else 0.0) for f in sorted(hits))
            return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return score


def least_positives(n_p: int) -> float:
    """Rows of P that a feature must occur in to be considered."""
    return max(2, 0.005 * n_p)


def choose_features(feature: np.ndarray, p: np.ndarray, u: np.ndarray, n_p: int, n_u: int, prior: float, most: int = SELECTED) -> np.ndarray:
    """Of hashes and the rows of P and U that have them: those more frequent in P than among the clean texts of U, however little, those of most evidence; sorted."""
    # U holds a share `prior` of toxic texts, so the rate among its clean texts is lower than in U.
    clean = np.maximum((u + 0.5) / (n_u + 1) - prior * p / n_p, 0.5 / (n_u + 1))
    found = (p >= least_positives(n_p)) & (p / n_p > clean)
    feature, p, clean = feature[found], p[found], clean[found]
    evidence = p * np.log(p / (n_p * clean)) - (p - n_p * clean)
    order = np.lexsort((feature, -evidence))[:most]
    return np.sort(feature[order[evidence[order] > EVIDENCE]]).astype(np.int32)


def select_features(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, most: int = SELECTED) -> np.ndarray:
    """choose_features() of rows that are at hand."""
    feature, of = np.unique(np.concatenate([*positive, *unlabelled]), return_inverse=True)
    cut = sum(map(len, positive))  # a row has a feature once
    p, u = (np.bincount(x, minlength=len(feature)).astype(float) for x in (of[:cut], of[cut:]))
    return choose_features(feature, p, u, len(positive), len(unlabelled), prior, most)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def nnpu_step(z: np.ndarray, n_p: int, prior: float, gamma: float = 1.0) -> tuple[float, np.ndarray]:
    """The non-negative risk of logits z (n_p rows of P, then those of U), and the descent direction's derivative by z.

    The negative class's risk is estimated as that of U less prior times that of P, taken as negatives. Where it is not below 0 the derivative is the whole
    risk's; else the estimate counts as 0, and the derivative raises it again by gamma.
    """
    s, n_u = _sigmoid(z), len(z) - n_p
    as_negative, as_positive = np.logaddexp(0, z), np.logaddexp(0, -z)  # losses of calling a row clean, or toxic, wrongly
    negative = as_negative[n_p:].mean() - prior * as_negative[:n_p].mean()
    by_z = np.concatenate([-prior * s[:n_p] / n_p, s[n_p:] / n_u])
    positive = prior * as_positive[:n_p].mean()
    if negative >= 0:
        return positive + negative, by_z + np.append(prior * (s[:n_p] - 1) / n_p, np.zeros(n_u))
    return positive, -gamma * by_z


def prior_bounds(prior: float) -> float:
    return float(np.clip(prior, 1e-3, 0.9))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, threshold: float = THRESHOLD, steps: int = 600, decay: float = 1e-4, gamma: float = 1.0, features: np.ndarray | None = None) -> Model:
    """Logistic loss, accelerated full-batch descent on the non-negative risk. Without positives or features, one low score for all. features: those selected already."""
    prior = prior_bounds(prior)
    start = float(np.log(prior / (1 - prior)))
    if features is None:
        features = select_features(positive, unlabelled, prior) if positive and unlabelled else np.zeros(0, np.int32)
    if not len(features):
        return Model(features, np.zeros(0), min(start, -2.0), prior)
    rows, columns = [], []
    for i, x in enumerate([*positive, *unlabelled]):
        at = np.searchsorted(features, x)
        at = at[(at < len(features)) & (features[np.minimum(at, len(features) - 1)] == x)]
        rows.append(np.full(len(at), i))
        columns.append(at)
    row, column = np.concatenate(rows), np.concatenate(columns)
    k, n_p, n_u = len(features), len(positive), len(unlabelled)
    logits = lambda w: w[-1] + np.bincount(row, w[column], n_p + n_u)
    gradient = lambda g: np.append(np.bincount(column, g[row], k), g.sum())
    share = np.concatenate([np.full(n_p, prior / n_p), np.full(n_u, 1 / n_u)])
    v = np.ones(k + 1)
    for _ in range(30):  # the largest curvature, for the step size
        v = gradient(share * logits(v / np.linalg.norm(v)))
    rate = 1 / (0.25 * np.linalg.norm(v) + decay)
    w = np.append(np.zeros(k), start)
    ahead, pace = w.copy(), 1.0
    for _ in range(steps):
        _, g = nnpu_step(logits(ahead), n_p, prior, gamma)
        grad = gradient(g) + decay * np.append(ahead[:-1], 0)
        new, faster = ahead - rate * grad, (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, w, pace = new + (pace - 1) / faster * (new - w), new, faster
    # Where fewest errors are estimated (a third into that stretch), there the threshold goes.
    z = logits(w)
    cuts = np.unique(z)
    middle = (cuts[1:] + cuts[:-1]) / 2
    above = lambda x: 1 - np.searchsorted(np.sort(x), middle) / len(x)
    found, called = above(z[:n_p]), above(z[n_p:])
    errors = prior * (1 - found) + np.maximum(0, called - prior * found)
    shift = 0.0
    if len(middle):
        best = middle[errors <= errors.min() + 1e-3]
        shift = np.log(threshold / (1 - threshold)) - (2 * best[0] + best[-1]) / 3
    return Model(features, w[:-1], float(w[-1] + shift), prior)


def _features_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            piece = batch.slice(at, 64)
            found = [text_features(t) for t in piece.column("text").to_pylist()]
            digest = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in found]
            yield pa.RecordBatch.from_arrays([piece.column("toxic"), pa.array(digest, pa.binary()), pa.array(found, pa.list_(pa.int32()))], names=["toxic", "digest", "features"])


def _selected_arrow(batches: Iterator[pa.RecordBatch], selected: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [np.intersect1d(np.array(x.values, np.int32), selected).astype(np.int32).tobytes() for x in batch.column("features")]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("digest"), pa.array(kept, pa.binary())], names=["toxic", "digest", "features"])


def train(docs: DataFrame, labels: DataFrame, fold: int | None = 3, held: int = 1, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on rows outside the held-out fold (crc32 of the id modulo `fold` is `held`; None: on all rows).

    P: rows labelled toxic. U: rows of the fold whatever their label, so that the prior holds for them; of both the
    `positives` and `unlabelled` rows of smallest hash of id and, where ids repeat, of text. prior: share of toxic rows; None: their share of the labelled
    rows of the fold, which should be a fair sample. Very long texts are read whole; their features, a few a different word, are held one text at a time.
    Features come to the driver only as counts and, at most SELECTED a row, as selected.
    """
    spark = docs.sparkSession
    small_batches(spark)
    outside = (crc32_mod(F.col("id"), fold) != held) if fold else F.lit(True)
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("toxic")).where(F.col("id").isNotNull() & F.col("toxic").isNotNull() & outside)
    marks = marks.groupBy("id").agg(F.max("toxic").alias("toxic"))
    if prior is None:
        n, k = marks.agg(F.count("*"), F.coalesce(F.sum((F.col("toxic") == 1).cast("int")), F.lit(0))).first()
        prior = (k + 0.5) / (n + 5) if n else 0.1
    order = F.xxhash64("id"), F.col("id")
    chosen = marks.where("toxic = 1").orderBy(*order).limit(positives)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(outside).withColumn("mark", F.xxhash64("text"))
    # The samples are cut before any text moves, by id and hash of the text, as an id may stand for any number of rows; both are bounded.
    held = texts.select("id", "mark").where("id IS NOT NULL")
    ids = held.orderBy(*order, "mark").limit(unlabelled).distinct()
    toxic = held.join(F.broadcast(chosen.select("id")), "id").distinct().orderBy(*order, "mark").limit(positives)
    sample = toxic.select("id", "mark", F.lit(1).alias("toxic")).unionByName(ids.select("id", "mark", F.lit(0).alias("toxic")))
    rows = texts.join(F.broadcast(sample), ["id", "mark"]).select("toxic", "text").mapInArrow(tidied(_features_arrow), "toxic int, digest binary, features array<int>")
    rows = materialize(rows.dropDuplicates(["toxic", "digest"]), "toxicity-sample")  # copies of a text count once
    n = dict.fromkeys((0, 1), 0) | {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n[0] or not n[1]:
        return fit_nnpu([], [], prior)
    counts = rows.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("u"))
    counts = counts.where(F.col("p") >= least_positives(n[1])).toArrow()
    feature, p, u = (counts.column(c).to_numpy() for c in ("feature", "p", "u"))
    selected = choose_features(feature, p, u, n[1], n[0], prior_bounds(prior))
    found: dict[int, list[np.ndarray]] = {0: [], 1: []}
    for r in rows.mapInArrow(tidied(lambda it: _selected_arrow(it, selected)), "toxic int, digest binary, features binary").orderBy("toxic", "digest").toLocalIterator():
        found[r.toxic].append(np.frombuffer(r.features, np.int32))
    return fit_nnpu(found[1], found[0], prior, features=selected)


def score_texts(docs: DataFrame, model: Model, carry: list[str], text_col: str = "text") -> DataFrame:
    """The columns named in carry, as struct `row`, and `score` of the whole text (null as empty)."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    inside = text_col in carry  # then the text travels once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = held.value.scorer()
        for batch in batches:
            texts = batch.column("row").field(text_col) if inside else batch.column("text")
            got = pa.array([score(t) for t in texts.to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), got], names=["row", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), *([] if inside else [F.col(text_col).alias("text")]))
    schema = rows.select("row", F.lit(0.0).alias("score")).schema
    return rows.mapInArrow(tidied(run), schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    Only the text enters a score; labels, ids and other columns do not. Null and empty texts get the score of a
    text without words. Repeated ids keep their rows, and count in the bounds of the samples as the rows they are. Without toxic labels all rows
    get the same low score. An empty table gives no rows. Very long texts are read whole, one at a time. Other columns are not read, whatever their names.
    Options: those of train().
    """
    model = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    fold, held = options.get("fold", 3), options.get("held", 1)
    outside = crc32_mod(F.col(id_col), fold) == held if fold else F.lit(False)
    return score_texts(docs, model, [id_col], text_col).select(f"row.{id_col}", "score").select(id_col, outside.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    model = train(docs, labels, id_col=id_col, text_col=text_col, **options)
    return score_texts(docs, model, docs.columns, text_col).where(F.col("score") < threshold).select("row.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
