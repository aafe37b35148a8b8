"""Training of two-class evidential models by distributed gradients.

A step sums the gradients of the rows of one batch: each task adds up its own rows, a second stage of few tasks adds up the tasks' sums, and the
driver adds what is left, steps the weights (AdamW) and sends them out with the next step. The driver holds weights and moments only, never rows. Sums are
added in the order of the tasks, so a run can be repeated exactly on the same files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.evidential import Layer, kl_warmup, load_weights, mlp, save_weights, score_batches
from tessera.operators.metrics import ranking_metrics
from tessera.sources.scratch import scratch_path

#: Rows whose activations a task holds at a time.
ROWS = 4096
#: Tasks that add up the sums of all others.
FEW = 32
SUMS = "part int, n double, loss double, grad array<double>"


@dataclass
class Settings:
    """epochs; batches: steps an epoch, each over its own rows; rate, decay: of AdamW; warmup: epochs until the divergence counts in full;
    class_weights and focal: of the loss; patience: epochs without a better validation before the end; monitor: loss or auroc."""

    epochs: int = 30
    batches: int = 1
    rate: float = 1e-3
    decay: float = 1e-4
    warmup: int = 10
    class_weights: tuple[float, float] = (1.0, 1.0)
    focal: float = 0.0
    patience: int = 30
    monitor: str = "loss"


@dataclass
class Trained:
    """layers: those of the best epoch; history: a dict an epoch; best: the best epoch, 0 if none was run."""

    layers: list[Layer]
    history: list[dict] = field(default_factory=list)
    best: int = 0


def first_layers(widths: list[int], seed: int = 3407) -> list[Layer]:
    """Weights drawn evenly from ±1 / sqrt(inputs); widths from the inputs to the two logits."""
    r = np.random.default_rng(seed)
    bound = lambda n: 1 / np.sqrt(n)
    return [(r.uniform(-bound(a), bound(a), (a, b)), r.uniform(-bound(a), bound(a), b)) for a, b in zip(widths, widths[1:], strict=False)]


def flat(layers: list[Layer]) -> np.ndarray:
    return np.concatenate([x.ravel() for layer in layers for x in layer])


def shaped(values: np.ndarray, like: list[Layer]) -> list[Layer]:
    parts = iter(np.split(values, np.cumsum([x.size for layer in like for x in layer])[:-1]))
    return [(next(parts).reshape(w.shape), next(parts).reshape(b.shape)) for w, b in like]


def loss_and_gradient(layers: list[Layer], x: np.ndarray, y: np.ndarray, kl_weight: float, class_weights: tuple[float, float] = (1.0, 1.0), focal: float = 0.0) -> tuple[float, np.ndarray]:
    """Summed over rows: the evidential loss and its gradient by all weights.

    With two classes the divergence of the evidence a against the class is ln a - 1 + 1 / a, so its slope is (a - 1) / a².
    """
    inputs, z = [], x
    for i, (w, b) in enumerate(layers):
        inputs.append(z)
        z = z @ w + b
        z = np.maximum(z, 0) if i < len(layers) - 1 else z
    alpha = np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) + 1
    at = np.arange(len(y))
    own, other, s = alpha[at, y], alpha[at, 1 - y], alpha.sum(1)
    p, q = own / s, other / s
    weight = np.asarray(class_weights)[y] * (q**focal if focal else 1.0)
    fit = 2 * q * q + 2 * p * q / (s + 1)
    loss = weight * fit + kl_weight * (np.log(other) - 1 + 1 / other)
    by_p = weight * (-4 * q + 2 * (1 - 2 * p) / (s + 1))
    if focal:
        by_p -= np.asarray(class_weights)[y] * focal * q ** (focal - 1) * fit
    by_s = weight * (-2 * p * q / (s + 1) ** 2)
    d = np.empty_like(alpha)
    d[at, y] = by_p * q / s + by_s
    d[at, 1 - y] = -by_p * p / s + by_s + kl_weight * (other - 1) / (other * other)
    d *= 1 / (1 + np.exp(-z))
    grads: list[np.ndarray] = []
    for i in range(len(layers) - 1, -1, -1):
        grads += [d.sum(0), (inputs[i].T @ d).ravel()]
        if i:
            d = (d @ layers[i][0].T) * (inputs[i] > 0)
    return float(loss.sum()), np.concatenate(grads[::-1])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """A list column as rows of `width` numbers."""
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != width).any():
        raise ValueError(f"features must be {width} numbers")
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _summed(rows: DataFrame, layers: list[Layer], kl_weight: float, settings: Settings, gradient: bool) -> tuple[float, float, np.ndarray]:
    """Rows, loss and gradient of all rows (features, label), by two stages of sums."""
    width, size = layers[0][0].shape[0], len(flat(layers))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, grad, part = 0, 0.0, np.zeros(size), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                one, slope = loss_and_gradient(layers, _matrix(piece.column("v"), width), piece.column("y").to_numpy().astype(np.int64), kl_weight, settings.class_weights, settings.focal)
                n, loss, grad, part = n + piece.num_rows, loss + one, grad + slope, piece.column("part")[0].as_py()
        yield _sums_row(part, n, loss, grad if gradient else np.zeros(0))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((row for batch in batches for row in batch.to_pylist()), key=lambda r: r["part"])
        if held:
            yield _sums_row(held[0]["part"], sum(r["n"] for r in held), sum(r["loss"] for r in held), np.sum([r["grad"] for r in held], axis=0))

    tasks = rows.select("v", "y", F.spark_partition_id().alias("part")).mapInArrow(own, SUMS)
    summed = tasks.repartition(FEW, F.col("part") % FEW).mapInArrow(together, SUMS).collect()
    summed = sorted(summed, key=lambda r: r["part"])
    grads = [r["grad"] for r in summed if r["grad"]]
    return sum(r["n"] for r in summed), sum(r["loss"] for r in summed), np.sum(grads, axis=0) if grads else np.zeros(size)


def _sums_row(part: int, n: float, loss: float, grad: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([float(n)]), pa.array([float(loss)]), pa.array([grad.tolist()], pa.list_(pa.float64()))], ["part", "n", "loss", "grad"])


class AdamW:
    """Adam with decoupled decay over one vector of weights."""

    def __init__(self, size: int, rate: float, decay: float) -> None:
        self.rate, self.decay, self.steps = rate, decay, 0
        self.m, self.v = np.zeros(size), np.zeros(size)

    def step(self, values: np.ndarray, grad: np.ndarray) -> np.ndarray:
        self.steps += 1
        self.m = 0.9 * self.m + 0.1 * grad
        self.v = 0.999 * self.v + 0.001 * grad * grad
        moved = (self.m / (1 - 0.9**self.steps)) / (np.sqrt(self.v) / np.sqrt(1 - 0.999**self.steps) + 1e-8)
        return values * (1 - self.rate * self.decay) - self.rate * moved


def _prepared(df: DataFrame, vector: str, label: str, batch: Column) -> DataFrame:
    """Rows with features and a label of 0 or 1, written by batch, so that a step reads its own rows only."""
    y = F.col(label).cast("int")
    checked = F.when(y.isin(0, 1), y).otherwise(F.raise_error(F.concat(F.lit("labels must be 0 or 1: "), y.cast("string"))).cast("int"))
    rows = df.where(F.col(vector).isNotNull() & y.isNotNull()).select(F.col(vector).cast("array<double>").alias("v"), checked.alias("y"), batch.cast("int").alias("batch"))
    path = scratch_path(df.sparkSession, "train")
    rows.write.partitionBy("batch").parquet(path)
    return df.sparkSession.read.schema("v array<double>, y int, batch int").parquet(path)


def _resumed(state: str | None, layers: list[Layer]) -> dict | None:
    if state is None:
        return None
    try:
        held = load_weights(state)
    except (FileNotFoundError, AnalysisException):
        return None
    if len(held["values"]) != len(flat(layers)):
        raise ValueError(f"{state} is of another model")
    return held


def train(rows: DataFrame, valid: DataFrame, layers: list[Layer], settings: Settings | None = None, vector: str = "vector", label: str = "label", id_col: str = "id", state: str | None = None, told: Callable[[dict], None] | None = None) -> Trained:
    """Fits the layers (ReLU between them, two logits at the end) and gives those of the best epoch on the validation table.

    rows, valid: id, features (equally many finite numbers), label (0 or 1; others raise). Rows without features or label are left out; an empty table raises. Rows go to
    the batches of an epoch by the hash of their id, the same in each epoch. The loss is the mean over a batch; the divergence from the flat distribution counts min(1, epoch / warmup).
    state: a path where weights and moments are kept after each epoch; a run that finds one goes on from there. told: called with each epoch's figures.
    """
    settings = settings or Settings()
    if settings.monitor not in ("loss", "auroc"):
        raise ValueError("monitor loss or auroc")
    batch = F.pmod(F.xxhash64(F.col(id_col)), F.lit(settings.batches)) if settings.batches > 1 else F.lit(0)
    data, held = _prepared(rows, vector, label, batch), _prepared(valid, vector, label, F.lit(0))
    values, adam = flat(layers), AdamW(len(flat(layers)), settings.rate, settings.decay)
    out, best, best_values, first = Trained(layers), np.inf, values, 1
    if (old := _resumed(state, layers)) is not None:
        values, adam.m, adam.v, best_values = (old[k] for k in ("values", "m", "v", "best_values"))
        adam.steps, best, first, out.best, out.history = int(old["steps"]), old["best"], int(old["epoch"]) + 1, int(old["best_epoch"]), old["history"]
    for epoch in range(first, settings.epochs + 1):
        if out.history and epoch - 1 - out.best >= settings.patience:
            break
        kl_weight, losses, seen = kl_warmup(epoch, settings.warmup), 0.0, 0.0
        for b in range(settings.batches):
            n, loss, grad = _summed(data.where(F.col("batch") == b), shaped(values, layers), kl_weight, settings, True)
            if n:
                values = adam.step(values, grad / n)
                losses, seen = losses + loss, seen + n
        now = shaped(values, layers)
        n, loss, _ = _summed(held, now, 1.0, settings, False)
        if not seen or not n:
            raise ValueError("no rows to train on" if not seen else "no rows to validate on")
        figures = {"epoch": epoch, "kl_weight": kl_weight, "train_loss": losses / seen, "valid_loss": loss / n}
        if settings.monitor == "auroc":
            scored = score_batches(held.select(F.col("v").alias("vector"), "y"), mlp(now)).select(F.col("prediction.p_toxic").alias("score"), F.col("y").alias("label"))
            figures["auroc"] = ranking_metrics(scored).first()["auroc"]
            if figures["auroc"] is None:
                raise ValueError("both classes must be in the validation table")
        out.history.append(figures)
        if told:
            told(figures)
        rank = -figures["auroc"] if settings.monitor == "auroc" else figures["valid_loss"]
        if rank < best:
            best, best_values, out.best = rank, values, epoch
        if state:
            save_weights({"values": values, "m": adam.m, "v": adam.v, "best_values": best_values, "steps": adam.steps, "best": best, "best_epoch": out.best, "epoch": epoch, "history": out.history}, state)
    out.layers = shaped(best_values, layers)
    return out
