"""Two-class Dirichlet ("evidential") outputs and losses, and small numpy models as batch functions."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def softplus_evidence(logit: Column) -> Column:
    """softplus(logit) + 1, safe for large values."""
    return F.greatest(logit, F.lit(0.0)) + F.log1p(F.exp(-F.abs(logit))) + 1


def dirichlet(alpha0: Column, alpha1: Column, threshold: float = 0.5) -> Column:
    """struct(p_toxic, pred_label, uncertainty, confidence, total_evidence, alphas, probs)."""
    s = alpha0 + alpha1
    p = alpha1 / s
    return F.struct(p.alias("p_toxic"), (p >= threshold).cast("int").alias("pred_label"), (2 / s).alias("uncertainty"), (1 - 2 / s).alias("confidence"), (s - 2).alias("total_evidence"), F.array(alpha0, alpha1).alias("alphas"), F.array(alpha0 / s, p).alias("probs"))


def digamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: by recurrence to 6 and the asymptotic series."""
    x = np.array(x, np.float64)
    out = np.zeros_like(x)
    while (low := x < 6).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f / 240)))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers: by recurrence to 9 and the asymptotic series."""
    x = np.array(x, np.float64)
    out = np.zeros_like(x)
    while (low := x < 9).any():
        out[low] -= np.log(x[low])
        x[low] += 1
    f = 1 / (x * x)
    return out + (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + (1 / 12 - f * (1 / 360 - f * (1 / 1260 - f / 1680))) / x


def dirichlet_kl(alphas: np.ndarray) -> np.ndarray:
    """Divergence of Dirichlet distributions (a row each) from the flat one."""
    alphas = np.atleast_2d(np.asarray(alphas, np.float64))
    s, k = alphas.sum(1), alphas.shape[1]
    return log_gamma(s) - log_gamma(alphas).sum(1) - log_gamma(np.array([float(k)]))[0] + ((alphas - 1) * (digamma(alphas) - digamma(s)[:, None])).sum(1)


def evidential_loss(alpha0: Column, alpha1: Column, label: Column, kl_weight: float = 1.0, class_weights: tuple[float, float] = (1.0, 1.0), focal: float = 0.0) -> Column:
    """Expected squared error and variance under the Dirichlet, weighted by class and by (1 - p of the class) ** focal, plus kl_weight times the
    divergence, from the flat one, of the evidence against the class."""

    def run(a0: pd.Series, a1: pd.Series, y: pd.Series) -> pd.Series:
        a, t = np.stack([a0, a1], 1).astype(np.float64).reshape(-1, 2), y.to_numpy(np.int64)
        hot = np.eye(2)[t]
        s = a.sum(1, keepdims=True)
        p = a / s
        fit = ((hot - p) ** 2 + p * (1 - p) / (s + 1)).sum(1)
        weight = np.asarray(class_weights)[t] * (1 - (p * hot).sum(1)) ** focal
        return pd.Series(weight * fit + kl_weight * (dirichlet_kl(hot + (1 - hot) * a) if len(a) else 0.0))

    return F.pandas_udf(run, "double")(alpha0, alpha1, label)


def kl_warmup(epoch: int, warmup: int) -> float:
    return min(1.0, epoch / warmup) if warmup else 1.0


Predict = Callable[[np.ndarray], np.ndarray]


def mlp(weights: list[tuple[np.ndarray, np.ndarray]]) -> Predict:
    """ReLU layers, the last linear: rows of features to rows of logits."""

    def run(x: np.ndarray) -> np.ndarray:
        for i, (w, b) in enumerate(weights):
            x = x @ w + b
            x = np.maximum(x, 0) if i < len(weights) - 1 else x
        return x

    return run


def layer_norm(x: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps)


Layer = tuple[np.ndarray, np.ndarray]  # weights (in, out) and bias


def _relu(x: np.ndarray, layer: Layer) -> np.ndarray:
    return np.maximum(x @ layer[0] + layer[1], 0)


def fusion(branches: list[np.ndarray], norms: list[Layer], adapters: list[Layer], joined: Layer, head: list[Layer], extra: tuple[np.ndarray, Layer, Layer] | None = None) -> np.ndarray:
    """Logits from three branches of features (rows each): normalised with a scale and a shift, adapted by a linear layer with ReLU, joined with their product
    by another, then the head. extra: a further branch with its norm and adapter, added before the head."""
    adapted = [_relu(layer_norm(x) * scale + shift, a) for x, (scale, shift), a in zip(branches, norms, adapters, strict=True)]
    z = _relu(np.concatenate([*adapted, np.prod(adapted, axis=0)], axis=-1), joined)
    if extra is not None:
        x, (scale, shift), adapter = extra
        z = z + _relu(layer_norm(x) * scale + shift, adapter)
    return mlp(head)(z)


def fuse_batches(df: DataFrame, columns: list[str], weights: dict, extra: str | None = None) -> DataFrame:
    """Adds the Dirichlet outputs of fusion() on array columns. weights: norms, adapters, joined, head (and extra_norm, extra_adapter); sent with the function."""

    def predict(frame: pd.DataFrame) -> np.ndarray:
        rows = [np.stack(frame[c].to_numpy()).astype(np.float64) for c in [*columns, *([extra] if extra else [])]]
        more = (rows[-1], weights["extra_norm"], weights["extra_adapter"]) if extra else None
        return fusion(rows[: len(columns)], weights["norms"], weights["adapters"], weights["joined"], weights["head"], more)

    return _scored(df, F.struct(*[F.col(c) for c in [*columns, *([extra] if extra else [])]]), predict)


def conv_encoder(tokens: np.ndarray, lengths: np.ndarray, embedding: np.ndarray, kernels: list[Layer], starts: np.ndarray | None = None) -> np.ndarray:
    """Features of many sequences: letter numbers (rows, length; 0 pads) embedded, kernels (width, in, out) with ReLU, and the maximum over a row's own places; a part for each kernel.

    A row's own places are `lengths` from `starts` (0) on; letters beyond them are seen by the kernels only.
    """
    x = embedding[tokens]
    x[tokens == 0] = 0
    n, long, _ = x.shape
    first = np.zeros(n, np.int64) if starts is None else starts
    place = np.arange(long)[None, :]
    own = (place >= first[:, None]) & (place < (first + lengths)[:, None])
    out = []
    for kernel, bias in kernels:
        before = kernel.shape[0] // 2
        padded = np.pad(x, ((0, 0), (before, kernel.shape[0] - 1 - before), (0, 0)))
        y = np.maximum(sum(padded[:, i : i + long] @ kernel[i] for i in range(kernel.shape[0])) + bias, 0)
        out.append(np.where(own[:, :, None], y, -np.inf).max(1) if long else np.zeros((n, len(bias))))
    return np.concatenate(out, axis=1)


#: Letters of a sequence that are convolved at a time.
STRETCH = 4_096


def encode_batches(df: DataFrame, seq: str, weights: dict, alphabet: str, rows: int = 64, stretch: int = STRETCH) -> DataFrame:
    """Adds the Dirichlet outputs of the sequence model: letters embedded, convolved, pooled, and the head. weights: embedding, kernels, head. An empty sequence has zeros as features.

    Long sequences are convolved in stretches, which see as many letters beyond their ends as kernels are wide, and the maxima of stretches are pooled: the
    result is that of the whole, and memory is that of `rows` stretches, whatever the length.
    """
    number = {ord(a): i + 1 for i, a in enumerate(alphabet)}
    codes = np.array(sorted(number), np.uint32)
    places = np.array([number[c] for c in sorted(number)], np.int64)
    beyond = max(k.shape[0] for k, _ in weights["kernels"])
    width = sum(len(b) for _, b in weights["kernels"])

    def letters(text: str | None) -> np.ndarray:
        c = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
        at = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
        return np.where(codes[at] == c, places[at], 0)

    def pieces(frame: pd.DataFrame) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """(row, own start, own length, letters) of each stretch."""
        for i, text in enumerate(frame["seq"]):
            numbers = letters(text)
            for low in range(0, len(numbers), stretch):
                high = min(low + stretch, len(numbers))
                left = max(0, low - beyond)
                yield i, low - left, high - low, numbers[left : high + beyond]

    def predict(frame: pd.DataFrame) -> np.ndarray:
        features = np.full((len(frame), width), -np.inf)
        todo = pieces(frame)
        while some := list(islice(todo, rows)):
            row, start, long, numbers = zip(*some, strict=True)
            tokens = np.zeros((len(some), max(map(len, numbers))), np.int64)
            for i, n in enumerate(numbers):
                tokens[i, : len(n)] = n
            np.maximum.at(features, np.array(row), conv_encoder(tokens, np.array(long), weights["embedding"], weights["kernels"], np.array(start)))
        return mlp(weights["head"])(np.where(np.isfinite(features), features, 0.0))

    return _scored(df, F.struct(F.col(seq).alias("seq")), predict)


def graph_encoder(features: np.ndarray, src: np.ndarray, dst: np.ndarray, layers: list[Layer]) -> np.ndarray:
    """One graph's vector: in each layer a node's incoming neighbours are averaged (none: zeros; no edges at all: itself), then linear and ReLU; at last the mean of the nodes."""
    h = np.asarray(features, np.float64)
    degree = np.bincount(dst, minlength=len(h)) if len(dst) else None
    for layer in layers:
        m = h
        if degree is not None:
            m = np.zeros_like(h)
            np.add.at(m, dst, h[src])
            m = m / np.maximum(degree, 1)[:, None]
        h = _relu(m, layer)
    return h.mean(0)


def encode_graphs(nodes: DataFrame, edges: DataFrame, layers: list[Layer]) -> DataFrame:
    """(graph_id, vector): graph_encoder() of each graph, which a task holds whole. nodes: graph_id, node (long), x (array); edges: graph_id, src, dst.

    Grouped by graph, so a graph has to fit a task; for larger ones take graphs.encode_large_graphs().
    """

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values("node")
        place = {n: i for i, n in enumerate(left["node"])}
        known = right[right["src"].isin(place) & right["dst"].isin(place)]
        vector = graph_encoder(np.stack(left["x"].to_numpy()), known["src"].map(place).to_numpy(np.int64), known["dst"].map(place).to_numpy(np.int64), layers) if len(left) else np.zeros(0)
        return pd.DataFrame({"graph_id": [key[0]], "vector": [vector.tolist()]}) if len(left) else pd.DataFrame({"graph_id": [], "vector": []}, dtype=object)

    kind = f"graph_id {nodes.schema['graph_id'].dataType.simpleString()}, vector array<double>"
    return nodes.groupBy("graph_id").cogroup(edges.groupBy("graph_id")).applyInPandas(run, kind)


def save_weights(weights: dict, path: str) -> None:
    """A model's arrays, in nested lists, tuples and dicts, as JSON: numbers as written by repr, so nothing is lost."""
    where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    plain = lambda x: {"array": x.tolist(), "shape": list(x.shape)} if isinstance(x, np.ndarray) else {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, list | tuple) else x
    with where.open_output_stream(name + ".part") as out:
        out.write(json.dumps(plain(weights)).encode())
    where.move(name + ".part", name)


def load_weights(path: str) -> dict:
    """What save_weights() wrote; tuples come back as lists."""
    where, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)

    def back(x: object) -> object:
        if isinstance(x, dict):
            return np.array(x["array"], np.float64).reshape(x["shape"]) if set(x) == {"array", "shape"} else {k: back(v) for k, v in x.items()}
        return [back(v) for v in x] if isinstance(x, list) else x

    return back(json.loads(where.open_input_stream(name).read()))


def _scored(df: DataFrame, inputs: Column, predict: Callable[[pd.DataFrame], np.ndarray]) -> DataFrame:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        z = predict(frame) if len(frame) else np.zeros((0, 2))
        a = np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) + 1
        return pd.DataFrame({"a0": a[:, 0], "a1": a[:, 1]})

    return df.withColumn("_a", F.pandas_udf(run, "a0 double, a1 double")(inputs)).select(*df.columns, dirichlet(F.col("_a.a0"), F.col("_a.a1")).alias("prediction"))


def score_batches(df: DataFrame, predict: Predict, vector: str = "vector") -> DataFrame:
    """Adds alphas and the Dirichlet outputs of a model that maps feature rows to two logits; Arrow batches, weights sent with the function."""

    return _scored(df, F.struct(F.col(vector).alias("v")), lambda frame: predict(np.stack(frame["v"].to_numpy()).astype(np.float64)))


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.1, decay: float = 1e-3, patience: int = 30, held: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, float]:
    """A two-class scorer by Adam with decoupled decay, stopped early on a held-out loss: the stand-in for the deep models' training loops."""
    w, b = np.zeros(x.shape[1]), 0.0
    m, v, best, since = np.zeros(len(w) + 1), np.zeros(len(w) + 1), (np.inf, w, b), 0
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = np.append(x.T @ (p - y) / len(y), (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1] - rate * decay * w, b - step[-1]
        hx, hy = held or (x, y)
        z = hx @ w + b
        loss = float(np.mean(np.logaddexp(0, z) - hy * z))
        best, since = ((loss, w.copy(), b), 0) if loss < best[0] - 1e-6 else (best, since + 1)
        if since >= patience:
            break
    return best[1], best[2]
