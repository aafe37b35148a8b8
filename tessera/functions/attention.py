"""Attention over three sets of features at once, in tiles.

Every triple of places (one of each set) has a score for each head, sum over k of w_k x_k y_k z_k; softmax over all triples weighs the products x y z, which are summed.
The cube of scores is never held: a tile of it at a time, with a running maximum and a running sum, which are set right when the maximum rises.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.evidential import Layer

#: Scores held at a time.
TILE = 1 << 20


class ThreeWay(NamedTuple):
    """nets: for each set its linear layers, each with ReLU; heads (heads, k): weights of the scores (a head's bias changes no softmax); pool: neighbouring features summed;
    scale and shift: of the result (a batch norm at inference)."""

    nets: tuple[list[Layer], list[Layer], list[Layer]]
    heads: np.ndarray
    pool: int = 1
    scale: np.ndarray | float = 1.0
    shift: np.ndarray | float = 0.0


def _net(x: np.ndarray, layers: list[Layer]) -> np.ndarray:
    for w, b in layers:
        x = np.maximum(x @ w + b, 0)
    return x


def three_way(x: np.ndarray, y: np.ndarray, z: np.ndarray, model: ThreeWay, tile: int = TILE) -> np.ndarray:
    """The pooled features of one row. x, y, z: places by features; none of them empty."""
    x, y, z = (_net(v, layers) for v, layers in zip((x, y, z), model.nets, strict=True))
    pairs = len(x) * len(y)
    step = max(1, tile // len(z))
    out = np.zeros(x.shape[1])
    for w in model.heads:
        most, total, pooled = -np.inf, 0.0, np.zeros(x.shape[1])
        for at in range(0, pairs, step):
            i = np.arange(at, min(pairs, at + step))
            xy = x[i // len(y)] * y[i % len(y)]
            scores = (xy * w) @ z.T
            high = max(most, float(scores.max()))
            e = np.exp(scores - high)
            before = np.exp(most - high)
            total, pooled, most = total * before + e.sum(), pooled * before + (xy * (e @ z)).sum(0), high
        out += pooled / total
    return out.reshape(-1, model.pool).sum(1) * model.scale + model.shift


def attend_batches(df: DataFrame, columns: tuple[str, str, str], model: ThreeWay, name: str = "attended") -> DataFrame:
    """Adds the pooled features of three array columns: arrays of numbers are sets of one feature, arrays of arrays sets of several. A row with a null or empty set gets null."""

    def places(value: object) -> np.ndarray | None:
        if value is None or not len(value):
            return None
        return np.stack([np.atleast_1d(np.asarray(v, np.float64)) for v in value])

    def run(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        rows = ([places(v) for v in row] for row in zip(x, y, z, strict=True))
        return pd.Series([None if any(v is None for v in row) else three_way(*row, model) for row in rows], dtype=object)

    return df.withColumn(name, F.pandas_udf(run, "array<double>")(*[F.col(c) for c in columns]))
