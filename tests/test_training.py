"""Distributed training against numpy on one machine."""

import numpy as np
import pytest

from tessera.functions.evidential import dirichlet_kl, mlp
from tessera.operators import training
from tessera.operators.training import Settings, first_layers, flat, loss_and_gradient, shaped, train


def made(n=600, width=5, seed=2):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, width))
    y = (x @ np.arange(1, width + 1) + r.normal(size=n) > 0.5).astype(int)
    return x, y


def frame(spark, x, y, first=0):
    return spark.createDataFrame([(first + i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, y, strict=True))], "id long, vector array<double>, label int")


def loss_by_hand(layers, x, y, lam, weights, focal):
    z = mlp(layers)(x)
    a = np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z))) + 1
    hot, s = np.eye(2)[y], a.sum(1, keepdims=True)
    p = a / s
    fit = ((hot - p) ** 2 + p * (1 - p) / (s + 1)).sum(1)
    return (np.asarray(weights)[y] * (1 - (p * hot).sum(1)) ** focal * fit + lam * dirichlet_kl(hot + (1 - hot) * a)).sum()


@pytest.mark.parametrize(("widths", "weights", "focal"), [([5, 2], (1.0, 1.0), 0.0), ([5, 7, 2], (1.0, 3.0), 0.0), ([5, 6, 4, 2], (2.0, 1.0), 2.0)])
def test_gradient_is_the_slope_of_the_loss(widths, weights, focal):
    x, y = made(50)
    layers = first_layers(widths)
    loss, grad = loss_and_gradient(layers, x, y, 0.4, weights, focal)
    at = flat(layers)
    f = lambda v: loss_by_hand(shaped(v, layers), x, y, 0.4, weights, focal)
    slope = np.array([(f(at + 1e-6 * d) - f(at - 1e-6 * d)) / 2e-6 for d in np.eye(len(at))])
    assert abs(loss - f(at)) < 1e-8 and np.abs(slope - grad).max() < 1e-6


def descend(layers, x, y, hx, hy, s):
    """The same on one machine, over the whole table in each step."""
    values, m, v, best = flat(layers), 0, 0, (np.inf, None)
    for t in range(1, s.epochs + 1):
        _, g = loss_and_gradient(shaped(values, layers), x, y, min(1.0, t / s.warmup), s.class_weights, s.focal)
        g = g / len(y)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        values = values * (1 - s.rate * s.decay) - s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v) / np.sqrt(1 - 0.999**t) + 1e-8)
        loss = loss_by_hand(shaped(values, layers), hx, hy, 1.0, s.class_weights, s.focal) / len(hy)
        best = min(best, (loss, t, values), key=lambda b: b[0])
    return best


def test_training_equals_descent_on_one_machine(spark):
    x, y = made()
    hx, hy = made(150, seed=5)
    s = Settings(epochs=12, rate=0.05, decay=0.01, warmup=5, class_weights=(1.0, 2.0), focal=1.0)
    layers = first_layers([5, 6, 2])
    got = train(frame(spark, x, y).repartition(7), frame(spark, hx, hy, 10_000), layers, s)
    loss, epoch, values = descend(layers, x, y, hx, hy, s)
    assert got.best == epoch and np.abs(flat(got.layers) - values).max() < 1e-9
    assert abs(got.history[epoch - 1]["valid_loss"] - loss) < 1e-9
    assert [h["kl_weight"] for h in got.history[:6]] == [0.2, 0.4, 0.6, 0.8, 1.0, 1.0]
    assert got.history[-1]["train_loss"] < got.history[5]["train_loss"]


def test_batches_auroc_and_patience(spark):
    x, y = made(900)
    hx, hy = made(200, seed=6)
    got = train(frame(spark, x, y), frame(spark, hx, hy, 10_000), first_layers([5, 8, 2]), Settings(epochs=25, batches=4, rate=0.05, warmup=3, monitor="auroc", patience=4))
    assert got.history[got.best - 1]["auroc"] == max(h["auroc"] for h in got.history) > 0.9
    assert len(got.history) in (25, got.best + 4)


def test_a_run_goes_on_from_its_state(spark, tmp_path, monkeypatch):
    x, y = made(300)
    rows, valid = frame(spark, x, y), frame(spark, *made(80, seed=9), 10_000)
    layers = first_layers([5, 4, 2])
    whole = train(rows, valid, layers, Settings(epochs=6, rate=0.05, batches=2))
    state = str(tmp_path / "state.json")
    train(rows, valid, layers, Settings(epochs=3, rate=0.05, batches=2), state=state)
    told = []
    rest = train(rows, valid, layers, Settings(epochs=6, rate=0.05, batches=2), state=state, told=told.append)
    assert [t["epoch"] for t in told] == [4, 5, 6] and np.abs(flat(rest.layers) - flat(whole.layers)).max() < 1e-12
    assert rest.history == whole.history and rest.best == whole.best
    with pytest.raises(ValueError, match="another model"):
        train(rows, valid, first_layers([5, 2]), Settings(epochs=1), state=state)


def test_rows_that_cannot_be_trained_on(spark):
    x, y = made(40)
    valid = frame(spark, x, y, 10_000)
    s = Settings(epochs=1)
    odd = frame(spark, x, y).unionByName(spark.createDataFrame([(1, None, 1), (2, [0.0] * 5, None), (None, [0.0] * 5, 0)], "id long, vector array<double>, label int"))
    assert abs(train(odd, valid, first_layers([5, 2]), s).history[0]["train_loss"] - loss_by_hand(first_layers([5, 2]), np.vstack([x, np.zeros((1, 5))]), np.append(y, 0), 0.1, (1, 1), 0) / 41) < 1e-12
    empty = frame(spark, x[:0], y[:0])
    with pytest.raises(ValueError, match="no rows to train"):
        train(empty, valid, first_layers([5, 2]), s)
    with pytest.raises(ValueError, match="no rows to validate"):
        train(frame(spark, x, y), empty, first_layers([5, 2]), s)
    for bad in (frame(spark, x[:, :4], y), frame(spark, x, y + 1)):
        with pytest.raises(Exception, match=r"must be"):
            train(bad, valid, first_layers([5, 2]), s)
    with pytest.raises(ValueError):
        train(odd, valid, first_layers([5, 2]), Settings(monitor="f1"))
    assert training.ROWS > 0
