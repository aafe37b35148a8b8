"""Attention in tiles against the whole cube."""

import numpy as np
import pytest

from tessera.functions.attention import ThreeWay, _net, attend_batches, three_way


def whole_cube(x, y, z, model):
    x, y, z = (_net(v, layers) for v, layers in zip((x, y, z), model.nets, strict=True))
    t = np.einsum("xk,yk,zk->xyzk", x, y, z)
    out = np.zeros(x.shape[1])
    for w in model.heads:
        s = t @ w
        p = np.exp(s - s.max())
        out += np.einsum("xyz,xyzk->k", p / p.sum(), t)
    return out.reshape(-1, model.pool).sum(1) * model.scale + model.shift


def made(dims=(1, 1, 1), k=6, heads=2, pool=2, seed=1, size=1.0):
    r = np.random.default_rng(seed)
    nets = tuple([(size * r.normal(size=(d, k)), r.uniform(0, 1, k)), (r.normal(size=(k, k)), r.uniform(0, 1, k))] for d in dims)
    return ThreeWay(nets, r.normal(size=(heads, k)), pool, r.normal(size=k // pool), r.normal(size=k // pool))


@pytest.mark.parametrize("widths", [(1, 1, 1), (3, 5, 7), (24, 24, 24), (2, 24, 9)])
@pytest.mark.parametrize("tile", [1, 10, 500, 1 << 20])
def test_tiles_equal_the_whole_cube(widths, tile):
    r = np.random.default_rng(3)
    model = made((2, 1, 3))
    x, y, z = (r.normal(size=(n, d)) for n, d in zip(widths, (2, 1, 3), strict=True))
    assert np.abs(three_way(x, y, z, model, tile) - whole_cube(x, y, z, model)).max() < 1e-9


def test_large_scores_do_not_overflow():
    r = np.random.default_rng(3)
    model = made(size=40.0)
    x, y, z = (r.normal(size=(9, 1)) * 10 for _ in range(3))
    got = three_way(x, y, z, model, 20)
    assert np.isfinite(got).all() and np.allclose(got, whole_cube(x, y, z, model))


def test_rows_of_a_table(spark):
    model = made()
    rows = [(1, [1.0, 2.0], [0.5], [1.0, -1.0, 3.0]), (2, [], [0.5], [1.0]), (3, None, [0.5], [1.0]), (4, [0.0], [0.0], [0.0])]
    got = {r.id: r.attended for r in attend_batches(spark.createDataFrame(rows, "id int, x array<double>, y array<double>, z array<double>"), ("x", "y", "z"), model).collect()}
    assert got[2] is None and got[3] is None
    for i, *sets in (rows[0], rows[3]):
        assert np.allclose(got[i], whole_cube(*[np.array(s)[:, None] for s in sets], model))
    wide = spark.createDataFrame([(1, [[1.0, 2.0]], [0.5], [[1.0, 0.0, 3.0]])], "id int, x array<array<double>>, y array<double>, z array<array<double>>")
    model = made((2, 1, 3))
    assert np.allclose(attend_batches(wide, ("x", "y", "z"), model).first().attended, whole_cube(np.array([[1.0, 2.0]]), np.array([[0.5]]), np.array([[1.0, 0.0, 3.0]]), model))
