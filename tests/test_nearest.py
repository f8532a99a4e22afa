"""The nearest rows by tiles against all products: ties, cells, and samples that mislead."""

import numpy as np
import pytest

from eligo.operators.vectors import STRIP, TILE, nearest


def units(rng, n):
    x = rng.standard_normal((n, 16))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute(sims, k):
    best = [np.lexsort((np.arange(len(row)), -row))[:k] for row in sims]
    return [(j, i) for j, row in enumerate(best) for i in row if sims[j, i] > -np.inf]


@pytest.mark.parametrize("misled", [False, True])
@pytest.mark.parametrize("cells", [False, True])
def test_nearest_is_the_sorted_head_of_all_products(cells, misled):
    rng = np.random.default_rng(3)
    q, x = units(rng, TILE + 40), units(rng, STRIP + 900)
    x[4000:4050] = x[7]  # equal ones over two strips
    if misled:
        x[:] = q[0]
        x[::16] = -q[0]  # every sampled row is the farthest
        x[5:900:7] = units(rng, len(x[5:900:7]))
    cell = rng.integers(0, 9, len(x))
    use = rng.random((len(q), 9)) < 0.4
    sims = np.round(q @ x.T, 6)
    if cells:
        sims = np.where(use[:, cell], sims, -np.inf)
    r, p, s = nearest(q, x, 30, *((cell, use) if cells else ()))
    want = brute(sims, 30)
    got = sorted(zip(r.tolist(), -s, p.tolist()))
    assert [(j, i) for j, _, i in got] == want
    assert np.allclose([-v for _, v, _ in got], [sims[j, i] for j, i in want], atol=1e-9)
