"""Recurrences composed block by block against the plain kernels, at any block length."""

import numpy as np
import pytest

from tickloom.functions import kernels as K
from tickloom.operators import scan as S


def walked(make, n, cuts):
    """make(slice, first) -> recurrence of those bars; runs of all blocks, each from the state that maps give it."""
    edges = [0, *cuts, n]
    state, out = None, []
    for a, b in zip(edges, edges[1:], strict=False):
        r = make(a, b)
        state = r.start() if state is None else state
        out.append(r.run(state))
        state = r.carry(state, r.summary())
    return np.concatenate(out, axis=-1)


CUTS = [[], [50], [1, 2, 3], [30, 60, 90, 120], [97, 98], list(range(10, 200, 10))]


@pytest.fixture(params=range(4))
def bars(request):
    rng = np.random.default_rng(request.param)
    n = 200
    c = 100 + (rng.normal(size=n) * [1, 0.2, 5, 1][request.param]).cumsum()
    if request.param == 3:
        c = np.round(c)  # ties, flat runs
    h, l = c + rng.random(n), c - rng.random(n)  # noqa: E741
    if request.param == 3:
        h, l = np.round(h), np.round(l)  # noqa: E741
    return h, l, c


def close(a, b):
    np.testing.assert_allclose(a, b, rtol=1e-11, atol=1e-11)


@pytest.mark.parametrize("cuts", CUTS)
def test_averages(bars, cuts):
    _, _, c = bars
    n = len(c)
    for length in (3, 14, 40):
        back = lambda a: max(0, a - 64)
        close(walked(lambda a, b: S.Seeded(c[back(a) : b], length, 2 / (length + 1), a - back(a)), n, cuts), K.seeded_ema(c, length))  # noqa: B023
        close(walked(lambda a, b: S.Summed(c[back(a) : b], length, a - back(a)), n, cuts), K.wilder_sum(c, length))  # noqa: B023
        gaps = c.copy()
        gaps[[0, 1, 20, 21, 22, 100]] = np.nan
        close(walked(lambda a, b: S.Faded(gaps[a:b], 1 / length), n, cuts), K.ewma(gaps, 1 / length))  # noqa: B023
        late = c.copy()
        late[:45] = np.nan
        close(walked(lambda a, b: S.Seeded(late[back(a) : b], length, 1 / length, a - back(a)), n, cuts), K.wilder(late, length))  # noqa: B023


@pytest.mark.parametrize("cuts", CUTS)
def test_kalman(bars, cuts):
    c = bars[2].copy()
    close(walked(lambda a, b: S.Level(c[a:b], a == 0), len(c), cuts), K.kalman(c))
    c[[5, 30, 31, 99]] = np.nan
    close(walked(lambda a, b: S.Level(c[a:b], a == 0), len(c), cuts), K.kalman(c))


@pytest.mark.parametrize("cuts", CUTS)
@pytest.mark.parametrize("m", [0.5, 1.0, 3.0])
def test_supertrend(bars, cuts, m):
    h, l, c = bars  # noqa: E741
    atr = K.ewma(K.true_range(h, l, c), 0.1)
    up, down = (h + l) / 2 + m * atr, (h + l) / 2 - m * atr
    value, way = K.supertrend(h, l, c, atr, m)
    got = walked(lambda a, b: S.Ratchet(up[a:b], down[a:b], c[a:b], c[a - 1] if a else np.nan, a == 0), len(c), cuts)
    np.testing.assert_array_equal(got[0], value)
    np.testing.assert_array_equal(got[1], way)


@pytest.mark.parametrize("cuts", CUTS)
def test_trend(bars, cuts):
    h, l, c = bars  # noqa: E741
    up, down = c > np.roll(h, 3), c < np.roll(l, 3)
    s, want = 0, []
    for i in range(len(c)):
        s = s if i == 0 else 1 if s == 0 and up[i] else 0 if s == 1 and down[i] else s
        want.append(s)
    np.testing.assert_array_equal(walked(lambda a, b: S.Trend(up[a:b], down[a:b], a == 0), len(c), cuts), want)
