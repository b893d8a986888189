import numpy as np
import pytest

from voxlake.operators import selection

NU, NV = 9, 7


@pytest.fixture(scope="module")
def grid():
    return np.random.default_rng(6).normal(size=(NV, NU))


def weight(mode, t):
    d = abs(t)
    if mode == "Linear":
        return max(1 - d, 0)
    return 1.5 * d**3 - 2.5 * d**2 + 1 if d <= 1 else -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2 if d < 2 else 0


def plain(grid, holes, width, height, first, step, mode):
    out = {}
    for i in range(width):
        for j in range(height):
            u, v = first[0] + i * step[0], first[1] + j * step[1]
            there = [(a, b) for a in range(NU) for b in range(NV) if (a, b) not in holes]
            if not any(-0.5 - 1e-9 < u - a <= 0.5 + 1e-9 and -0.5 - 1e-9 < v - b <= 0.5 + 1e-9 for a, b in there):
                continue
            if mode == "Nearest":
                near = [(a, b) for a, b in there if -0.5 < u - a <= 0.5 and -0.5 < v - b <= 0.5]
                if near:
                    out[i, j] = grid[near[0][1], near[0][0]]
                continue
            w = {(a, b): weight(mode, u - a) * weight(mode, v - b) for a, b in there}
            out[i, j] = sum(x * grid[b, a] for (a, b), x in w.items()) / sum(w.values())
    return out


@pytest.mark.parametrize("mode", ["Nearest", "Linear", "Cubic"])
@pytest.mark.parametrize("width,height,first,step", [(30, 22, (-1.1, -0.7), (0.37, 0.41)), (6, 5, (0.3, 0.2), (2.6, 1.9)), (9, 7, (0.0, 0.0), (1.0, 1.0)), (4, 4, (3.0, 3.0), (0.125, 0.5))])
def test_views(spark, grid, mode, width, height, first, step):
    holes = {(4, 3), (0, 6)}
    rows = [(1, u, v, None if (u, v) == (0, 6) else float(grid[v, u])) for u in range(NU) for v in range(NV) if (u, v) != (4, 3)]
    plane = spark.createDataFrame(rows, "image_id long, u int, v int, value double").repartition(3)
    got = {(r.u, r.v): r.value for r in selection.resampled(plane, width, height, first, step, mode).collect() if r.value is not None}
    want = plain(grid, holes, width, height, first, step, mode)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_at_the_samples_the_values_are_theirs(spark, grid):
    plane = spark.createDataFrame([(1, u, v, float(grid[v, u])) for u in range(NU) for v in range(NV)], "image_id long, u int, v int, value double")
    for mode in ("Nearest", "Linear", "Cubic"):
        got = {(r.u, r.v): r.value for r in selection.resampled(plane, NU, NV, mode=mode).collect()}
        assert all(got[u, v] == pytest.approx(grid[v, u]) for u in range(NU) for v in range(NV))


def test_a_straight_line_stays_one(spark):
    plane = spark.createDataFrame([(i, u, v, 2.0 * u - v + i) for i in (1, 2) for u in range(12) for v in range(12)], "image_id long, u int, v int, value double")
    for mode in ("Linear", "Cubic"):
        for r in selection.resampled(plane, 20, 20, (3.1, 3.2), (0.21, 0.17), mode).collect():
            assert r.value == pytest.approx(2 * (3.1 + 0.21 * r.u) - (3.2 + 0.17 * r.v) + r.image_id)


def test_nothing(spark):
    assert selection.resampled(spark.createDataFrame([], "image_id long, u int, v int, value double"), 5, 5).count() == 0
