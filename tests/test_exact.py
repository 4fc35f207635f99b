from datetime import timedelta

import numpy as np
import pytest
from brute import found, outliers, to_points, within_counts

from farpoint import GridParams, LshParams, QueryMode, WindowSpec, detect_lsh, detect_outliers, neighbor_counts
from farpoint.plans.approximate import detect_filtered
from farpoint.plans.exact import nearest_neighbors

SECOND = 1_000_000
SPEC = WindowSpec(timedelta(seconds=50), timedelta(seconds=20))  # size no multiple of slide


def clustered(seed, n, dims, crowd=0.34):
    """Clusters, noise, exact copies, points on cell borders, and a third of all in one spot."""
    rng = np.random.default_rng(seed)
    noise = rng.uniform(-40, 40, (n, dims))
    centers = rng.uniform(-30, 30, (5, dims))
    tight = centers[rng.integers(0, 5, n)] + rng.normal(0, 2.0, (n, dims))
    x = np.where(rng.random((n, 1)) < 0.5, tight, noise)
    hot = rng.random(n) < crowd
    x[hot] = np.array([3.0] * dims) + rng.normal(0, 0.6, (hot.sum(), dims))
    copies = rng.integers(0, n, n // 20)
    x[rng.integers(0, n, n // 20)] = x[copies]
    border = rng.integers(0, n, n // 20)
    x[border] = np.round(x[border])
    us = rng.integers(-100, 200, n) * SECOND + rng.integers(0, 3, n) * 10 * SECOND
    return x, us


@pytest.mark.parametrize(
    "dims, radius, k", [(1, 0.3, 5), (2, 2.0, 5), (2, 2.0, 0), (3, 4.0, 8), (5, 9.0, 6), (10, 22.0, 4), (3, 4.0, 1)]
)
def test_exact_equals_nested_loop(spark, dims, radius, k):
    x, us = clustered(dims * 10 + k, 900, dims)
    params = GridParams(radius, k, dims, sort_dim=dims - 1)
    assert found(detect_outliers(to_points(spark, x, us), params, SPEC), SPEC) == outliers(x, us, params, SPEC)


def test_no_windows_and_many_copies(spark):
    x, us = clustered(5, 600, 3)
    x[:250] = [7.0, -7.0, 0.0]  # one set of copies holds more than a third
    params = GridParams(4.0, 8, 3)
    points = to_points(spark, x, us).drop("arrival")
    assert found(detect_outliers(points, params), None) == outliers(x, us, params, None)


def test_partial_boxes_are_opened(spark, monkeypatch):
    """Many points in few boxes, each cut by many spheres, with hot keys spread to chunks."""
    from farpoint.plans import tables

    monkeypatch.setattr(tables, "CHUNK_ROWS", 3)
    rng = np.random.default_rng(3)
    ring = rng.normal(0, 1, (700, 3))
    ring = ring / np.linalg.norm(ring, axis=1)[:, None] * rng.normal(4.0, 0.03, (700, 1))
    x = np.vstack([ring, rng.normal(0, 0.05, (10, 3))])
    us = np.zeros(len(x), dtype=int)
    params = GridParams(4.0, 300, 3)
    expected = within_counts(x, us, params, None)
    assert found(detect_outliers(to_points(spark, x, us).drop("arrival"), params), None) == {
        key for key, n in expected.items() if n < 300
    }
    rows = neighbor_counts(to_points(spark, x, us).drop("arrival"), params).collect()
    assert {(0, r.point_id): r.n_neighbors for r in rows} == expected


@pytest.mark.parametrize("hot_keys", [2, 1000])
def test_many_dimensions_in_small_lots(spark, monkeypatch, hot_keys):
    """All points in few blocks; lots far smaller than the blocks, listed or joined."""
    from farpoint.plans import exact, tables

    monkeypatch.setattr(exact, "WIDE_LOT", 40)
    monkeypatch.setattr(tables, "HOT_KEYS", hot_keys)
    x, us = clustered(51, 500, 12)
    params = GridParams(20.0, 4, 12)
    assert found(detect_outliers(to_points(spark, x, us), params, SPEC), SPEC) == outliers(x, us, params, SPEC)


def test_counts_per_window(spark):
    x, us = clustered(11, 500, 2)
    params = GridParams(2.0, 5, 2)
    rows = neighbor_counts(to_points(spark, x, us), params, SPEC).selectExpr(
        "unix_micros(window_start) AS s", "point_id", "n_neighbors"
    )
    counted = {(r.s // SPEC.slide_us, r.point_id): r.n_neighbors for r in rows.collect()}
    assert counted == within_counts(x, us, params, SPEC)


def test_distance_of_exactly_the_radius_counts(spark):
    x = np.array([[0.0, 0.0], [3.0, 4.0], [-3.0, -4.0], [0.0, 5.000001], [-0.0, 0.0]])
    params = GridParams(5.0, 3, 2)
    us = np.zeros(5, dtype=int)
    points = to_points(spark, x, us).drop("arrival")
    assert found(detect_outliers(points, params), None) == outliers(x, us, params, None) == {(0, 2), (0, 3)}


def test_numbers_that_are_none(spark):
    x, us = clustered(9, 200, 2)
    x[0] = [np.nan, 1.0]
    x[1] = [np.inf, 1.0]
    x[2] = [3.0, -np.inf]
    for params in (GridParams(3.0, 4, 2), GridParams(3.0, 0, 2)):
        expected = outliers(np.where(np.isfinite(x), x, np.nan), us, params, SPEC)
        assert {1, 2} <= {i for _, i in expected}
        assert found(detect_outliers(to_points(spark, x, us), params, SPEC), SPEC) == expected


@pytest.mark.parametrize("mode", [QueryMode.NEWEST, QueryMode.EXPIRING, QueryMode.MIDDLE_EXPIRING])
def test_modes_ask_each_point_once_per_stage(spark, mode):
    x, us = clustered(21, 500, 2)
    us[:20] = np.arange(20) * 20 * SECOND - 100 * SECOND  # exactly on slide boundaries
    params = GridParams(2.0, 5, 2)
    w, s = SPEC.size_us, SPEC.slide_us

    def asked(win, t):
        newest = t + s >= win * s + w
        expiring = t < win * s + s
        middle = win * s + w // 2 <= t < win * s + w // 2 + s
        return {"newest": newest, "expiring": expiring, "middle_expiring": middle or expiring}[mode.value]

    expected = {(win, i) for win, i in outliers(x, us, params, SPEC) if asked(win, us[i])}
    assert found(detect_outliers(to_points(spark, x, us), params, SPEC, mode), SPEC) == expected


def test_verified_hashing_flags_every_outlier_and_filter_is_exact(spark):
    x, us = clustered(31, 400, 3)
    params = GridParams(4.0, 6, 3)
    points = to_points(spark, x, us)
    truth = outliers(x, us, params, SPEC)
    assert truth <= found(detect_lsh(points, params, SPEC, lsh=LshParams(num_tables=2)), SPEC)
    assert found(detect_filtered(points, params, SPEC), SPEC) == truth


@pytest.mark.parametrize("dims", [3, 10])
def test_nearest_neighbors(spark, dims):
    x, us = clustered(41, 300, dims)
    params = GridParams(4.0 if dims == 3 else 22.0, 6, dims)
    points = to_points(spark, x, us)
    asked = detect_outliers(points, params, SPEC)
    got = {}
    for r in nearest_neighbors(points, asked, params, SPEC, top=2).collect():
        got.setdefault((r.win, r.point_id), []).append((r.place, r.distance, r.neighbor_id))
    for (win, i), rows in got.items():
        t = us.astype(int)
        same = [j for j in range(len(x)) if j != i and win * SPEC.slide_us <= t[j] < win * SPEC.slide_us + SPEC.size_us]
        near = sorted((float(np.linalg.norm(x[i] - x[j])), j) for j in same)
        near = [(d, j) for d, j in near if d <= params.radius][:2]
        assert [j for _, _, j in sorted(rows)] == [j for _, j in near]
