"""Pivot blocks lose no pair and leave few to compare, windows and skew included."""

from datetime import timedelta

import numpy as np
import pytest
from brute import found, outliers, to_points, within_counts
from pyspark.sql import functions as F

from farpoint import GridParams, WindowSpec
from farpoint.plans import exact, pivots

SPEC = WindowSpec(timedelta(seconds=40), timedelta(seconds=20))


def _clusters(n, dims, seed, spread=20.0):
    """Clusters anywhere, a hot one, single points; the first coordinates are alike."""
    rng = np.random.default_rng(seed)
    centers = rng.uniform(-spread, spread, (12, dims))
    centers[:, :3] = 0.0
    which = np.where(rng.random(n) < 0.35, 0, rng.integers(0, 12, n))
    x = centers[which] + rng.normal(0, 0.25, (n, dims))
    x[::40] = rng.uniform(-spread, spread, (len(x[::40]), dims))
    return x, rng.integers(0, 100, n) * 1_000_000


def _compared(points, lay):
    """Pairs that meet in the blocks: each point against the blocks around its own."""
    rows = points.select("point_id", "coords").select("*", *lay.block_columns())
    held = rows.groupBy(*lay.block_key).agg(F.count("*").alias("n"))
    for b in lay.block_key:
        rows = rows.withColumn(b, F.explode(F.array(*[F.col(b) + o for o in (-1, 0, 1)])))
    return rows.join(held, lay.block_key).agg(F.sum("n")).first()[0]


@pytest.mark.parametrize("dims", [10, 64])
@pytest.mark.parametrize("mode", ["all", "expiring"])
def test_windowed_detection_in_many_dimensions(spark, dims, mode):
    x, us = _clusters(400, dims, dims)
    x[5, 7] = np.nan
    params = GridParams(0.45 * dims**0.5, 5, dims)
    got = found(exact.detect_outliers(to_points(spark, x, us), params, SPEC, mode), SPEC)
    want = {(w, i) for w, i in outliers(x, us, params, SPEC) if mode == "all" or w == us[i] // SPEC.slide_us}
    assert got == want and len(want) > 10


def test_counts_in_many_dimensions(spark):
    x, us = _clusters(150, 12, 3)
    params = GridParams(2.0, 5, 12)
    got = {r.point_id: r.n_neighbors for r in exact.neighbor_counts(to_points(spark, x, us), params).collect()}
    assert got == {i: n for (_, i), n in within_counts(x, np.zeros(len(us), int), params, None).items()}


@pytest.mark.parametrize("dims", [10, 64])
def test_less_than_half_of_the_pairs_meet(spark, dims):
    x, us = _clusters(1500, dims, 50 + dims)
    points = to_points(spark, x, us)
    params = GridParams(0.45 * dims**0.5, 5, dims)
    by_pivot = exact.layout_for(points, params, None)
    assert len(by_pivot.pivots) == exact.PIVOTS and by_pivot.block_key == ["b0", "b1", "b2"]
    met, before = (_compared(points, lay) for lay in (by_pivot, exact.Layout(params, None)))
    assert met < 0.5 * len(x) ** 2 < before


def test_no_near_pair_is_more_than_a_block_apart(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1e6, (40, 9))
    step = rng.normal(0, 1, (40, 9))
    y = x + step / np.linalg.norm(step, axis=1)[:, None] * 0.5  # at the radius
    both = to_points(spark, np.vstack([x, y]), np.zeros(80, int))
    chosen = pivots.choose_pivots(both, 3)
    rows = both.select("point_id", *pivots.block_columns(chosen, 0.5)).collect()
    at = {r.point_id: (r.b0, r.b1, r.b2) for r in rows}
    assert all(abs(a - b) <= 1 for i in range(40) for a, b in zip(at[i], at[i + 40]))


def test_choice_of_pivots(spark):
    empty = to_points(spark, np.zeros((1, 9)), np.zeros(1, int)).limit(0)
    assert pivots.choose_pivots(empty, 3) == ()
    same = to_points(spark, np.ones((20, 9)), np.zeros(20, int))
    assert pivots.choose_pivots(same, 3) == ((1.0,) * 9,)
    x, us = _clusters(300, 9, 1)
    a, b = (pivots.choose_pivots(to_points(spark, x[p], us), 3) for p in (slice(None), slice(None, None, -1)))
    assert a == b and len(set(a)) == 3
    huge = to_points(spark, np.array([[1e200] * 9, [-1e200] * 9, [0.0] * 9]), np.zeros(3, int))
    params = GridParams(1.0, 1, 9)
    assert found(exact.detect_outliers(huge, params), None) == {(0, 0), (0, 1), (0, 2)}
    assert exact.detect_outliers(same, params).count() == exact.detect_outliers(empty, params).count() == 0
