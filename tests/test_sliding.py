"""Windows of many slides and of odd slides: sums, prunes and detection against brute force."""

from collections import Counter
from datetime import timedelta

import numpy as np
import pytest
from brute import found, outliers, to_points, windows_of
from pyspark.sql import functions as F

from farpoint import GridParams, WindowSpec
from farpoint.operators import cells, sliding, windows
from farpoint.plans.exact import detect_outliers

MANY = WindowSpec(timedelta(seconds=40), timedelta(milliseconds=200))  # 200 slides
ODD = WindowSpec(timedelta(milliseconds=100_000), timedelta(milliseconds=30_001))  # panes of 1 ms
RAGGED = WindowSpec(timedelta(milliseconds=1_000), timedelta(milliseconds=96))  # eleven windows or ten
PARAMS = GridParams(2.0, 3, 2)


def _made(n, span_ms, seed):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, 1)) < 0.4, rng.normal(0, 0.1, (n, 2)), rng.uniform(-8, 8, (n, 2)))
    return x, rng.integers(-span_ms, span_ms, n) * 1_000


@pytest.mark.parametrize("longest", [1, 5, 9, 70, 300])
def test_interval_sums(spark, longest):
    rng = np.random.default_rng(longest)
    rows = [(int(k), int(a), int(a + rng.integers(-1, longest)), int(n)) for k, a, n in zip(rng.integers(0, 3, 200), rng.integers(-500, 500, 200), rng.integers(0, 9, 200))]
    want = Counter()
    seen = set()
    for k, a, b, n in rows:
        for w in range(a, b + 1):
            want[w, k] += n
            seen.add((w, k))
    df = spark.createDataFrame(rows, "key long, a long, b long, n long")
    got = sliding.interval_sums(df, ["key"], F.col("a"), F.col("b"), ["n"], longest).collect()
    assert len(got) == len(seen) and {(r.win, r.key): r.n for r in got} == {key: want[key] for key in seen}
    runs = sliding.interval_runs(df, ["key"], F.col("a"), F.col("b"), ["n"], longest).collect()
    assert sum(r.wlast - r.wfirst + 1 for r in runs) == len(seen)
    assert sliding.interval_sums(df.limit(0), ["key"], F.col("a"), F.col("b"), ["n"], longest).count() == 0


@pytest.mark.parametrize("spec,span", [(MANY, 60_000), (ODD, 200_000), (RAGGED, 2_000)])
def test_counts_and_prune(spark, spec, span):
    x, us = _made(150, span, 5)
    points = to_points(spark, x, us)
    count, size = Counter(), Counter()
    at = {}
    for i, t in enumerate(us):
        cell = tuple(int(np.floor(v / PARAMS.side + 1e-8)) for v in x[i])
        for w in windows_of(int(t), spec):
            count[w, cell] += 1
            size[w] += 1
            at[w, i] = cell
    got = {(r.win, tuple(r.cell)): r.n for r in cells.cell_counts(points, PARAMS, spec).collect()}
    assert got == count
    assert {r.win: r.n for r in windows.window_sizes(points, spec).collect()} == size
    pruned = Counter((r.win, r.point_id) for r in cells.dense_prune(points, PARAMS, spec).collect())
    assert pruned == Counter(k for k, cell in at.items() if count[k[0], cell] - 1 < PARAMS.min_pts)


@pytest.mark.parametrize("spec,span,n", [(MANY, 30_000, 120), (ODD, 200_000, 300), (RAGGED, 1_500, 200)])
@pytest.mark.parametrize("mode", ["all", "newest", "expiring"])
def test_detection(spark, spec, span, n, mode):
    x, us = _made(n, span, 6)
    got = found(detect_outliers(to_points(spark, x, us), PARAMS, spec, mode), spec)
    want = outliers(x, us, PARAMS, spec)
    if mode == "newest":
        want = {(w, i) for w, i in want if w == (us[i] - spec.size_us) // spec.slide_us + 1}
    elif mode == "expiring":
        want = {(w, i) for w, i in want if w == us[i] // spec.slide_us}
    assert got == want and want


def test_no_copy_for_each_pane_or_window(spark):
    """Rows that the plans make grow with the slides of a window, not with its panes, and counts
    per window are not made by copies of the counts per pane."""
    points = to_points(spark, *_made(50, 200_000, 7))
    plan = cells.dense_prune(points, PARAMS, ODD)._jdf.queryExecution().optimizedPlan().toString()
    assert f"{ODD.panes_per_window - 1})" not in plan and "+ 3)" in plan  # windows reach over four slides
    plan = cells.cell_counts(points, PARAMS, MANY)._jdf.queryExecution().optimizedPlan().toString()
    assert "lead" in plan
