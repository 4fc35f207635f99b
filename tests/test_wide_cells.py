"""Neighbour cells in more dimensions than offsets can be listed for."""

import numpy as np
import pytest
from brute import to_points

from farpoint import GridParams
from farpoint.functions import grid
from farpoint.operators import cells, neighbors


@pytest.mark.parametrize(("dims", "listed"), [(2, 0), (5, 2_000), (10, 2_000)])
def test_joined_cells_equal_all_pairs(spark, monkeypatch, dims, listed):
    monkeypatch.setattr(grid, "MAX_OFFSETS", listed)
    rng = np.random.default_rng(dims)
    x = np.round(rng.normal(0, 2.0, (150, dims)), 1)
    params = GridParams(4.0, 3, dims, sort_dim=1)
    counts = cells.cell_counts(to_points(spark, x, np.zeros(150, dtype=int)).drop("arrival"), params, None).cache()
    n = {tuple(r.cell): r.n for r in counts.collect()}
    s2 = {(a, b): sum((i - j) ** 2 for i, j in zip(a, b)) for a in n for b in n}
    sums = {tuple(r.cell): (r.n, r.level1_count, r.level2_count) for r in neighbors.neighbor_sums(counts, params, level=2).collect()}
    reach = {c: [sum(n[b] for b in n if s2[c, b] <= k * dims) for k in (1, 9)] for c in n}
    assert sums == {c: (n[c], *reach[c]) for c in n}
    pairs = [(tuple(r.cell), tuple(r.near), r.n) for r in neighbors.candidate_pairs(counts, params).collect()]
    still = [c for c in n if reach[c][0] - 1 < 3 <= reach[c][1] - 1]
    assert sorted(pairs) == sorted((c, b, n[b]) for c in still for b in n if s2[c, b] <= 9 * dims) and pairs
    levels = neighbors.leveled_pairs(counts, params).collect()
    assert len(levels) == sum(v <= 10 * dims for v in s2.values())
    near = {c: sum(n[b] for b in n if s2[c, b] <= dims and abs(c[1] - b[1]) <= 1) for c in n}
    assert {tuple(r.cell): r.level1_count for r in neighbors.capped_sums(counts, params, 1_000).collect()} == near
