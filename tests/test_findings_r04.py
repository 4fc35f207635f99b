"""One small test for each finding of the fourth round that changed code."""

from datetime import timedelta

import numpy as np
import pytest
from brute import found, outliers, to_points, windows_of, within_counts

from farpoint import GridParams, WindowSpec, detect_outliers
from farpoint.functions import grid
from farpoint.operators import neighbors
from farpoint.plans import exact

SPEC = WindowSpec(timedelta(seconds=40), timedelta(seconds=20))


@pytest.mark.parametrize("listed, spec", [(True, SPEC), (False, SPEC), (True, None)])
def test_dense_places_are_not_counted_cell_by_cell(spark, monkeypatch, listed, spec):
    """definite_outliers in many dimensions counts cells only where tiles do not settle them."""
    from farpoint.plans import tables

    rng = np.random.default_rng(41)
    n = 600
    x = np.where(rng.random((n, 1)) < 0.8, rng.uniform(0, 5, (n, 5)), rng.uniform(100, 130, (n, 5)))
    x[5, 2], x[6], x[7, 0] = 1e200, -1e300, np.inf
    x[8:20] = x[1]  # copies
    us = np.sort(rng.integers(-50, 100, n)) * 1_000_000
    params = GridParams(6.0, 3, 5, sort_dim=1)
    seen, sums = [], neighbors.neighbor_sums

    def counting(counts, *args, **more):
        seen.append(counts.count())
        return sums(counts, *args, **more)

    monkeypatch.setattr(neighbors, "neighbor_sums", counting)
    monkeypatch.setattr(neighbors, "LOT", 40)
    if not listed:
        monkeypatch.setattr(tables, "SMALL_ROWS", 3)
    rows = neighbors.definite_outliers(to_points(spark, x, us), params, spec).collect()

    last = grid.LAST_INDEX
    cells = np.floor(np.clip(x / params.side + grid.CELL_SHIFT, -last, last))
    want, per_window = set(), {}
    for i, t in enumerate(us):
        for w in windows_of(int(t), spec):
            per_window.setdefault(w, []).append(i)
    for w, ids in per_window.items():
        c = cells[ids]
        s2 = sum((c[:, None, j] - c[None, :, j]) ** 2 for j in range(5))
        want |= {(w, ids[k]) for k in np.flatnonzero((s2 <= 45).sum(axis=1) < 4)}
    got = [(r.win, r.point_id) for r in rows]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    every = len({(w, tuple(cells[i])) for w, ids in per_window.items() for i in ids})
    if listed:
        assert seen[0] < every / 2


def test_a_dense_lot_is_counted_without_a_double_for_each_pair(monkeypatch):
    """range_count compares in single floats, and squares in doubles only what they cannot tell apart."""
    import pyarrow as pa

    from farpoint.functions import blocks

    rng = np.random.default_rng(5)
    params = GridParams(5.0, 3, 3)
    x = np.concatenate([rng.integers(0, 12, (900, 3)).astype(float), 1e6 + rng.normal(0, 3, (60, 3)), [[1e200] * 3, [-1e300, 0, 0], [4e17, 0, 0]]])
    panes, n = rng.integers(0, 3, len(x)), rng.integers(1, 3, len(x))
    columns = {f"x{j}": x[:, j] for j in range(3)}
    ids = np.arange(len(x))
    asked = pa.table({"point_id": ids, "wmin": 0 * ids, "wmax": 0 * ids, "plo": 0 * ids, "phi": 0 * ids + 2, **columns})
    roots, plain = [], np.ones(len(x), int)
    for weight in (plain, n):
        with np.errstate(over="ignore"):
            near = np.sqrt(sum((x[:, None, j] - x[None, :, j]) ** 2 for j in range(3))) <= params.radius
        want = {(i, p): int((near[i] * weight)[panes == p].sum()) for i in ids for p in range(3)}
        points = pa.table({"pane": panes, "n": weight, **columns})
        few = blocks._few_true
        monkeypatch.setattr(blocks, "_few_true", lambda mask: roots.append((mask.size, len(few(mask)))) or few(mask))
        rows = blocks.near_counter(params.radius, 3)(asked, points).to_pylist()
        assert {(r["point_id"], r["pane"]): r["n"] for r in rows} == {k: v for k, v in want.items() if v}
        monkeypatch.setattr(blocks, "_few_true", few)
    assert 0 < sum(few for _, few in roots) < sum(all_ for all_, _ in roots) / 10


def test_queries_of_one_place_meet_in_one_lot(spark, monkeypatch):
    """a hot block is dealt by places, so that its lots are as dense as it is; one hot place by rows."""
    monkeypatch.setattr(exact, "NEAR_LOT", 20)
    dealt, lots = [], exact.dealt_in_lots

    def noting(left, right, keys, row, lot, name):
        dealt.append(name)
        return lots(left, right, keys, row, lot, name)

    monkeypatch.setattr(exact, "dealt_in_lots", noting)
    rng = np.random.default_rng(6)
    x = np.round(np.concatenate([rng.normal(0, 6.0, (200, 2)), np.full((80, 2), 3.0)]), 1)
    us = np.sort(rng.integers(0, 100, len(x))) * 1_000_000
    params = GridParams(4.0, 3, 2)
    got = exact.neighbor_counts(to_points(spark, x, us), params, SPEC).selectExpr("unix_micros(window_start) s", "point_id", "n_neighbors")
    rows = [((r.s // SPEC.slide_us, r.point_id), r.n_neighbors) for r in got.collect()]
    assert len(rows) == len(dict(rows)) and dict(rows) == within_counts(x, us, params, SPEC)
    assert dealt == ["_place", "_chunk", "_asked_place", "_lot"]


def test_what_lots_clear_is_not_shuffled_again(spark, monkeypatch):
    """in many dimensions only points that lots leave, and what is around them, are folded and counted by cells."""
    rng = np.random.default_rng(63)
    x = np.where(np.arange(400)[:, None] < 360, rng.normal(0, 0.3, (400, 10)), rng.uniform(30, 60, (400, 10)))
    x[5, 2], x[6, 3], x[7] = np.nan, np.inf, 1e200
    x[380:] = x[:20]  # copies
    us = np.sort(rng.integers(0, 100, 400)) * 1_000_000
    params = GridParams(2.5, 3, 10)
    folded, fold = [], exact.fold_boxes

    def counting(flat, *args):
        folded.append(flat.count())
        return fold(flat, *args)

    monkeypatch.setattr(exact, "fold_boxes", counting)
    monkeypatch.setattr(exact, "CLEAR_LOT", 60)
    got = found(detect_outliers(to_points(spark, x, us), params, SPEC), SPEC)
    assert got == outliers(x, us, params, SPEC) and len(got) > 20
    assert folded[0] < 200
