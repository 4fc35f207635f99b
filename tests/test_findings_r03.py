"""One small test for each finding of the third round that changed code."""

from datetime import timedelta

import numpy as np
import pyarrow as pa
import pytest
from brute import found, outliers, to_points, within_counts

from farpoint import GridParams, WindowSpec, detect_outliers
from farpoint.functions import grid
from farpoint.operators import cells, neighbors
from farpoint.plans import approximate, exact
from farpoint.streaming.state import TrailingCounts, state_on_disk


def test_sums_per_slab_take_all_cells(spark):
    """no cell of a slab is left out unless a cap is given."""
    x = np.array([[0.1, 0.5 + i] for i in range(150)] + [[0.1, 3.5]] * 4)
    params = GridParams(2 * np.sqrt(2.0), 3, 2)  # a slab of 150 cells of side 1
    counts = cells.cell_counts(to_points(spark, x, np.zeros(len(x), dtype=int)).drop("arrival"), params, None)
    n = {tuple(r.cell): r.n for r in counts.collect()}
    assert len(n) == 150
    got = {tuple(r.cell): (r.n, r.level1_count) for r in neighbors.capped_sums(counts, params).collect()}
    assert got == {c: (n[c], sum(n.get((c[0], c[1] + o), 0) for o in (-1, 0, 1))) for c in n}


class _Rows:
    """A state variable in memory that counts the values written to it."""

    def __init__(self):
        self.kept, self.moved = {}, 0

    def _put(self, key, value):
        self.moved += sum(len(v) if isinstance(v, list) else 1 for v in value)
        self.kept[key] = value

    def getValue(self, key):
        return self.kept.get(key)

    def updateValue(self, key, value):
        self._put(key, value)

    def removeKey(self, key):
        del self.kept[key]

    def exists(self):
        return bool(self.kept)

    def get(self):
        return self.kept.get(0)

    def update(self, value):
        self._put(0, value)

    def clear(self):
        self.kept = {}

    def put(self, rows):
        self._put(0, rows)

    def appendList(self, rows):
        self.moved += len(rows)
        self.kept[0] = [*self.kept.get(0, []), *rows]


class _Handle:
    def __init__(self):
        self.states, self.timers = [], set()

    def _state(self, *args):
        self.states.append(_Rows())
        return self.states[-1]

    getMapState = getListState = getValueState = _state

    def registerTimer(self, at):
        self.timers.add(at)


class _Point:
    def __init__(self, us, point_id):
        self.us, self.point_id = us, point_id


class _Expiry:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at


def test_a_tick_moves_its_own_rows_only():
    """what is written grows with the points, not with points times ticks."""
    n, stay = 2_000, 64_000_001
    counts, handle = TrailingCounts(stay, 1_000_000, False), _Handle()
    counts.init(handle)
    us = [i * 500_000 // 3 for i in range(n)]  # 334 ticks, all rows there from the start
    list(counts.handleInputRows((1,), iter([_Point(t, i) for i, t in enumerate(us)]), None))
    rows = [r for t in sorted(handle.timers) for r in counts.handleExpiredTimer((1,), None, _Expiry(t))]
    assert {r.point_id: r["count"] for r in rows} == {i: sum(u - stay < v <= u for v in us) for i, u in enumerate(us)}
    assert not any(s.exists() for s in handle.states)
    assert sum(s.moved for s in handle.states) < 6 * n


def test_sums_in_many_dimensions_make_no_pairs(spark, monkeypatch):
    """blocks of cells meet without a row for each pair, in lots of any size."""
    monkeypatch.setattr(grid, "MAX_OFFSETS", 0)
    monkeypatch.setattr(neighbors, "_joined_cells", None)
    monkeypatch.setattr(neighbors, "LOT", 30, raising=False)
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 2.0, (200, 5)), 1)
    x[:3, 4] = 1e300, -1e300, 4e9  # far cells share a block with near ones
    params = GridParams(4.0, 3, 5)
    counts = cells.cell_counts(to_points(spark, x, np.zeros(200, dtype=int)).drop("arrival"), params, None).cache()
    n = {tuple(r.cell): r.n for r in counts.collect()}
    for strict in (False, True):
        ring = {5} if strict else set()
        want = {}
        for a in n:
            s2 = {b: sum((i - j) ** 2 for i, j in zip(a, b)) for b in n}
            near = [sum(n[b] for b in n if s2[b] <= limit - strict and (limit == 5 or s2[b] not in ring)) for limit in (5, 45)]
            want[a] = (n[a], *near)
        got = neighbors.neighbor_sums(counts, params, level=2, strict=strict).collect()
        assert {tuple(r.cell): (r.n, r.level1_count, r.level2_count) for r in got} == want


@pytest.mark.parametrize("filtered", [False, True])
def test_few_points_of_many_dimensions_are_copied_to_blocks(spark, monkeypatch, filtered):
    """what its own pane clears is not compared with all points around it."""
    rng = np.random.default_rng(6)
    x = np.where(rng.random((300, 1)) < 0.9, rng.normal(0, 0.3, (300, 10)), rng.uniform(-9, 9, (300, 10)))
    x[5, 2], x[6, 3], x[7] = np.nan, np.inf, 1e200
    x[250:] = x[:50]  # copies
    us = np.sort(rng.integers(0, 100, 300)) * 1_000_000
    params, spec = GridParams(2.0, 3, 10), WindowSpec(timedelta(seconds=40), timedelta(seconds=20))
    asked, bounds = [], exact.neighbor_bounds

    def counting(queries, *args):
        asked.append(queries.count())
        return bounds(queries, *args)

    monkeypatch.setattr(exact, "neighbor_bounds", counting)
    monkeypatch.setattr(approximate, "neighbor_bounds", counting)
    monkeypatch.setattr(exact, "CLEAR_LOT", 20, raising=False)
    detect = approximate.detect_filtered if filtered else detect_outliers
    got = found(detect(to_points(spark, x, us), params, spec), spec)
    assert got == outliers(x, us, params, spec) and got
    assert max(asked) < 200  # a row for each window in the hashed step


def test_a_micro_batch_opens_few_stores(spark):
    """F8, F9: partitions of state are no more than tasks at a time, whatever a shuffle has."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        with state_on_disk(spark):
            assert int(spark.conf.get("spark.sql.shuffle.partitions")) <= spark.sparkContext.defaultParallelism
            assert spark.conf.get("spark.sql.streaming.join.stateFormatVersion") == "3"
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_points_of_a_cell_are_one_row_of_state():
    """rows for the state of the joins are packs; what a pack clears does not go there."""
    from farpoint.functions import packs

    n = 3_000
    cell = [[0, 0] if i % 3 else [i % 7, -1] for i in range(n)]
    rows = pa.table({
        "pane": pa.array([i % 2 for i in range(n)]),
        "cell": pa.array(cell, pa.list_(pa.int64())),
        "arrival": pa.array(range(n), pa.timestamp("us", "UTC")),
        "own": pa.array([{"point_id": i} for i in range(n)]),
        "clears": pa.array([i != 6 for i in range(n)]),
    })
    out = pa.Table.from_batches(packs.packer(["cell"], "own", None)(iter(rows.to_batches(500)))).to_pylist()
    assert sorted(p["point_id"] for r in out for p in r["own"]) == list(range(n)) and len(out) <= 20
    for r in out[:-1]:
        ids = [p["point_id"] for p in r["own"]]
        assert all(cell[i] == r["cell"] and i % 2 == ids[0] % 2 for i in ids) and r["arrival"].microsecond == max(ids)
    assert out[-1]["own"] == [] and out[-1]["arrival"].microsecond == n - 1
    left = pa.Table.from_batches(packs.packer(["cell"], "own", 71)(iter(rows.to_batches(500)))).to_pylist()
    crowded = lambda r: sum(p["point_id"] != 6 for p in r["own"]) > 71
    assert left[:-1] == [r for r in out[:-1] if not crowded(r)] and 1 < len(left) < len(out)


@pytest.mark.parametrize("dims, sort_dim", [(2, 0), (4, 3)])
def test_counts_of_all_neighbours_make_no_pairs(spark, monkeypatch, dims, sort_dim):
    """no query is copied to the blocks around it and no cut box becomes a row."""
    monkeypatch.setattr(exact, "neighbor_bounds", None)
    monkeypatch.setattr(exact, "open_partial_boxes", None)
    monkeypatch.setattr(exact, "NEAR_LOT", 25, raising=False)
    rng = np.random.default_rng(17)
    x = np.round(np.where(rng.random((400, 1)) < 0.6, rng.normal(0, 1.0, (400, dims)), rng.uniform(-40, 40, (400, dims))))
    x[5, 0], x[6, 1], x[7], x[8, 0] = np.nan, np.inf, 1e200, -1e300
    x[300:340] = x[:40]  # copies
    us = np.sort(rng.integers(0, 100, 400)) * 1_000_000
    params, spec = GridParams(5.0, 3, dims, sort_dim), WindowSpec(timedelta(seconds=40), timedelta(seconds=20))
    got = exact.neighbor_counts(to_points(spark, x, us), params, spec).selectExpr("unix_micros(window_start) s", "point_id", "n_neighbors")
    rows = [((r.s // spec.slide_us, r.point_id), r.n_neighbors) for r in got.collect()]
    want = within_counts(x, us, params, spec)
    lonely = {k: 0 for k in want if not np.isfinite(x[k[1]]).all()}
    assert len(rows) == len(want) and dict(rows) == {**want, **lonely}


def test_copies_in_a_box_that_is_cut():
    """a query with no box wholly within its radius, and points that are there more than once."""
    from farpoint.functions import blocks

    asked = pa.table({"point_id": [1], "wmin": [0], "wmax": [0], "plo": [0], "phi": [0], "x0": [0.0]})
    points = pa.table({"pane": [0, 0, 0], "n": [3, 2, 5], "x0": [4.9, 4.2, 5.1]})
    assert blocks.near_counter(5.0, 1)(asked, points).to_pylist() == [{"point_id": 1, "wmin": 0, "wmax": 0, "pane": 0, "n": 5}]
    points = pa.table({"pane": [0, 0], "n": [3, 5], "x0": [5.0, 5.4]})
    assert blocks.near_counter(5.0, 1)(asked, points).column("n").to_pylist() == [3]
