"""Multi-probe hashing against brute force: buckets, probe order, neighbours and outliers."""

import math
from datetime import timedelta

import numpy as np
import pytest
from brute import found, to_points, windows_of, within_counts
from pyspark.sql import functions as F

from farpoint import GridParams, LshParams, WindowSpec
from farpoint.functions import hashing
from farpoint.plans import probing
from farpoint.plans.exact import detect_outliers, nearest_neighbors

SPEC = WindowSpec(timedelta(seconds=40), timedelta(seconds=20))


def _probes(values, probes):
    """Own bucket and the best moves of one or two hashes, tried out one by one."""
    own = [math.floor(v) for v in values]
    moves = sorted((d * d, i, step) for i, v in enumerate(values) for d, step in ((v - math.floor(v), -1), (1.0 - (v - math.floor(v)), 1)))[:probes]
    sets = [(s, i, step, -1, 0) for s, i, step in moves]
    sets += [(a[0] + b[0], a[1], a[2], b[1], b[2]) for x, a in enumerate(moves) for b in moves[x + 1 :] if a[1] != b[1]]
    out = [tuple(own)]
    for _, i, step, j, other in sorted(sets)[:probes]:
        moved = list(own)
        moved[i] += step
        if j >= 0:
            moved[j] += other
        out.append(tuple(moved))
    return out


def _values(x, lsh, params, k):
    width = lsh.width_for(params.radius)
    out = []
    for table in hashing.projections(lsh, params.dims, params.radius):
        row = []
        for a, b in table[:k]:
            dot = 0.0
            for i, (u, v) in enumerate(zip(x, a)):
                dot = u * v if i == 0 and params.dims <= 16 else dot + u * v
            row.append((dot + b) / width)
        out.append(row)
    return out


def _brute(x, us, params, spec, lsh, within):
    """(win, point) -> neighbours found, as sorted (distance, other)."""
    members = {}
    for i, t in enumerate(us):
        if np.isfinite(x[i]).all():
            for w in windows_of(int(t), spec):
                members.setdefault(w, []).append(i)
    out = {}
    for w, ids in members.items():
        k = max(1, math.floor(math.log(len(ids)) + 0.5)) if lsh.hashes is None else lsh.hashes
        vals = {i: _values(x[i], lsh, params, k) for i in ids}
        for i in ids:
            met = set()
            for t in range(lsh.num_tables):
                looked = set(_probes(vals[i][t], lsh.probes))
                met |= {j for j in ids if j != i and tuple(math.floor(v) for v in vals[j][t]) in looked}
            near = []
            for j in met:
                total = 0.0
                for a, b in zip(x[i], x[j]):
                    total += (a - b) * (a - b)
                if within is None or math.sqrt(total) <= within:
                    near.append((math.sqrt(total), j))
            out[w, i] = sorted(near)
    return out


def _cloud(n, dims, seed):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, 1)) < 0.4, rng.normal(0, 0.2, (n, dims)), rng.uniform(-8, 8, (n, dims)))
    x[3] = x[4]
    x[5, 0] = np.nan
    return x, np.sort(rng.integers(0, 60, n)) * 1_000_000


@pytest.mark.parametrize("probes", [0, 1, 3, 9])
def test_probe_order(spark, probes):
    rng = np.random.default_rng(probes)
    rows = [(i, [float(v) for v in rng.uniform(-3, 3, rng.integers(1, 6))]) for i in range(50)]
    df = spark.createDataFrame(rows, "id int, v array<double>")
    got = df.select("id", hashing.probe_sequence(F.col("v"), probes).alias("p")).collect()
    for r in got:
        assert [tuple(p) for p in r.p] == _probes(rows[r.id][1], probes)
        assert len({tuple(p) for p in r.p}) == len(r.p)


@pytest.mark.parametrize("dims,lsh", [(2, LshParams(probes=4)), (3, LshParams(num_tables=2, hashes=3, probes=6)), (20, LshParams(num_tables=2, hashes=2, probes=3))])
@pytest.mark.parametrize("within", [None, 3.0])
def test_neighbours_out_of_buckets(spark, monkeypatch, dims, lsh, within):
    monkeypatch.setattr(probing, "CHUNK_ROWS", 7)  # a hot bucket is many lots on both sides
    monkeypatch.setattr(probing, "LOT_ROWS", 40)
    x, us = _cloud(180, dims, dims)
    params = GridParams(2.0, 4, dims)
    points = to_points(spark, x, us)
    asked = probing._timed(points, SPEC).select(F.explode(F.sequence(F.floor(F.col("us") / 20_000_000) - 1, F.floor(F.col("us") / 20_000_000))).alias("win"), "point_id", "coords")
    got = {}
    for r in probing.bucket_neighbors(asked, points, params, SPEC, lsh, 4, within).collect():
        got.setdefault((r.win, r.point_id), []).append((r.place, r.distance, r.neighbor_id))
    want = {key: near[:4] for key, near in _brute(x, us, params, SPEC, lsh, within).items() if near}
    assert got.keys() == want.keys()
    for key, near in want.items():
        mine = sorted(got[key])
        assert [p for p, *_ in mine] == list(range(1, len(near) + 1))
        if dims <= 16:
            assert [(d, j) for _, d, j in mine] == near
        else:  # sums over an array start from zero
            assert np.allclose([d for _, d, _ in mine], [d for d, _ in near])


@pytest.mark.parametrize("dims", [1, 2, 5])
def test_outliers_by_probing(spark, dims):
    x, us = _cloud(250, dims, 30 + dims)
    params = GridParams(2.0, 4, dims)
    lsh = LshParams(probes=5)
    got = found(probing.detect_probed(to_points(spark, x, us), params, SPEC, lsh=lsh), SPEC)
    truth = {key for key, n in within_counts(x, us, params, SPEC).items() if n < params.min_pts}
    near = _brute(x, us, params, SPEC, lsh, params.radius)
    few = {key for key, found_here in near.items() if len(found_here) < params.min_pts}
    assert truth <= got  # nothing is missed
    # false alarms are points that their buckets leave with too few, and that the grid does not clear
    assert got - truth <= few


def test_probes_take_the_place_of_tables(spark):
    """More probes of one table: fewer false alarms, and more of the nearest neighbours."""
    rng = np.random.default_rng(77)
    x, us = rng.uniform(0, 12, (900, 3)), np.zeros(900, int)
    params = GridParams(2.0, 5, 3)
    points = to_points(spark, x, us)
    truth = {r.point_id for r in detect_outliers(points, params).collect()}
    alarms = []
    for probes in (0, 4, 16):
        got = {r.point_id for r in probing.detect_probed(points, params, lsh=LshParams(probes=probes)).collect()}
        assert truth <= got
        alarms.append(len(got - truth))
    assert alarms[0] > alarms[1] > alarms[2]
    asked = detect_outliers(points, params)
    exact = {(r.point_id, r.neighbor_id) for r in nearest_neighbors(points, asked, params).collect()}
    got = {(r.point_id, r.neighbor_id) for r in probing.nearest_probed(points, asked, params, lsh=LshParams(num_tables=2, probes=16), within=2.0).collect()}
    assert got <= exact and len(got) >= 0.9 * len(exact)


def test_awkward_input(spark):
    params = GridParams(2.0, 2, 2)
    none = to_points(spark, np.zeros((1, 2)), np.zeros(1, int)).limit(0)
    assert probing.detect_probed(none, params, SPEC).count() == 0
    nan = to_points(spark, np.array([[np.nan, 1.0], [np.inf, 1.0]]), np.zeros(2, int))
    assert found(probing.detect_probed(nan, params), None) == {(0, 0), (0, 1)}
    same = to_points(spark, np.ones((5, 2)), np.zeros(5, int))
    assert probing.detect_probed(same, params).count() == 0
    assert probing.detect_probed(same, GridParams(2.0, 0, 2)).count() == 0
    with pytest.raises(ValueError):
        LshParams(probes=-1)


def test_the_bucket_is_the_join_key(spark):
    points = to_points(spark, *_cloud(60, 2, 1))
    asked = points.withColumn("win", F.lit(0).cast("bigint"))
    plan = probing.bucket_neighbors(asked, points, GridParams(2.0, 3, 2), None, LshParams(probes=2))._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
