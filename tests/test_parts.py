import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from brute import to_points
from pyspark.sql import functions as F

from farpoint import GridParams, LshParams, WindowSpec, arrival_from_order, parse_points, preset, render_points
from farpoint.functions import grid, hashing
from farpoint.operators import accuracy, cells, neighbors, windows
from farpoint.plans import tables
from farpoint.sources.points import points_from_columns, read_point_lines, row_index
from farpoint.sources.sinks import write_outlier_table, write_outlier_text


def test_presets_and_checks():
    tao = preset("TAO")
    assert (tao.radius, tao.min_pts, tao.dims, tao.sort_dim) == (1.9, 50, 3, 1)
    assert tao.side == (1.9 / 2) / math.sqrt(3)
    with pytest.raises(ValueError):
        preset("tao2")
    for bad in ({"radius": 0}, {"min_pts": -1}, {"dims": 0}, {"sort_dim": 3}, {"radius": float("nan")}):
        with pytest.raises(ValueError):
            GridParams(**{"radius": 1.0, "min_pts": 1, "dims": 3, **bad})
    with pytest.raises(ValueError):
        WindowSpec(10, 20)
    with pytest.raises(ValueError):
        LshParams(hashes=0)


def test_parse(spark):
    lines = ["1.0,2.5,-3", "1,abc,3", "4,5", "", "NaN,1,2", " 1 , 2 ,3e2", None]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    rows = parse_points(df, 3, mode="permissive").collect()
    assert [r.bad for r in rows] == [False, True, True, True, False, False, True]
    assert rows[0].coords == [1.0, 2.5, -3.0] and rows[5].coords == [1.0, 2.0, 300.0]
    assert math.isnan(rows[4].coords[0]) and rows[1].coords is None
    assert parse_points(df.limit(1), 3).count() == 1
    with pytest.raises(Exception, match="not a line of 3 numbers"):
        parse_points(df, 3).collect()
    with pytest.raises(ValueError):
        parse_points(df, 3, mode="lenient")


def test_text_in_and_out(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([("1.5,2.0",), ("-1,0",)], "value string").coalesce(1).write.text(source)
    lines = read_point_lines(spark, source)
    ordered = row_index(lines, ["file", "block", "line"])
    points = points_from_columns(parse_points(ordered, 2), "row_index", "coords")
    assert [tuple(r.coords) for r in points.orderBy("point_id").collect()] == [(1.5, 2.0), (-1.0, 0.0)]
    assert sorted(r.value for r in render_points(points).collect()) == ["[-1.0, 0.0]", "[1.5, 2.0]"]
    answers = points.select(F.lit(None).cast("timestamp").alias("window_start"), F.lit(None).cast("timestamp").alias("window_end"), "point_id")
    for _ in range(2):  # overwrites
        write_outlier_text(answers, points, out)
        write_outlier_table(answers, points, out + "-table")
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["[-1.0, 0.0]", "[1.5, 2.0]"]
    assert spark.read.parquet(out + "-table").columns == ["window_start", "window_end", "point_id", "coords"]


def test_arrival_from_order_is_gapless(spark):
    ids = spark.range(0, 3000, 3).repartition(7).withColumn("back", -F.col("id"))
    stamped = arrival_from_order(ids, ["back"], datetime(2024, 1, 1), timedelta(milliseconds=2))
    rows = stamped.orderBy("back").selectExpr("row_index", "unix_millis(arrival) AS ms").collect()
    assert [r.row_index for r in rows] == list(range(1000))
    assert [r.ms - 1704067200000 for r in rows] == [2 * i for i in range(1000)]


def test_cells_keep_sign_and_order(spark):
    params = GridParams(radius=2 * math.sqrt(2), min_pts=1, dims=2)  # side 1
    points = to_points(spark, np.array([[0.5, 10.5], [-10.5, 0.5], [-0.0, 1.0], [-1e-12, -1.0]]), np.zeros(4, dtype=int))
    placed = cells.assign_cells(points, params).withColumn("center", grid.cell_center("cell"))
    rows = placed.withColumn("back", grid.cell_from_center("center")).orderBy("point_id").collect()
    assert [r.cell for r in rows] == [[0, 10], [-11, 0], [0, 1], [0, -1]]
    assert rows[1].center == [-10.5, 0.5]
    assert all(r.back == r.cell for r in rows)
    with pytest.raises(Exception, match="a point needs 3 coordinates"):
        cells.assign_cells(points, GridParams(1.0, 1, 3)).collect()


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_levels_bound_the_distances(dims):
    """With side 1 the radius is 2 sqrt(d): corners of touching cells are within it, and cells
    beyond level 2 are out of it."""
    radius = 2 * math.sqrt(dims)
    assert math.sqrt(dims * 4) <= radius
    for o in grid.offsets_within(dims, 12 * dims):
        s2 = sum(i * i for i in o)
        center = math.sqrt(s2)
        if s2 <= dims:
            assert center + radius / 2 <= radius + 1e-9
        if s2 > 9 * dims:
            assert center - radius / 2 > radius - 1e-9
    assert len(grid.offsets_within(2, 18)) == 61


def test_dense_prune_threshold(spark):
    """A cell of exactly min_pts points: each has one neighbour too few."""
    x = np.zeros((5, 2))
    points = to_points(spark, x, np.zeros(5, dtype=int)).drop("arrival")
    assert cells.dense_prune(points, GridParams(1.0, 5, 2), None).count() == 5
    assert cells.dense_prune(points, GridParams(1.0, 5, 2), None, count_self=True).count() == 0
    assert cells.dense_prune(points, GridParams(1.0, 4, 2), None).count() == 0


def test_latest_counts_ignore_order_of_updates(spark):
    rows = [([1], 3, 30), ([1], 9, 90), ([1], 5, 50), ([2], 1, 10)]
    df = spark.createDataFrame(rows, "cell array<bigint>, version bigint, count bigint")
    got = {tuple(r.cell): (r["count"], r.version) for r in cells.latest_counts(df, ["cell"]).collect()}
    assert got == {(1,): (90, 9), (2,): (10, 1)}


def test_trailing_counts_with_ties_and_long_histories(spark):
    rng = np.random.default_rng(2)
    us = rng.integers(0, 400, 500) * 1_000_000
    x = np.where(rng.random((500, 1)) < 0.7, 0.1, rng.uniform(-3, 3, (500, 1)))
    params, window = GridParams(2.0, 3, 1), timedelta(seconds=37)
    points = to_points(spark, x, us)
    got = {r.point_id: r["count"] for r in cells.running_counts(points, params, window).collect()}
    c = np.floor(x[:, 0] / params.side + 1e-8)
    expected = {
        i: int(((c == c[i]) & (us <= us[i]) & (us >= us[i] - 37_000_000)).sum()) for i in range(500)
    }
    assert got == expected


def test_slab_rank_equals_row_number(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(0, 3, (800, 3)), 1)
    params = GridParams(3.0, 3, 3, sort_dim=1)
    counts = cells.cell_counts(to_points(spark, x, np.zeros(800, dtype=int)).drop("arrival"), params, None)
    full = {(tuple(r.cell), r.place) for r in cells.slab_ranked(counts, params).collect()}
    order = {}
    for r in counts.collect():
        order.setdefault(r.cell[1], []).append((-r.n, r.cell))
    expected = {(tuple(c), i + 1) for slab in order.values() for i, (_, c) in enumerate(sorted(slab))}
    assert full == expected
    capped = {(tuple(r.cell), r.place) for r in cells.slab_ranked(counts, params, top=4).collect()}
    assert capped == {(c, p) for c, p in expected if p <= 4}
    plain = {tuple(r.cell): r.level1_count for r in neighbors.neighbor_sums(counts, params).collect()}
    for r in neighbors.capped_sums(counts, params, 2).collect():
        assert r.level1_count <= plain[tuple(r.cell)]


def test_hash_count_rounds_half_up(spark):
    sizes = [1, 2, 4, 5, 12, 90, 91, 1_000_000]
    df = spark.createDataFrame([(n,) for n in sizes], "n bigint")
    got = [r.k for r in df.select(hashing.hash_count(F.col("n"), LshParams()).alias("k")).collect()]
    assert got == [max(1, math.floor(math.log(n) + 0.5)) for n in sizes]


def test_confusion(spark):
    exact = spark.createDataFrame([(1, 1), (1, 2)], "win bigint, point_id bigint")
    approx = spark.createDataFrame([(1, 2), (1, 3)], "win bigint, point_id bigint")
    sizes = spark.createDataFrame([(1, 10), (2, 4)], "win bigint, n bigint")
    matched = accuracy.label_match(exact, approx, ["win", "point_id"])
    rows = {r.win: r for r in accuracy.confusion(matched, sizes, ["win"]).collect()}
    assert (rows[1].tp, rows[1].fp, rows[1].tn, rows[1].fn) == (1, 1, 7, 1)
    assert rows[1].precision == 0.5 and rows[2].tn == 4 and rows[2].recall is None


def test_spread_join_meets_each_pair_once(spark):
    right = spark.range(1000).selectExpr("id AS r", "IF(id < 700, 0, id % 20) AS key")
    left = spark.range(30).selectExpr("id AS l", "id % 20 AS key")
    counts = right.groupBy("key").agg(F.count("*").alias("n"))
    a, b, keys = tables.spread_hot_keys(left, right, ["key"], counts, ["r"], chunk=50)
    assert b.select("key", "_chunk").distinct().where("key = 0").count() > 5
    expected = left.join(right, "key").select("l", "r")
    spread = a.join(b, keys).select("l", "r")
    assert spread.count() == expected.count() and spread.exceptAll(expected).isEmpty()


def test_windows_match_builtin(spark):
    spec = WindowSpec(timedelta(seconds=50), timedelta(seconds=20))
    points = to_points(spark, np.zeros((40, 1)), (np.arange(40) * 7 - 130) * 1_000_000)
    ours = windows.with_bounds(windows.assign_windows(points, spec), spec).select("window_start", "window_end", "point_id")
    w = F.window("arrival", "50 seconds", "20 seconds")
    builtin = points.select(w.alias("w"), "point_id").select("w.start", "w.end", "point_id")
    assert ours.exceptAll(builtin).isEmpty() and builtin.exceptAll(ours).isEmpty()
