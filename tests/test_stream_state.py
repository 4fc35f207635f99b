"""Keyed state with timers and the joined streaming plan, against the batch operators."""

from datetime import timedelta

import numpy as np
import pytest
from brute import found, outliers, to_points
from pyspark.sql import functions as F
from test_stream import PARAMS, SCHEMA, SPEC, _write_in_order

from farpoint import GridParams
from farpoint.operators import cells
from farpoint.streaming.joined import stream_outliers_joined
from farpoint.streaming.state import TICKS, state_on_disk, stream_cell_updates, stream_running_counts, tick_us

STAY = timedelta(seconds=40)
DELAY = timedelta(seconds=5)
LINE = GridParams(2.0, 3, 1)


def _made(n=400, seed=8):
    """Points in a hot cell and elsewhere, some instants shared, a little out of order."""
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, 1)) < 0.35, 0.5, rng.uniform(-8, 8, (n, 1)))
    us = np.sort(rng.integers(0, 200_000, n)) * 1_000
    us[1::17] = us[0:-1:17][: len(us[1::17])]
    for i in range(0, n - 1, 9):
        us[[i, i + 1]] = us[[i + 1, i]]
    return x, us


def _run(spark, stream, tmp_path, name):
    with state_on_disk(spark):
        writer = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-cp"))
        query = writer.trigger(availableNow=True).format("parquet").start(str(tmp_path / name))
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(str(tmp_path / name)), query.recentProgress


def _settled(column, end_us):
    """Instants in ticks that the watermark has passed."""
    tick = tick_us(STAY)
    return F.ceil(F.col(column) / tick) * tick <= end_us


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    x, us = _made()
    folder = tmp_path_factory.mktemp("rows")
    return x, us, _write_in_order(spark, folder, x, us, np.array_split(np.arange(len(x)), 5))


def test_running_counts_of_a_stream(spark, source, tmp_path):
    x, us, path = source
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    got, progress = _run(spark, stream_running_counts(rows, LINE, STAY, DELAY), tmp_path, "counts")
    assert sum(p["numInputRows"] > 0 for p in progress) >= 5
    points = to_points(spark, x, us)
    settled = points.withColumn("us", F.unix_micros("arrival")).where(_settled("us", int(us.max()) - 5_000_000))
    want = cells.running_counts(points, LINE, STAY).join(settled.select("point_id"), "point_id").select(*got.columns)
    assert got.count() == want.count() > 300
    assert got.exceptAll(want).count() == 0


def test_updates_of_a_stream_and_what_is_left_of_its_state(spark, source, tmp_path):
    x, us, path = source
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    got, progress = _run(spark, stream_cell_updates(rows, LINE, STAY, DELAY), tmp_path, "updates")
    want = cells.cell_updates(to_points(spark, x, us), LINE, STAY).where(_settled("at", int(us.max()) - 5_000_000))
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0
    assert got.where("count = 0").count() > 0  # cells that time has emptied
    kept = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in progress]
    # 200 s of points came, and the state has those of the last 40 s, the delay and a tick
    assert kept[-1] < 0.5 * len(x)


def test_all_state_goes_when_time_has_passed(spark, source, tmp_path):
    x, us, _ = source
    x, us = np.vstack([x, [[99.0]]]), np.append(us, us.max() + 100_000_000)
    path = _write_in_order(spark, tmp_path, x, us, [*np.array_split(np.arange(len(x) - 1), 2), [len(x) - 1]])
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    got, progress = _run(spark, stream_cell_updates(rows, LINE, STAY, DELAY), tmp_path, "updates")
    last = got.groupBy("cell").agg(F.max_by("count", "at").alias("n"))
    assert last.where("n <> 0").count() == 0
    assert sum(s["numRowsTotal"] for s in progress[-1]["stateOperators"]) <= 4  # the last point and its timer
    want = cells.cell_updates(to_points(spark, x[:-1], us[:-1]), LINE, STAY)
    assert got.count() == want.count() and got.exceptAll(want.select(*got.columns)).count() == 0


def test_a_stopped_query_goes_on_where_it_was(spark, source, tmp_path):
    x, us, _ = source
    folder = tmp_path / "rows"
    folder.mkdir()
    halves = np.array_split(np.arange(len(x)), 2)
    _write_some(spark, folder, x, us, halves[0], 0)
    rows = lambda: spark.readStream.schema(SCHEMA).parquet(str(folder / "in"))
    _run(spark, stream_running_counts(rows(), LINE, STAY, DELAY), tmp_path, "counts")
    _write_some(spark, folder, x, us, halves[1], 1)
    got, _ = _run(spark, stream_running_counts(rows(), LINE, STAY, DELAY), tmp_path, "counts")
    want = cells.running_counts(to_points(spark, x, us), LINE, STAY).select(*got.columns)
    assert got.count() == got.distinct().count() > 300
    assert got.exceptAll(want).count() == 0


def _write_some(spark, folder, x, us, ids, number):
    points = to_points(spark, x, us)
    points.where(points.point_id.isin([int(i) for i in ids])).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def test_joined_plan_equals_nested_loop(spark, tmp_path):
    rng = np.random.default_rng(9)
    x = np.where(rng.random((500, 1)) < 0.4, rng.normal(0, 0.1, (500, 2)), rng.uniform(-8, 8, (500, 2)))
    us = np.sort(rng.integers(0, 200, 500)) * 1_000_000
    x[7, 0] = np.nan
    path = _write_in_order(spark, tmp_path, x, us, np.array_split(np.arange(500), 5))
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    got, progress = _run(spark, stream_outliers_joined(rows, PARAMS, SPEC, DELAY), tmp_path, "found")
    assert sum(p["numInputRows"] > 0 for p in progress) >= 5
    limit = us.max() - 5_000_000
    want = {(w, i) for w, i in outliers(x, us, PARAMS, SPEC) if w * SPEC.slide_us + SPEC.size_us <= limit}
    assert found(got, SPEC) == want and len(want) > 50
    state = [sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in progress]
    assert state[-1] < max(state)  # closed windows leave the state


def test_a_crowded_cell_makes_no_pairs(spark, tmp_path):
    """9 of 10 points in one cell: the pair join sees each of them on one side only."""
    rng = np.random.default_rng(10)
    x = np.where(rng.random((600, 1)) < 0.9, 0.1, rng.uniform(-8, 8, (600, 2)))
    us = np.sort(rng.integers(0, 100, 600)) * 1_000_000
    path = _write_in_order(spark, tmp_path, x, us, np.array_split(np.arange(600), 2))
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    got, progress = _run(spark, stream_outliers_joined(rows, PARAMS, SPEC, DELAY), tmp_path, "found")
    limit = us.max() - 5_000_000
    assert found(got, SPEC) == {(w, i) for w, i in outliers(x, us, PARAMS, SPEC) if w * SPEC.slide_us + SPEC.size_us <= limit}
    # rows that the last aggregation takes up: outlying points and their near ones, not 540 ** 2
    assert max(s["numRowsUpdated"] for p in progress for s in p["stateOperators"]) < 20 * 600


def test_ticks():
    assert tick_us(timedelta(milliseconds=1)) == 1000
    assert tick_us(STAY) * TICKS == 40_000_000
