import os
from datetime import timedelta

import numpy as np
from brute import found, outliers, to_points

from farpoint import GridParams, WindowSpec, stream_outliers
from farpoint.streaming.outliers import read_stream_outliers, read_stream_progress, stream_cell_counts

SPEC = WindowSpec(timedelta(seconds=40), timedelta(seconds=20))
PARAMS = GridParams(2.0, 3, 2)
SCHEMA = "point_id bigint, arrival timestamp, coords array<double>"


def _write_in_order(spark, folder, x, us, pieces):
    """One file per piece, with rising modification times."""
    points = to_points(spark, x, us)
    for i, ids in enumerate(pieces):
        part = str(folder / f"part-{i}")
        points.where(points.point_id.isin([int(j) for j in ids])).coalesce(1).write.parquet(part)
        name = next(f for f in os.listdir(part) if f.endswith(".parquet"))
        target = folder / "in" / f"{i}.parquet"
        target.parent.mkdir(exist_ok=True)
        target.write_bytes((folder / f"part-{i}" / name).read_bytes())
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(folder / "in")


def test_stream_equals_batch_on_closed_windows(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.uniform(-8, 8, (400, 2))
    us = np.sort(rng.integers(0, 200, 400)) * 1_000_000
    # the last point comes far too late: all its windows have closed long before
    x, us = np.vstack([x, [[0.0, 0.0]]]), np.append(us, 1_000_000)
    source = _write_in_order(spark, tmp_path, x, us, [*np.array_split(np.arange(400), 3), [400]])
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    root = str(tmp_path / "state")
    for _ in range(2):  # a second start finds nothing new
        query = stream_outliers(rows, PARAMS, SPEC, root, delay=timedelta(seconds=5), once=True)
        query.awaitTermination()
    progress = {r.batch: r for r in read_stream_progress(spark, root).collect()}
    assert len(progress) == 4 and progress[3].n_late == 1
    limit = us.max() - 5_000_000
    expected = {(w, i) for w, i in outliers(x[:400], us[:400], PARAMS, SPEC) if w * SPEC.slide_us + SPEC.size_us <= limit}
    assert found(read_stream_outliers(spark, root), SPEC) == expected
    assert sum(r.n_outliers for r in progress.values()) == len(expected)


def test_stream_counts(spark, tmp_path):
    rng = np.random.default_rng(7)
    x, us = rng.uniform(-3, 3, (200, 2)), np.sort(rng.integers(0, 100, 200)) * 1_000_000
    source = _write_in_order(spark, tmp_path, x, us, np.array_split(np.arange(200), 2))
    rows = spark.readStream.schema(SCHEMA).parquet(source)
    counts = stream_cell_counts(rows, PARAMS, SPEC, timedelta(seconds=1))
    query = (
        counts.writeStream.outputMode("append").format("memory").queryName("counted")
        .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {(r.s, tuple(r.cell)): r.n for r in spark.sql("SELECT unix_micros(window_start) s, cell, n FROM counted").collect()}
    expected = {}
    for p, t in zip(x, us):
        cell = tuple(int(v) for v in np.floor(p / PARAMS.side + 1e-8))
        for w in range((t - SPEC.size_us) // SPEC.slide_us + 1, t // SPEC.slide_us + 1):
            if w * SPEC.slide_us + SPEC.size_us <= us.max() - 1_000_000:
                key = (int(w * SPEC.slide_us), cell)
                expected[key] = expected.get(key, 0) + 1
    assert got == expected


def test_points_within_the_delay_count_whatever_came_first(spark, tmp_path):
    x = np.zeros((4, 2)) + np.arange(4)[:, None] * 10
    us = np.array([200, 170, 110, 900]) * 1_000_000
    source = _write_in_order(spark, tmp_path, x, us, [[0], [1], [2], [3]])
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    root = str(tmp_path / "state")
    stream_outliers(rows, PARAMS, SPEC, root, delay=timedelta(seconds=300), once=True).awaitTermination()
    assert sum(r.n_late for r in read_stream_progress(spark, root).collect()) == 0
    per_point = {}
    for r in read_stream_outliers(spark, root).collect():
        per_point[r.point_id] = per_point.get(r.point_id, 0) + 1
    assert per_point == {0: 2, 1: 2, 2: 2}


def test_files_of_a_stream_expire(spark, tmp_path):
    """Twenty micro-batches: the panes and step tables that stay do not grow with them."""
    rng = np.random.default_rng(12)
    us = np.arange(400) * 1_000_000
    x = rng.uniform(-8, 8, (400, 2))
    source = _write_in_order(spark, tmp_path, x, us, np.array_split(np.arange(400), 20))
    rows = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    root = tmp_path / "state"
    steps = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(steps))
    stream_outliers(rows, PARAMS, SPEC, str(root), delay=timedelta(seconds=5), once=True).awaitTermination()
    assert len(list(read_stream_progress(spark, str(root)).collect())) == 20
    expected = {(w, i) for w, i in outliers(x, us, PARAMS, SPEC) if w * SPEC.slide_us + SPEC.size_us <= us.max() - 5_000_000}
    assert found(read_stream_outliers(spark, str(root)), SPEC) == expected
    # open windows reach 40 s and the delay back, panes are 20 s: of 20 panes these are left
    assert len([n for n in os.listdir(root / "points") if n.startswith("pane=")]) <= 4
    assert set(os.listdir(steps)) == before
