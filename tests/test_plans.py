"""Shape of the plans: what is read, and that nothing is joined without a key."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from farpoint import GridParams, LshParams, WindowSpec, points_from_columns
from farpoint.operators import cells, neighbors
from farpoint.params import QueryMode
from farpoint.plans import approximate, exact

SPEC = WindowSpec(timedelta(seconds=50), timedelta(seconds=10))


@pytest.fixture(scope="module")
def points(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("wide") / "rows")
    coords = [F.col("id").cast("double").alias(c) for c in "abcdefghijkl"]
    rows = spark.range(100).select("id", F.timestamp_seconds("id").alias("ts"), *coords, F.lit("x").alias("unused"))
    rows.write.parquet(path)
    return spark.read.parquet(path)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def check(text):
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "unused" not in text
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


@pytest.mark.parametrize("dims", [2, 3, 6])
def test_exact_plan(spark, points, dims):
    params = GridParams(3.0, 5, dims)
    lay = exact.Layout(params, SPEC)
    pts = points_from_columns(points, "id", list("abcdefghijkl"[:dims]), "ts")
    flat = exact._flat(exact._canonical(pts, SPEC, False), lay)
    boxes = exact.fold_boxes(flat, lay)
    folded = plan(boxes)
    check(folded)
    assert folded.count("HashAggregate") == 2 and folded.count("Exchange") == 1  # partial sums first
    bounds = exact.neighbor_bounds(exact._suspects(flat, boxes, lay, QueryMode.ALL), boxes, flat, lay)
    text = plan(bounds)
    check(text)
    assert "MapInArrow" not in text
    # columns of no use to the job never leave the scan
    assert all(f",{c}:double" not in text for c in "abcdefghijkl"[dims:])


def test_operator_plans(spark, points):
    params = GridParams(3.0, 5, 2)
    pts = points_from_columns(points, "id", ["a", "b"], "ts")
    counts = cells.cell_counts(pts, params, SPEC)
    for df in (
        counts,
        cells.dense_prune(pts, params, SPEC),
        cells.running_counts(pts, params, timedelta(seconds=50)),
        cells.slab_ranked(counts, params),
        neighbors.slab_pairs(counts, params),
        neighbors.candidate_pairs(counts, params),
        neighbors.definite_outliers(pts, params, SPEC),
        approximate.detect_lsh(pts, params, SPEC, lsh=LshParams(verify=False)),
    ):
        check(plan(df))
