"""Inputs that once gave wrong answers without an error."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from farpoint import GridParams, detect_outliers
from farpoint.functions import hashing
from farpoint.params import LshParams

T0 = dt.datetime(2024, 1, 1)


def _points(spark, coords):
    rows = [(i, T0, c) for i, c in enumerate(coords)]
    return spark.createDataFrame(rows, "point_id long, arrival timestamp, coords array<double>")


@pytest.mark.parametrize("scale", [1e20, 1e300, -1e20])
@pytest.mark.parametrize("dims", [1, 2, 4, 9])
def test_huge_values_do_not_clear_each_other(spark, scale, dims):
    coords = [[(i + 1) * scale] + [0.0] * (dims - 1) for i in range(4)] + [[scale] + [0.0] * (dims - 1)]
    found = detect_outliers(_points(spark, coords), GridParams(radius=1.0, min_pts=1, dims=dims))
    assert {r.point_id for r in found.collect()} == {1, 2, 3}  # 0 and 4 are the same place


@pytest.mark.parametrize("coords", [[[0.0, 0.0], [0.0, 0.0, 100.0]], [[0.0, 0.0], [0.0]]])
def test_wrong_number_of_coordinates_is_an_error(spark, coords):
    with pytest.raises(Exception, match="needs 2 coordinates"):
        detect_outliers(_points(spark, coords), GridParams(radius=1.0, min_pts=1, dims=2)).collect()


def test_hash_count_has_no_cap(spark):
    k = spark.range(1).select(hashing.hash_count(F.lit(2**62), LshParams())).first()[0]
    assert k == 43 <= len(hashing.projections(LshParams(), 2, 1.0)[0])
    assert len(hashing.projections(LshParams(hashes=50), 2, 1.0)[0]) == 50
