"""Writing outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_of(coords: str = "coords") -> Column:
    """``[x, y, z]``, as ``value``."""
    text = F.array_join(F.transform(coords, lambda v: v.cast("string")), ", ", "null")
    return F.concat(F.lit("["), text, F.lit("]")).alias("value")


def render_points(points: DataFrame, coords: str = "coords") -> DataFrame:
    """One ``[x, y, z]`` line per point, as ``value``."""
    return points.select(line_of(coords))


def with_coords(outliers: DataFrame, points: DataFrame) -> DataFrame:
    """Outlier rows together with the coordinates of their points."""
    return outliers.join(points.select("point_id", "coords"), "point_id")


def write_outlier_text(outliers: DataFrame, points: DataFrame, path: str) -> None:
    """Overwrite a folder of text files, one outlier per line."""
    render_points(with_coords(outliers, points)).write.mode("overwrite").text(path)


def write_outlier_table(outliers: DataFrame, points: DataFrame, path: str) -> None:
    """Overwrite a parquet table ``window_start, window_end, point_id, coords``."""
    with_coords(outliers, points).select(
        "window_start", "window_end", "point_id", "coords"
    ).write.mode("overwrite").parquet(path)
