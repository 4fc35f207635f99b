"""Sliding windows over points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farpoint.functions import timing
from farpoint.operators.sliding import window_sums
from farpoint.params import WindowSpec


def assign_windows(points: DataFrame, spec: WindowSpec | None) -> DataFrame:
    """One row per point and window, with the window number ``win``."""
    us = timing.arrival_us(points, "arrival") if spec else F.lit(0).cast("bigint")
    wins = F.sequence(timing.first_window(F.col("us"), spec), timing.last_window(F.col("us"), spec))
    return points.withColumn("us", us).withColumn("win", F.explode(wins))


def with_bounds(df: DataFrame, spec: WindowSpec | None) -> DataFrame:
    """Replace the window number by its start and end."""
    rest = [c for c in df.columns if c != "win"]
    return df.select(*timing.window_bounds(F.col("win"), spec), *rest)


def window_sizes(points: DataFrame, spec: WindowSpec | None) -> DataFrame:
    """Number of points per window, from counts per pane."""
    us = timing.arrival_us(points, "arrival") if spec else F.lit(0).cast("bigint")
    panes = points.select(timing.pane_of(us, spec).alias("pane")).groupBy("pane").agg(F.count("*").alias("n"))
    return window_sums(panes, [], spec)
