"""Points out of the given tables, and the settings the registered queries use."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farpoint.params import GridParams, WindowSpec
from farpoint.sources.points import points_from_columns, row_index

EVENT_WINDOW = WindowSpec(timedelta(days=4), timedelta(days=2))
EVENT_FINE_WINDOW = WindowSpec(timedelta(days=5), timedelta(days=1))
EVENT_MANY_WINDOW = WindowSpec(timedelta(days=4), timedelta(days=4) / 200)  # a window is 200 slides
EVENT_ODD_WINDOW = WindowSpec(timedelta(days=4), timedelta(days=2, milliseconds=1))  # panes of 1 ms
SHIP_WINDOW = WindowSpec(timedelta(days=60), timedelta(days=30))

EVENTS_3D = GridParams(radius=12.0, min_pts=10, dims=3)
EVENTS_2D = GridParams(radius=4.0, min_pts=5, dims=2)
EVENTS_1D = GridParams(radius=12.0, min_pts=5, dims=1)
SHIPPED = GridParams(radius=4.0, min_pts=3, dims=3, sort_dim=1)
SHIPPED_5D = GridParams(radius=8.0, min_pts=3, dims=5, sort_dim=1)
SHIPPED_NEAR_5D = GridParams(radius=5.0, min_pts=3, dims=5, sort_dim=1)
SHIPPED_10D = GridParams(radius=22.0, min_pts=3, dims=10, sort_dim=1)
EMBEDDED = GridParams(radius=1.2, min_pts=5, dims=64)
STREAM_DELAY = timedelta(hours=1)
STREAM_BATCHES = 5  # micro-batches that a table is replayed in
STREAM_FILES = 2  # files of each


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_coords(dims: int) -> list[str | Column]:
    clicks = F.get_json_object("props", "$.k").cast("double")
    clock = F.hour("ts") + F.minute("ts") / F.lit(60.0)
    return ["value", clicks, clock][:dims]


def events(spark: SparkSession, sf_dir: str, dims: int) -> DataFrame:
    return points_from_columns(table(spark, sf_dir, "events"), "event_id", event_coords(dims), "ts")


def scaled_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in units in which the radius of the preset ``TAO`` tells them apart."""
    value, clicks, clock = event_coords(3)
    coords = [F.col(value) / F.lit(30.0), clicks / F.lit(30.0), clock / F.lit(6.0)]
    return points_from_columns(table(spark, sf_dir, "events"), "event_id", coords, "ts")


def shipped(spark: SparkSession, sf_dir: str, dims: int = 3) -> DataFrame:
    """Order lines, numbered along all their columns: no smaller key is unique."""
    lines = table(spark, sf_dir, "lineitem")
    numbered = row_index(lines, lines.columns)
    coords = ["l_quantity", F.col("l_extendedprice") / 1000, F.col("l_discount") * 100]
    coords += [F.col("l_tax") * 100, F.col("l_linenumber").cast("double")]
    coords += [F.pmod(c, F.lit(50)).cast("double") for c in ("l_orderkey", "l_partkey", "l_suppkey")]
    coords += [F.dayofyear("l_shipdate") / F.lit(10.0), F.col("l_quantity") * F.col("l_discount")]
    return points_from_columns(numbered, "row_index", coords[:dims], "l_shipdate")


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points_from_columns(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
