"""Windowed distance-based outlier detection as PySpark DataFrame jobs."""

from farpoint.params import PRESETS, GridParams, LshParams, QueryMode, WindowSpec, preset
from farpoint.plans.approximate import detect_lsh, detect_lsh_local, detect_lsh_shared
from farpoint.plans.exact import detect_outliers, neighbor_counts
from farpoint.sources.points import (
    arrival_from_order,
    parse_points,
    points_from_columns,
    read_point_lines,
)
from farpoint.sources.sinks import render_points, write_outlier_table, write_outlier_text
from farpoint.streaming.outliers import stream_outliers

__all__ = [
    "PRESETS",
    "GridParams",
    "LshParams",
    "QueryMode",
    "WindowSpec",
    "arrival_from_order",
    "detect_lsh",
    "detect_lsh_local",
    "detect_lsh_shared",
    "detect_outliers",
    "neighbor_counts",
    "parse_points",
    "points_from_columns",
    "preset",
    "read_point_lines",
    "render_points",
    "stream_outliers",
    "write_outlier_table",
    "write_outlier_text",
]
