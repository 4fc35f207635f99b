"""Grid-cell summaries: assignment, counts per window, trailing counts and their changes."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farpoint.functions import grid, timing
from farpoint.operators.prefix import running_sum
from farpoint.operators.sliding import window_sums
from farpoint.params import GridParams, WindowSpec
from farpoint.plans.tables import largest_keys, shuffled, spread_hot_keys

SEGMENTS_PER_WINDOW = 64  # time segments of a trailing count
SEGMENT_CELLS = 64  # cells per segment of a slab


def assign_cells(points: DataFrame, params: GridParams) -> DataFrame:
    """Add ``cell``; a wrong number of coordinates stops the job."""
    right_size = F.size("coords") == params.dims
    stop = F.raise_error(F.lit(f"a point needs {params.dims} coordinates")).cast("array<double>")
    checked = F.when(right_size, F.col("coords")).otherwise(stop)
    return points.withColumn("cell", grid.cell_of(checked, params.side))


def pane_counts(points: DataFrame, params: GridParams, spec: WindowSpec | None) -> DataFrame:
    """Points per pane and cell."""
    us = timing.arrival_us(points, "arrival") if spec else F.lit(0).cast("bigint")
    return (
        assign_cells(points, params)
        .groupBy(timing.pane_of(us, spec).alias("pane"), "cell")
        .agg(F.count("*").alias("n"))
    )


def cell_counts(points: DataFrame, params: GridParams, spec: WindowSpec | None) -> DataFrame:
    """Points per window and cell, summed from the panes the windows share."""
    return window_sums(pane_counts(points, params, spec), ["cell"], spec)


def points_of_cells(
    points: DataFrame,
    cells: DataFrame,
    params: GridParams,
    spec: WindowSpec | None,
    crowded_from: int | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The points of the given ``(win, cell)`` rows, as ``(win, point_id, cell)`` and the
    columns of either side named in ``keep``.

    With ``crowded_from``, cells that hold so many points in one pane are known not to be
    asked for, and the largest of them are dropped by a short broadcast list before the
    shuffle. Without it, crowded cells are dealt to several tasks.
    """
    us = timing.arrival_us(points, "arrival") if spec else F.lit(0).cast("bigint")
    own = [c for c in keep if c in points.columns]
    theirs = [c for c in keep if c not in points.columns]
    placed = assign_cells(points, params).withColumn("_us", us)
    if crowded_from is not None:
        pane = timing.pane_of(F.col("_us"), spec).alias("pane")
        crowded = largest_keys(pane_counts(points, params, spec), ["pane", "cell"], F.col("n") >= crowded_from).drop("n")
        placed = placed.select("*", pane).join(F.broadcast(crowded), ["pane", "cell"], "left_anti")
    # met by slide, not by pane: a window of many short panes is few slides
    placed = placed.select("point_id", "cell", timing.unit_of(F.col("_us"), spec).alias("unit"), "_us", *own)
    asked = cells.select("win", "cell", *theirs, F.explode(timing.units_of_window(F.col("win"), spec)).alias("unit"))
    key = ["unit", "cell"]
    if crowded_from is None:
        sizes = placed.groupBy(*key).agg(F.count("*").alias("n"))
        asked, placed, key = spread_hot_keys(asked, placed, key, sizes, ["point_id"])
    met = placed.join(shuffled(asked), key).where(timing.holds(F.col("win"), F.col("_us"), spec))
    return met.select("win", "point_id", "cell", *keep)


def dense_prune(points: DataFrame, params: GridParams, spec: WindowSpec | None, count_self: bool = False) -> DataFrame:
    """Points per window whose own cell does not clear them.

    A cell clears its points when it holds ``min_pts`` others; with ``count_self`` the point
    itself counts towards the threshold.
    """
    enough = params.min_pts if count_self else params.min_pts + 1
    sparse = cell_counts(points, params, spec).where(F.col("n") < enough)
    return points_of_cells(points, sparse, params, spec, enough).select("win", "point_id")


def _changes(points: DataFrame, params: GridParams, window: timedelta) -> DataFrame:
    """Net change of each cell's trailing count per instant; a point leaves just after
    ``arrival + window``."""
    stay = round(window.total_seconds() * 1_000_000) + 1
    placed = assign_cells(points, params).select("cell", timing.arrival_us(points, "arrival").alias("us"))
    arrivals = placed.groupBy("cell", "us").agg(F.count("*").alias("came"))
    moves = F.array(
        F.struct(F.col("us").alias("at"), F.col("came").alias("delta"), F.col("came").alias("came")),
        F.struct(
            (F.col("us") + F.lit(stay)).alias("at"),
            (-F.col("came")).alias("delta"),
            F.lit(0).cast("bigint").alias("came"),
        ),
    )
    return (
        arrivals.select("cell", F.inline(moves))
        .groupBy("cell", "at")
        .agg(F.sum("delta").alias("delta"), F.sum("came").alias("came"))
    )


def trailing_counts(points: DataFrame, params: GridParams, window: timedelta) -> DataFrame:
    """Count of each cell after every instant at which it changes or is hit:
    ``(cell, at, delta, came, count)`` with ``came`` new points at that instant."""
    width = max(1, round(window.total_seconds() * 1_000_000) // SEGMENTS_PER_WINDOW)
    return running_sum(
        _changes(points, params, window),
        ["cell"],
        [timing.floor_div(F.col("at"), width)],
        [F.col("at")],
        F.col("delta"),
        "count",
    )


def running_counts(points: DataFrame, params: GridParams, window: timedelta) -> DataFrame:
    """Each point with the number of points of its cell in the trailing window, itself and
    points of the same instant included: ``(point_id, cell, count)``."""
    counts = trailing_counts(points, params, window).where(F.col("came") > 0)
    placed = assign_cells(points, params).select(
        "point_id", "cell", timing.arrival_us(points, "arrival").alias("at")
    )
    key = ["cell", "at"]
    sizes = placed.groupBy(*key).agg(F.count("*").alias("n"))
    counts, placed, key = spread_hot_keys(counts.select("cell", "at", "count"), placed, key, sizes, ["point_id"])
    return placed.join(shuffled(counts), key).select("point_id", "cell", "count")


def cell_updates(points: DataFrame, params: GridParams, window: timedelta) -> DataFrame:
    """Change log of the trailing counts: ``(cell, at, count)`` where the count changes."""
    return trailing_counts(points, params, window).where(F.col("delta") != 0).select("cell", "at", "count")


def latest_counts(updates: DataFrame, keys: list[str]) -> DataFrame:
    """Count of the highest version per key, whatever the order the updates came in."""
    return updates.groupBy(*keys).agg(
        F.max_by("count", "version").alias("count"), F.max("version").alias("version")
    )


def latest_per_window(
    points: DataFrame, params: GridParams, spec: WindowSpec
) -> DataFrame:
    """Last emitted trailing count of each cell in each window, first per pane."""
    emitted = trailing_counts(points, params, timedelta(microseconds=spec.size_us)).where(F.col("came") > 0)
    per_pane = latest_counts(
        emitted.select(
            timing.pane_of(F.col("at"), spec).alias("pane"), "cell", "count", F.col("at").alias("version")
        ),
        ["pane", "cell"],
    )
    return latest_counts(
        per_pane.select(
            F.explode(timing.windows_of_pane(F.col("pane"), spec)).alias("win"), "cell", "count", "version"
        ),
        ["win", "cell"],
    )


def slab_ranked(counts: DataFrame, params: GridParams, top: int | None = None) -> DataFrame:
    """Cells of a window ordered within their slab along the sort dimension, most populous
    first: adds ``slab`` and ``place``. ``top`` keeps only the first places."""
    rows = counts.withColumn("slab", F.col("cell")[params.sort_dim])
    if top is not None:
        order = Window.partitionBy("win", "slab").orderBy(F.desc("n"), F.asc("cell"))
        return rows.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= top)
    others = [i for i in range(params.dims) if i != params.sort_dim]
    lead = timing.floor_div(F.col("cell")[others[0]], SEGMENT_CELLS) if others else F.lit(0).cast("bigint")
    return running_sum(
        rows,
        ["win", "slab"],
        [F.col("n"), lead],
        [F.asc("cell")],
        F.lit(1).cast("bigint"),
        "place",
        segment_order=[F.desc("_seg0"), F.asc("_seg1")],
    )
