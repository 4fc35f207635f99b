"""Detection as one streaming plan: the watermark closes windows, Spark's state does the rest.

Three steps in a row, each keyed by the window, all in append mode:

1. Points per window and cell. A cell of more than ``min_pts`` points clears them, since all
   points of a cell are neighbours; it is dropped here.
2. The points of the other cells, joined back to the cells by window and cell. At most
   ``min_pts`` points of a cell go on, however dense the stream is elsewhere.
3. These points join all points of the blocks around them by window and block (whole cells, more
   than one radius, up to three dimensions); pairs within the radius are counted per window and point.

What goes into the state of the joins are *packs*: the points that a task has read of one pane and
cell, or block, as one row. The points of a pack share their windows. A pack of a cell with more than
``min_pts`` points has cleared them and does not go to step 2.

No step keeps a pair, and none meets two points of a crowded cell. The state of a window is
dropped when the watermark passes its end, which is also when its outliers come out. There is
nothing to read or write between micro-batches but Spark's own checkpoint.
"""

from __future__ import annotations

import math
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.functions import grid, packs, timing
from farpoint.functions.distance import array_distance, distance
from farpoint.operators.cells import assign_cells
from farpoint.params import GridParams, WindowSpec

FLAT_DIMS = 8  # up to so many the distance is one flat expression


def _block(params: GridParams) -> list[Column]:
    cells = math.isqrt(4 * params.dims) + 1  # a radius is 2 * sqrt(dims) cells
    return [timing.floor_div(F.col("cell")[i], cells).alias(f"b{k}") for k, i in enumerate(params.join_dims)]


def _packed(placed: DataFrame, by: list[str], member: Column, out: str, crowd: int | None, delay: str) -> DataFrame:
    """Rows of ``arrival``, ``by`` and the list ``out`` of the points of one pane."""
    rows = placed.select("pane", *by, "arrival", member.alias(out), "clears")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([f"arrival {kinds['arrival']}", *[f"{c} {kinds[c]}" for c in by], f"{out} array<{kinds[out]}>"])
    return rows.mapInArrow(packs.packer(by, out, crowd), schema).withWatermark("arrival", delay)


def _distance(params: GridParams) -> Column:
    if params.dims > FLAT_DIMS:
        return array_distance("own", "coords")
    return distance([F.col("own")[i] for i in range(params.dims)], [F.col("coords")[i] for i in range(params.dims)])


def stream_outliers_joined(
    points: DataFrame,
    params: GridParams,
    spec: WindowSpec,
    delay: timedelta = timedelta(milliseconds=500),
    keep_coords: bool = False,
) -> DataFrame:
    """Outliers of a stream: ``(window_start, window_end, point_id)`` and, if asked for, their
    ``coords``; each window once, when the watermark passes its end. Write it in append mode.

    A point without ``min_pts`` others within the radius is an outlier; one whose coordinates are
    not all finite is near no other, and is no neighbour of itself either.
    """
    size, slide = (f"{us} microseconds" for us in (spec.size_us, spec.slide_us))
    window = F.window("arrival", size, slide).alias("window")
    late = f"{round(delay.total_seconds() * 1000)} milliseconds"
    finite = F.forall("coords", lambda v: F.abs(v) < F.lit(float("inf")))
    # the cells of values beyond a double's grain hold far points, too: they clear nothing
    inner = F.forall("cell", lambda i: F.abs(i) < F.lit(grid.LAST_INDEX))
    placed = assign_cells(points, params).select("point_id", "arrival", "coords", "cell", finite.alias("finite"))
    placed = placed.withColumn("clears", F.coalesce(F.col("finite") & inner, F.lit(False)))
    crowd = F.sum(F.col("clears").cast("int"))
    counted = placed.withWatermark("arrival", late).select(window, "cell", "clears").groupBy("window", "cell")
    sparse = counted.agg(crowd.alias("n")).where(F.col("n") <= params.min_pts).drop("n")
    blocks = _block(params)
    names = [f"b{i}" for i in range(len(blocks))]
    # a point with no value in a coordinate is in no block
    whole = placed.where(F.col("arrival").isNotNull() & F.forall("cell", lambda i: i.isNotNull()))
    whole = whole.withColumn("pane", timing.pane_of(timing.arrival_us(points, "arrival"), spec))
    own = F.struct("point_id", F.col("coords").alias("own"), "finite")
    asked = _packed(whole, ["cell"], own, "asking", params.min_pts, late).select(window, "cell", "asking")
    asked = asked.join(sparse, ["window", "cell"])
    steps = F.array(*[F.struct(*[F.lit(v).alias(f"o{i}") for i, v in enumerate(o)]) for o in _around(len(names))])
    asked = asked.select("window", "asking", *blocks, F.explode(steps).alias("step"))
    asked = asked.select("window", "asking", *[(F.col(n) + F.col("step")[f"o{i}"]).alias(n) for i, n in enumerate(names)])
    near = F.struct(F.col("point_id").alias("other_id"), "coords")
    others = _packed(whole.select("*", *blocks), names, near, "others", None, late).select(window, *names, "others")
    pairs = asked.join(others, ["window", *names]).select("window", F.inline("asking"), "others")
    pairs = pairs.select("window", "point_id", "own", "finite", F.inline("others"))
    same = F.col("point_id") == F.col("other_id")  # keeps points that have no other at all
    close = F.col("finite") & (_distance(params) <= F.lit(params.radius))
    kept = [F.any_value("own").alias("coords")] if keep_coords else []
    near = F.sum(F.when(same, 0).otherwise(1)).alias("n")
    found = pairs.where(same | close).groupBy("window", "point_id").agg(near, *kept).where(F.col("n") < params.min_pts)
    bounds = [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]
    return found.select(*bounds, "point_id", *(["coords"] if keep_coords else []))


def stream_window_sizes(points: DataFrame, spec: WindowSpec, delay: timedelta = timedelta(milliseconds=500)) -> DataFrame:
    """Points per window, each window once: ``(window_start, window_end, n)``."""
    size, slide = (f"{us} microseconds" for us in (spec.size_us, spec.slide_us))
    counts = points.withWatermark("arrival", f"{round(delay.total_seconds() * 1000)} milliseconds")
    counts = counts.groupBy(F.window("arrival", size, slide).alias("window")).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "n")


def _around(dims: int) -> list[tuple[int, ...]]:
    out: list[tuple[int, ...]] = [()]
    for _ in range(dims):
        out = [(*o, v) for o in out for v in (-1, 0, 1)]
    return out
