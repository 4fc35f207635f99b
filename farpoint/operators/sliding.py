"""Sums over sliding windows without a copy of each row for each window.

A row counts in a run of windows. With few windows in a run it is simply copied to each. With
many, as when a window is a hundred slides long, it is added where its run begins and taken
off where it ends, and a running sum between these changes gives the count of all windows in
between at once. Time is cut into segments longer than a run, a run is split where it crosses
from one to the next, and every segment is summed by itself: no group grows with the history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farpoint.functions import timing
from farpoint.params import WindowSpec

FEW_WINDOWS = 8  # up to so many windows in a run, rows are copied
SEGMENT_WINDOWS = 64  # least windows of a segment


def windows_in_run(spec: WindowSpec | None) -> int:
    """Most windows that hold one instant."""
    return 1 if spec is None else -(-spec.size_us // spec.slide_us)


def interval_runs(rows: DataFrame, keys: list[str], first: Column, last: Column, sums: list[str], longest: int) -> DataFrame:
    """Sums over rows that count from window ``first`` to ``last``: ``keys``, ``wfirst`` and
    ``wlast`` of a run of windows, and the ``sums`` that hold in all of them. Windows that no row
    counts in are in no run. No row may count in more than ``longest`` windows."""
    width = max(SEGMENT_WINDOWS, longest)
    rows = rows.select(*keys, *sums, first.alias("_f"), last.alias("_l")).where(F.col("_f") <= F.col("_l"))
    segments = F.sequence(timing.floor_div(F.col("_f"), width), timing.floor_div(F.col("_l"), width))
    rows = rows.withColumn("_seg", F.explode(segments))  # two at most
    begin, end = F.col("_seg") * width, (F.col("_seg") + 1) * width - 1
    one = F.lit(1).cast("bigint")
    moves = F.array(
        F.struct(F.greatest("_f", begin).alias("_at"), one.alias("_rows"), *[F.col(c) for c in sums]),
        F.struct((F.least("_l", end) + 1).alias("_at"), (-one).alias("_rows"), *[(-F.col(c)).alias(c) for c in sums]),
    )
    deltas = rows.select(*keys, "_seg", F.inline(moves)).groupBy(*keys, "_seg", "_at")
    deltas = deltas.agg(F.sum("_rows").alias("_rows"), *[F.sum(c).alias(c) for c in sums])
    order = Window.partitionBy(*keys, "_seg").orderBy("_at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = deltas.select(
        *keys,
        F.col("_at").alias("wfirst"),
        (F.lead("_at").over(order) - 1).alias("wlast"),
        F.sum("_rows").over(so_far).alias("_rows"),
        *[F.sum(c).over(so_far).alias(c) for c in sums],
    )
    # the last change of a segment takes everything off
    return runs.where("_rows > 0").drop("_rows")


def interval_sums(
    rows: DataFrame, keys: list[str], first: Column, last: Column, sums: list[str], longest: int, name: str = "win"
) -> DataFrame:
    """``interval_runs`` with a row for each window: ``name``, ``keys`` and the ``sums``."""
    if longest > FEW_WINDOWS:
        runs = interval_runs(rows, keys, first, last, sums, longest)
        return runs.select(F.explode(F.sequence("wfirst", "wlast")).alias(name), *keys, *sums)
    rows = rows.select(*keys, *sums, first.alias("_f"), last.alias("_l")).where(F.col("_f") <= F.col("_l"))
    copies = rows.select(F.explode(F.sequence("_f", "_l")).alias(name), *keys, *sums)
    return copies.groupBy(name, *keys).agg(*[F.sum(c).alias(c) for c in sums])


def window_sums(per_pane: DataFrame, keys: list[str], spec: WindowSpec | None, sums: tuple[str, ...] = ("n",)) -> DataFrame:
    """Sums per ``pane`` and keys -> sums per window ``win`` and keys."""
    first, last = (f(F.col("pane"), spec) for f in (timing.first_window_of_pane, timing.last_window_of_pane))
    return interval_sums(per_pane, keys, first, last, list(sums), windows_in_run(spec))
