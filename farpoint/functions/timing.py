"""Panes and windows as integer arithmetic on epoch microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.params import QueryMode, WindowSpec


def floor_div(value: Column, by: int) -> Column:
    """Exact integer floor division, also for negative values."""
    if by == 1:
        return value
    return ((value - F.pmod(value, F.lit(by))) / F.lit(by)).cast("bigint")


def arrival_us(df: DataFrame, column: str) -> Column:
    """Epoch microseconds of a timestamp column; zone-less timestamps are read as UTC."""
    kind = df.schema[column].dataType.simpleString()
    if kind == "timestamp":
        return F.unix_micros(F.col(column))
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(column))
    if kind == "date":
        return F.datediff(F.col(column), F.lit("1970-01-01").cast("date")).cast("bigint") * 86_400_000_000
    if kind in ("bigint", "int"):
        return F.col(column).cast("bigint") * 1000  # epoch milliseconds
    raise TypeError(f"column {column} of type {kind} is no arrival time")


def pane_of(us: Column, spec: WindowSpec | None) -> Column:
    """Number of the pane that holds the instant; without windows there is one pane."""
    if spec is None:
        return F.lit(0).cast("bigint")
    return floor_div(us, spec.pane_us)


def first_window(us: Column, spec: WindowSpec | None) -> Column:
    """Number of the earliest window that holds the instant (window k starts at k slides)."""
    if spec is None:
        return F.lit(0).cast("bigint")
    return floor_div(us - F.lit(spec.size_us), spec.slide_us) + 1


def last_window(us: Column, spec: WindowSpec | None) -> Column:
    """Number of the latest window that holds the instant."""
    if spec is None:
        return F.lit(0).cast("bigint")
    return floor_div(us, spec.slide_us)


def middle_window(us: Column, spec: WindowSpec) -> Column:
    """Number of the window in which the instant has just passed the half of its stay."""
    return floor_div(us - F.lit(spec.size_us // 2), spec.slide_us)


def first_window_of_pane(pane: Column, spec: WindowSpec | None) -> Column:
    if spec is None:
        return F.lit(0).cast("bigint")
    return floor_div(pane - F.lit(spec.panes_per_window), spec.panes_per_slide) + 1


def last_window_of_pane(pane: Column, spec: WindowSpec | None) -> Column:
    if spec is None:
        return F.lit(0).cast("bigint")
    return floor_div(pane, spec.panes_per_slide)


def windows_of_pane(pane: Column, spec: WindowSpec | None) -> Column:
    """Array of the windows that contain a pane."""
    return F.sequence(first_window_of_pane(pane, spec), last_window_of_pane(pane, spec))


def panes_of_window(win: Column, spec: WindowSpec | None) -> Column:
    """Array of the panes that make up a window."""
    if spec is None:
        return F.array(F.lit(0).cast("bigint"))
    start = win * spec.panes_per_slide
    return F.sequence(start, start + (spec.panes_per_window - 1))


def unit_of(us: Column, spec: WindowSpec | None) -> Column:
    """Number of the slide that holds the instant."""
    return last_window(us, spec)


def units_of_window(win: Column, spec: WindowSpec | None) -> Column:
    """Array of the slides that a window overlaps: few, however short the panes are. An instant
    of the last of them may lie beyond the window."""
    if spec is None:
        return F.array(F.lit(0).cast("bigint"))
    return F.sequence(win, win + (-(-spec.size_us // spec.slide_us) - 1))


def holds(win: Column, us: Column, spec: WindowSpec | None) -> Column:
    """Whether the instant lies in the window."""
    if spec is None:
        return F.lit(True)
    return win.between(first_window(us, spec), last_window(us, spec))


def mode_windows(us: Column, spec: WindowSpec | None, mode: QueryMode) -> list[Column] | None:
    """The windows in which a point is asked about; ``None`` stands for all of them."""
    if mode is QueryMode.ALL or spec is None:
        return None
    if mode is QueryMode.NEWEST:
        return [first_window(us, spec)]
    if mode is QueryMode.EXPIRING:
        return [last_window(us, spec)]
    if 2 * spec.slide_us > spec.size_us:
        raise ValueError("mode middle_expiring needs a slide of at most half the window")
    return [middle_window(us, spec), last_window(us, spec)]


def window_bounds(win: Column, spec: WindowSpec | None) -> list[Column]:
    """``window_start`` and ``window_end`` as timestamps; null without windows."""
    if spec is None:
        empty = F.lit(None).cast("timestamp")
        return [empty.alias("window_start"), empty.alias("window_end")]
    start = win * F.lit(spec.slide_us)
    return [
        F.timestamp_micros(start).alias("window_start"),
        F.timestamp_micros(start + F.lit(spec.size_us)).alias("window_end"),
    ]
