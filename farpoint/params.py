"""Parameters of a detection job, validated once and passed to every operator."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import timedelta
from enum import Enum


class QueryMode(str, Enum):
    """Which points of a window are asked about."""

    NEWEST = "newest"  # points that arrived in the last slide of the window
    EXPIRING = "expiring"  # points that leave the window at the next slide
    MIDDLE_EXPIRING = "middle_expiring"  # once at half of the window, once when leaving
    ALL = "all"  # every point in every window


def _micros(value: timedelta | int | float) -> int:
    """A duration in microseconds; plain numbers are milliseconds."""
    if isinstance(value, timedelta):
        return (value.days * 86_400 + value.seconds) * 1_000_000 + value.microseconds
    return round(value * 1000)


@dataclass(frozen=True)
class WindowSpec:
    """Sliding event-time window, aligned to the epoch.

    The time axis is cut into *panes* of ``gcd(size, slide)``; every window is a run of
    whole panes, so a count per pane is computed once and shared by all windows that
    contain the pane.
    """

    size: timedelta | int
    slide: timedelta | int

    def __post_init__(self) -> None:
        if self.size_us <= 0 or self.slide_us <= 0:
            raise ValueError("window size and slide must be positive")
        if self.slide_us > self.size_us:
            raise ValueError("window slide must not be longer than the window")

    @property
    def size_us(self) -> int:
        return _micros(self.size)

    @property
    def slide_us(self) -> int:
        return _micros(self.slide)

    @property
    def pane_us(self) -> int:
        return math.gcd(self.size_us, self.slide_us)

    @property
    def panes_per_window(self) -> int:
        return self.size_us // self.pane_us

    @property
    def panes_per_slide(self) -> int:
        return self.slide_us // self.pane_us


@dataclass(frozen=True)
class GridParams:
    """Radius, neighbour threshold and dimensions, plus the grid derived from them."""

    radius: float
    min_pts: int
    dims: int
    sort_dim: int = 0  # 0-based dimension with the widest range of values

    def __post_init__(self) -> None:
        if not (self.radius > 0 and math.isfinite(self.radius)):
            raise ValueError("radius must be a positive finite number")
        if self.min_pts < 0:
            raise ValueError("min_pts must not be negative")
        if self.dims < 1:
            raise ValueError("dims must be at least 1")
        if not 0 <= self.sort_dim < self.dims:
            raise ValueError("sort_dim must name one of the dimensions")

    @property
    def side(self) -> float:
        """Cell side whose diagonal is half the radius."""
        return (self.radius / 2) / math.sqrt(self.dims)

    @property
    def join_dims(self) -> tuple[int, ...]:
        """Up to three dimensions that key the distance join, the widest first."""
        rest = [i for i in range(self.dims) if i != self.sort_dim]
        return tuple(([self.sort_dim] + rest)[:3])


@dataclass(frozen=True)
class LshParams:
    """Random-projection hashing. ``hashes`` fixes k; ``None`` takes round(ln n) per model."""

    num_tables: int = 1
    hashes: int | None = None
    width: float | None = None  # None: four times the radius
    seed: int = 7
    verify: bool = True  # a candidate counts only if it lies within the radius
    probes: int = 0  # further buckets of each table that a question looks into

    def __post_init__(self) -> None:
        if self.num_tables < 1:
            raise ValueError("num_tables must be at least 1")
        if self.hashes is not None and self.hashes < 1:
            raise ValueError("hashes must be at least 1")
        if self.width is not None and not self.width > 0:
            raise ValueError("width must be positive")
        if self.probes < 0:
            raise ValueError("probes must not be negative")

    def width_for(self, radius: float) -> float:
        return self.width if self.width is not None else 4 * radius


# The published experiment settings per dataset (sort_dim is 0-based here).
PRESETS: dict[str, GridParams] = {
    "TAO": GridParams(radius=1.9, min_pts=50, dims=3, sort_dim=1),
    "FC": GridParams(radius=739.0, min_pts=33, dims=10, sort_dim=9),
    "FARS": GridParams(radius=13.0, min_pts=30, dims=67, sort_dim=13),
    "MSD": GridParams(radius=2000.0, min_pts=20, dims=90, sort_dim=13),
}

# Window and slide of the experiments, in milliseconds.
DEFAULT_WINDOW = WindowSpec(size=100_000, slide=20_000)


def preset(name: str) -> GridParams:
    """Named experiment settings; an unknown name is an error."""
    try:
        return PRESETS[name]
    except KeyError:
        raise ValueError(f"unknown preset {name!r}; known: {', '.join(PRESETS)}") from None
