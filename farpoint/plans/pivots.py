"""Blocks of space by distances to a few pivots.

In many dimensions the first coordinates say little about where a point is: blocks of three of
them leave nearly all pairs to be compared. The distance to a pivot says more, and by the
triangle inequality two points within a radius have distances to any pivot that differ by no
more than it. So blocks of the distances to some pivots, as wide as the radius, serve as the
join key in place of the coordinates: whatever the pivots are, no pair is lost.

Pivots are points of a bounded sample, each as far as possible from those before it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.functions import distance as dist
from farpoint.functions import grid

SAMPLE_POINTS = 512  # rows that pivots are chosen from
HASH_PARTS = 256  # one of them is looked into first
#: Blocks are wider than the radius by so much, far more than distances are rounded by.
MARGIN = 1e-3


def choose_pivots(points: DataFrame, count: int, sample: int = SAMPLE_POINTS) -> tuple[tuple[float, ...], ...]:
    """Up to ``count`` distinct points of finite coordinates, far from each other.

    The sample is the rows with the smallest hash of their coordinates, so the choice does not
    depend on the order of the rows. Only the sample reaches the driver.
    """
    coords = points.select("coords")
    # the smallest hashes of all are those of a part of the range, if it has enough: no shuffle of all points
    for some in (coords.where(F.xxhash64("coords") < -(1 << 63) + (1 << 64) // HASH_PARTS), coords):
        rows = some.distinct().orderBy(F.xxhash64("coords"), "coords").limit(sample).collect()
        if len(rows) == sample:
            break
    if not rows:
        return ()
    x = np.array([r.coords for r in rows])
    with np.errstate(over="ignore", invalid="ignore"):
        gap = np.linalg.norm(x - x.mean(axis=0), axis=1)
        chosen: list[int] = []
        for _ in range(count):
            gap = np.where(np.isfinite(gap), gap, 0.0)
            best = int(np.argmax(gap))
            if chosen and gap[best] == 0.0:
                break
            chosen.append(best)
            here = np.linalg.norm(x - x[best], axis=1)
            gap = here if len(chosen) == 1 else np.minimum(gap, here)
    return tuple(tuple(map(float, x[i])) for i in chosen)


def block_columns(pivots: tuple[tuple[float, ...], ...], radius: float, coords: str = "coords") -> list[Column]:
    """The block of a point along each pivot: points within the radius lie in the same or the
    next one."""
    wide = radius * (1 + MARGIN)
    return [
        grid.cell_index(dist.array_distance(coords, F.array(*[F.lit(v) for v in p])), wide).alias(f"b{i}")
        for i, p in enumerate(pivots)
    ]
