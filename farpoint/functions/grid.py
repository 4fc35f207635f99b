"""Column expressions for grid cells.

A cell is an ``array<bigint>`` of floor indices: sign and order are kept, so two cells
share a key only if they are the same cell.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: shift added before the floor, keeps tiny negative noise out of cell -1.
CELL_SHIFT = 1e-8
#: Index of the last cell: beyond it a double is coarser than a cell, all values share one.
LAST_INDEX = 1 << 50
MAX_OFFSETS = 2_000  # beyond so many offset vectors, occupied cells are joined instead of listed ones


def cell_index(value: Column, side: float) -> Column:
    """Floor index of one coordinate, within ``LAST_INDEX``. The points of an outermost cell
    may be far apart: such a cell must not clear its points."""
    last = F.lit(float(LAST_INDEX))
    return F.floor(F.greatest(F.least(value / F.lit(side) + F.lit(CELL_SHIFT), last), -last))


def cell_of(coords: str | Column, side: float) -> Column:
    """Cell of a coordinate array of any length."""
    return F.transform(coords, lambda v: cell_index(v, side))


def cell_center(cell: str | Column) -> Column:
    """Cell centre in units of the side: half-integers."""
    return F.transform(cell, lambda i: i + F.lit(0.5))


def cell_from_center(center: str | Column) -> Column:
    """Back from a centre to its cell."""
    return F.transform(center, lambda c: F.floor(c))


def cell_id(cell: str | Column) -> Column:
    """Readable, collision-free cell name such as ``3:-1:12``."""
    return F.array_join(F.transform(cell, lambda i: i.cast("string")), ":")


def squared_offset(a: str | Column, b: str | Column) -> Column:
    """Sum of squared index differences of two cells."""
    diffs = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(diffs, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def neighbor_level(s2: Column, dims: int, strict: bool = False) -> Column:
    """1: all pairs of the two cells are neighbours, 2: some may be, 0: none.

    Integer form of the centre-distance bounds: with a cell diagonal of half the radius,
    ``centre distance + r/2 <= r`` is ``s2 <= d`` and ``centre distance - r/2 <= r`` is
    ``s2 <= 9 d``. ``strict`` gives ``<`` in the bounds; a cell exactly on a bound then
    satisfies neither side and falls to level 0.
    """
    if strict:
        return (
            F.when(s2 < dims, 1).when((s2 > dims) & (s2 < 9 * dims), 2).otherwise(0)
        )
    return F.when(s2 <= dims, 1).when(s2 <= 9 * dims, 2).otherwise(0)


def few_offsets(dims: int, limit: int) -> bool:
    """Whether listing the offsets is shorter than a join of the occupied cells."""
    return (2 * math.isqrt(limit) + 1) ** dims <= MAX_OFFSETS


def offsets_within(dims: int, limit: int) -> list[tuple[int, ...]]:
    """All integer offset vectors with squared length up to ``limit``."""
    reach = math.isqrt(limit)
    steps = range(-reach, reach + 1)
    return [o for o in itertools.product(steps, repeat=dims) if sum(i * i for i in o) <= limit]


def offset_literal(offsets: list[tuple[int, ...]]) -> Column:
    """The offsets as one literal array of structs ``(o0, o1, ...)`` for ``explode``."""
    rows = (", ".join(f"'o{i}', {v}L" for i, v in enumerate(o)) for o in offsets)
    return F.expr("array(" + ", ".join(f"named_struct({row})" for row in rows) + ")")
