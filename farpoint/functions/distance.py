"""Euclidean distance, to points and to boxes.

All forms add the squared differences in dimension order, so a point inside a box never
gets a distance below the box's nearest or above its farthest bound: rounding is monotone.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _root_of_sum(terms: Sequence[Column]) -> Column:
    return F.sqrt(reduce(lambda a, b: a + b, terms))


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Distance of two points given as flat columns; stays inside generated code."""
    return _root_of_sum([(x - y) * (x - y) for x, y in zip(a, b)])


def array_distance(a: str | Column, b: str | Column) -> Column:
    """Distance of two coordinate arrays of any length."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v))


def nearest(x: Sequence[Column], low: Sequence[Column], high: Sequence[Column]) -> Column:
    """Distance from a point to the closest place of a box."""
    gaps = [F.greatest(lo - v, v - hi, F.lit(0.0)) for v, lo, hi in zip(x, low, high)]
    return _root_of_sum([g * g for g in gaps])


def farthest(x: Sequence[Column], low: Sequence[Column], high: Sequence[Column]) -> Column:
    """Distance from a point to the farthest corner of a box."""
    gaps = [F.greatest(v - lo, hi - v) for v, lo, hi in zip(x, low, high)]
    return _root_of_sum([g * g for g in gaps])


def columns(prefix: str, dims: int) -> list[str]:
    return [f"{prefix}{i}" for i in range(dims)]


def refs(prefix: str, dims: int, of: Callable[[str], Column] = F.col) -> list[Column]:
    return [of(c) for c in columns(prefix, dims)]
