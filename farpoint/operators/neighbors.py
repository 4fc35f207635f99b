"""Sums over neighbouring cells: offsets are listed where they are few, as in two or three
dimensions; otherwise occupied cells are joined by block. Both give the same pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.functions import blocks as lots
from farpoint.functions import grid, timing
from farpoint.operators.cells import assign_cells, cell_counts, points_of_cells, slab_ranked
from farpoint.operators.sliding import window_sums
from farpoint.params import GridParams, WindowSpec
from farpoint.plans.tables import dealt_in_lots, of_few_keys, shuffled, spread_hot_keys, with_small, written

LOT = 10_000  # cells of either side in one group of the comparison in many dimensions
TILE_CELLS = 4  # per dimension of a tile, whose cells are 3 apart at most: within level 2 in any dimensions
TILE_SHIFTS = (0, 2)  # of the tiles, in cells: what lies at the edge of one is amid another


def _shifted(cell: str, offset: Column, dims: int) -> Column:
    return F.array(*[F.col(cell)[i] + offset[f"o{i}"] for i in range(dims)])


def _squared(offset: Column, dims: int) -> Column:
    total = offset["o0"] * offset["o0"]
    for i in range(1, dims):
        total = total + offset[f"o{i}"] * offset[f"o{i}"]
    return total


def _bound(params: GridParams, level: int, strict: bool) -> int:
    limit = params.dims if level == 1 else 9 * params.dims
    return limit - 1 if strict else limit


def _joined_cells(asking: DataFrame, counts: DataFrame, params: GridParams, limit: int) -> DataFrame:
    """Asked cells with the occupied cells up to ``limit`` (squared) around them, in any number
    of dimensions: ``(win, cell, near, n, s2)``.

    Blocks are longer than the reach in up to three dimensions, so a cell meets the blocks
    beside its own and nothing further; crowded blocks are dealt to several tasks.
    """
    dims, side = params.join_dims, math.isqrt(limit) + 1
    blocks = [f"b{i}" for i in dims]

    def blocked(column: str) -> list[Column]:
        return [timing.floor_div(F.col(column)[i], side).alias(b) for i, b in zip(dims, blocks)]

    left = asking.select("win", "cell", *blocked("cell"))
    for b in blocks:
        left = left.withColumn(b, F.explode(F.array(F.col(b) - 1, F.col(b), F.col(b) + 1)))
    right = counts.select("win", F.col("cell").alias("near"), "n", *blocked("cell"))
    sizes = right.groupBy("win", *blocks).agg(F.count("*").alias("n"))
    left, right, key = spread_hot_keys(left, right, ["win", *blocks], sizes, ["near"], every_key=True)
    met = left.join(shuffled(right), key)
    return met.select("win", "cell", "near", "n", grid.squared_offset("cell", "near").alias("s2")).where(F.col("s2") <= limit)


def _reach_and_side(limit: int) -> tuple[int, int]:
    """Cells that a sum reaches along one dimension, and cells per dimension of the blocks it is formed by."""
    reach = math.isqrt(limit)
    return reach, 2 * (reach + 1)


def _met_sums(counts: DataFrame, params: GridParams, level: int, strict: bool, asked: DataFrame | None = None) -> DataFrame:
    """``neighbor_sums`` by blocks of cells: each cell lies in one block and is copied, as one
    that is counted, to the blocks within its reach.

    Blocks of up to three dimensions are twice as long as the reach, so a cell has few copies.
    Both sides of a block are dealt to lots of bounded size that meet as matrices in a task.
    """
    limits = {"level1_count": _bound(params, 1, strict)}
    if level == 2:
        limits["level2_count"] = _bound(params, 2, strict)
    reach, side = _reach_and_side(max(limits.values()))
    counts = written(counts.where(F.forall("cell", lambda i: i.isNotNull())))
    blocks = {f"b{i}": F.col("cell")[i] for i in params.join_dims}
    keys = ["win", *blocks]
    asking = counts.select("win", "cell", "n", *[timing.floor_div(c, side).alias(b) for b, c in blocks.items()])
    others = counts.select(F.col("win").alias("win"), F.col("cell").alias("near"), F.col("n").alias("n"))
    for b, i in zip(blocks, params.join_dims):
        c = F.col("near")[i]
        ends = [timing.floor_div(c + o, side) for o in (-reach, reach)]
        others = others.withColumn(b, F.explode(F.sequence(*ends)))
    if asked is not None:
        asking = asking.join(shuffled(asked), ["win", "cell"], "left_semi")
        others = of_few_keys(others, asking, keys)
    asking, others, dealt = dealt_in_lots(asking, others, keys, ["near"], LOT, "_chunk")
    others, asking, dealt = dealt_in_lots(others, asking, dealt, ["cell"], LOT, "_lot")
    sums = ", ".join(f"{name} bigint" for name in limits)
    met = (
        asking.groupBy(*dealt)
        .cogroup(others.groupBy(*dealt))
        .applyInArrow(
            lots.cell_adder(limits, params.dims if strict and level == 2 else None),
            f"win bigint, cell array<bigint>, n bigint, {sums}",
        )
    )
    return met.groupBy("win", "cell").agg(F.max("n").alias("n"), *[F.sum(name).alias(name) for name in limits])


def slab_pairs(counts: DataFrame, params: GridParams) -> DataFrame:
    """Slabs along the sort dimension joined with the same and the two next slabs:
    ``(win, slab, other_slab, n_cells, n_points)``, what a search of that slab meets.

    Slabs are summed before the join, so a long slab is one row and not its pairs of cells.
    """
    slabs = (
        counts.groupBy("win", F.col("cell")[params.sort_dim].alias("slab"))
        .agg(F.count("*").alias("n_cells"), F.sum("n").alias("n_points"))
    )
    asking = slabs.select("win", "slab", F.explode(F.array(*[F.col("slab") + F.lit(o) for o in (-1, 0, 1)])).alias("other_slab"))
    return asking.join(shuffled(slabs.withColumnRenamed("slab", "other_slab")), ["win", "other_slab"]).select(
        "win", "slab", "other_slab", "n_cells", "n_points"
    )


def neighbor_sums(
    counts: DataFrame, params: GridParams, level: int = 1, strict: bool = False, asked: DataFrame | None = None
) -> DataFrame:
    """``level1_count`` and, for ``level`` 2, ``level2_count`` of every occupied cell, or of those
    of them that are ``asked`` (``win, cell``).

    Each cell sends its count to the cells in reach, partial sums first: one shuffle, and a
    populous cell is a single row. Level-1 sums include the cell itself; level-2 sums include
    level 1. The number of offsets grows fast with the dimensions: 61 at level 2 for d = 2. Where
    they are many, blocks of occupied cells meet, without a row for each pair.
    """
    d, limit = params.dims, _bound(params, level, strict)
    if not grid.few_offsets(d, limit):
        return _met_sums(counts, params, level, strict, asked)
    sums = [F.sum(F.when(F.col("s2") <= _bound(params, 1, strict), F.col("n")).otherwise(0)).alias("level1_count")]
    if level == 2:
        ring = F.col("s2") != d if strict else F.lit(True)  # a strict bound leaves s2 = d out
        sums.append(F.sum(F.when(ring, F.col("n")).otherwise(0)).alias("level2_count"))
    reach = grid.offset_literal(grid.offsets_within(d, limit))
    sent = counts.select("win", "cell", "n", F.explode(reach).alias("o"))
    sent = sent.select("win", _shifted("cell", F.col("o"), d).alias("cell"), "n", _squared(F.col("o"), d).alias("s2"))
    found = (
        sent.groupBy("win", "cell")
        .agg(F.sum(F.when(F.col("s2") == 0, F.col("n"))).alias("n"), *sums)
        .where(F.col("n").isNotNull())
    )
    return found if asked is None else found.join(shuffled(asked), ["win", "cell"], "left_semi")


def capped_sums(counts: DataFrame, params: GridParams, max_cells_per_slab: int | None = None) -> DataFrame:
    """Level-1 sums over the cells of a slab and the slabs beside it: all of them, unless a cap is given.

    With a cap only the most populous cells of each slab take part. Such a sum is a lower bound of
    the full one and may be used to clear points, never to call them outliers.
    """
    d = params.dims
    top = counts if max_cells_per_slab is None else slab_ranked(counts, params, top=max_cells_per_slab)
    no_count = F.lit(None).cast("bigint").alias("n")
    if grid.few_offsets(d, d):
        reach = [o for o in grid.offsets_within(d, d) if abs(o[params.sort_dim]) <= 1]
        sent = top.select("win", "cell", "n", F.explode(grid.offset_literal(reach)).alias("o")).select(
            "win", _shifted("cell", F.col("o"), d).alias("cell"), F.col("n").alias("part"), no_count
        )
    else:
        apart = F.abs(F.col("cell")[params.sort_dim] - F.col("near")[params.sort_dim])
        sent = _joined_cells(counts, top, params, d).where(apart <= 1).select("win", "cell", F.col("n").alias("part"), no_count)
    home = counts.select("win", "cell", F.lit(0).cast("bigint").alias("part"), "n")
    return (
        sent.unionByName(home)
        .groupBy("win", "cell")
        .agg(F.max("n").alias("n"), F.sum("part").alias("level1_count"))
        .where(F.col("n").isNotNull())
    )


def _cells_of_sparse_tiles(points: DataFrame, params: GridParams, spec: WindowSpec | None, enough: int) -> DataFrame:
    """Cells ``(win, cell)`` whose tiles all hold fewer than ``enough`` points.

    The cells of a tile are within level 2 of each other, so the count of a tile is a lower bound of the
    level-2 sum of each of its cells. Dense places are a few tiles however many cells they have.
    """
    us = timing.arrival_us(points, "arrival") if spec else F.lit(0).cast("bigint")
    placed = assign_cells(points, params).select("cell", us.alias("us")).where(F.forall("cell", lambda i: i.isNotNull()))
    tiles = [f"t{i}" for i in range(params.dims)]

    def tile(shift: int) -> list[Column]:
        return [timing.floor_div(F.col("cell")[i] + F.lit(shift), TILE_CELLS).alias(t) for i, t in enumerate(tiles)]

    layers = F.array(*[F.struct(F.lit(shift).alias("shift"), *tile(shift)) for shift in TILE_SHIFTS])
    per_pane = placed.select(timing.pane_of(F.col("us"), spec).alias("pane"), F.inline(layers)).groupBy("pane", "shift", *tiles)
    sums = window_sums(per_pane.agg(F.count("*").alias("n")), ["shift", *tiles], spec)
    sparse = written(sums.where(F.col("n") < enough).select("shift", "win", *tiles))

    def layer(shift: int) -> DataFrame:
        return sparse.where(F.col("shift") == shift).drop("shift")

    # met by slide, so a point is not copied to its windows before it is known to be in a sparse tile
    asked = written(layer(TILE_SHIFTS[0]).select("*", F.explode(timing.units_of_window(F.col("win"), spec)).alias("unit")))
    cells = placed.select("cell", "us", timing.unit_of(F.col("us"), spec).alias("unit"), *tile(TILE_SHIFTS[0]))
    cells = with_small(cells, asked, ["unit", *tiles], ["cell", "us"]).where(timing.holds(F.col("win"), F.col("us"), spec))
    cells = cells.select("win", "cell").distinct()
    for shift in TILE_SHIFTS[1:]:
        cells = with_small(cells.select("*", *tile(shift)), layer(shift), ["win", *tiles], ["cell"]).select("win", "cell")
    return written(cells)


def _points_around(points: DataFrame, cells: DataFrame, params: GridParams, spec: WindowSpec | None) -> DataFrame:
    """The points that the level-2 sums of the ``cells`` can depend on, or more."""
    reach, side = _reach_and_side(_bound(params, 2, False))
    blocks = [f"b{i}" for i in params.join_dims]
    ends = [[timing.floor_div(F.col("cell")[i] + o, side) for o in (-reach, reach)] for i in params.join_dims]
    near = cells.select("win", *[F.struct(*e).alias(b) for b, e in zip(blocks, ends)]).distinct()
    for b in blocks:
        near = near.withColumn(b, F.explode(F.sequence(F.col(b)["col1"], F.col(b)["col2"])))
    near = near.select(*blocks, F.explode(timing.units_of_window(F.col("win"), spec)).alias("unit"))
    us = timing.arrival_us(points, "arrival") if spec else F.lit(0).cast("bigint")
    placed = assign_cells(points, params)
    placed = placed.select(
        *points.columns, timing.unit_of(us, spec).alias("unit"),
        *[timing.floor_div(F.col("cell")[i], side).alias(b) for i, b in zip(params.join_dims, blocks)],
    )
    return of_few_keys(placed, near, ["unit", *blocks]).select(*points.columns)


def definite_outliers(points: DataFrame, params: GridParams, spec: WindowSpec | None, count_self: bool = False) -> DataFrame:
    """Points per window that cannot have enough neighbours even if every point of the cells
    in reach were one: ``(win, point_id)``.

    Where offsets are too many to be listed, counts of tiles settle most cells, and only the others and what
    is around them are counted cell by cell.
    """
    enough = params.min_pts if count_self else params.min_pts + 1
    asked = None
    if not grid.few_offsets(params.dims, _bound(params, 2, False)):
        asked = _cells_of_sparse_tiles(points, params, spec, enough)
        points = _points_around(points, asked, params, spec)
    sums = neighbor_sums(cell_counts(points, params, spec), params, level=2, asked=asked)
    lonely = sums.where(F.col("level2_count") < enough)
    return points_of_cells(points, lonely, params, spec, enough).select("win", "point_id")


def leveled_pairs(counts: DataFrame, params: GridParams, strict: bool = False) -> DataFrame:
    """Occupied cells with the occupied cells around them and the neighbourhood level of the
    pair: ``(win, cell, near, s2, level)``. The ring just out of reach is shown as level 0."""
    d = params.dims
    if not grid.few_offsets(d, 10 * d):
        pairs = _joined_cells(counts, counts, params, 10 * d)
        return pairs.select("win", "cell", "near", "s2", grid.neighbor_level(F.col("s2"), d, strict).alias("level"))
    around = grid.offset_literal(grid.offsets_within(d, 10 * d))
    asking = counts.select("win", "cell", F.explode(around).alias("o")).select(
        "win", "cell", _shifted("cell", F.col("o"), d).alias("near")
    )
    s2 = grid.squared_offset("cell", "near")
    return asking.join(shuffled(counts.select("win", F.col("cell").alias("near"))), ["win", "near"]).select(
        "win", "cell", "near", s2.alias("s2"), grid.neighbor_level(s2, d, strict).alias("level")
    )


def unresolved_cells(counts: DataFrame, params: GridParams) -> DataFrame:
    """Cells that neither their level-1 sum nor their level-2 sum settles."""
    k = params.min_pts
    return neighbor_sums(counts, params, level=2).where(
        (F.col("level1_count") - 1 < k) & (F.col("level2_count") - 1 >= k)
    )


def candidate_pairs(counts: DataFrame, params: GridParams) -> DataFrame:
    """Unresolved cells with the cells whose points may be neighbours:
    ``(win, cell, near, level, n)``. Pairs are of occupied cells."""
    d = params.dims
    asking = unresolved_cells(counts, params)
    if not grid.few_offsets(d, 9 * d):
        pairs = _joined_cells(asking, counts, params, 9 * d)
        return pairs.select("win", "cell", "near", grid.neighbor_level(F.col("s2"), d).alias("level"), "n")
    reach = grid.offset_literal(grid.offsets_within(d, 9 * d))
    asking = asking.select("win", "cell", F.explode(reach).alias("o")).select(
        "win",
        "cell",
        _shifted("cell", F.col("o"), d).alias("near"),
        grid.neighbor_level(_squared(F.col("o"), d), d).alias("level"),
    )
    return asking.join(shuffled(counts.withColumnRenamed("cell", "near")), ["win", "near"]).select(
        "win", "cell", "near", "level", "n"
    )
