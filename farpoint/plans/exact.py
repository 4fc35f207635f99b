"""Exact windowed detection.

The answer of a point in a window is settled by the cheapest bound that can settle it:

1. counts of grid cells per pane, summed per window. Up to three dimensions cells have a
   diagonal of half the radius and are cleared by the sum over the cells they touch; beyond,
   a cell is a *tile* with a diagonal of one radius and is cleared by its own count;
2. the points of the other cells meet *boxes*: the points of one small cell in one pane,
   reduced to a count and a bounding box. A box wholly within the radius adds its count to
   the lower bound, one partly within adds to the upper bound only;
3. where the two bounds disagree about ``min_pts``, the partial boxes are opened and their
   points compared one by one.

Nothing is copied once per window on the data side: windows share the counts of their
panes. A dense place is a few boxes however many points it holds, so no task sees all
pairs of a crowded cell.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farpoint.functions import blocks, grid, timing
from farpoint.functions import distance as dist
from farpoint.operators.sliding import interval_sums, window_sums, windows_in_run
from farpoint.params import GridParams, QueryMode, WindowSpec
from farpoint.plans import pivots
from farpoint.plans.tables import SMALL_ROWS, dealt_in_lots, largest_keys, of_few_keys, shuffled, spread_hot_keys, written

GRID_DIMS = 8  # up to here boxes are grid cells; beyond, a box is one distinct point
SURE_NEIGHBOR_DIMS = 3  # up to here the sure neighbour cells are few enough to add up
PIVOTS = 3  # of the join blocks in many dimensions
WIDE_LOT = 10_000  # rows of either side in one group of the wide comparison
NEAR_LOT = 250_000  # rows of either side in one group of a count of all neighbours
CLEAR_LOT = 4_000  # points that a point in many dimensions is compared with first
SLACK = 1e-7  # keeps rounding in v/side from breaking a bound of the grid


@dataclass(frozen=True)
class Layout:
    """Column names and grid constants of one job."""

    grid: GridParams
    spec: WindowSpec | None
    only: tuple[int, int] | None = None
    #: Points whose distances take the place of coordinates in the blocks; beyond ``GRID_DIMS``.
    pivots: tuple[tuple[float, ...], ...] = ()

    @property
    def dims(self) -> int:
        return self.grid.dims

    @property
    def gridded(self) -> bool:
        return self.dims <= GRID_DIMS

    @property
    def split_bits(self) -> int:
        """A cell is split into 2**bits boxes per dimension. From four dimensions on the
        cell is a tile, so one split gives boxes with a diagonal of half the radius."""
        return {1: 4, 2: 2}.get(self.dims, 1)

    @property
    def cell_side(self) -> float:
        return self.grid.side * (1 - SLACK) * (1 if self.summed else 2)

    @property
    def box_side(self) -> float:
        return self.cell_side / 2**self.split_bits

    @cached_property
    def block(self) -> int:
        """Boxes per dimension in a join block, at least one radius wide."""
        return int(self.grid.radius * (1 + SLACK) / self.box_side) + 1

    @property
    def xs(self) -> list[str]:
        return dist.columns("x", self.dims) if self.gridded else ["coords"]

    @property
    def box_key(self) -> list[str]:
        return dist.columns("s", self.dims) if self.gridded else ["coords"]

    @property
    def summed(self) -> bool:
        """Cells are half a tile wide and are summed with the cells they touch."""
        return self.dims <= SURE_NEIGHBOR_DIMS

    @property
    def cell_key(self) -> list[str]:
        return dist.columns("c", self.dims) if self.gridded else ["cell"]

    @property
    def tile_key(self) -> list[str]:
        return dist.columns("t", self.dims) if self.summed else self.cell_key

    @property
    def block_key(self) -> list[str]:
        return [f"b{i}" for i in (range(len(self.pivots)) if self.pivots else self.grid.join_dims)]

    @property
    def stretch(self) -> int:
        """Panes per stretch of time, the time part of the join key."""
        return self.spec.panes_per_window if self.spec else 1

    def box_columns(self) -> list[Column]:
        return [grid.cell_index(F.col(f"x{i}"), self.box_side).alias(f"s{i}") for i in range(self.dims)]

    def block_columns(self) -> list[Column]:
        if self.gridded:
            return [
                timing.floor_div(F.col(f"s{i}"), self.block).alias(f"b{i}")
                for i in self.grid.join_dims
            ]
        if self.pivots:
            return pivots.block_columns(self.pivots, self.grid.radius)
        wide = self.grid.radius * (1 + SLACK)
        return [grid.cell_index(F.col("coords")[i], wide).alias(f"b{i}") for i in self.grid.join_dims]

    def cell_columns(self) -> list[Column]:
        if self.gridded:
            return [
                F.shiftright(F.col(f"s{i}"), self.split_bits).alias(f"c{i}") for i in range(self.dims)
            ]
        return [grid.cell_of("coords", self.cell_side).alias("cell")]


    def outermost(self, tile: bool = False) -> Column:
        """A cell (or tile) that values of any size may share."""
        last = grid.LAST_INDEX
        if not self.gridded:
            return F.exists("cell", lambda c: F.abs(c) == last)
        shift = self.split_bits + (tile and self.summed)
        ends = [last >> shift, -last >> shift]
        return reduce(lambda a, b: a | b, [F.col(c).isin(ends) for c in (self.tile_key if tile else self.cell_key)])


def layout_for(points: DataFrame, params: GridParams, spec: WindowSpec | None, only: tuple[int, int] | None = None) -> Layout:
    """The layout of a job; in many dimensions with pivots out of a sample of its points."""
    if params.dims <= GRID_DIMS:
        return Layout(params, spec, only)
    return Layout(params, spec, only, pivots.choose_pivots(points.where(finite(params.dims)), PIVOTS))


def finite(dims: int) -> Column:
    """All coordinates are ordinary numbers; others have no distance to anything."""
    if dims <= GRID_DIMS:
        ok = F.lit(True)
        for i in range(dims):
            ok = ok & (F.abs(F.col("coords")[i]) < F.lit(float("inf")))
        return F.coalesce(ok, F.lit(False))
    return F.coalesce(
        F.forall("coords", lambda v: F.abs(v) < F.lit(float("inf"))), F.lit(False)
    )


def _canonical(points: DataFrame, spec: WindowSpec | None, staged: bool, dims: int | None = None) -> DataFrame:
    us = timing.arrival_us(points, "arrival") if spec else F.lit(0).cast("bigint")
    coords = F.col("coords")
    if dims is not None:
        wrong = F.raise_error(F.concat(F.lit(f"a point needs {dims} coordinates, found "), F.size("coords")))
        coords = F.when(coords.isNull() | (F.size("coords") == dims), coords).otherwise(wrong).alias("coords")
    base = points.select("point_id", us.alias("us"), coords)
    return written(base) if staged else base


def _flat(base: DataFrame, lay: Layout) -> DataFrame:
    """``point_id, us, pane`` and the coordinates, in fixed-width columns where possible."""
    base = base.where(finite(lay.dims)).withColumn("pane", timing.pane_of(F.col("us"), lay.spec))
    if not lay.gridded:
        return base
    xs = [F.col("coords")[i].alias(f"x{i}") for i in range(lay.dims)]
    return base.select("point_id", "us", "pane", *xs).select("*", *lay.box_columns())


def fold_boxes(flat: DataFrame, lay: Layout, also: tuple[str, ...] = ()) -> DataFrame:
    """One row per pane and occupied box (and value of ``also``): count and bounds. Copies
    of a point fold here."""
    aggs = [F.count("*").alias("n")]
    if lay.gridded:
        for i in range(lay.dims):
            aggs += [F.min(f"x{i}").alias(f"lo{i}"), F.max(f"x{i}").alias(f"hi{i}")]
    return flat.groupBy("pane", *lay.box_key, *also).agg(*aggs)


def _placed(rows: DataFrame, lay: Layout) -> DataFrame:
    """Add the cell and tile columns. Up to three dimensions a tile is 2**d cells."""
    rows = rows.select("*", *lay.cell_columns())
    if not lay.summed:
        return rows
    return rows.select("*", *[F.shiftright(c, 1).alias(t) for c, t in zip(lay.cell_key, lay.tile_key)])


def _in_scope(rows: DataFrame, lay: Layout) -> DataFrame:
    return rows if lay.only is None else rows.where(F.col("win").between(*lay.only))


def _near_sums(per_window: DataFrame, lay: Layout) -> DataFrame:
    """Replace the count of each cell by the sum over itself and all cells it touches, which
    are surely within the radius.

    Each cell sends its count to the cells around it, partial sums first: one shuffle, no
    pairs. Cells that only receive are empty and drop out again.
    """
    cells = lay.cell_key
    around = grid.offset_literal(list(itertools.product((-1, 0, 1), repeat=lay.dims)))
    sent = per_window.select("*", F.explode(around).alias("o"))
    home = F.lit(True)
    for i in range(lay.dims):
        home = home & (F.col("o")[f"o{i}"] == 0)
    moved = [(F.col(c) + F.col("o")[f"o{i}"]).alias(c) for i, c in enumerate(cells)]
    return (
        sent.select("win", *moved, "n", home.alias("home"))
        .groupBy("win", *cells)
        .agg(F.sum("n").alias("n"), F.max("home").alias("home"))
        .where("home")
    )


def _open_cells(boxes: DataFrame, lay: Layout) -> DataFrame:
    """Cells per slide with the range of windows their counts leave open."""
    cells = lay.cell_key
    per_pane = boxes.select("pane", *lay.cell_columns(), "n").groupBy("pane", *cells).agg(F.sum("n").alias("n"))
    counted = _in_scope(window_sums(per_pane, cells, lay.spec), lay)
    counted = counted.withColumn("n", F.when(lay.outermost(), F.lit(-1 << 40)).otherwise(F.col("n")))
    if lay.summed:
        counted = _near_sums(counted, lay)
    still_open = counted.where(F.col("n") - 1 < lay.grid.min_pts)
    return (
        still_open.select(F.explode(timing.units_of_window(F.col("win"), lay.spec)).alias("unit"), *cells, "win")
        .groupBy("unit", *cells)
        .agg(F.min("win").alias("wmin"), F.max("win").alias("wmax"))
    )


def _suspects(flat: DataFrame, boxes: DataFrame, lay: Layout, mode: QueryMode) -> DataFrame:
    """Points with the range of windows in which the cell counts did not clear them."""
    # a pane's tile that is crowded by itself clears its points in every window; the
    # largest such tiles are dropped by a short broadcast list, before any shuffle
    tile = ["pane", *lay.tile_key]
    tiles = _placed(boxes, lay).where(~lay.outermost(tile=True)).groupBy(*tile).agg(F.sum("n").alias("n"))
    crowded = largest_keys(tiles, tile, F.col("n") - 1 >= lay.grid.min_pts).drop("n")
    # a slide may reach beyond the first windows that overlap it
    first, last = (f(F.col("us"), lay.spec) for f in (timing.first_window, timing.last_window))
    clamped = {"wmin": F.greatest("wmin", first), "wmax": F.least("wmax", last)}
    found = (
        _placed(flat, lay)
        .join(F.broadcast(crowded), tile, "left_anti")
        .withColumn("unit", timing.unit_of(F.col("us"), lay.spec))
        .join(shuffled(_open_cells(boxes, lay)), ["unit", *lay.cell_key])
        .withColumns(clamped)
        .where("wmin <= wmax")
        .select("point_id", "us", *lay.xs, "wmin", "wmax")
    )
    if lay.gridded:  # cheaper to compute again than to shuffle
        found = found.select("*", *lay.box_columns())
    asked = timing.mode_windows(F.col("us"), lay.spec, mode)
    if asked is None:
        return found
    inside = [w.between(F.col("wmin"), F.col("wmax")) for w in asked]
    picks = [F.when(ok, w) for ok, w in zip(inside, asked)]
    low, high = (picks[0], picks[0]) if len(picks) == 1 else (F.least(*picks), F.greatest(*picks))
    return found.withColumns({"wmin": low, "wmax": high}).where(F.col("wmin").isNotNull())


def _keyed_queries(queries: DataFrame, lay: Layout) -> DataFrame:
    """Copy each query to the blocks and stretches of time its answer can depend on."""
    s = lay.spec.panes_per_slide if lay.spec else 1
    w = lay.stretch
    q = queries.withColumns({"plo": F.col("wmin") * s, "phi": F.col("wmax") * s + (w - 1)})
    q = q.select("*", *lay.block_columns())
    q = q.withColumn(
        "stretch",
        F.explode(F.sequence(timing.floor_div(F.col("plo"), w), timing.floor_div(F.col("phi"), w))),
    )
    for b in lay.block_key:
        q = q.withColumn(b, F.explode(F.array(*[F.col(b) + F.lit(o) for o in (-1, 0, 1)])))
    return q


def _keyed_boxes(boxes: DataFrame, lay: Layout) -> DataFrame:
    return boxes.select(
        "*", timing.floor_div(F.col("pane"), lay.stretch).alias("stretch"), *lay.block_columns()
    )


def _per_window(counts: DataFrame, lay: Layout, sums: list[str], keep: list[str]) -> DataFrame:
    """Sums per point and pane -> sums per point and window."""
    first = F.greatest("wmin", timing.first_window_of_pane(F.col("pane"), lay.spec))
    last = F.least("wmax", timing.last_window_of_pane(F.col("pane"), lay.spec))
    # what is kept is the same in all rows of a point
    return interval_sums(counts, ["point_id", *keep], first, last, sums, windows_in_run(lay.spec))


def _block_sizes(rows: DataFrame, lay: Layout) -> DataFrame:
    """Rows per join block and stretch of time, an upper bound of its boxes."""
    return (
        rows.select(timing.floor_div(F.col("pane"), lay.stretch).alias("stretch"), *lay.block_columns())
        .groupBy("stretch", *lay.block_key)
        .agg(F.count("*").alias("n"))
    )


def _wide_counts(q: DataFrame, e: DataFrame, lay: Layout) -> DataFrame:
    """Neighbour counts in many dimensions: blocks of queries against blocks of points.

    Both sides of every block are dealt to lots of bounded size, so Spark decides where work
    runs and each task only multiplies out one lot of queries with one lot of points.
    """
    keys = ["stretch", *lay.block_key]
    q, e, keys = dealt_in_lots(q, e, keys, ["pane", "other"], WIDE_LOT, "_chunk")
    e, q, keys = dealt_in_lots(e, q, keys, ["point_id"], WIDE_LOT, "_lot")
    met = (
        q.select("point_id", "us", "wmin", "wmax", "plo", "phi", "coords", *keys)
        .groupBy(*keys)
        .cogroup(e.select("pane", "n", "other", *keys).groupBy(*keys))
        .applyInArrow(blocks.counter(lay.grid.radius), blocks.SCHEMA)
    )
    per_pane = met.groupBy("point_id", "pane").agg(
        F.sum("n").alias("least"), F.sum("n").alias("most"), *[F.min(c).alias(c) for c in ("us", "wmin", "wmax")]
    )
    return _per_window(per_pane, lay, ["least", "most"], ["us"])


def _near_counts(queries: DataFrame, points: DataFrame, lay: Layout) -> DataFrame:
    """Exact counts per query and window, the point itself included, for any number of queries.

    A query stays in the block it is in; the points, copies of one folded, go to the blocks within
    their reach, which are few, since a block is four radii wide. Lots of bounded size
    meet in a task, where boxes within the radius are counted whole. No pair is a row.
    """
    stretch, reach = lay.stretch, lay.block
    s = lay.spec.panes_per_slide if lay.spec else 1
    names = dict(zip(lay.block_key, [F.col(f"s{i}") for i in lay.grid.join_dims]))
    keys = ["stretch", *names]
    q = queries.withColumns({"plo": F.col("wmin") * s, "phi": F.col("wmax") * s + (stretch - 1)})
    q = q.withColumns({b: timing.floor_div(c, 4 * reach) for b, c in names.items()})
    q = q.select("point_id", "wmin", "wmax", "plo", "phi", *lay.xs, *names,
                 F.explode(F.sequence(timing.floor_div(F.col("plo"), stretch), timing.floor_div(F.col("phi"), stretch))).alias("stretch"))
    e = points.groupBy("pane", *lay.xs).agg(F.count("*").alias("n"))
    e = written(e).select("*", *lay.box_columns()).withColumn("stretch", timing.floor_div(F.col("pane"), stretch))
    for b, c in names.items():
        ends = [timing.floor_div(c + o, 4 * reach) for o in (-reach, reach)]
        e = e.withColumn(b, F.explode(F.sequence(*ends)))
    e = e.select("pane", "n", *lay.xs, *keys)

    # lots hold whole small places, so they are as dense as the block; only a place with more rows than
    # a lot is dealt by its rows
    place = [grid.cell_index(F.col(x), lay.grid.radius / 2) for x in lay.xs]
    q, e, keys = dealt_in_lots(q, e, keys, place, NEAR_LOT, "_place")
    q, e, keys = dealt_in_lots(q, e, keys, ["pane", *lay.xs], 2 * NEAR_LOT, "_chunk")
    e, q, keys = dealt_in_lots(e, q, keys, place, NEAR_LOT, "_asked_place")
    e, q, keys = dealt_in_lots(e, q, keys, ["point_id"], 2 * NEAR_LOT, "_lot")
    kind = queries.schema["point_id"].dataType.simpleString()
    met = (
        q.groupBy(*keys)
        .cogroup(e.groupBy(*keys))
        .applyInArrow(blocks.near_counter(lay.grid.radius, lay.dims), f"point_id {kind}, wmin bigint, wmax bigint, pane bigint, n bigint")
    )
    return _per_window(met, lay, ["n"], []).select("point_id", "win", F.col("n").alias("within"))


def _lots(rows: DataFrame, here: list[str]) -> DataFrame:
    """How many lots of about ``CLEAR_LOT`` rows each place of more rows is dealt to."""
    sizes = rows.groupBy(*here).agg(F.ceil(F.count("*") / F.lit(CLEAR_LOT)).alias("lots"))
    return written(sizes.where(F.col("lots") > 1))


def _dealt(rows: DataFrame, sizes: DataFrame, here: list[str], row: list[str]) -> DataFrame:
    rows = rows.join(F.broadcast(sizes.orderBy(F.desc("lots")).limit(SMALL_ROWS)), here, "left")
    return rows.withColumn("lot", F.pmod(F.xxhash64(*row), F.coalesce("lots", F.lit(1).cast("bigint")))).drop("lots")


def _left_in_lots(flat: DataFrame, lay: Layout) -> DataFrame:
    """The points in many dimensions that a lot of their own pane and block does not clear.

    Points of a pane share their windows, so neighbours found there count in all of them, and any part of
    the pane may clear. All points go through one shuffle, and only what is left through those after it.
    """
    here = ["pane", *lay.block_key]
    names = ["point_id", "us", "coords", "pane"]
    points = flat.select(*names, *lay.block_columns())
    points = _dealt(points, _lots(points, here), here, names[:3])
    left = points.groupBy(*here, "lot").applyInArrow(
        blocks.own_clearer(lay.grid.radius, lay.grid.min_pts, names), flat.select(*names).schema
    )
    return written(left)


def _around(flat: DataFrame, left: DataFrame, lay: Layout) -> DataFrame:
    """The points that counts of those ``left`` can depend on, or more."""
    keys = ["stretch", *lay.block_key]
    spans = [f(F.col("pane"), lay.spec) for f in (timing.first_window_of_pane, timing.last_window_of_pane)]
    near = _keyed_queries(left.withColumns(dict(zip(("wmin", "wmax"), spans))), lay)
    return of_few_keys(_keyed_boxes(flat, lay), near, keys).select(*flat.columns)


def _thinned(suspects: DataFrame, boxes: DataFrame, lay: Layout) -> DataFrame:
    """Suspects in many dimensions that ``min_pts`` others of their own pane do not clear.

    Points of a pane share their windows, so neighbours found there count in all of them, and
    any part of the pane may clear. The points of each block are dealt to lots by a hash of the
    coordinates; each lot is compared with itself. Nothing is copied, and the work grows with
    the points; only those that are left go to the blocks around them.
    """
    here = ["pane", *lay.block_key]
    points = boxes.select("pane", F.col("coords").alias("other"), "n", *lay.block_columns())
    sizes = _lots(points, here)
    key = [*here, "lot"]
    suspects = suspects.select("point_id", "us", "coords", "wmin", "wmax")
    asked = suspects.select("*", timing.pane_of(F.col("us"), lay.spec).alias("pane"), *lay.block_columns())
    left = (
        _dealt(asked, sizes, here, ["coords"])
        .groupBy(*key)
        .cogroup(_dealt(points, sizes, here, ["other"]).groupBy(*key))
        .applyInArrow(blocks.clearer(lay.grid.radius, lay.grid.min_pts), suspects.schema)
    )
    return written(left)


def uncleared(points: DataFrame, params: GridParams, spec: WindowSpec | None = None) -> DataFrame:
    """``point_id`` of the points that a bounded comparison within their pane does not clear, in
    more than ``GRID_DIMS`` dimensions. All outliers of finite coordinates are among them."""
    lay = layout_for(points, params, spec)
    flat = _flat(_canonical(points, spec, False, params.dims), lay)
    spans = [f(F.col("pane"), spec) for f in (timing.first_window_of_pane, timing.last_window_of_pane)]
    everyone = flat.withColumns(dict(zip(("wmin", "wmax"), spans)))
    return _thinned(everyone, written(fold_boxes(flat, lay)), lay).select("point_id")


def neighbor_bounds(
    queries: DataFrame, boxes: DataFrame, flat: DataFrame, lay: Layout, match: Column | None = None
) -> DataFrame:
    """Per query point and window: least and greatest possible number of points within the
    radius (and in boxes that ``match``), the point itself included."""
    r = lay.grid.radius
    keys = ["stretch", *lay.block_key]
    q = _keyed_queries(queries, lay)
    if lay.gridded:
        e = _keyed_boxes(boxes, lay).drop(*lay.box_key)
        q = q.drop(*lay.box_key)
        x, lo, hi = (dist.refs(p, lay.dims) for p in ("x", "lo", "hi"))
        reach = dist.nearest(x, lo, hi) <= r
        within = dist.farthest(x, lo, hi) <= r
        keep = ["us", *lay.xs]
    else:
        e = _keyed_boxes(boxes, lay).withColumnRenamed("coords", "other")
        if match is None:
            return _wide_counts(q, e, lay)
        reach = dist.array_distance("coords", "other") <= r
        within = F.lit(True)
        keep = ["us"]
    if lay.dims > len(lay.block_key):
        # the blocks ignore some dimensions, so one block may hold any number of boxes
        row = [c for c in e.columns if c not in ("n", *keys)]
        q, e, keys = spread_hot_keys(q, e, keys, _block_sizes(flat, lay), row)
    meets = F.col("pane").between(F.col("plo"), F.col("phi"))
    met = q.join(shuffled(e), keys).where(meets & reach if match is None else meets & match & reach)
    per_pane = met.groupBy("point_id", "pane").agg(
        F.sum(F.when(within, F.col("n")).otherwise(0)).alias("least"),
        F.sum("n").alias("most"),
        *[F.min(c).alias(c) for c in [*keep, "wmin", "wmax"]],
    )
    return _per_window(per_pane, lay, ["least", "most"], keep)


def open_partial_boxes(
    queries: DataFrame,
    boxes: DataFrame,
    flat: DataFrame,
    lay: Layout,
    match: Column | None = None,
    also: tuple[str, ...] = (),
) -> DataFrame:
    """``hits`` per query point and window: points within the radius in the boxes that the
    sphere cuts."""
    r = lay.grid.radius
    x, lo, hi = (dist.refs(p, lay.dims) for p in ("x", "lo", "hi"))
    spread = F.lit(False)
    for a, b in zip(lo, hi):
        spread = spread | (a < b)
    boxes = boxes.where((F.col("n") > 1) & spread)
    q = _keyed_queries(queries, lay).drop(*lay.box_key)
    part = q.join(shuffled(_keyed_boxes(boxes, lay)), ["stretch", *lay.block_key]).where(
        F.col("pane").between(F.col("plo"), F.col("phi"))
        & (dist.nearest(x, lo, hi) <= r)
        & ~(dist.farthest(x, lo, hi) <= r)
    )
    if match is not None:
        part = part.where(match)
    key = ["pane", *lay.box_key, *also]
    part = part.select("point_id", "wmin", "wmax", *lay.xs, *key)
    inner = flat.select(
        F.col("point_id").alias("other_id"), *[F.col(c).alias(f"y{i}") for i, c in enumerate(lay.xs)], *key
    )
    part, inner, key = spread_hot_keys(part, inner, key, boxes.select(*key, "n"), ["other_id"])
    hits = part.join(shuffled(inner), key).where(dist.distance(x, dist.refs("y", lay.dims)) <= r)
    per_pane = hits.groupBy("point_id", "pane").agg(
        F.count("*").alias("hits"), F.min("wmin").alias("wmin"), F.min("wmax").alias("wmax")
    )
    return _per_window(per_pane, lay, ["hits"], [])


def _asked(df: DataFrame, lay: Layout, mode: QueryMode) -> DataFrame:
    asked = timing.mode_windows(F.col("us"), lay.spec, mode)
    return df if asked is None else df.where(F.col("win").isin(*asked))


def _settled(
    bounds: DataFrame, boxes: DataFrame, flat: DataFrame, lay: Layout, unsettled: Column
) -> DataFrame:
    """Exact ``within`` for the unsettled rows, the bounds' ``least`` for the others."""
    rows = bounds.select("point_id", "win", F.col("least").alias("within"))
    if not lay.gridded:
        return rows
    bounds = written(bounds)
    rest = bounds.where(unsettled)
    if rest.isEmpty():
        return bounds.select("point_id", "win", F.col("least").alias("within"))
    queries = rest.groupBy("point_id").agg(
        F.min("win").alias("wmin"), F.max("win").alias("wmax"), *[F.min(c).alias(c) for c in lay.xs]
    )
    queries = queries.select("*", *lay.box_columns())
    hits = open_partial_boxes(queries, boxes, flat, lay)
    return bounds.join(shuffled(hits), ["point_id", "win"], "left").select(
        "point_id", "win", (F.col("least") + F.coalesce("hits", F.lit(0))).alias("within")
    )


def detect_outliers(
    points: DataFrame,
    params: GridParams,
    spec: WindowSpec | None = None,
    mode: QueryMode | str = QueryMode.ALL,
    staged: bool = False,
    only: tuple[int, int] | None = None,
) -> DataFrame:
    """Points with fewer than ``min_pts`` other points within ``radius``, per window.

    ``points`` has ``point_id``, ``coords array<double>`` and, with windows, ``arrival``.
    Returns ``window_start, window_end, point_id``. A point with a coordinate that is not a
    finite number is at no distance from any other and always an outlier.

    The points are read more than once. ``staged`` writes their narrow form once first, which
    pays off when they are costly to produce (parsed text or JSON) and not when they are
    plain columns of a columnar table. ``only`` limits the answer to the windows numbered
    from its first to its last value (window k starts k slides after the epoch).
    """
    mode = QueryMode(mode)
    lay = layout_for(points, params, spec, only)
    base = _canonical(points, spec, staged, params.dims)
    flat = asked = _flat(base, lay)
    if not lay.gridded:
        asked = _left_in_lots(flat, lay)
        flat = _around(flat, asked, lay)
    boxes = counted = written(fold_boxes(flat, lay))
    if not lay.gridded:  # no other cells are asked for
        own = asked.select(*lay.cell_columns())
        counted = of_few_keys(boxes.select("*", *lay.cell_columns()), own, lay.cell_key).select(*boxes.columns)
    return verdict(base, flat, boxes, _suspects(asked, counted, lay, mode), lay, mode, thinned=True)


def verdict(
    base: DataFrame,
    flat: DataFrame,
    boxes: DataFrame,
    suspects: DataFrame,
    lay: Layout,
    mode: QueryMode,
    thinned: bool = False,
) -> DataFrame:
    """Settle the suspects exactly and return the outliers. In many dimensions a bounded comparison
    comes first, unless they are ``thinned``."""
    k = lay.grid.min_pts
    if not (lay.gridded or thinned):
        suspects = _thinned(suspects, boxes, lay)
    bounds = neighbor_bounds(suspects, boxes, flat, lay)
    bounds = _asked(bounds.where(F.col("least") - 1 < k), lay, mode)
    # "least" counts too few only where "most" still allows an inlier
    counted = _settled(bounds, boxes, flat, lay, F.col("most") - 1 >= k)
    found = counted.where(F.col("within") - 1 < k).select("win", "point_id")
    found = found.unionByName(lonely_by_nature(base, lay, mode))
    return found.select(*timing.window_bounds(F.col("win"), lay.spec), "point_id")


def lonely_by_nature(base: DataFrame, lay: Layout, mode: QueryMode) -> DataFrame:
    """Rows whose coordinates are no finite numbers, in each window they are asked in."""
    us = F.col("us")
    rows = base.where(~finite(lay.dims)).select("point_id", "us")
    asked = timing.mode_windows(us, lay.spec, mode)
    if asked is None:
        wins = F.sequence(timing.first_window(us, lay.spec), timing.last_window(us, lay.spec))
    else:
        wins = F.array_distinct(F.array(*asked))
    return _in_scope(rows.select(F.explode(wins).alias("win"), "point_id"), lay)


def settle_points(
    points: DataFrame,
    flagged: DataFrame,
    params: GridParams,
    spec: WindowSpec | None = None,
    mode: QueryMode | str = QueryMode.ALL,
) -> DataFrame:
    """Exact answer when all outliers are known to be among ``flagged``
    (``window_start, point_id``): only those are compared with the data."""
    mode = QueryMode(mode)
    lay = layout_for(points, params, spec)
    base = _canonical(points, spec, False, params.dims)
    flat = _flat(base, lay)
    boxes = written(fold_boxes(flat, lay))
    win = (
        timing.floor_div(F.unix_micros("window_start"), spec.slide_us) if spec else F.lit(0).cast("bigint")
    )
    spans = (
        flagged.select("point_id", win.alias("win"))
        .groupBy("point_id")
        .agg(F.min("win").alias("wmin"), F.max("win").alias("wmax"))
    )
    suspects = flat.drop("pane").join(shuffled(spans), "point_id")
    return verdict(base, flat, boxes, suspects, lay, mode)


def neighbor_counts(
    points: DataFrame,
    params: GridParams,
    spec: WindowSpec | None = None,
    staged: bool = False,
) -> DataFrame:
    """Exact number of other points within the radius, for every point in every window.

    Whole boxes within the radius are counted without touching their points; only boxes that the
    sphere may cut are opened, within the tasks.
    """
    lay = layout_for(points, params, spec)
    base = _canonical(points, spec, staged, params.dims)
    flat = _flat(base, lay)
    everyone = flat.withColumns(
        {
            "wmin": timing.first_window_of_pane(F.col("pane"), spec),
            "wmax": timing.last_window_of_pane(F.col("pane"), spec),
        }
    ).drop("pane")
    if lay.gridded:
        counted = _near_counts(everyone, flat, lay)
    else:
        # each row is about to be copied to all blocks around it: share that out first
        bounds = neighbor_bounds(everyone.repartition("point_id"), written(fold_boxes(flat, lay)), flat, lay)
        counted = bounds.select("point_id", "win", F.col("least").alias("within"))
    lonely = lonely_by_nature(base, lay, QueryMode.ALL).select(
        "point_id", "win", F.lit(1).cast("bigint").alias("within")
    )
    return counted.unionByName(lonely).select(
        *timing.window_bounds(F.col("win"), spec),
        "point_id",
        (F.col("within") - 1).alias("n_neighbors"),
    )


def nearest_neighbors(
    points: DataFrame,
    asked: DataFrame,
    params: GridParams,
    spec: WindowSpec | None = None,
    top: int | None = None,
) -> DataFrame:
    """The ``top`` (default ``min_pts``) nearest other points within the radius of each row of
    ``asked`` (``window_start, point_id``): ``win, point_id, neighbor_id, distance, place``.

    Meant for outliers, which have few neighbours. Only boxes the sphere touches are opened.
    """
    lay = layout_for(points, params, spec)
    r = params.radius
    flat = _flat(_canonical(points, spec, False, params.dims), lay)
    win = (
        timing.floor_div(F.unix_micros("window_start"), spec.slide_us) if spec else F.lit(0).cast("bigint")
    )
    asked = asked.select("point_id", win.alias("win"))
    spans = asked.groupBy("point_id").agg(F.min("win").alias("wmin"), F.max("win").alias("wmax"))
    queries = _keyed_queries(flat.drop("pane").join(shuffled(spans), "point_id"), lay)
    keys = ["stretch", *lay.block_key]
    if lay.gridded:
        x, lo, hi, y = (dist.refs(p, lay.dims) for p in ("x", "lo", "hi", "y"))
        boxes = written(fold_boxes(flat, lay))
        key = ["pane", *lay.box_key]
        touched = (
            queries.drop(*lay.box_key)
            .join(shuffled(_keyed_boxes(boxes, lay)), keys)
            .where(F.col("pane").between(F.col("plo"), F.col("phi")) & (dist.nearest(x, lo, hi) <= r))
            .select("point_id", "wmin", "wmax", *lay.xs, *key)
        )
        sizes = boxes.select(*key, "n")
        gap = dist.distance(x, y)
        others = [F.col(c).alias(f"y{i}") for i, c in enumerate(lay.xs)]
        inner = flat.select(F.col("point_id").alias("neighbor_id"), *others, *key)
    else:
        key = keys
        touched = queries
        inner = _keyed_boxes(flat, lay).select(
            F.col("point_id").alias("neighbor_id"), F.col("coords").alias("other"), "pane", *key
        )
        sizes = inner.groupBy(*key).agg(F.count("*").alias("n"))
        gap = dist.array_distance("coords", "other")
    touched, inner, key = spread_hot_keys(touched, inner, key, sizes, ["neighbor_id"])
    met = touched.join(shuffled(inner), key).withColumn("distance", gap)
    met = met.where((F.col("distance") <= r) & (F.col("point_id") != F.col("neighbor_id")))
    first = F.greatest("wmin", timing.first_window_of_pane(F.col("pane"), spec))
    last = F.least("wmax", timing.last_window_of_pane(F.col("pane"), spec))
    rows = met.where(first <= last).select(
        "point_id", F.explode(F.sequence(first, last)).alias("win"), "neighbor_id", "distance"
    )
    order = Window.partitionBy("win", "point_id").orderBy("distance", "neighbor_id")
    return (
        rows.join(shuffled(asked), ["win", "point_id"], "left_semi")
        .withColumn("place", F.row_number().over(order).cast("bigint"))
        .where(F.col("place") <= (params.min_pts if top is None else top))
    )
