"""Detection with random-projection hashing.

The grid settles what it can; the points it leaves open are asked how many *candidates*
share a hash bucket with them in at least one table. With ``verify`` (default) a candidate
counts only if it lies within the radius, so each point this mode clears is surely an
inlier. Without it, the number of candidates alone decides.

Three models differ in what is indexed and hence in k: one model over all points of the
window; one over the union of the open points' neighbour cells; one per open point's cell.

No pair of a crowded bucket is ever formed. Without ``verify`` bucket sizes decide; pairs of
hash signatures are only formed in buckets of at most ``min_pts`` points. With ``verify``
points meet boxes that share a signature, as in exact detection.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.functions import grid, hashing, timing
from farpoint.operators.cells import cell_counts, points_of_cells
from farpoint.operators.neighbors import candidate_pairs, neighbor_sums
from farpoint.operators.windows import assign_windows, window_sizes
from farpoint.params import GridParams, LshParams, QueryMode, WindowSpec
from farpoint.plans.exact import (
    GRID_DIMS,
    SURE_NEIGHBOR_DIMS,
    Layout,
    finite,
    fold_boxes,
    lonely_by_nature,
    neighbor_bounds,
    open_partial_boxes,
    settle_points,
    uncleared,
)
from farpoint.plans.tables import shuffled, spread_hot_keys, with_small, written

# each window stands for one instant: rows already carry their window number
PER_WINDOW = WindowSpec(timedelta(microseconds=1), timedelta(microseconds=1))


def _prepared(points: DataFrame, params: GridParams, lsh: LshParams) -> DataFrame:
    """Finite points with their full hash vectors ``h``, one per table."""
    tables = hashing.projections(lsh, params.dims, params.radius)
    width = lsh.width_for(params.radius)
    h = F.array(*[hashing.hash_vector(F.col("coords"), t, width) for t in tables])
    return points.where(finite(params.dims)).withColumn("h", h)


def _cut(h: Column, k: Column) -> Column:
    """Bucket of each table: the first k hashes."""
    return F.transform(h, lambda v: F.slice(v, F.lit(1), k))


def _with_k(rows: DataFrame, models: DataFrame, lsh: LshParams) -> DataFrame:
    """Add k of the row's window. ``models`` has the model size ``n`` per window."""
    if lsh.hashes is not None:
        return rows.withColumn("k", F.lit(lsh.hashes))
    ks = written(models.select("win", hashing.hash_count(F.col("n"), lsh).alias("k")))
    return with_small(rows, ks, ["win"], ["point_id"])


def lsh_models(points: DataFrame, params: GridParams, spec: WindowSpec | None, lsh: LshParams) -> DataFrame:
    """Size, width and number of hashes of the whole-window model: ``(win, n, width, k)``."""
    return window_sizes(points.where(finite(params.dims)), spec).select(
        "win", "n", F.lit(lsh.width_for(params.radius)).alias("width"), hashing.hash_count(F.col("n"), lsh).alias("k")
    )


def _asked(rows: DataFrame, spec: WindowSpec | None, mode: QueryMode) -> DataFrame:
    asked = timing.mode_windows(F.col("us"), spec, mode)
    return rows if asked is None else rows.where(F.col("win").isin(*asked))


def _few_candidates(suspects: DataFrame, groups: DataFrame, model: list[str], k: int) -> DataFrame:
    """Suspects with fewer than ``k`` candidates in their model, without distances.

    ``groups`` has the model columns, the buckets ``sig`` and a count ``n``; ``suspects``
    the model columns, ``point_id`` and ``sig``.
    """
    buckets = [*model, "table", "bucket"]
    by_table = groups.select(*model, "sig", "n", F.posexplode("sig").alias("table", "bucket"))
    sizes = by_table.groupBy(*buckets).agg(F.sum("n").alias("n"))
    asking = suspects.select(*model, "point_id", "sig", F.posexplode("sig").alias("table", "bucket"))
    each, asking_spread, key = spread_hot_keys(sizes, asking, buckets, sizes, ["point_id"])
    judged = (
        asking_spread.join(shuffled(each), key)
        .groupBy(*model, "point_id", "sig")
        .agg(F.max("n").alias("largest"), F.sum(F.col("n") - 1).alias("most"))
    )
    sure = judged.where(F.col("most") < k).select("win", "point_id")
    # in doubt only with several small buckets that may share members
    doubt = judged.where((F.col("most") >= k) & (F.col("largest") - 1 < k)).select(
        *model, "point_id", F.col("sig").alias("mine"), F.posexplode("sig").alias("table", "bucket")
    )
    earlier = F.exists(
        F.sequence(F.lit(1), F.col("table")),
        lambda t: (t <= F.col("table")) & (F.get("mine", t - 1) == F.get("sig", t - 1)),
    )
    first_meeting = ~(F.when(F.col("table") > 0, earlier).otherwise(False))
    counted = (
        doubt.join(shuffled(by_table), buckets)
        .where(first_meeting)
        .groupBy(*model, "point_id")
        .agg(F.sum("n").alias("met"))
        .where(F.col("met") - 1 < k)
    )
    return sure.unionByName(counted.select("win", "point_id"))


def _few_verified(
    suspects: DataFrame, windowed: DataFrame, params: GridParams
) -> DataFrame:
    """Suspects with fewer than ``min_pts`` points within the radius among their candidates.

    ``suspects`` carry their own ``k``; ``windowed`` has ``sig`` cut at the window's k,
    which is never below it.
    """
    lay = Layout(params, PER_WINDOW)
    base = windowed.select("point_id", F.col("win").alias("us"), F.col("win").alias("pane"), "coords", "sig")
    asks = suspects.select(
        "point_id", F.col("win").alias("us"), "coords", "k", _cut(F.col("h"), F.col("k")).alias("mine"),
        F.col("win").alias("wmin"), F.col("win").alias("wmax"),
    )
    if lay.gridded:
        xs = [F.col("coords")[i].alias(f"x{i}") for i in range(lay.dims)]
        base = base.select("point_id", "us", "pane", "sig", *xs).select("*", *lay.box_columns())
        asks = asks.select("*", *xs).drop("coords").select("*", *lay.box_columns())
    asks = written(asks)
    boxes = written(fold_boxes(base, lay, ("sig",)))
    same = F.exists(
        F.sequence(F.lit(0), F.size("mine") - 1),
        lambda t: F.get("mine", t) == F.slice(F.get("sig", t), F.lit(1), F.col("k")),
    )
    k = params.min_pts
    bounds = neighbor_bounds(asks, boxes, base, lay, same).where(F.col("least") - 1 < k)
    if not lay.gridded:
        return bounds.select("win", "point_id")
    bounds = written(bounds)
    rest = bounds.where(F.col("most") - 1 >= k)
    few = bounds.where(F.col("most") - 1 < k).select("win", "point_id")
    if rest.isEmpty():
        return few
    again = asks.join(rest.select("point_id", F.col("win").alias("us")), ["point_id", "us"], "left_semi")
    hits = open_partial_boxes(again, boxes, base, lay, same, ("sig",))
    settled = rest.join(hits, ["point_id", "win"], "left").where(
        F.col("least") + F.coalesce("hits", F.lit(0)) - 1 < k
    )
    return few.unionByName(settled.select("win", "point_id"))


def _grid_suspects(
    hashed: DataFrame, params: GridParams, spec: WindowSpec | None, mode: QueryMode
) -> DataFrame:
    """Points that neither their cell nor its level-1 neighbours clear."""
    k = params.min_pts
    cells = cell_counts(hashed, params, spec)
    if params.dims <= SURE_NEIGHBOR_DIMS:
        cells = neighbor_sums(cells, params).where(F.col("level1_count") - 1 < k)
    else:
        cells = cells.where(F.col("n") - 1 < k)
    found = points_of_cells(hashed, cells, params, spec, k + 1, keep=("us", "coords", "h"))
    return _asked(found, spec, mode)


def _windowed(
    hashed: DataFrame, spec: WindowSpec | None, lsh: LshParams, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Points per window with their buckets at the window's k."""
    rows = assign_windows(hashed, spec).select("win", "point_id", "coords", "h", *keep)
    rows = _with_k(rows, window_sizes(hashed, spec), lsh)
    return rows.select("win", "point_id", "coords", *keep, _cut(F.col("h"), F.col("k")).alias("sig"))


def _timed(hashed: DataFrame, spec: WindowSpec | None) -> DataFrame:
    us = timing.arrival_us(hashed, "arrival") if spec else F.lit(0).cast("bigint")
    return hashed.withColumn("us", us)


def _finish(found: DataFrame, points: DataFrame, params: GridParams, spec: WindowSpec | None, mode: QueryMode) -> DataFrame:
    lonely = lonely_by_nature(_timed(points, spec), Layout(params, spec), mode)
    rows = found.unionByName(lonely.select("win", "point_id"))
    return rows.select(*timing.window_bounds(F.col("win"), spec), "point_id")


def detect_lsh(
    points: DataFrame,
    params: GridParams,
    spec: WindowSpec | None = None,
    mode: QueryMode | str = QueryMode.ALL,
    lsh: LshParams = LshParams(),
    asked: DataFrame | None = None,
) -> DataFrame:
    """One model over all points of the window: ``window_start, window_end, point_id``. With
    ``asked`` (``point_id``) only these are judged, against all points."""
    mode = QueryMode(mode)
    hashed = _timed(_prepared(points, params, lsh), spec)
    suspects = _with_k(_grid_suspects(hashed, params, spec, mode), window_sizes(hashed, spec), lsh)
    if asked is not None:
        suspects = suspects.join(shuffled(asked), "point_id", "left_semi")
    windowed = _windowed(hashed, spec, lsh)
    if lsh.verify:
        found = _few_verified(suspects, windowed, params)
    else:
        groups = windowed.groupBy("win", "sig").agg(F.count("*").alias("n"))
        asks = suspects.select("win", "point_id", _cut(F.col("h"), F.col("k")).alias("sig"))
        found = _few_candidates(asks, groups, ["win"], params.min_pts)
    return _finish(found, points, params, spec, mode)


def _unresolved(
    hashed: DataFrame, params: GridParams, spec: WindowSpec | None, mode: QueryMode
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cell counts, open points (level 1 too few, level 2 enough) and definite outliers."""
    k = params.min_pts
    counts = written(cell_counts(hashed, params, spec))
    sums = neighbor_sums(counts, params, level=2).where(F.col("level1_count") - 1 < k)
    rows = _asked(
        points_of_cells(hashed, sums, params, spec, k + 1, keep=("us", "coords", "h", "level2_count")), spec, mode
    )
    rows = written(rows)
    return counts, rows.where(F.col("level2_count") - 1 >= k), rows.where(F.col("level2_count") - 1 < k)


def detect_lsh_shared(
    points: DataFrame,
    params: GridParams,
    spec: WindowSpec | None = None,
    mode: QueryMode | str = QueryMode.ALL,
    lsh: LshParams = LshParams(num_tables=3),
) -> DataFrame:
    """One model per window over the neighbour cells of all its open points."""
    mode = QueryMode(mode)
    hashed = _timed(_prepared(points, params, lsh), spec)
    counts, suspects, definite = _unresolved(hashed, params, spec, mode)
    # with a query mode only the cells of the points asked about are indexed
    asking = suspects.select("win", "cell").distinct()
    near = (
        candidate_pairs(counts, params)
        .join(asking, ["win", "cell"], "left_semi")
        .groupBy("win", F.col("near").alias("cell"))
        .agg(F.max("n").alias("n"))
    )
    models = near.groupBy("win").agg(F.sum("n").alias("n"))
    suspects = _with_k(suspects, models, lsh)
    if lsh.verify:
        found = _few_verified(suspects, _windowed(hashed, spec, lsh), params)
    else:
        indexed = _with_k(points_of_cells(hashed, near, params, spec, keep=("h",)), models, lsh)
        groups = (
            indexed.select("win", _cut(F.col("h"), F.col("k")).alias("sig"))
            .groupBy("win", "sig")
            .agg(F.count("*").alias("n"))
        )
        asks = suspects.select("win", "point_id", _cut(F.col("h"), F.col("k")).alias("sig"))
        found = _few_candidates(asks, groups, ["win"], params.min_pts)
    return _finish(found.unionByName(definite.select("win", "point_id")), points, params, spec, mode)


def detect_lsh_local(
    points: DataFrame,
    params: GridParams,
    spec: WindowSpec | None = None,
    mode: QueryMode | str = QueryMode.ALL,
    lsh: LshParams = LshParams(num_tables=3),
) -> DataFrame:
    """One model per open cell over its own neighbour cells; k follows their size."""
    mode = QueryMode(mode)
    hashed = _timed(_prepared(points, params, lsh), spec)
    counts, suspects, definite = _unresolved(hashed, params, spec, mode)
    suspects = suspects.withColumn("k", hashing.hash_count(F.col("level2_count"), lsh))
    if lsh.verify:
        found = _few_verified(suspects, _windowed(hashed, spec, lsh), params)
    else:
        # points fold to hash signatures per cell before they meet the models in reach
        folded = (
            _windowed(hashed.withColumn("cell", grid.cell_of("coords", params.side)), spec, lsh, ("cell",))
            .groupBy("win", F.col("cell").alias("near"), "sig")
            .agg(F.count("*").alias("n"))
        )
        models = suspects.select("win", "cell", "k").distinct()
        pairs = candidate_pairs(counts, params).drop("n").join(models, ["win", "cell"])
        groups = (
            pairs.join(shuffled(folded), ["win", "near"])
            .select("win", "cell", _cut(F.col("sig"), F.col("k")).alias("sig"), "n")
            .groupBy("win", "cell", "sig")
            .agg(F.sum("n").alias("n"))
        )
        asks = suspects.select("win", "cell", "point_id", _cut(F.col("h"), F.col("k")).alias("sig"))
        found = _few_candidates(asks, groups, ["win", "cell"], params.min_pts)
    return _finish(found.unionByName(definite.select("win", "point_id")), points, params, spec, mode)


def detect_filtered(
    points: DataFrame,
    params: GridParams,
    spec: WindowSpec | None = None,
    mode: QueryMode | str = QueryMode.ALL,
    lsh: LshParams = LshParams(num_tables=4, hashes=2),
) -> DataFrame:
    """Exact detection with hashing in front: whatever verified hashing clears is an inlier,
    and only the flagged points are settled exactly. Pays off in many dimensions, where the
    grid alone clears little. There, points that a bounded part of the data clears are not hashed
    against the rest."""
    lsh = LshParams(**{**lsh.__dict__, "verify": True})
    asked = uncleared(points, params, spec) if params.dims > GRID_DIMS else None
    flagged = detect_lsh(points, params, spec, mode, lsh, asked)
    return settle_points(points, flagged, params, spec, QueryMode(mode))
