"""Multi-probe hashing: nearest neighbours out of hash buckets, and detection with them.

Each table cuts space by its first ``k`` random projections, where ``k`` follows the number of
points in the window. A question looks into its own bucket and into the ``probes`` buckets that
its neighbours are likeliest to lie in, by the distance of its hashes to their borders. So one
table finds what otherwise takes several, and no table is stored more than once.

Buckets are the join key. Points and questions of a bucket are dealt to lots of a bounded size
on both sides, a lot meets in one task as matrices, and gives at most ``top`` neighbours of each
question: pairs are neither shuffled nor kept. The lots' shares of a question are merged by a
second top-``top``, after removing what several tables have found.

That a question needs more than its own bucket shows in ``detect_probed``: a point that has
fewer than ``min_pts`` neighbours among the candidates within the radius is an outlier, so what
is missed raises false alarms and never hides an outlier.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from farpoint.functions import hashing, nearest, timing
from farpoint.operators.cells import cell_counts, points_of_cells
from farpoint.operators.neighbors import neighbor_sums
from farpoint.operators.windows import assign_windows, window_sizes
from farpoint.params import GridParams, LshParams, QueryMode, WindowSpec
from farpoint.plans.exact import SURE_NEIGHBOR_DIMS, Layout, finite, lonely_by_nature
from farpoint.plans.tables import shuffled, spread_hot_keys, with_small, written

LOT_ROWS = 50_000  # points that a task holds at a time, beyond the rows of one chunk
CHUNK_ROWS = 20_000  # of one bucket, on either side


def _timed(points: DataFrame, spec: WindowSpec | None) -> DataFrame:
    us = timing.arrival_us(points, "arrival") if spec else F.lit(0).cast("bigint")
    return points.withColumn("us", us)


def _buckets(rows: DataFrame, models: DataFrame, params: GridParams, lsh: LshParams, most: int, probes: int) -> DataFrame:
    """One row for each table and bucket of ``(win, point_id, coords)``; the window's ``k`` is
    taken from ``models``, ``most`` is the largest of them."""
    width = lsh.width_for(params.radius)
    tables = [t[:most] for t in hashing.projections(lsh, params.dims, params.radius)]
    rows = with_small(rows.select("win", "point_id", "coords"), models, ["win"], ["point_id"])
    values = F.array(*[F.array(*hashing.hash_values(F.col("coords"), t, width)) for t in tables])
    rows = rows.select("win", "point_id", "coords", "k", F.posexplode(values).alias("table", "values"))
    found = hashing.probe_sequence(F.slice("values", F.lit(1), F.col("k")), probes)
    return rows.select("win", "point_id", "coords", "table", F.explode(found).alias("bucket"))


def bucket_neighbors(
    asked: DataFrame,
    points: DataFrame,
    params: GridParams,
    spec: WindowSpec | None = None,
    lsh: LshParams = LshParams(),
    top: int | None = None,
    within: float | None = None,
) -> DataFrame:
    """The ``top`` (default ``min_pts``) nearest other points that share a bucket with each row of
    ``asked`` (``win, point_id, coords``): ``win, point_id, neighbor_id, distance, place``.

    ``within`` leaves out candidates beyond a distance. Points and questions whose coordinates
    are not all finite find nothing.
    """
    top = params.min_pts if top is None else top
    points = points.where(finite(params.dims))
    sizes = written(window_sizes(points, spec))
    models = sizes.select("win", hashing.hash_count(F.col("n"), lsh).alias("k"))
    facts = sizes.agg(F.max(hashing.hash_count(F.col("n"), lsh)).alias("k"), F.sum("n").alias("n")).first()
    if facts.k is None or top < 1:
        return asked.sparkSession.createDataFrame([], f"{nearest.SCHEMA}, place bigint")
    members = _buckets(assign_windows(points, spec), models, params, lsh, facts.k, 0)
    questions = _buckets(asked.where(finite(params.dims)), models, params, lsh, facts.k, lsh.probes)
    key = ["win", "table", "bucket"]
    held = written(members.groupBy(*key).agg(F.count("*").alias("n")))
    # questions of empty buckets find nothing; and both sides of a hot bucket are dealt to chunks
    questions = written(questions.join(shuffled(held.select(*key)), key, "left_semi"))
    asking = questions.groupBy(*key).agg(F.count("*").alias("n"))
    members = members.join(shuffled(asking.select(*key)), key, "left_semi")
    questions, members, key = spread_hot_keys(questions, members, key, held, ["point_id"], CHUNK_ROWS, "_part", every_key=True)
    per_part = questions.groupBy(*key).agg(F.count("*").alias("n"))
    members, questions, key = spread_hot_keys(members, questions, key, per_part, ["point_id"], CHUNK_ROWS, "_share", every_key=True)
    lots = max(1, -(-facts.n * lsh.num_tables // LOT_ROWS))
    name = F.xxhash64(*key)
    columns = [name.alias("key"), F.pmod(name, F.lit(lots)).alias("lot"), "win", "point_id", "coords"]
    found = (
        questions.select(*columns).groupBy("lot")
        .cogroup(members.select(*columns).groupBy("lot"))
        .applyInArrow(nearest.finder(top, within), nearest.SCHEMA)
    )
    found = found.repartition("win", "point_id").dropDuplicates(["win", "point_id", "neighbor_id"])
    order = Window.partitionBy("win", "point_id").orderBy("distance", "neighbor_id")
    return found.withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= top)


def nearest_probed(
    points: DataFrame,
    asked: DataFrame,
    params: GridParams,
    spec: WindowSpec | None = None,
    lsh: LshParams = LshParams(num_tables=2, probes=12),
    top: int | None = None,
    within: float | None = None,
) -> DataFrame:
    """``nearest_neighbors`` out of hash buckets: for each row of ``asked`` (``window_start,
    point_id``). Every neighbour found is one; some may be missed."""
    win = timing.floor_div(F.unix_micros("window_start"), spec.slide_us) if spec else F.lit(0).cast("bigint")
    rows = asked.select("point_id", win.alias("win")).join(shuffled(points.select("point_id", "coords")), "point_id")
    return bucket_neighbors(rows, points, params, spec, lsh, top, within)


def detect_probed(
    points: DataFrame,
    params: GridParams,
    spec: WindowSpec | None = None,
    mode: QueryMode | str = QueryMode.ALL,
    lsh: LshParams = LshParams(probes=8),
    only: tuple[int, int] | None = None,
) -> DataFrame:
    """Points with fewer than ``min_pts`` candidates within the radius among the buckets they look
    into: ``window_start, window_end, point_id``. The grid clears what it can first. ``only``
    limits the answer to the windows numbered from its first to its last value."""
    mode, k = QueryMode(mode), params.min_pts
    placed = _timed(points.where(finite(params.dims)), spec)
    cells = cell_counts(placed, params, spec)
    if params.dims <= SURE_NEIGHBOR_DIMS:
        cells = neighbor_sums(cells, params).where(F.col("level1_count") - 1 < k)
    else:
        cells = cells.where(F.col("n") - 1 < k)
    if only is not None:
        cells = cells.where(F.col("win").between(*only))
    open_points = points_of_cells(placed, cells, params, spec, k + 1, keep=("us", "coords"))
    chosen = timing.mode_windows(F.col("us"), spec, mode)
    if chosen is not None:
        open_points = open_points.where(F.col("win").isin(*chosen))
    open_points = written(open_points.select("win", "point_id", "coords"))
    near = bucket_neighbors(open_points, points, params, spec, lsh, k, params.radius)
    enough = near.where(F.col("place") == k).select("win", "point_id")
    few = open_points.select("win", "point_id").join(enough, ["win", "point_id"], "left_anti")
    lonely = lonely_by_nature(_timed(points, spec), Layout(params, spec, only), mode)
    rows = (few if k > 0 else few.limit(0)).unionByName(lonely.select("win", "point_id"))
    return rows.select(*timing.window_bounds(F.col("win"), spec), "point_id")
