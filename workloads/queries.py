"""The registered queries: one per operator, each over whole tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farpoint.functions import grid
from farpoint.functions.timing import arrival_us
from farpoint.operators import accuracy, cells, neighbors, windows
from farpoint.params import GridParams, LshParams, QueryMode, WindowSpec, preset
from farpoint.plans import approximate, exact, probing
from farpoint.plans.tables import shared_folder
from farpoint.sources import points as src
from farpoint.sources import sinks, text_stream
from farpoint.streaming import joined, metrics, state
from farpoint.streaming import outliers as streaming
from farpoint.streaming.state import state_on_disk
from workloads import inputs as inp

Query = Callable[[SparkSession, str], DataFrame]


def _start_ms(spec: WindowSpec) -> Column:
    return (F.col("win") * F.lit(spec.slide_us // 1000)).alias("window_start_ms")


def _ms(name: str) -> Column:
    return F.unix_millis(name).alias(f"{name}_ms")


def _shown(outliers: DataFrame) -> DataFrame:
    return outliers.select(_ms("window_start"), _ms("window_end"), "point_id")


def _cell(name: str = "cell", out: str = "cell") -> Column:
    return grid.cell_id(name).alias(out)


# ---- sources and sinks ----------------------------------------------------------------


def _lines(spark: SparkSession, sf_dir: str, spoilt: bool) -> DataFrame:
    lines = inp.table(spark, sf_dir, "lineitem")
    third = F.col("l_discount").cast("string")
    if spoilt:
        third = F.when(F.col("l_returnflag") == "R", F.lit("n/a")).otherwise(third)
    return lines.select(F.concat_ws(",", "l_quantity", "l_extendedprice", third).alias("value"))


def _coord_columns(df: DataFrame, *more: str | Column) -> DataFrame:
    return df.select(*[F.col("coords")[i].alias(f"x{i}") for i in range(3)], *more)


def parse_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = src.parse_points(_lines(spark, sf_dir, spoilt=True), 3, mode="permissive")
    return _coord_columns(parsed, "bad")


def read_text_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    _lines(spark, sf_dir, spoilt=False).write.text(path)
    return _coord_columns(src.parse_points(src.read_point_lines(spark, path), 3))


def arrival_from_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamped = src.arrival_from_order(
        inp.table(spark, sf_dir, "events").select("event_id"), ["event_id"], datetime(2024, 1, 1), timedelta(milliseconds=1)
    )
    return stamped.select("event_id", _ms("arrival"))


def outlier_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = inp.events(spark, sf_dir, 2)
    found = exact.detect_outliers(points, inp.EVENTS_2D, inp.EVENT_WINDOW, staged=True)
    path = f"{shared_folder(spark)}/outliers-{uuid.uuid4().hex}"
    sinks.write_outlier_text(found, points, path)
    return spark.read.text(path)


# ---- windows and cells ----------------------------------------------------------------


def window_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.assign_windows(inp.events(spark, sf_dir, 1), inp.EVENT_FINE_WINDOW)
    return _shown(windows.with_bounds(rows, inp.EVENT_FINE_WINDOW))


def window_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = windows.window_sizes(inp.events(spark, sf_dir, 1), inp.EVENT_FINE_WINDOW)
    return sizes.select(_start_ms(inp.EVENT_FINE_WINDOW), "n")


def cell_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.assign_cells(inp.events(spark, sf_dir, 3), inp.EVENTS_3D).select("point_id", _cell())


def cell_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    center = grid.cell_center("cell")
    placed = cells.assign_cells(inp.events(spark, sf_dir, 3), inp.EVENTS_3D)
    return placed.select("point_id", *[center[i].alias(f"center{i}") for i in range(3)])


def cell_from_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = cells.assign_cells(inp.events(spark, sf_dir, 3), inp.EVENTS_3D)
    back = placed.withColumn("center", grid.cell_center("cell")).withColumn("cell", grid.cell_from_center("center"))
    return back.select("point_id", _cell())


def _counts(spark: SparkSession, sf_dir: str, params: GridParams) -> DataFrame:
    return cells.cell_counts(inp.events(spark, sf_dir, params.dims), params, inp.EVENT_WINDOW)


def cell_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir, inp.EVENTS_3D).select(_start_ms(inp.EVENT_WINDOW), _cell(), "n")


def cell_counts_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cells.cell_counts(inp.events(spark, sf_dir, 1), inp.EVENTS_1D, inp.EVENT_MANY_WINDOW)
    return counts.select(_start_ms(inp.EVENT_MANY_WINDOW), _cell(), "n")


def dense_prune_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells.dense_prune(inp.events(spark, sf_dir, 1), inp.EVENTS_1D, inp.EVENT_MANY_WINDOW)
    return rows.select(_start_ms(inp.EVENT_MANY_WINDOW), "point_id")


def cell_running_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cells.running_counts(inp.events(spark, sf_dir, 1), inp.EVENTS_1D, inp.EVENT_WINDOW.size)
    return counts.select("point_id", _cell(), F.col("count").alias("cell_count"))


def cell_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = cells.cell_updates(inp.events(spark, sf_dir, 1), inp.EVENTS_1D, inp.EVENT_WINDOW.size)
    return changes.select(_cell(), F.col("at").alias("at_us"), F.col("count").alias("cell_count"))


def cell_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = cells.latest_per_window(inp.events(spark, sf_dir, 1), inp.EVENTS_1D, inp.EVENT_WINDOW)
    return latest.select(
        _start_ms(inp.EVENT_WINDOW), _cell(), F.col("count").alias("cell_count"), F.col("version").alias("version_us")
    )


def slab_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = cells.slab_ranked(_counts(spark, sf_dir, inp.EVENTS_3D), inp.EVENTS_3D)
    return ranked.select(_start_ms(inp.EVENT_WINDOW), "slab", _cell(), "n", "place")


# ---- neighbouring cells ---------------------------------------------------------------


def slab_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbors.slab_pairs(_counts(spark, sf_dir, inp.EVENTS_3D), inp.EVENTS_3D)
    return pairs.select(_start_ms(inp.EVENT_WINDOW), "slab", "other_slab", "n_cells", "n_points")


def neighbor_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbors.leveled_pairs(_counts(spark, sf_dir, inp.EVENTS_2D), inp.EVENTS_2D)
    strict = grid.neighbor_level(F.col("s2"), 2, strict=True)
    return pairs.select(
        _start_ms(inp.EVENT_WINDOW), _cell(), _cell("near", "near"), "s2", "level", strict.alias("level_strict")
    )


def level1_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = neighbors.neighbor_sums(_counts(spark, sf_dir, inp.EVENTS_3D), inp.EVENTS_3D)
    return sums.select(_start_ms(inp.EVENT_WINDOW), _cell(), "n", "level1_count")


def level1_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = neighbors.capped_sums(_counts(spark, sf_dir, inp.EVENTS_3D), inp.EVENTS_3D)
    return sums.select(_start_ms(inp.EVENT_WINDOW), _cell(), "n", "level1_count")


def level2_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = neighbors.neighbor_sums(_counts(spark, sf_dir, inp.EVENTS_2D), inp.EVENTS_2D, level=2)
    return sums.select(_start_ms(inp.EVENT_WINDOW), _cell(), "n", "level1_count", "level2_count")


def candidate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbors.candidate_pairs(_counts(spark, sf_dir, inp.EVENTS_2D), inp.EVENTS_2D)
    return pairs.select(_start_ms(inp.EVENT_WINDOW), _cell(), _cell("near", "near"), "level", "n")


def dense_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells.dense_prune(inp.events(spark, sf_dir, 1), inp.EVENTS_1D, inp.EVENT_WINDOW)
    return rows.select(_start_ms(inp.EVENT_WINDOW), "point_id")


def definite_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbors.definite_outliers(inp.events(spark, sf_dir, 2), inp.EVENTS_2D, inp.EVENT_WINDOW)
    return rows.select(_start_ms(inp.EVENT_WINDOW), "point_id")


def level1_count_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = cells.cell_counts(inp.shipped(spark, sf_dir, 5), inp.SHIPPED_5D, inp.SHIP_WINDOW)
    sums = neighbors.neighbor_sums(counts, inp.SHIPPED_5D)
    return sums.select(_start_ms(inp.SHIP_WINDOW), _cell(), "n", "level1_count")


def definite_outliers_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = neighbors.definite_outliers(inp.shipped(spark, sf_dir, 5), inp.SHIPPED_NEAR_5D, inp.SHIP_WINDOW)
    return rows.select(_start_ms(inp.SHIP_WINDOW), "point_id")


# ---- exact detection ------------------------------------------------------------------


def _exact(mode: QueryMode, spec: WindowSpec = inp.EVENT_WINDOW) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = inp.events(spark, sf_dir, 3)
        return _shown(exact.detect_outliers(points, inp.EVENTS_3D, spec, mode, staged=True))

    return run


def outliers_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = inp.scaled_events(spark, sf_dir)
    return _shown(exact.detect_outliers(points, preset("TAO"), inp.EVENT_WINDOW, staged=True))


def outliers_shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = inp.shipped(spark, sf_dir)
    return _shown(exact.detect_outliers(points, inp.SHIPPED, inp.SHIP_WINDOW))


def outliers_shipped_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = inp.shipped(spark, sf_dir, 10)
    return _shown(exact.detect_outliers(points, inp.SHIPPED_10D, inp.SHIP_WINDOW))


def outliers_embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.detect_outliers(inp.embedded(spark, sf_dir), inp.EMBEDDED).select("point_id")


def outliers_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approximate.detect_filtered(inp.embedded(spark, sf_dir), inp.EMBEDDED).select("point_id")


def range_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = exact.neighbor_counts(inp.events(spark, sf_dir, 3), inp.EVENTS_3D, inp.EVENT_WINDOW, staged=True)
    return counts.select(_ms("window_start"), "point_id", "n_neighbors")


def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = inp.events(spark, sf_dir, 3)
    found = exact.detect_outliers(points, inp.EVENTS_3D, inp.EVENT_WINDOW, staged=True)
    near = exact.nearest_neighbors(points, found, inp.EVENTS_3D, inp.EVENT_WINDOW)
    return near.select(_start_ms(inp.EVENT_WINDOW), "point_id", "neighbor_id", "distance", "place")


# ---- hashing --------------------------------------------------------------------------

ONE_TABLE = LshParams(num_tables=1)
THREE_TABLES = LshParams(num_tables=3)


def lsh_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = approximate.lsh_models(inp.events(spark, sf_dir, 3), inp.EVENTS_3D, inp.EVENT_WINDOW, ONE_TABLE)
    return models.select(_start_ms(inp.EVENT_WINDOW), "n", "width", "k")


def _hashed(detect: Callable, params: GridParams, lsh: LshParams, verify: bool) -> Query:
    chosen = LshParams(num_tables=lsh.num_tables, verify=verify)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = inp.events(spark, sf_dir, params.dims)
        return _shown(detect(points, params, inp.EVENT_WINDOW, lsh=chosen))

    return run


PROBED = LshParams(num_tables=1, probes=8)
PROBED_TABLES = LshParams(num_tables=2, probes=12)


def outliers_lsh_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(probing.detect_probed(inp.events(spark, sf_dir, 3), inp.EVENTS_3D, inp.EVENT_WINDOW, lsh=PROBED))


def knn_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = inp.events(spark, sf_dir, 3)
    found = exact.detect_outliers(points, inp.EVENTS_3D, inp.EVENT_WINDOW, staged=True)
    near = probing.nearest_probed(points, found, inp.EVENTS_3D, inp.EVENT_WINDOW, PROBED_TABLES, within=inp.EVENTS_3D.radius)
    return near.select(_start_ms(inp.EVENT_WINDOW), "point_id", "neighbor_id", "distance", "place")


def accuracy_of_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = inp.events(spark, sf_dir, 3)
    truth = exact.detect_outliers(points, inp.EVENTS_3D, inp.EVENT_WINDOW, staged=True)
    approx = approximate.detect_lsh(points, inp.EVENTS_3D, inp.EVENT_WINDOW, lsh=ONE_TABLE)
    matched = accuracy.label_match(truth, approx, ["window_start", "point_id"])
    sizes = windows.with_bounds(windows.window_sizes(points, inp.EVENT_WINDOW), inp.EVENT_WINDOW).drop("window_end")
    table = accuracy.confusion(matched, sizes, ["window_start"])
    return table.select(_ms("window_start"), "tp", "fp", "tn", "fn", "precision", "recall")


# ---- streaming ------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str, dims: int = 2) -> DataFrame:
    """The events as they would have come in: one micro-batch for each slice of time."""
    table = inp.table(spark, sf_dir, "events")
    folder = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}"
    first, last = table.agg(F.min("ts"), F.max("ts")).first()
    number = F.lit(0)
    for i in range(1, inp.STREAM_BATCHES if first else 1):
        number = number + (F.col("ts") >= F.lit(first + i * (last - first) / inp.STREAM_BATCHES)).cast("int")
    for i in range(inp.STREAM_BATCHES):  # files of a slice are older than those of the next
        table.where(number == i).repartition(inp.STREAM_FILES).write.mode("append").parquet(folder)
    rows = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", inp.STREAM_FILES).parquet(folder)
    return src.points_from_columns(rows, "event_id", inp.event_coords(dims), "ts")


def _run_to_end(stream: DataFrame) -> DataFrame:
    """All rows that a streaming plan gives for what is there now."""
    spark = stream.sparkSession
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", f"{root}/checkpoint")
    with state_on_disk(spark):
        writer.trigger(availableNow=True).format("parquet").start(f"{root}/rows").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")


def outliers_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    streaming.stream_outliers(
        _event_stream(spark, sf_dir), inp.EVENTS_2D, inp.EVENT_WINDOW, root, delay=inp.STREAM_DELAY, once=True
    ).awaitTermination()
    return _shown(streaming.read_stream_outliers(spark, root))


def outliers_stream_probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    streaming.stream_outliers(
        _event_stream(spark, sf_dir), inp.EVENTS_2D, inp.EVENT_WINDOW, root, delay=inp.STREAM_DELAY, once=True, lsh=PROBED
    ).awaitTermination()
    return _shown(streaming.read_stream_outliers(spark, root))


def outliers_stream_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = joined.stream_outliers_joined(_event_stream(spark, sf_dir), inp.EVENTS_2D, inp.EVENT_WINDOW, inp.STREAM_DELAY)
    return _shown(_run_to_end(stream))


def cell_counts_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = streaming.stream_cell_counts(
        _event_stream(spark, sf_dir), inp.EVENTS_2D, inp.EVENT_WINDOW, inp.STREAM_DELAY
    )
    return _run_to_end(counts).select(_ms("window_start"), _cell(), "n")


def cell_running_count_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _event_stream(spark, sf_dir, 1)
    counts = state.stream_running_counts(points, inp.EVENTS_1D, inp.EVENT_WINDOW.size, inp.STREAM_DELAY)
    return _run_to_end(counts).select("point_id", _cell(), F.col("count").alias("cell_count"))


def cell_updates_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _event_stream(spark, sf_dir, 1)
    changes = state.stream_cell_updates(points, inp.EVENTS_1D, inp.EVENT_WINDOW.size, inp.STREAM_DELAY)
    return _run_to_end(changes).select(_cell(), F.col("at").alias("at_us"), F.col("count").alias("cell_count"))


def window_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _run_to_end(joined.stream_window_sizes(_event_stream(spark, sf_dir), inp.EVENT_WINDOW, inp.STREAM_DELAY))
    stream = joined.stream_outliers_joined(_event_stream(spark, sf_dir), inp.EVENTS_2D, inp.EVENT_WINDOW, inp.STREAM_DELAY)
    table = metrics.window_metrics(sizes, _run_to_end(stream))
    return table.select(_ms("window_start"), "n_points", "n_outliers", "n_windows", "total_outliers", "mean_outliers")


def _text_slices(spark: SparkSession, table: DataFrame, by: str, value: Column) -> str:
    """A folder of text files, written slice by slice along a column."""
    folder = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}"
    first, last = table.agg(F.min(by), F.max(by)).first()
    number = F.lit(0)
    for i in range(1, inp.STREAM_BATCHES if first is not None else 1):
        number = number + (F.col(by) >= F.lit(first + (last - first) * i / inp.STREAM_BATCHES)).cast("int")
    for i in range(inp.STREAM_BATCHES):
        table.where(number == i).repartition(inp.STREAM_FILES).select(value).write.mode("append").text(folder)
    return folder


def text_stream_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as points of a stream: coordinates, how often an id is given, and whether the
    arrival is one of today's files."""
    lines = inp.table(spark, sf_dir, "lineitem")
    value = F.concat_ws(",", "l_quantity", "l_extendedprice", "l_discount")
    began = F.timestamp_micros(F.lit(int(time.time() * 1_000_000) - 60_000_000))
    folder = _text_slices(spark, lines, "l_orderkey", value)
    points = _run_to_end(text_stream.stream_text_points(spark, folder, 3, files_per_batch=inp.STREAM_FILES))
    copies = points.groupBy("point_id").agg(F.count("*").alias("copies"))
    rows = points.join(copies.hint("merge"), "point_id")
    return _coord_columns(rows, "copies", (F.col("arrival") >= began).alias("stamped"))


def text_stream_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = inp.table(spark, sf_dir, "events")
    us = arrival_us(table, "ts")
    folder = _text_slices(spark, table, "ts", F.concat_ws(",", us, *inp.event_coords(2)))
    root = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    with state_on_disk(spark):
        text_stream.detect_text_stream(
            spark, folder, f"{root}/text", f"{root}/checkpoint", inp.EVENTS_2D, inp.EVENT_WINDOW, 0, inp.STREAM_DELAY, True,
            inp.STREAM_FILES,
        ).awaitTermination()
    return text_stream.read_outlier_text(spark, f"{root}/text")


QUERIES: dict[str, Query] = {
    "outliers_exact": _exact(QueryMode.ALL),
    "outliers_exact_fine": _exact(QueryMode.ALL, inp.EVENT_FINE_WINDOW),
    "outliers_preset": outliers_preset,
    "outliers_shipped": outliers_shipped,
    "outliers_shipped_wide": outliers_shipped_wide,
    "outliers_embedded": outliers_embedded,
    "outliers_filtered": outliers_filtered,
    "mode_all": _exact(QueryMode.ALL),
    "mode_newest": _exact(QueryMode.NEWEST),
    "mode_expiring": _exact(QueryMode.EXPIRING),
    "mode_middle_expiring": _exact(QueryMode.MIDDLE_EXPIRING, inp.EVENT_FINE_WINDOW),
    "range_count": range_count,
    "knn_topk": knn_topk,
    "parse_points": parse_points,
    "read_text_points": read_text_points,
    "arrival_from_order": arrival_from_order,
    "outlier_text": outlier_text,
    "window_assign": window_assign,
    "window_sizes": window_sizes,
    "cell_assign": cell_assign,
    "cell_center": cell_center,
    "cell_from_center": cell_from_center,
    "cell_counts": cell_counts,
    "cell_counts_many": cell_counts_many,
    "dense_prune_many": dense_prune_many,
    "outliers_odd_slide": _exact(QueryMode.ALL, inp.EVENT_ODD_WINDOW),
    "cell_running_count": cell_running_count,
    "cell_updates": cell_updates,
    "cell_latest": cell_latest,
    "slab_ranked": slab_ranked,
    "slab_pairs": slab_pairs,
    "neighbor_level": neighbor_level,
    "level1_count": level1_count,
    "level1_capped": level1_capped,
    "level2_count": level2_count,
    "candidate_pairs": candidate_pairs,
    "dense_prune": dense_prune,
    "definite_outliers": definite_outliers,
    "level1_count_wide": level1_count_wide,
    "definite_outliers_wide": definite_outliers_wide,
    "lsh_params": lsh_params,
    "outliers_lsh": _hashed(approximate.detect_lsh, inp.EVENTS_3D, ONE_TABLE, True),
    "outliers_lsh_candidates": _hashed(approximate.detect_lsh, inp.EVENTS_3D, ONE_TABLE, False),
    "outliers_lsh_shared": _hashed(approximate.detect_lsh_shared, inp.EVENTS_2D, THREE_TABLES, True),
    "outliers_lsh_shared_candidates": _hashed(
        approximate.detect_lsh_shared, inp.EVENTS_2D, THREE_TABLES, False
    ),
    "outliers_lsh_local": _hashed(approximate.detect_lsh_local, inp.EVENTS_2D, THREE_TABLES, True),
    "outliers_lsh_local_candidates": _hashed(
        approximate.detect_lsh_local, inp.EVENTS_2D, THREE_TABLES, False
    ),
    "outliers_lsh_probed": outliers_lsh_probed,
    "knn_lsh": knn_lsh,
    "accuracy": accuracy_of_lsh,
    "outliers_stream": outliers_stream,
    "outliers_stream_probed": outliers_stream_probed,
    "outliers_stream_joined": outliers_stream_joined,
    "cell_counts_stream": cell_counts_stream,
    "cell_running_count_stream": cell_running_count_stream,
    "cell_updates_stream": cell_updates_stream,
    "window_metrics": window_metrics,
    "text_stream_points": text_stream_points,
    "text_stream_outliers": text_stream_outliers,
}
