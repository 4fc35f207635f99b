"""Detection on streams.

Each micro-batch is appended to a table of points partitioned by pane. When the watermark
passes the end of windows, the batch plan runs on exactly their panes and its answer is
appended. State is files in shared storage: it has no memory limit, a lost executor costs a
task, and a repeated batch overwrites its own output. Panes that no open window needs and the
tables between the steps of a batch are dropped again.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from farpoint.functions import grid, timing
from farpoint.params import GridParams, LshParams, QueryMode, WindowSpec
from farpoint.plans.exact import detect_outliers
from farpoint.plans.probing import detect_probed
from farpoint.plans.tables import drop_folders, steps_dropped

PANE_FOLDERS = 1000  # up to so many panes are opened by name
POINT_SCHEMA = "point_id bigint, us bigint, coords array<double>, pane bigint, batch bigint"
PROGRESS_SCHEMA = (
    "batch bigint, watermark_us bigint, closed bigint, n_late bigint, n_outliers bigint, seconds double"
)
OUTLIER_SCHEMA = "window_start timestamp, window_end timestamp, point_id bigint"


@dataclass(frozen=True)
class StreamFolders:
    """Where a stream keeps its files, all below one root in shared storage."""

    root: str

    @property
    def points(self) -> str:
        return f"{self.root}/points"

    @property
    def outliers(self) -> str:
        return f"{self.root}/outliers"

    @property
    def progress(self) -> str:
        return f"{self.root}/progress"

    @property
    def checkpoint(self) -> str:
        return f"{self.root}/checkpoint"


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def _last_progress(spark: SparkSession, folders: StreamFolders, batch: int):
    """The one row the batch before this one left behind."""
    path = f"{folders.progress}/batch-{batch - 1}"
    if not _exists(spark, path):
        return None
    return spark.read.schema(PROGRESS_SCHEMA).parquet(path).first()


def _expire(spark: SparkSession, folders: StreamFolders, first: int) -> None:
    """Drop the panes before the first that an open window needs. The caller passes what the
    batch before has closed: a repeated batch still finds all panes of its windows."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folders.points)
    store = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(root)] if store.exists(root) else []
    panes = [n for n in names if n.startswith("pane=") and int(n.removeprefix("pane=")) < first]
    drop_folders(spark, [f"{folders.points}/{n}" for n in panes])


def _stored_points(spark: SparkSession, folders: StreamFolders, first: int, last: int) -> DataFrame:
    """Points of a run of panes. A short run is opened by folder, without listing the table."""
    paths = [folders.points]
    if last - first < PANE_FOLDERS:
        named = (f"{folders.points}/pane={pane}" for pane in range(first, last + 1))
        paths = [p for p in named if _exists(spark, p)]
        if not paths:
            return spark.createDataFrame([], POINT_SCHEMA)
    stored = spark.read.schema(POINT_SCHEMA).option("basePath", folders.points).parquet(*paths)
    return stored.where(F.col("pane").between(first, last))


def _on_batch(
    folders: StreamFolders, params: GridParams, spec: WindowSpec, mode: QueryMode, delay_us: int, lsh: LshParams | None
):
    def run(batch_rows: DataFrame, batch: int) -> None:
        began = time.monotonic()
        spark = batch_rows.sparkSession
        last = _last_progress(spark, folders, batch)
        closed = last["closed"] if last else None
        if closed is not None:
            _expire(spark, folders, (closed + 1) * spec.panes_per_slide)
        rows = batch_rows.select("point_id", timing.arrival_us(batch_rows, "arrival").alias("us"), "coords")
        # a late point still counts in the windows that are open
        late = F.lit(False) if closed is None else timing.last_window(F.col("us"), spec) <= closed
        seen = Observation()
        rows = rows.observe(
            seen, F.max("us").alias("newest"), F.min("us").alias("oldest"), F.count_if(late).alias("late")
        )
        stored = rows.where(~late).withColumn("pane", timing.pane_of(F.col("us"), spec))
        # a repeated batch overwrites its own folders and no others
        (
            stored.withColumn("batch", F.lit(batch))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("pane", "batch")
            .parquet(folders.points)
        )
        facts = seen.get
        watermark = last["watermark_us"] if last else None
        if facts["newest"] is not None:
            watermark = max(facts["newest"] - delay_us, watermark if watermark is not None else facts["newest"] - delay_us)
        n_outliers = 0
        if watermark is not None:
            newly = (watermark - spec.size_us) // spec.slide_us
            if closed is None:
                # nothing before the first points can have been due
                start = (facts["oldest"] - spec.size_us) // spec.slide_us + 1
            else:
                start = closed + 1
            if newly >= start:
                n_outliers = _close(spark, folders, params, spec, mode, lsh, (start, newly), batch)
                closed = newly
            elif closed is None:
                closed = newly  # only the watermark closes windows, not the first points seen
        row = (batch, watermark, closed, facts["late"], n_outliers, time.monotonic() - began)
        progress = spark.createDataFrame([row], PROGRESS_SCHEMA).coalesce(1)
        progress.write.mode("overwrite").parquet(f"{folders.progress}/batch-{batch}")

    return run


def _close(
    spark: SparkSession,
    folders: StreamFolders,
    params: GridParams,
    spec: WindowSpec,
    mode: QueryMode,
    lsh: LshParams | None,
    windows: tuple[int, int],
    batch: int,
) -> int:
    """Answer the windows that have just ended, from their panes only."""
    first_pane = windows[0] * spec.panes_per_slide
    last_pane = windows[1] * spec.panes_per_slide + spec.panes_per_window - 1
    panes = _stored_points(spark, folders, first_pane, last_pane).select(
        "point_id", F.timestamp_micros("us").alias("arrival"), "coords"
    )
    found = Observation()
    with steps_dropped(spark):
        if lsh is None:
            outliers = detect_outliers(panes, params, spec, mode, only=windows)
        else:
            outliers = detect_probed(panes, params, spec, mode, lsh, only=windows)
        outliers.observe(found, F.count("*").alias("n")).write.mode("overwrite").parquet(
            f"{folders.outliers}/batch-{batch}"
        )
        return found.get["n"]


def stream_outliers(
    points: DataFrame,
    params: GridParams,
    spec: WindowSpec,
    root: str,
    mode: QueryMode | str = QueryMode.ALL,
    delay: timedelta = timedelta(milliseconds=500),
    once: bool = False,
    every: str = "10 seconds",
    lsh: LshParams | None = None,
) -> StreamingQuery:
    """Start detection on a stream of canonical points: exact, or with ``lsh`` by multi-probe
    hashing of each window.

    A window is answered when an arrival is seen that is ``delay`` past its end. ``once``
    works off what is there and stops. Read the answers with :func:`read_stream_outliers`.
    """
    folders = StreamFolders(root.rstrip("/"))
    delay_us = round(delay.total_seconds() * 1_000_000)
    writer = points.writeStream.option("checkpointLocation", folders.checkpoint).foreachBatch(
        _on_batch(folders, params, spec, QueryMode(mode), delay_us, lsh)
    )
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


def read_stream_outliers(spark: SparkSession, root: str) -> DataFrame:
    """All answers so far."""
    return spark.read.schema(OUTLIER_SCHEMA).parquet(f"{StreamFolders(root.rstrip('/')).outliers}/*")


def read_stream_progress(spark: SparkSession, root: str) -> DataFrame:
    """Per micro-batch: watermark, last closed window, late points, outliers and time taken."""
    return spark.read.schema(PROGRESS_SCHEMA).parquet(f"{StreamFolders(root.rstrip('/')).progress}/*")


def stream_cell_counts(
    points: DataFrame, params: GridParams, spec: WindowSpec, delay: timedelta = timedelta(milliseconds=500)
) -> DataFrame:
    """Points per window and cell as a streaming aggregation.

    Append mode gives each count once, when its window has closed; update mode gives the
    counts that changed in each micro-batch.
    """
    size, slide = (f"{us} microseconds" for us in (spec.size_us, spec.slide_us))
    return (
        points.withColumn("cell", grid.cell_of("coords", params.side))
        .withWatermark("arrival", f"{round(delay.total_seconds() * 1000)} milliseconds")
        .groupBy(F.window("arrival", size, slide).alias("window"), "cell")
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "cell", "n")
    )
