"""What detection has done so far: per window from its answers, per micro-batch from Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from farpoint.operators.prefix import running_sum

SEGMENT_WINDOWS = 1000
BATCH_SCHEMA = "batch bigint, query string, n_rows bigint, seconds double, watermark string, state_rows bigint, late_rows bigint"


def window_metrics(sizes: DataFrame, outliers: DataFrame) -> DataFrame:
    """One row for each window of ``sizes`` (``window_start, n``): its points, its outliers, and
    the number, total and mean of outliers over all windows up to it.

    Windows without outliers count. The running sums go by segments of windows, so a long
    history is not one task's.
    """
    found = outliers.groupBy("window_start").agg(F.count("*").alias("n_outliers"))
    rows = sizes.select("window_start", F.col("n").alias("n_points")).join(found, "window_start", "left")
    rows = rows.withColumn("n_outliers", F.coalesce("n_outliers", F.lit(0).cast("bigint")))
    # segments of time as wide as a thousand windows, by the average distance of two
    facts = rows.agg(F.min(F.unix_micros("window_start")).alias("a"), F.max(F.unix_micros("window_start")).alias("b"), F.count("*").alias("n")).first()
    width = max(1, ((facts.b or 0) - (facts.a or 0)) // max(1, facts.n) * SEGMENT_WINDOWS)
    segment = F.floor(F.unix_micros("window_start") / F.lit(width))
    order = [F.col("window_start")]
    rows = running_sum(rows, [], [segment], order, F.col("n_outliers"), "total_outliers")
    rows = running_sum(rows, [], [segment], order, F.lit(1).cast("bigint"), "n_windows")
    return rows.withColumn("mean_outliers", F.col("total_outliers") / F.col("n_windows"))


class BatchTimes(StreamingQueryListener):
    """Keeps the progress of each micro-batch as a row below ``root``, one folder for each, so a
    query that is started again goes on with the record it has.

    Register it with ``spark.streams.addListener``. ``query`` names the query to follow. A plan
    that reads its source several times counts its rows as often in ``n_rows``.
    """

    def __init__(self, spark: SparkSession, root: str, query: str) -> None:
        self._spark, self._root, self._query = spark, root.rstrip("/"), query

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self._query:
            return
        state = sum(s.numRowsTotal for s in p.stateOperators)
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        row = (p.batchId, p.name, p.numInputRows, p.batchDuration / 1000, p.eventTime.get("watermark"), state, late)
        rows = self._spark.createDataFrame([row], BATCH_SCHEMA).coalesce(1)
        rows.write.mode("overwrite").parquet(f"{self._root}/batch-{p.batchId}")


def read_batch_times(spark: SparkSession, root: str) -> DataFrame:
    """All rows so far, with ``total_seconds`` and ``mean_seconds`` up to each micro-batch."""
    rows = spark.read.schema(BATCH_SCHEMA).parquet(f"{root.rstrip('/')}/batch-*")
    # one row for each micro-batch of one query: a single task may order them
    so_far = Window.partitionBy("query").orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({"total_seconds": F.sum("seconds").over(so_far), "mean_seconds": F.avg("seconds").over(so_far)})
