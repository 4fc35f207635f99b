"""Getting points: ``point_id bigint, arrival timestamp, coords array<double>``."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from farpoint.functions.timing import arrival_us
from farpoint.plans.tables import written


def read_point_lines(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Header-less text, one point per line, as ``value`` (and its place, in batch)."""
    if stream:
        return spark.readStream.text(path)
    return (
        spark.read.text(path)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
        )
        .withColumn("line", F.monotonically_increasing_id())
    )


def parse_points(
    lines: DataFrame,
    dims: int,
    value: str | Column = "value",
    delimiter: str = ",",
    mode: str = "failfast",
) -> DataFrame:
    """Add ``coords`` parsed from delimited text.

    ``failfast`` stops the job at a bad line. ``permissive`` keeps the row: ``coords`` is
    null and ``bad`` true where a field is no number or the number of fields is not ``dims``.
    """
    if mode not in ("failfast", "permissive"):
        raise ValueError("mode is 'failfast' or 'permissive'")
    text = F.col(value) if isinstance(value, str) else value
    quoted = "\\Q" + delimiter + "\\E"
    fields = F.transform(F.split(text, quoted), lambda f: F.trim(f).try_cast("double"))
    good = F.coalesce(
        (F.size(fields) == dims) & F.forall(fields, lambda v: v.isNotNull()), F.lit(False)
    )
    if mode == "permissive":
        return lines.withColumns({"coords": F.when(good, fields), "bad": ~good})
    message = F.concat(F.lit(f"not a line of {dims} numbers: "), F.coalesce(text, F.lit("null")))
    stop = F.raise_error(message).cast("array<double>")
    return lines.withColumn("coords", F.when(good, fields).otherwise(stop))


def points_from_columns(
    df: DataFrame,
    point_id: str | Column,
    coords: list[str | Column] | str | Column,
    arrival: str | Column | None = None,
) -> DataFrame:
    """Canonical points out of any table's columns.

    ``coords`` is a list of numeric columns or one numeric array column. ``arrival`` is a
    timestamp, a zone-less timestamp or date (read as UTC), or epoch milliseconds.
    """
    ident = F.col(point_id) if isinstance(point_id, str) else point_id
    if isinstance(coords, list):
        cols = [F.col(c) if isinstance(c, str) else c for c in coords]
        vector = F.array(*[c.cast("double") for c in cols])
    else:
        vector = (F.col(coords) if isinstance(coords, str) else coords).cast("array<double>")
    out = [ident.cast("bigint").alias("point_id"), vector.alias("coords")]
    if arrival is not None:
        timed = df.withColumn("_arrival", F.col(arrival) if isinstance(arrival, str) else arrival)
        if timed.schema["_arrival"].dataType.simpleString() == "timestamp":
            when = F.col("_arrival")
        else:
            when = F.timestamp_micros(arrival_us(timed, "_arrival"))
        return timed.select(out[0], when.alias("arrival"), out[1])
    return df.select(*out)


def row_index(df: DataFrame, order: list[str]) -> DataFrame:
    """Add ``row_index`` 0, 1, 2, ... along a unique order, without a single-task sort.

    Rows are range-partitioned and numbered within each partition; the table is written
    once so that both the numbers and the partition sizes come from the same split. Only
    one size per partition is ever gathered.
    """
    split = written(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("bigint"), 33))
    )
    # one row per partition of the table above, so a single task may order them
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        split.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    return (
        split.join(F.broadcast(starts), "_part")
        .withColumn("row_index", F.col("_start") + F.col("_at"))
        .drop("_part", "_at", "_start")
    )


def arrival_from_order(
    df: DataFrame,
    order: list[str],
    start: datetime,
    step: timedelta = timedelta(milliseconds=1),
) -> DataFrame:
    """Stamp rows with evenly spaced arrivals along a unique order.

    Replays a file at a fixed rate without waiting: row i arrives at ``start + i * step``.
    """
    step_us = round(step.total_seconds() * 1_000_000)
    start_us = round((start - datetime(1970, 1, 1, tzinfo=start.tzinfo)).total_seconds() * 1_000_000)
    return row_index(df, order).withColumn(
        "arrival", F.timestamp_micros(F.lit(start_us) + F.col("row_index") * F.lit(step_us))
    )
