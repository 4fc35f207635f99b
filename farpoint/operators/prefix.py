"""Running sums and ranks over groups of any size.

A plain window function sorts a whole group in one task. Here a group is cut into segments
along its order: the segment totals are summed up first, then each segment on its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from farpoint.plans.tables import shuffled


def running_sum(
    df: DataFrame,
    keys: list[str],
    segment: list[Column],
    order: list[Column],
    value: Column,
    out: str,
    segment_order: list[Column] | None = None,
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group up to this row.

    ``segment`` must rise with ``order`` (or follow ``segment_order``), and ``order`` must
    be unique within a group.
    """
    names = [f"_seg{i}" for i in range(len(segment))]
    rows = df.select("*", value.alias("_v"), *[s.alias(n) for s, n in zip(segment, names)])
    by_segment = segment_order or [F.col(n) for n in names]
    before = (
        Window.partitionBy(*keys)
        .orderBy(*by_segment)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    starts = (
        rows.groupBy(*keys, *names)
        .agg(F.sum("_v").alias("_total"))
        .withColumn("_start", F.sum("_total").over(before) - F.col("_total"))
        .drop("_total")
    )
    inside = (
        Window.partitionBy(*keys, *names)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        rows.withColumn("_run", F.sum("_v").over(inside))
        .join(shuffled(starts), [*keys, *names])
        .withColumn(out, F.col("_start") + F.col("_run"))
        .drop("_v", "_run", "_start", *names)
    )
