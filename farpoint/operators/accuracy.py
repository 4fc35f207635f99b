"""How an approximate answer compares with the exact one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_match(exact: DataFrame, approximate: DataFrame, keys: list[str]) -> DataFrame:
    """Every point that either answer calls an outlier, with both labels."""
    return exact.select(*keys, F.lit(True).alias("in_exact")).join(
        approximate.select(*keys, F.lit(True).alias("in_approx")), keys, "full_outer"
    ).select(
        *keys,
        F.coalesce("in_exact", F.lit(False)).alias("exact"),
        F.coalesce("in_approx", F.lit(False)).alias("approx"),
    )


def confusion(matched: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """Confusion matrix, precision and recall per group of the non-empty list ``by``.

    Points that both answers call inliers never leave their table: they are the group's
    size minus the rest.
    """
    cases = {"tp": (True, True), "fp": (False, True), "fn": (True, False)}
    sums = matched.groupBy(*by).agg(
        *[
            F.sum(F.when((F.col("exact") == e) & (F.col("approx") == a), 1).otherwise(0)).alias(name)
            for name, (e, a) in cases.items()
        ]
    )
    full = sizes.join(sums, by, "left").na.fill(0, ["tp", "fp", "fn"])
    return full.select(
        *by,
        "tp",
        "fp",
        (F.col("n") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"),
        "fn",
        F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")).alias("precision"),
        F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")).alias("recall"),
    )
