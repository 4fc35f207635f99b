"""Small helpers the operators of this package share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.plans.tables import shuffled, written

__all__ = ["BLANKS", "bitmap_of", "fresh", "in_bitmap", "min_links", "read_table", "shuffled", "written"]

#: The characters of ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
BITMAP_BITS = 24


def read_table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def bitmap_of(ids: DataFrame, column: str, bits: int = BITMAP_BITS) -> np.ndarray:
    """Membership filter of fixed size (``2**bits`` bits) over a column of 64 bit hashes.

    Only the folded bits reach the driver. A full filter lets rows through that an exact
    join then drops: it saves work and never decides.
    """
    slot = F.col(column).bitwiseAND((1 << bits) - 1)
    word, bit = F.shiftright(slot, 6), slot.bitwiseAND(63).cast("int")
    rows = ids.select(word.cast("int").alias("w"), F.expr("1L").alias("one"), bit.alias("b"))
    rows = rows.groupBy("w").agg(F.expr("bit_or(shiftleft(one, b))").alias("v"))
    found = rows.toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.w.to_numpy(np.int64)] = found.v.to_numpy(np.int64).view(np.uint64)
    return out


def in_bitmap(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def min_links(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 50) -> DataFrame:
    """Smallest node reachable by links, for every linked node: ``node``, ``root``.

    Alternating star contraction: every node of a neighbourhood is hung below its smallest
    member, first for larger, then for smaller neighbours, until nothing moves. Each round is
    two aggregations, written to the shared folder; no neighbourhood is gathered in a task.
    """
    lo, hi = F.least(a, b), F.greatest(a, b)
    edges = written(links.where(F.col(a) != F.col(b)).select(hi.alias("u"), lo.alias("v")).distinct())
    state = None
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("x"), "m", "u")
        small = small.select(F.expr("stack(2, x, m, u, m) as (u, v)")).where("u <> v").distinct()
        edges = written(small)
        found = edges.agg(
            F.count("*").alias("n"),
            F.countDistinct("u").alias("d"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
        ).first()
        if found.n == 0 or (found == state and found.n == found.d):
            break
        state = found
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    own = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return roots.unionAll(own.join(roots, "node", "left_anti"))


def or_zero(c: str | Column) -> Column:
    return F.coalesce(c, F.lit(0))
