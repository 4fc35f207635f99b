"""Tables written between the steps of a plan, and spreading of hot join keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_KEYS = 1000  # rows of a broadcast list of the largest keys
CHUNK_ROWS = 50_000  # rows of one key that a single task takes on
SMALL_ROWS = 100_000  # rows of a table that may be broadcast


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def steps_dropped(spark: SparkSession) -> Iterator[None]:
    """Drop the tables that ``written`` makes inside, once their results have been stored."""
    paths: list[str] = []
    token = _scopes.set((*_scopes.get(), paths))
    try:
        yield
    finally:
        _scopes.reset(token)
        drop_folders(spark, paths)


def drop_folders(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders that this library has written."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see, as named in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="farpoint-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return folder


def written(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and go on from there.

    Cuts the lineage, survives the loss of executors and keeps a step that two later steps
    read from being computed twice. The table stays, unless ``steps_dropped`` encloses the call.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/farpoint-step-{uuid.uuid4().hex}"
    for paths in _scopes.get():
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """Side of a join that may be of any size: never broadcast, however well it compresses."""
    return df.hint("merge")


def largest_keys(counts: DataFrame, keys: list[str], above: Column, listed: int = HOT_KEYS) -> DataFrame:
    """At most ``listed`` keys, the largest first. Any key left out is smaller than
    a thousandth of all rows, so leaving it out costs balance and never rows."""
    return counts.where(above).orderBy(F.desc("n")).limit(listed).select(*keys, "n")


def spread_hot_keys(
    left: DataFrame,
    right: DataFrame,
    keys: list[str],
    counts: DataFrame,
    right_row: list[str] | list[Column],
    chunk: int | None = None,
    name: str = "_chunk",
    every_key: bool = False,
    listed: int = HOT_KEYS,
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Salt an equi-join whose right side has hot keys.

    ``counts`` holds the right-side rows ``n`` per key. Right rows of a hot key are dealt to
    chunks by a hash of ``right_row``; left rows of that key are copied to each chunk; all
    other keys stay as they are. Each pair of rows still meets exactly once.

    ``every_key`` also deals the keys too many for the broadcast list of ``listed`` keys, by a plain join, so
    that no group is larger than about ``chunk`` rows: needed where groups go to memory.
    """
    chunk = CHUNK_ROWS if chunk is None else chunk
    large = counts.where(F.col("n") > chunk).select(*keys, "n")
    hot = F.broadcast(largest_keys(large, keys, F.lit(True), listed).withColumnRenamed("n", "_hot"))
    one = F.lit(1).cast("bigint")

    def dealt(side: DataFrame) -> DataFrame:
        side = side.join(hot, keys, "left")
        size = F.col("_hot")
        if every_key:
            other = large.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("n").alias("_size"))
            # listed keys need no second size: a hash of the row takes the place of their
            # first key, so that this shuffle does not gather them either
            apart = F.xxhash64(*[c for c in side.columns if c not in keys])
            first = F.when(F.col("_hot").isNull(), F.col(keys[0])).otherwise(apart)
            on = [first == F.col(f"_{keys[0]}")] + [F.col(k) == F.col(f"_{k}") for k in keys[1:]]
            side = side.join(shuffled(other), on, "left").drop(*[f"_{k}" for k in keys])
            size = F.coalesce("_hot", "_size")
        parts = F.coalesce(F.ceil(size / F.lit(chunk)), one)
        return side.withColumn("_parts", parts).drop("_hot", "_size")

    right = dealt(right).withColumn(name, F.pmod(F.xxhash64(*right_row), F.col("_parts")))
    left = dealt(left).withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1)))
    return left.drop("_parts"), right.drop("_parts"), [*keys, name]


def dealt_in_lots(
    left: DataFrame, right: DataFrame, keys: list[str], right_row: list[str] | list[Column], lot: int, name: str
) -> tuple[DataFrame, DataFrame, list[str]]:
    """``spread_hot_keys`` for all keys of more than ``lot`` rows. They are counted first: up to
    ``SMALL_ROWS`` of them are broadcast, so neither side is shuffled to learn the size of its key."""
    sizes = written(right.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > lot))
    many = sizes.limit(SMALL_ROWS + 1).count() > SMALL_ROWS
    return spread_hot_keys(left, right, keys, sizes, right_row, lot, name, every_key=many, listed=SMALL_ROWS)


def of_few_keys(rows: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Only the rows of the ``asked`` keys, if these are few enough to be broadcast; otherwise all rows."""
    asked = written(asked.select(*keys).distinct())
    return rows.join(F.broadcast(asked), keys, "left_semi") if asked.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else rows


def with_small(rows: DataFrame, small: DataFrame, keys: list[str], row: list[str]) -> DataFrame:
    """Add the columns of ``small``, one row for each key, to ``rows``.

    ``small`` is counted: up to ``SMALL_ROWS`` it is broadcast, so the rows stay where they are.
    Beyond that both sides are shuffled, with the rows of large keys dealt by ``row``.
    """
    if small.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return rows.join(F.broadcast(small), keys)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    small, rows, keys = spread_hot_keys(small, rows, keys, counts, row, name="_copy", every_key=True)
    return rows.join(shuffled(small), keys).drop("_copy")
