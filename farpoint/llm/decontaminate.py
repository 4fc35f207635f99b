"""Benchmark decontamination by spaced seeds, with DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.llm.steps import BLANKS, fresh, written

# The word places each mask compares. Together they hit every run of 16 words in
# which at most 3 differ.
MASKS = ((0, 1, 2, 3, 4, 5), (0, 1, 2, 5, 6, 7), (0, 1, 3, 4, 6, 7))


@dataclass(frozen=True)
class DecontaminationParams:
    window: int = 16  # words of an overlap; a shorter item is one window
    percent: int = 80  # of them that must agree, place by place
    broadcast_rows: int = 1_000_000  # seeds of the benchmark that are broadcast at most


def with_words(df: DataFrame, text: Column, name: str) -> DataFrame:
    """Adds the hashes of the words: letters and digits, in lower case."""
    plain = F.btrim(F.regexp_replace(F.lower(text), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", " "), F.lit(BLANKS))
    df = df.withColumn("_plain", plain)
    words = F.when(F.col("_plain") == "", F.array().cast("array<string>")).otherwise(F.split("_plain", " "))
    return df.withColumn(name, F.transform(words, lambda w: F.xxhash64(w))).drop("_plain")


def _seeds(rows: DataFrame, words: str, *keep: str, runs: tuple[int, ...] = ()) -> DataFrame:
    """One row per mask, or run of so many words, and place: ``place``, ``seed`` and the kept
    columns. The word array is read in place, it is not copied to the rows."""
    masks = [*enumerate(MASKS), *((len(MASKS) + k, tuple(range(k))) for k in runs)]
    at = rows.select(*keep, words, F.posexplode_outer(words).alias("place", "_w")).drop("_w")

    def seed(n: int, mask: tuple[int, ...]) -> Column:
        inside = F.col("place") + (mask[-1] + 1) <= F.size(words)
        return F.when(inside, F.xxhash64(F.lit(n), *[F.get(words, F.col("place") + j) for j in mask]))

    seeds = F.explode(F.array(*[seed(n, m) for n, m in masks])).alias("seed")
    return at.select(*keep, words, "place", seeds).where("seed is not null")


def _short(items: DataFrame, p: DecontaminationParams) -> DataFrame:
    """Items below one window, cut into one piece more than words may differ, so that a piece is
    whole in every overlap: ``run``, the words of each piece, and ``pieces``."""
    n = F.size("item")
    pieces = F.floor(n * (100 - p.percent) / 100).cast("int") + 1
    short = items.where(n < p.window).withColumn("pieces", F.least(pieces, n))
    return short.withColumn("run", F.floor(n / F.col("pieces")).cast("int"))


def _pieces(short: DataFrame, runs: tuple[int, ...]) -> DataFrame:
    """One row per piece, as ``_seeds`` makes them."""
    at = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("i")
    at = short.select("item_id", "item", "run", at).withColumn("place", F.col("i") * F.col("run"))
    seed = F.lit(None).cast("bigint")
    for k in runs:
        words = [F.get("item", F.col("place") + j) for j in range(k)]
        seed = F.when(F.col("run") == k, F.xxhash64(F.lit(len(MASKS) + k), *words)).otherwise(seed)
    return at.select("item_id", "item", "place", seed.alias("seed"))


def overlaps(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", params: DecontaminationParams | None = None) -> DataFrame:
    """Places where a text overlaps a benchmark item: ``row`` (hash of the text), ``item_id``,
    ``first_word`` (of the text, where the item would begin), ``matched`` (most agreeing words
    in one window) and ``window``.

    Texts and items are cut into words; the seeds of all places are joined, hits of one
    diagonal are one candidate, and the words along it are compared window by window, so
    substituted words are tolerated and inserted ones start another diagonal. Items shorter than
    the window are found by the seeds of their pieces, too, whichever of their words differ.
    """
    p = params or DecontaminationParams()
    items = with_words(benchmark, F.col(item_text_col).cast("string"), "item")
    items = items.select(F.col(item_col).alias("item_id"), "item").where(F.size("item") > 0).distinct()
    short = written(_short(items, p))
    runs = tuple(sorted(r.run for r in short.select("run").distinct().collect()))  # below one window: a few values
    seeds = _seeds(items, "item", "item_id").unionByName(_pieces(short, runs))
    seeds = written(seeds.withColumnRenamed("place", "item_place"))
    if seeds.count() <= p.broadcast_rows:
        seeds = F.broadcast(seeds)
    texts = df.select(text_hash(F.col(text_col)).alias("row"), F.col(text_col).cast("string").alias("_text"))
    texts = with_words(texts, F.col("_text"), "words").drop("_text")
    hits = _seeds(texts, "words", "row", runs=runs).join(seeds, "seed")
    begin = F.col("place") - F.col("item_place")  # where the item's first word would be
    from_word = F.greatest(begin, F.lit(0))
    length = begin + F.size("item") - from_word
    hits = hits.select("row", "item_id", begin.alias("first_word"), "item", F.slice("words", from_word + 1, length).alias("part"))
    hits = hits.groupBy("row", "item_id", "first_word", "item").agg(F.first("part").alias("part"))
    skip = F.greatest(-F.col("first_word"), F.lit(0))
    same = F.transform("item", lambda x, j: F.coalesce((F.get("part", j - skip) == x).cast("int"), F.lit(0)))
    hits = hits.withColumn("same", same).withColumn("window", F.least(F.lit(p.window), F.size("item")))
    starts = F.sequence(F.lit(1), F.size("item") - F.col("window") + 1)
    sums = F.transform(starts, lambda i: F.aggregate(F.slice("same", i, F.col("window")), F.lit(0), lambda a, x: a + x))
    hits = hits.withColumn("matched", F.array_max(sums))
    return hits.where(F.col("matched") * 100 >= F.col("window") * p.percent).select("row", "item_id", "first_word", "matched", "window")


def text_hash(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(text.cast("string")).alias("a"), F.xxhash64(F.lit(3), text.cast("string")).alias("b"))


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: DecontaminationParams | None = None) -> DataFrame:
    """Verdict on every text.

    One row per input row: ``doc_id``, ``contaminated``, ``n_items`` and ``item_ids`` (sorted)
    of the benchmark items it overlaps (see ``overlaps``). A null or empty text overlaps
    nothing, a benchmark item without words is not looked for, a null item id counts
    as an item of its own but is not listed. Repeated rows get the same answer; other columns
    are ignored.
    """
    found = overlaps(df, benchmark, text_col=text_col, params=params)
    found = found.select("row", "item_id").distinct().groupBy("row")
    # no more entries than the benchmark has items
    found = found.agg(F.count("*").alias("n"), F.sort_array(F.collect_list("item_id")).alias("item_ids"))
    out = df.select(F.col(id_col).alias("doc_id"), text_hash(F.col(text_col)).alias("row")).join(found, "row", "left")
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    kind = benchmark.schema["item_id"].dataType.simpleString()
    return out.select("doc_id", (n > 0).alias("contaminated"), n.alias("n_items"), F.coalesce("item_ids", F.array().cast(f"array<{kind}>")).alias("item_ids"))


def clean_rows(df: DataFrame, benchmark: DataFrame, text_col: str = "text", params: DecontaminationParams | None = None) -> DataFrame:
    """The rows of ``df`` that overlap no benchmark item."""
    found = written(overlaps(df, benchmark, text_col=text_col, params=params).select("row").distinct())
    (row,) = fresh(df, "_row")
    marked = df.withColumn(row, text_hash(F.col(text_col)))
    return marked.join(found.withColumnRenamed("row", row), row, "left_anti").drop(row)
