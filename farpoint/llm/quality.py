"""Quality rules: per-text counts, then cross-document line frequency per host."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.llm.steps import BLANKS, fresh, shuffled, written


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 20
    repeat_percent: int = 30  # of the words may lie in repeated windows
    window: int = 8
    host_documents: int = 25  # a line in more distinct documents of one host is boilerplate
    left_percent: int = 15  # of the words must be left when such lines are gone


# Letters of scripts written without blanks (Thai, Lao, Burmese, Khmer, kana, Han): each weighs as a word.
UNSPACED = "\\x{0E00}-\\x{0EFF}\\x{1000}-\\x{109F}\\x{1780}-\\x{17FF}\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}\\x{20000}-\\x{323AF}"


def _without(text: Column, characters: str) -> Column:
    return F.regexp_replace(text, characters, "")


def base_counts(texts: DataFrame, p: QualityParams) -> DataFrame:
    """Adds the counts of the ``text`` column. Every step works inside one row; the costly one
    (places of repeated windows) only where two windows of the text are equal."""
    df = texts.withColumn("_trimmed", F.btrim("text", F.lit(BLANKS)))
    words = F.when(F.col("_trimmed") == "", F.array().cast("array<string>")).otherwise(F.split("_trimmed", "[\\x20\\x09-\\x0D]+"))
    df = df.withColumn("_words", words).drop("_trimmed")
    df = df.withColumn("_lines", F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    df = df.select(
        *[c for c in df.columns if c not in ("_words", "_lines")],
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.concat_ws("", "_words")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), "[#*$%&|<>]"))).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
    )
    k = p.window
    last = F.col("n_words").cast("int") - k
    windows = F.when(
        last > 0,
        F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.xxhash64(F.slice("_hashes", i, k))),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_windows", windows).drop("_hashes")
    df = df.withColumn("_again", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    # windows in order of their hash, then those equal to a neighbour, then their places
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_sorted", F.when(F.col("_again"), placed)).drop("_windows", "_again")
    size = F.size("_sorted")

    def twin(e: Column, j: Column) -> Column:
        before = (j > 0) & (F.get("_sorted", j - 1)["h"] == e["h"])
        after = (j < size - 1) & (F.get("_sorted", j + 1)["h"] == e["h"])
        return before | after

    df = df.withColumn("_places", F.sort_array(F.transform(F.filter("_sorted", twin), lambda e: e["i"]))).drop("_sorted")
    covered = F.aggregate(
        "_places",
        F.struct(F.lit(0).alias("n"), F.lit(-k).alias("at")),
        lambda s, i: F.struct((s["n"] + F.least(F.lit(k), i - s["at"])).alias("n"), i.alias("at")),
        lambda s: s["n"],
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).drop("_places")


def _lines(texts: DataFrame, p: QualityParams) -> DataFrame:
    """One row per line: its text and host, the hash of the line (white space folded, lower
    case, digits as one) and its words, where a letter of a script without blanks is one."""
    plain = F.regexp_replace(F.lower(F.btrim("text", F.lit(BLANKS))), "[0-9]+", "0")
    df = texts.select("row", "host", F.split(plain, "\n").alias("lines"))
    normal = F.transform("lines", lambda x: F.btrim(F.regexp_replace(x, "[\\x20\\x09-\\x0D]+", " ")))
    df = df.select("row", "host", F.filter(normal, lambda x: x != "").alias("lines"))

    def words(x: Column) -> Column:
        spaced = F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1
        pieces = F.regexp_count(x, F.lit(f"[{UNSPACED}]|[^ {UNSPACED}]+"))
        return F.when(F.rlike(x, F.lit(f"[{UNSPACED}]")), pieces).otherwise(spaced)

    keyed = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("line"), words(x).alias("words")))
    df = df.select("row", "host", F.explode_outer(keyed).alias("k"))
    return df.where("k is not null").select("row", "host", "k.line", "k.words")  # outer: no filter computes it again


def quality_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", params: QualityParams | None = None
) -> DataFrame:
    """Counts and verdict of every text.

    One row per input row: ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``kept`` and ``percent_left`` (of the words,
    in lines that stay). Null text counts as empty: no words, so it fails. Null hosts
    are one host. Repeated rows get the same answer; other columns are ignored.

    Lines found in more than ``host_documents`` distinct documents of their host are removed,
    where rows of equal text are one document, be the line ever so short;
    a document with less than ``left_percent`` of its words left is rejected.
    """
    p = params or QualityParams()
    texts = _texts(df, text_col, host_col, F.col(id_col).alias("doc_id"))
    # written: a filter on the answer would be pushed below the counts, and compute them again
    base = written(base_counts(texts, p).drop("text", "host").withColumn("base_failed", _base_failed(p)))
    out = base.join(_shares(texts, p), "row", "left")
    left = F.coalesce("left", F.lit(100)).cast("bigint")
    kept = ~F.col("base_failed") & (left >= p.left_percent)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        kept.alias("kept"), left.alias("percent_left"),
    )


def keep_good(df: DataFrame, text_col: str = "text", host_col: str = "source", params: QualityParams | None = None) -> DataFrame:
    """The rows of ``df`` that ``quality_rules`` keeps."""
    p = params or QualityParams()
    texts = _texts(df, text_col, host_col)
    failed = written(base_counts(texts, p).select("row", _base_failed(p).alias("failed"))).where("failed").select("row")
    poor = _shares(texts, p).where(F.col("left") < p.left_percent).select("row")
    (row,) = fresh(df, "_row")
    gone = written(failed.unionAll(poor).distinct()).withColumnRenamed("row", row)
    text, host = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, host_col))
    # rejected texts grow with the corpus: one plan at every size, and no broadcast
    return df.withColumn(row, _row_hash(text, host)).join(shuffled(gone), row, "left_anti").drop(row)


def _row_hash(text: Column, host: Column) -> Column:
    """128 bits that stand for both."""
    return F.struct(F.xxhash64(text, host).alias("a"), F.xxhash64(F.lit(1), host, text).alias("b"))


def _texts(df: DataFrame, text_col: str, host_col: str, *keep: Column) -> DataFrame:
    """``text``, ``host`` and ``row``, which stands for both."""
    text, host = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (text_col, host_col))
    return df.select(*keep, text.alias("text"), host.alias("host"), _row_hash(text, host).alias("row"))


def _base_failed(p: QualityParams) -> Column:
    return (F.col("n_words") < p.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * p.repeat_percent)


def _shares(texts: DataFrame, p: QualityParams) -> DataFrame:
    """Percent of the words of each text that are ``left`` without its host's frequent lines."""
    lines = written(_lines(texts, p))
    keys = ["host", "line"]
    found = lines.select(*keys, "row").distinct()
    often = written(found.groupBy(*keys).count().where(F.col("count") > p.host_documents).select(*keys, F.lit(True).alias("often")))
    # the frequent lines are broadcast only if the table is small enough for it
    marked = lines.join(often, keys, "left")
    part = marked.groupBy("row").agg(
        F.sum("words").alias("all"), F.sum(F.when(F.col("often"), F.col("words")).otherwise(0)).alias("gone")
    )
    left = F.floor((F.col("all") - F.col("gone")) * 100 / F.col("all"))
    return part.select("row", left.alias("left"))
