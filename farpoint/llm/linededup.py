"""Line dedup: levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from farpoint.llm.steps import BLANKS, fresh, written
from farpoint.plans.tables import shared_folder

# The letters a key folds.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class LineParams:
    min_length: int = 10  # shorter keys are never dropped
    batches: int = 4
    fanout: int = 2  # runs of a level that are compacted into one of the next
    buckets: int = 12  # of every run; raise it with the data


def line_key(line: Column) -> Column:
    """The line without white space around it, A-Z in lower case."""
    return F.btrim(line, F.lit(BLANKS))


def _folded(text: Column) -> Column:
    plain = F.octet_length(text) == F.length(text)  # ASCII: the fast function is the same
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def line_hash(key: Column) -> list[Column]:
    """128 bits, as two columns."""
    return [F.xxhash64(key).alias("a"), F.xxhash64(F.lit(7), key).alias("b")]


class LineRuns:
    """Line hashes seen so far, with the first document of each.

    A run is a table bucketed and sorted by the hash, so a batch that is shuffled once to the
    same buckets is merged with every run without moving the runs. ``fanout`` runs of a level
    become one of the next; a hash is in one run only.
    """

    def __init__(self, spark: SparkSession, params: LineParams) -> None:
        self.spark, self.p = spark, params
        self.levels: list[list[str]] = []
        self.name = f"line_runs_{uuid.uuid4().hex}"
        self.made = 0

    def _write(self, rows: DataFrame) -> str:
        table = f"{self.name}_{self.made}"
        self.made += 1
        path = f"{shared_folder(self.spark).rstrip('/')}/{table}"
        rows = rows.repartition(self.p.buckets, "a", "b")
        rows.write.bucketBy(self.p.buckets, "a", "b").sortBy("a", "b").option("path", path).saveAsTable(table)
        return table

    def runs(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def add(self, batch: DataFrame) -> DataFrame:
        """Take in ``(a, b, doc)`` of a batch whose documents come after all earlier ones.
        Returns the hashes it is the first to hold, each with its smallest document."""
        new = batch.groupBy("a", "b").agg(F.min("doc").alias("doc"))
        for run in self.runs():
            new = new.join(self.spark.table(run).select("a", "b").hint("merge"), ["a", "b"], "left_anti")
        table = self._write(new)
        self._place(table, 0)
        return self.spark.table(table)

    def _place(self, table: str, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(table)
        if len(self.levels[level]) >= self.p.fanout:
            parts = [self.spark.table(t) for t in self.levels[level]]
            merged = parts[0]
            for x in parts[1:]:
                merged = merged.unionAll(x)
            self.levels[level] = []
            self._place(self._write(merged), level + 1)

    def forget(self) -> None:
        """Take the names out of the catalog; the files stay with the job's scratch data."""
        for i in range(self.made):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{i}")


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: LineParams | None = None) -> DataFrame:
    """Every input row with its text less the lines that an earlier document holds.

    Adds ``n_lines`` (before dropping), ``n_dropped`` and ``kept_text``, and keeps the input's
    columns, whatever their names are but those three. A line goes if its key (``line_key``) has at least ``min_length`` code points and
    a document with a smaller id holds it too; lines repeated within the first document stay.
    Null or empty text is one empty line. Rows without an id are together one document after
    all others; rows that share an id are one document. An empty table gives an empty result.

    Documents come in ``batches`` by ranges of their id. Each batch finds its new hashes by
    anti-joins with the sorted runs and becomes a run itself (``LineRuns``).
    """
    p = params or LineParams()
    spark = df.sparkSession
    last = F.lit(2**63 - 1)
    doc = F.coalesce(F.col(id_col).cast("bigint"), last)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    shares = [i / p.batches for i in range(1, p.batches)]
    cuts = df.agg(F.percentile_approx(doc, shares, 10_000)).first()[0] if shares else []
    batch = sum(((doc > c).cast("int") for c in sorted(set(cuts or []))), F.lit(0))
    row = F.xxhash64(text)  # rows that share an id may differ in their text
    parts = F.split(_folded(text), "\n", -1)
    lines = df.select(doc.alias("doc"), row.alias("row"), batch.alias("batch"), F.posexplode_outer(parts).alias("pos", "line"))
    lines = lines.withColumn("line", line_key(F.col("line"))).where(F.length("line") >= p.min_length)
    lines = written(lines.select("batch", "doc", "row", "pos", *line_hash(F.col("line"))))

    runs = LineRuns(spark, p)
    dropped = None
    for i in range(len(set(cuts or [])) + 1):
        own = lines.where(F.col("batch") == i).drop("batch")
        new = runs.add(own)
        # keys of this join are hashes with their document: no line is hot here
        gone = own.join(new.select("a", "b", "doc").hint("merge"), ["a", "b", "doc"], "left_anti")
        dropped = gone if dropped is None else dropped.unionAll(gone)
    # a document's list is no longer than the document
    doc_name, row_name, gone_name, lines_name = fresh(df, "_doc", "_row", "_gone", "_lines")
    lists = dropped.groupBy("doc", "row").agg(F.collect_set("pos").alias(gone_name))
    lists = written(lists.withColumnsRenamed({"doc": doc_name, "row": row_name}))
    runs.forget()

    out = df.withColumns({doc_name: doc, row_name: row}).join(lists, [doc_name, row_name], "left").drop(doc_name, row_name)
    out = out.withColumn(lines_name, F.split(text, "\n", -1))
    n = F.size(lines_name).cast("bigint")
    gone = F.coalesce(gone_name, F.array().cast("array<int>"))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines_name) - 1), gone)
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines_name, i)), "\n")
    return out.withColumns(
        {"n_lines": n, "n_dropped": F.size(gone).cast("bigint"), "kept_text": F.when(F.col(gone_name).isNull(), text).otherwise(kept)}
    ).drop(gone_name, lines_name)
