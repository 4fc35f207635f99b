"""A corpus on its way to training: five stages, each over all that the one before kept.

Every stage but the last returns the columns of ``documents``. Stages are cut by tables in
the shared folder, so a lost executor never sends the work back further than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farpoint.llm.decontaminate import clean_rows
from farpoint.llm.jaccard import keep_one_each
from farpoint.llm.linededup import dedup_lines
from farpoint.llm.quality import keep_good
from farpoint.llm.queries import encoded
from farpoint.llm.steps import BLANKS, read_table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; so does a document of which nothing is left."""
    out = dedup_lines(docs)
    out = out.where((F.col("n_dropped") == 0) | (F.btrim("kept_text", F.lit(BLANKS)) != ""))
    changed = {"text": F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.col("kept_text"))}
    changed["n_chars"] = F.when(F.col("n_dropped") == 0, F.col("n_chars")).otherwise(F.length("kept_text").cast("bigint"))
    return out.withColumns(changed).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return keep_one_each(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return clean_rows(docs, read_table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of what is left, and of their decoding."""
    return encoded(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", jaccard_join),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe),
]

#: BPE cannot be said in SQL; the rows are held against a plain Python version in tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
