"""Interaction audit of document filters: what each filter removes in every order of them.

1. Every document gets a mask, one bit for each filter that it fails. Documents fold to
   cells ``(part, mask)`` with their counts; no document is looked at again after that.
2. A recursive CTE walks all orders: a row is a prefix of an order with the bits applied so
   far. A level extends each prefix by every unused letter, joins the mask cells of its part
   and emits the metrics of that step.
3. A removal by a prefix of ``k`` letters happens in ``(n - k)!`` full orders; that weight
   gives the sums over all orders without listing them.

The identical-text filter needs one row for each text: the smallest ``doc_id`` of a text is
found by an aggregation with partial sums, however many copies there are.

Defined results. A null text is empty; a null part is the empty string, and joins a part of
that name. Rows repeated as a whole count each. A null ``doc_id`` is neither smaller nor
larger than another, so such a row is never a copy and has no labels. A document with several
label rows is good (toxic) if one of them says so. No documents: no rows. Extra columns are
not looked at, whatever their names are.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farpoint.llm.steps import or_zero, written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WHITE = r"[\x20\x09-\x0D]+"

#: Filters of ``audit_documents`` in the order of their bits; the last is the copy filter.
LETTERS = "ABCDE"


def text_conditions(text: Column) -> list[Column]:
    """Failure conditions on one text: short, repetitive, shouting, symbols."""
    words = F.filter(F.split(text, _WHITE), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    upper = F.length(text) - F.length(F.translate(text, _UPPER, ""))
    return [n < 200, 100 * distinct < 50 * n, 100 * upper > 3 * F.length(text), text.rlike(r"[#$%&*|]")]


def mask_of(conditions: list[Column]) -> Column:
    """Bit ``i`` is set if condition ``i`` holds; a null condition does not."""
    out = F.lit(0)
    for i, c in enumerate(conditions):
        out = out.bitwiseOR(F.when(c, 1 << i).otherwise(0))
    return out


def label_flags(labels: DataFrame) -> DataFrame:
    """One row for each labelled document: ``doc_id, good, toxic`` as 0 or 1."""
    flags = [F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))]
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*flags)


def mask_cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the filters they fail."""
    text = F.coalesce("text", F.lit(""))
    last = 1 << (len(LETTERS) - 1)
    rows = docs.select(
        "doc_id",
        F.coalesce("lang", F.lit("")).alias("part"),
        mask_of(text_conditions(text)).alias("mask"),
        F.unhex(F.md5(text.cast("binary"))).alias("body"),
    )
    # narrow, and read by both sides of the next join: texts are gone through once
    rows = written(rows.groupBy("body", "doc_id", "part", "mask").agg(F.count("*").alias("n")))
    first = rows.groupBy("body").agg(F.min("doc_id").alias("doc_id")).withColumn("_first", F.lit(True))
    rows = rows.join(first, ["body", "doc_id"], "left")
    copy = F.col("_first").isNull() & F.col("doc_id").isNotNull()
    rows = rows.withColumn("mask", F.col("mask").bitwiseOR(F.when(copy, last).otherwise(0)))
    rows = rows.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    rows = rows.join(label_flags(labels), "doc_id", "left")
    return rows.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * or_zero("good")).alias("good"),
        F.sum(F.col("n") * or_zero("toxic")).alias("toxic"),
    )


def _walk_sql(letters: str) -> str:
    """The recursion over prefixes. ``cells`` has one row for each part."""
    bit = "shiftleft(1, instr('{0}', letter) - 1)".format(letters)

    def total(what: str, where: str) -> str:
        return f"aggregate(c.cells, 0L, (s, x) -> s + if({where}, x.{what}, 0L))"

    here = "(x.mask & bit) <> 0 AND (x.mask & applied) = 0"
    unused = f"filter(split('{letters}', ''), x -> instr(filter_order, x) = 0)"
    return f"""
    WITH RECURSIVE walk(part, filter_order, step, applied, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
      SELECT part, CAST('' AS STRING), 0, 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {{cells}}
      UNION ALL
      SELECT w.part, concat(filter_order, letter), step + 1, applied | bit,
        {total('n', '(x.mask & (applied | bit)) = 0')}, {total('n', here)},
        {total('n', '(x.mask & bit) <> 0 AND (x.mask & applied) <> 0')}, {total('n', 'x.mask = bit')},
        {total('good', here)}, {total('toxic', here)}
      FROM (
        SELECT part, filter_order, step, applied, letter, {bit} AS bit
        FROM (SELECT part, filter_order, step, applied, explode({unused}) AS letter FROM walk WHERE step < {len(letters)})
      ) w JOIN {{cells}} c ON w.part = c.part
    )
    SELECT * FROM walk WHERE step > 0
    """


def walk_orders(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part and prefix of an order, with the metrics of its last filter.

    ``letters`` names the bits of ``mask``, lowest first. There are ``n!`` orders of ``n``
    letters, so this is for a handful of filters.
    """
    spark = cells.sparkSession
    packed = F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")  # at most 2**n of them
    packed = written(cells.groupBy("part").agg(packed))
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # rows grow with the parts
    try:
        return written(spark.sql(_walk_sql(letters), cells=packed))
    finally:
        spark.conf.set(limit, before)


def audit_orders(cells: DataFrame, letters: str = LETTERS) -> DataFrame:
    """Metrics of every step of every order: ``part, filter_order, step``, the counts of the
    step and ``shapley``, its filter's removals summed over all orders."""
    walk = walk_orders(cells, letters)
    n = len(letters)
    weight = F.element_at(F.array(*[F.lit(factorial(n - k)).cast("bigint") for k in range(1, n + 1)]), F.col("step"))
    letter = F.substring("filter_order", -1, 1)
    shapley = walk.groupBy("part", letter.alias("letter")).agg(F.sum(F.col("removed") * weight).alias("shapley"))
    orders = walk.where(F.col("step") == n).select("part", "filter_order", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"))
    orders = orders.withColumn("prefix", F.expr("left(filter_order, step)"))
    steps = walk.drop("step", "applied").withColumnRenamed("filter_order", "prefix")
    out = orders.join(steps, ["part", "prefix"]).withColumn("letter", F.expr("right(prefix, 1)"))
    return out.join(shapley, ["part", "letter"]).drop("prefix", "letter")


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over ``documents``."""
    return audit_orders(mask_cells(docs, labels))
