"""Search hits: deduplication, top-k, engine fallback, budgets and filters, as relational operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(hits: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of the smallest ``order`` for each key, by a pre-aggregated minimum of whole rows."""
    others = [c for c in hits.columns if c not in key]
    best = hits.groupBy(*key).agg(F.min(F.struct(order, *[c for c in others if c != order])).alias("best"))
    return best.select(*key, *[F.col(f"best.{c}").alias(c) for c in others])


def top_k(hits: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """At most k rows of each group; Spark cuts each partition to k before the shuffle."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def first_answering(hits: DataFrame, query: str, engine_rank: str) -> DataFrame:
    """Rows of the first engine that has any for the query."""
    best = hits.groupBy(query).agg(F.min(engine_rank).alias(engine_rank))
    return hits.join(best, [query, engine_rank], "left_semi")


def split_budget(hits: DataFrame, group: str, order: str, total: int) -> DataFrame:
    """An equal share of ``total`` for each row of a group, the remainder to the first ones."""
    w = Window.partitionBy(group)
    n, place = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    return hits.withColumn("budget", F.floor(F.lit(total) / n) + F.when(place < F.lit(total) % n, 1).otherwise(0))


def running_budget(rows: DataFrame, group: str, order: str, size: str, limit: int) -> DataFrame:
    """Running total of ``size`` and whether the row still fits; a group with one that doesn't fails as a whole."""
    ordered = Window.partitionBy(group).orderBy(order)
    used = rows.withColumn("used", F.sum(size).over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return used.withColumn("fits", F.col("used") <= limit).withColumn("group_fits", F.sum(size).over(Window.partitionBy(group)) <= limit)


def filter_indices(answer: Column, count: Column) -> Column:
    """Distinct 1-based numbers within range, in the order in which the answer names them."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(r"([0-9]+)"), 1), lambda x: x.try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda x: x.isNotNull() & (x >= 1) & (x <= count)))
