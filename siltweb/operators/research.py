"""An investigation as a pipeline: hits, their sources, the choice among them and a bounded report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as txt


def enrich(hits: DataFrame, sources: DataFrame, first: int = 5, limit: int = 40_000) -> DataFrame:
    """``hits(query, rank, title, url)`` with ``source`` for the first ranks, at most ``limit`` characters, or a ``warning`` where none is there. ``sources``: url, markdown."""
    wanted = F.col("rank") <= first
    joined = hits.join(sources.select(F.col("url").alias("s_url"), "markdown"), wanted & (F.col("url") == F.col("s_url")), "left")
    return joined.select(*hits.columns, F.when(wanted, txt.truncate(F.col("markdown"), limit)).alias("source"), F.when(wanted & F.col("markdown").isNull(), "source unavailable").alias("warning"))


def choose(hits: DataFrame, answer: Callable[[Column], Column], fallback: int = 5) -> DataFrame:
    """The hits that ``answer`` names by number, in its order; the first ``fallback`` of a query where it names none. ``answer`` maps a query's block of untrusted titles to a text with numbers."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "title", "url")))
    block = txt.envelope("hits", F.array_join(F.transform(F.col("all"), lambda h: F.concat(h["rank"].cast("string"), F.lit(". "), h["title"])), "\n"))
    asked = hits.groupBy("query").agg(ordered.alias("all")).withColumn("answer", answer(block))
    numbers = F.transform(F.regexp_extract_all("answer", F.lit("([0-9]+)"), 1), lambda x: x.try_cast("int"))
    named = F.array_distinct(F.filter(numbers, lambda n: n.between(1, F.size("all"))))
    picked = F.when(F.size(named) > 0, F.transform(named, lambda n: F.get("all", n - 1))).otherwise(F.slice("all", 1, fallback))
    return asked.select("query", F.posexplode(picked).alias("place", "h")).select("query", "place", "h.*")


def report(chosen: DataFrame, warnings: DataFrame, most_hits: int = 5, most_warnings: int = 10, limit: int = 1_000_000) -> DataFrame:
    """``query, report, valid``: Markdown with escaped titles and destinations; invalid where it has too many parts or is too long. ``warnings``: query, warning."""
    line = F.concat(F.lit("- ["), txt.escape_markdown(F.col("title")), F.lit("]("), txt.escape_destination(F.col("url")), F.lit(")"))
    hits = chosen.groupBy("query").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda s: s["l"]), "\n").alias("body"), F.count("*").alias("n"))
    notes = warnings.groupBy("query").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("> "), txt.escape_markdown(F.col("warning"))))), "\n").alias("notes"), F.count("*").alias("w"))
    joined = hits.join(notes, "query", "left")
    whole = F.concat(F.lit("# "), txt.escape_markdown(F.col("query").cast("string")), F.lit("\n\n"), F.col("body"), F.coalesce(F.concat(F.lit("\n\n"), F.col("notes")), F.lit("")))
    return joined.select("query", whole.alias("report"), ((F.col("n") <= most_hits) & (F.coalesce("w", F.lit(0)) <= most_warnings) & (F.length(whole) <= limit)).alias("valid"))


def numbered(hits: DataFrame, order: Column) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(order)))
