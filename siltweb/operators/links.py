"""Links of pages: extraction in document order, resolution, scope, deduplication and the cap per page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from .tree import anchors

def discover(pages: DataFrame, subdomains: bool = False, per_page: int = 1024) -> DataFrame:
    """Links that a crawl would take up: resolved, in scope, not destructive, the first of each target on its page, at most ``per_page``.

    Deduplication keeps the smallest ordinal by a pre-aggregated minimum; the cap numbers the survivors of one page.
    """
    found = anchors(pages).select("page_id", F.col("url").alias("base"), "ordinal", urls.resolve(F.col("url"), F.col("href")).alias("target"))
    kept = found.where(F.col("target").isNotNull() & urls.within_scope(F.col("base"), F.col("target"), subdomains) & ~urls.is_destructive(F.col("target")))
    first = kept.groupBy("page_id", "target").agg(F.min("ordinal").alias("ordinal"))
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("ordinal"))
    return first.withColumn("place", place).where(F.col("place") <= per_page)


def outlinks_by_origin(pages: DataFrame) -> DataFrame:
    """``origin, pages, links, targets``: per origin, its pages, their in-scope links and the distinct targets of these."""
    found = anchors(pages).select("page_id", urls.canonicalize(F.col("url")).alias("base"), urls.resolve(F.col("url"), F.col("href")).alias("target"))
    good = found.where(F.col("target").isNotNull() & urls.within_scope(F.col("base"), F.col("target"), False) & ~urls.is_destructive(F.col("target")))
    per_target = good.groupBy(urls.origin(F.col("base")).alias("origin"), "target").agg(F.count("*").alias("n"))
    links = per_target.groupBy("origin").agg(F.sum("n").alias("links"), F.count("*").alias("targets"))
    counts = pages.groupBy(urls.origin(F.col("url")).alias("origin")).agg(F.count("*").alias("pages"))
    return counts.join(links, "origin", "left").select("origin", "pages", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("targets", F.lit(0)).alias("targets"))
