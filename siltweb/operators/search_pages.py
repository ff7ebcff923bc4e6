"""Result pages of search engines: rows of hits, and the difference between no results and an unknown layout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as txt
from .html import decode_entities


@dataclass(frozen=True)
class Layout:
    """Regular expressions: a result's container, and within it the link (target, then title) and the snippet."""

    container: str
    link: str
    snippet: str
    #: A page with this mark and no container has no results; without it the layout is unknown.
    empty_mark: str
    #: Query parameter of wrapped targets, where the engine wraps them.
    wrapper: str | None = None


# The two engines' layouts.
DUCKDUCKGO = Layout(r'(?is)<div class="result\b[^>]*>(.*?)</div>', r'(?is)<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', r'(?is)class="result__snippet"[^>]*>(.*?)</', "no results", "uddg")
BING = Layout(r'(?is)<li class="b_algo\b[^>]*>(.*?)</li>', r'(?is)<h2>\s*<a\b[^>]*href="([^"]*)"[^>]*>(.*?)</a>', r"(?is)<p\b[^>]*>(.*?)</p>", "there are no results")


def _plain(c: Column) -> Column:
    return txt.clean(decode_entities(F.regexp_replace(c, "<[^>]*>", "")))


def results(pages: DataFrame, key: str, body: str, layout: Layout, limit: int = 20) -> DataFrame:
    """``key, status, ordinal, title, url, snippet``: hits in page order, or one row whose status is ``empty`` or ``layout``.

    Hits without a title or an http(s) target are left out before the limit.
    """
    target = lambda c: decode_entities(F.regexp_extract(c, layout.link, 1))

    def unwrapped(c: Column) -> Column:
        if layout.wrapper is None:
            return target(c)
        wrapped = F.regexp_extract(target(c), rf"[?&]{layout.wrapper}=([^&#]*)", 1)
        return F.when(wrapped != "", F.try_url_decode(wrapped)).otherwise(target(c))

    hit = lambda c: F.struct(txt.truncate(_plain(F.regexp_extract(c, layout.link, 2)), 512).alias("title"), unwrapped(c).alias("url"), txt.truncate(_plain(F.regexp_extract(c, layout.snippet, 1)), 2048).alias("snippet"))
    found = F.transform(F.regexp_extract_all(body, F.lit(layout.container), 1), hit)
    good = F.slice(F.filter(found, lambda h: (h["title"] != "") & h["url"].rlike("^https?://")), 1, limit)
    status = F.when(F.size("hits") > 0, "ok").when(F.lower(body).contains(layout.empty_mark), "empty").otherwise("layout")
    rows = pages.withColumn("hits", good).select(key, status.alias("status"), F.posexplode_outer("hits").alias("ordinal", "h"))
    return rows.select(key, "status", "ordinal", "h.*")
