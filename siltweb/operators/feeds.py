"""Feeds in RSS, Atom and JSON: entries with the links, texts and dates that readers choose, HTML as Markdown."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as txt
from ..functions import urls
from ..storage import materialize
from . import tree
from .html import decode_entities

_TEXT = "struct<text:string,html:boolean>"
_FIELDS = f"title string, links array<struct<rel:string,href:string>>, summary {_TEXT}, content {_TEXT}, published string, updated string"
_TYPE = pa.struct([("text", pa.string()), ("html", pa.bool_())])
#: Characters that a description may have, and entries that a feed may give.
LONGEST_DESCRIPTION, MOST_ITEMS = 100_000, 100


def _date(text: str | None) -> str | None:
    """RFC 3339 in UTC of the date forms that feeds use; null for what isn't one."""
    text = (text or "").strip()
    try:
        at = datetime.fromisoformat(text) if re.match(r"\d{4}-", text) else parsedate_to_datetime(text)
    except (ValueError, TypeError, IndexError):
        return None
    return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).astimezone(timezone.utc).isoformat()


def _xml_entries(body: str) -> Iterator[dict]:
    """Entries of an RSS or Atom document without a DTD; element names without their namespaces."""
    name = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""
    inner = lambda e: (e.text or "") + "".join(ElementTree.tostring(c, encoding="unicode") for c in e)
    for e in ElementTree.fromstring(body).iter():
        if name(e) not in ("item", "entry"):
            continue
        rss = name(e) == "item"
        out: dict = {"links": []}
        for c in e:
            n, plain = name(c), "".join(c.itertext())
            if n == "title":
                out.setdefault("title", plain)
            elif n == "link":
                href = plain.strip() if rss else c.get("href")
                if href:
                    out["links"].append({"rel": c.get("rel"), "href": href})
            elif n in ("description", "summary", "encoded", "content"):
                kind = c.get("type", "html" if rss else "text")
                for below in c.iter() if kind == "xhtml" else ():
                    below.tag = name(below)
                text = {"text": inner(c) if kind == "xhtml" else plain, "html": kind in ("html", "xhtml", "text/html", "application/xhtml+xml")}
                out.setdefault("summary" if n in ("description", "summary") else "content", text)
            elif n in ("pubDate", "published", "issued"):
                out.setdefault("published", _date(plain))
            elif n in ("updated", "date", "modified"):
                out.setdefault("updated", _date(plain))
        yield out


def _json_entries(body: str) -> Iterator[dict]:
    text = lambda value, html: {"text": value, "html": html} if isinstance(value, str) else None
    for item in json.loads(body).get("items", []):
        content = text(item.get("content_html"), True) or text(item.get("content_text"), False)
        links = [{"rel": None, "href": item["url"]}] if item.get("url") else [{"rel": None, "href": item["external_url"]}] if item.get("external_url") else []
        yield {"title": item.get("title"), "links": links, "summary": text(item.get("summary"), False), "content": content, "published": _date(item.get("date_published")), "updated": _date(item.get("date_modified"))}


def entries(feeds: DataFrame) -> DataFrame:
    """``feed_id, url, position`` and the raw fields of every entry of ``feed_id, url, body``; ``error`` where a document can't be read, as its only row: ``dtd`` or ``feed``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["title", "links", "summary", "content", "published", "updated"]
        types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.struct([("rel", pa.string()), ("href", pa.string())])), _TYPE, _TYPE, pa.string(), pa.string(), pa.string()]
        for batch in batches:
            held: list[tuple] = []
            for feed_id, url, body in zip(*(batch.column(c).to_pylist() for c in ("feed_id", "url", "body"))):
                body, found, error = (body or "").lstrip("﻿ \t\r\n"), [], None
                if re.search(r"<!DOCTYPE", re.sub(r"(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->", "", body), re.I) and body.startswith("<"):
                    error = "dtd"
                else:
                    try:
                        found = list(_xml_entries(body) if body.startswith("<") else _json_entries(body))
                    except (ElementTree.ParseError, ValueError, AttributeError, TypeError, RecursionError):
                        error, found = "feed", []
                if error:
                    held.append((feed_id, url, *(None,) * 7, error))
                held += [(feed_id, url, k, *(e.get(n) for n in names), None) for k, e in enumerate(found)]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=["feed_id", "url", "position", *names, "error"])

    return feeds.select(F.col("feed_id").cast("long").alias("feed_id"), "url", "body").mapInArrow(run, f"feed_id long, url string, position int, {_FIELDS}, error string")


def explicit_links(feeds: DataFrame) -> DataFrame:
    """``feed_id, position, fallback`` of XML feeds: what an entry's guid or id says its address is, read from the document on its own.

    The position is the entry's place in its document, by which it is joined with the entries. A guid that says it is no
    permalink gives none.
    """
    bare = F.regexp_replace("body", r"(?s)<!--.*?-->", "")
    blocks = F.regexp_extract_all(bare, F.lit(r"(?s)<(?:\w+:)?(?:item|entry)\b[^>]*?(?:/>|>(?:.*?)</(?:\w+:)?(?:item|entry)>)"), 0)
    each = feeds.where(F.ltrim(F.regexp_replace("body", "^\\x{FEFF}", "")).startswith("<")).select(F.col("feed_id").cast("long").alias("feed_id"), F.posexplode(blocks).alias("position", "block"))
    guid = F.regexp_extract("block", r"(?s)<(?:\w+:)?guid\b([^>]*)>(.*?)</", 2)
    permanent = ~F.regexp_extract("block", r"(?s)<(?:\w+:)?guid\b([^>]*)>", 1).rlike(r"(?i)isPermaLink\s*=\s*[\"']false[\"']")
    own = F.regexp_extract("block", r"(?s)<(?:\w+:)?id\b[^>]*>(.*?)</", 1)
    given = F.when(F.col("block").rlike(r"^<(?:\w+:)?item\b"), F.when(permanent, guid)).otherwise(own)
    plain = F.trim(F.regexp_replace(given, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))
    return each.select("feed_id", "position", F.nullif(F.replace(plain, F.lit("&amp;"), F.lit("&")), F.lit("")).alias("fallback"))


def primary_link(links: Column) -> Column:
    """The first alternate link, else the first that names no relation, else the first."""
    first = lambda test: F.get(F.filter(links, test), F.lit(0))["href"]
    return F.coalesce(first(lambda x: x["rel"] == "alternate"), first(lambda x: x["rel"].isNull()), F.get(links, F.lit(0))["href"])


def items(feeds: DataFrame, limit: int = 20) -> DataFrame:
    """``feed_id, ordinal, title, link, description, date`` of the first ``limit`` usable entries of each feed, at most 100; texts are empty where absent.

    An entry with neither title, link nor description isn't usable and takes no place. Links are resolved against the
    feed's url and kept if they are http(s). HTML descriptions become Markdown; one that can't within its bounds gives way to
    the content, and is empty in the end. Documents that can't be read have no items; `entries` tells why.
    """
    found = entries(feeds).where("error is null").join(explicit_links(feeds), ["feed_id", "position"], "left")
    found = materialize(found.withColumn("page_id", F.monotonically_increasing_id()), "feed-entries")
    html = lambda c, k: found.where(F.col(c)["html"]).select((F.col("page_id") * 2 + k).alias("page_id"), "url", F.col(c)["text"].alias("html"))
    drawn = tree.markdown_bounded(html("summary", 0).union(html("content", 1)), LONGEST_DESCRIPTION).select("page_id", F.nullif(F.trim("markdown"), F.lit("")).alias("markdown"))
    both = drawn.groupBy(F.expr("page_id div 2").alias("page_id")).agg(F.max(F.when(F.col("page_id") % 2 == 0, F.col("markdown"))).alias("summary_md"), F.max(F.when(F.col("page_id") % 2 == 1, F.col("markdown"))).alias("content_md"))
    plain = lambda c: txt.clean(decode_entities(c))
    told = lambda c: F.when(F.col(c)["html"], F.col(f"{c}_md")).otherwise(plain(F.col(c)["text"]))
    link = F.coalesce(urls.resolve(F.col("url"), F.trim(primary_link(F.col("links")))), urls.resolve(F.col("url"), F.col("fallback")), F.lit(""))
    made = found.join(both, "page_id", "left").select("feed_id", "position", F.coalesce(plain(F.col("title")), F.lit("")).alias("title"), link.alias("link"), F.coalesce(told("summary"), told("content"), F.lit("")).alias("description"), F.coalesce("published", "updated", F.lit("")).alias("date"))
    usable = made.where("title <> '' or link <> '' or description <> ''")
    place = F.row_number().over(Window.partitionBy("feed_id").orderBy("position")) - 1
    return usable.withColumn("ordinal", place).where(F.col("ordinal") < min(limit, MOST_ITEMS)).drop("position").select("feed_id", "ordinal", "title", "link", "description", "date")
