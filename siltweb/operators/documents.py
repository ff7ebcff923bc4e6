"""Parsers of documents that hold many rows: feeds, issue lists, search listings and nested JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as txt
from .html import decode_entities


def feed_items(feeds: DataFrame, key: str, body: str, limit: int = 20) -> DataFrame:
    """``key, ordinal, title, link, description, date`` of RSS and Atom documents: all texts, empty where absent.

    Entries with neither title, link nor description are dropped before the limit. A document with a DTD has no rows.
    """
    allowed = feeds.where(~F.upper(body).contains("<!DOCTYPE"))
    entry = r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"

    def field(e: Column, *names: str) -> Column:
        found = [F.nullif(F.regexp_extract(e, rf"(?is)<{n}\b[^>]*>(.*?)</{n}>", 1), F.lit("")) for n in names]
        raw = F.coalesce(*found, F.lit(""))
        return txt.bounded(decode_entities(F.regexp_replace(F.regexp_replace(raw, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"), "<[^>]*>", "")))

    def item(e: Column) -> Column:
        link = F.coalesce(F.nullif(field(e, "link"), F.lit("")), F.nullif(F.regexp_extract(e, r'(?is)<link\b[^>]*href="([^"]*)"', 1), F.lit("")), F.nullif(field(e, "guid", "id"), F.lit("")), F.lit(""))
        return F.struct(field(e, "title").alias("title"), link.alias("link"), field(e, "description", "summary", "content").alias("description"), field(e, "pubDate", "updated", "published").alias("date"))

    items = F.filter(F.transform(F.regexp_extract_all(body, F.lit(entry), 1), item), lambda i: (i["title"] != "") | (i["link"] != "") | (i["description"] != ""))
    return allowed.select(key, F.posexplode(F.slice(items, 1, limit)).alias("ordinal", "i")).select(key, "ordinal", "i.*")


def issues(pages: DataFrame, key: str, body: str) -> DataFrame:
    """Issues of pages of an issue list in JSON, pull requests left out: ``key, ordinal, raw_count, number, title, state``."""
    schema = "array<struct<number: long, title: string, state: string, pull_request: struct<url: string>>>"
    parsed = pages.select(key, F.from_json(body, schema).alias("all"))
    each = parsed.select(key, F.size("all").alias("raw_count"), F.posexplode("all").alias("ordinal", "i")).where("i.pull_request is null")
    return each.select(key, "ordinal", "raw_count", "i.number", "i.title", "i.state")


def listing(pages: DataFrame, key: str, body: str, limit: int) -> DataFrame:
    """Posts of listings in JSON (``data.children[].data``) that have a title and a link, the first ``limit`` of each: ``key, ordinal, title, url, score``."""
    schema = "struct<data: struct<children: array<struct<data: struct<title: string, permalink: string, score: long>>>>>"
    children = F.from_json(body, schema)["data"]["children"]
    good = F.filter(F.transform(children, lambda c: c["data"]), lambda d: F.coalesce((d["title"] != "") & (d["permalink"] != ""), F.lit(False)))
    each = pages.select(key, F.posexplode(F.slice(good, 1, limit)).alias("ordinal", "d"))
    return each.select(key, "ordinal", txt.bounded(F.col("d.title")).alias("title"), F.col("d.permalink").alias("url"), F.col("d.score").alias("score"))


def envelope_results(pages: DataFrame, key: str, body: str) -> DataFrame:
    """Results of envelopes whose ``code`` is 0, with ids of twelve characters that begin with BV: ``key, ordinal, bvid, title``; markup in titles is taken off."""
    schema = "struct<code: int, data: struct<result: array<struct<bvid: string, title: string>>>>"
    parsed = pages.select(key, F.from_json(body, schema).alias("p")).where("p.code = 0")
    each = parsed.select(key, F.posexplode("p.data.result").alias("ordinal", "r")).where(F.col("r.bvid").rlike("^BV[A-Za-z0-9]{10}$"))
    return each.select(key, "ordinal", F.col("r.bvid").alias("bvid"), txt.clean(decode_entities(F.regexp_replace("r.title", "<[^>]*>", ""))).alias("title"))


def json_search(docs: DataFrame, key: str, body: str, name: str, max_depth: int = 12) -> DataFrame:
    """Every value under the key ``name`` at any depth of JSON documents: ``key, path, value``.

    A level is one ``variant_explode`` of what is left, so the walk is breadth-first and its rows are the documents' nodes.
    """
    level = docs.select(key, F.lit("$").alias("path"), F.try_parse_json(body).alias("v")).where("v is not null")
    found = None
    for _ in range(max_depth):
        level.createOrReplaceTempView("json_level")
        rows = level.sparkSession.sql(f"select {key}, concat(path, '.', coalesce(e.key, cast(e.pos as string))) path, e.key name, e.value v from json_level, lateral variant_explode(v) e")
        hit = rows.where(F.col("name") == name).select(key, "path", F.to_json("v").alias("value"))
        found = hit if found is None else found.union(hit)
        level = rows.select(key, "path", "v").where(F.schema_of_variant("v").rlike("^(OBJECT|ARRAY)"))
    return found
