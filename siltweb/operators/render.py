"""Results as text for people, and files that people keep: listings of hits, repositories, issues, posts and videos; cookie files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _listed(rows: DataFrame, key: str, order: str, line: Column, none: str | None = None) -> DataFrame:
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda s: s["l"]), "\n")
    out = rows.groupBy(key).agg(F.count(order).alias("n"), joined.alias("text"))
    return out.select(key, (F.when(F.col("n") == 0, F.lit(none)).otherwise(F.col("text")) if none else F.col("text")).alias("text"))


def hits(rows: DataFrame) -> DataFrame:
    """``query, text`` of ``query, rank, title, url, snippet, markdown, error, warning``: each hit's number, title and url, then what there is of it. A query whose ranks are all null has no results."""
    lines = F.array(
        F.concat(F.col("rank").cast("string"), F.lit(". "), "title", F.lit("\n   "), "url"),
        F.when(F.coalesce("snippet", F.lit("")) != "", F.concat(F.lit("   "), "snippet")),
        F.col("markdown"),
        F.concat(F.lit("   scrape error: "), "error"),
    )
    body = _listed(rows.withColumn("one", F.array_join(F.filter(lines, lambda x: x.isNotNull()), "\n")), "query", "rank", F.col("one"), "No results.")
    warned = rows.groupBy("query").agg(F.max("warning").alias("warning"))
    text = F.when(F.col("warning").isNotNull() & (F.col("text") != "No results."), F.concat(F.lit("warning: "), "warning", F.lit("\n"), "text")).otherwise(F.col("text"))
    return body.join(warned, "query").select("query", text.alias("text"))


def repository(name: Column, description: Column, stars: Column, forks: Column, language: Column, homepage: Column) -> Column:
    n = lambda c: c.cast("string")
    return F.concat(name, F.lit("\n"), F.coalesce(description, F.lit("(no description)")), F.lit("\n★ "), n(stars), F.lit("  forks "), n(forks), F.lit("  lang "), F.coalesce(language, F.lit("n/a")), F.lit("\n"), homepage)


def issues(rows: DataFrame, key: str) -> DataFrame:
    """``key, text`` of ``number, title, url``; a key whose numbers are all null has none open."""
    return _listed(rows, key, "number", F.concat(F.lit("#"), F.col("number").cast("string"), F.lit(" "), "title", F.lit("\n   "), "url"), "No open issues.")


def posts(rows: DataFrame, key: str) -> DataFrame:
    return _listed(rows, key, "rank", F.concat("title", F.lit(" (▲"), F.col("score").cast("string"), F.lit(")\n   "), "url"))


def videos(rows: DataFrame, key: str) -> DataFrame:
    return _listed(rows, key, "rank", F.concat("title", F.lit(" — "), "url"))


def repositories(documents: DataFrame) -> DataFrame:
    """The repository that each ``id, json`` describes; without the fields that all have, or with a page elsewhere than on its host, no row."""
    wire = "full_name string, description string, stargazers_count long, forks_count long, language string, license struct<spdx_id:string>, open_issues_count long, html_url string, default_branch string"
    r = documents.select("id", F.from_json("json", wire).alias("r")).select("id", "r.*")
    whole = r.where(F.col("full_name").isNotNull() & F.col("stargazers_count").isNotNull() & F.col("html_url").rlike(r"^https://([\w-]+\.)*github\.com(/|$)"))
    return whole.select("id", F.col("full_name").alias("name"), "description", F.col("stargazers_count").alias("stars"), F.col("forks_count").alias("forks"), "language", F.col("license.spdx_id").alias("license"), F.col("open_issues_count").alias("open_issues"), F.col("html_url").alias("homepage"), "default_branch")


def cookie_format(raw: Column) -> Column:
    """netscape by its first line, json where it is an array or object, else header."""
    first = F.lower(F.trim(F.split_part(F.ltrim(raw), F.lit("\n"), F.lit(1))))
    return F.when(first == "# netscape http cookie file", "netscape").when(F.ltrim(raw).rlike(r"^[\[{]"), "json").otherwise("header")


def cookies(files: DataFrame) -> DataFrame:
    """``id, line, name, value, domain, path, secure, http_only, expires, error`` of ``id, host, raw`` cookie files of seven fields a line.

    A line that isn't as it should be, or whose domain doesn't hold the host, has its fault in ``error`` and nothing else.
    """
    lines = files.select("id", F.lower(F.regexp_replace("host", r"\.+$", "")).alias("host"), F.posexplode(F.split("raw", r"\r?\n")).alias("line", "whole"))
    kept = lines.withColumn("whole", F.trim("whole")).where((F.col("whole") != "") & (~F.col("whole").startswith("#") | F.col("whole").startswith("#HttpOnly_")))
    f = kept.withColumn("http_only", F.col("whole").startswith("#HttpOnly_")).withColumn("f", F.split(F.regexp_replace("whole", "^#HttpOnly_", ""), "\t"))
    at = lambda k: F.get("f", F.lit(k))
    domain = F.regexp_replace(F.lower(at(0)), r"^\.+|\.+$", "")
    flag = lambda k: F.lower(at(k)).isin("true", "false")
    whole = F.lower(at(1)) == "true"
    error = (
        F.when(F.size("f") != 7, "fields")
        .when(~flag(1) | ~flag(3), "flag")
        .when(whole & ~((F.col("host") == domain) | F.col("host").endswith(F.concat(F.lit("."), domain))), "domain")
        .when(~whole & (F.col("host") != domain), "domain")
        .when(~at(2).rlike(r"^/[\x20-\x3A\x3C-\x7E]*$"), "path")
        .when(~at(4).rlike("^[0-9]{1,18}$"), "expiry")
        .when(~at(5).rlike(r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+$") | ~at(6).rlike(r"^[\x21\x23-\x2B\x2D-\x3A\x3C-\x5B\x5D-\x7E]*$"), "pair")
    )
    good = error.isNull()
    return f.select(
        "id", "line", F.when(good, at(5)).alias("name"), F.when(good, at(6)).alias("value"), F.when(good & whole, domain).alias("domain"), F.when(good, at(2)).alias("path"),
        F.when(good, F.lower(at(3)) == "true").alias("secure"), F.when(good, F.col("http_only")).alias("http_only"), F.when(good, F.nullif(F.try_to_number(at(4), F.lit("9" * 18)).cast("long"), F.lit(0))).alias("expires"), error.alias("error"),
    )


def xml_captions(documents: DataFrame) -> DataFrame:
    """``id, start_ms, duration_ms, text`` of timed text in XML, of the forms ``<text start dur>`` in seconds and ``<p t d>`` in milliseconds."""
    from .html import decode_entities
    from ..functions import text as txt

    tags = F.regexp_extract_all("xml", F.lit(r"(?s)(<(?:text|p)\s[^>]*>.*?</(?:text|p)>)"), 1)
    one = documents.where(~F.col("xml").rlike(r"(?i)<!DOCTYPE|<!ENTITY")).select("id", F.posexplode(tags).alias("ordinal", "t"))
    of = lambda name: F.nullif(F.regexp_extract("t", rf"^<[^>]*\s{name}=[\"']([^\"']*)", 1), F.lit(""))
    body = txt.truncate(txt.clean(decode_entities(decode_entities(F.regexp_replace(F.regexp_extract("t", r"(?s)^<[^>]*>(.*)</", 1), "<[^>]*>", "")))), 100_000)
    start = F.coalesce(txt.seconds_to_ms(of("start")), F.when(of("t").rlike("^[0-9]{1,12}$"), of("t")).cast("long"))
    length = F.coalesce(txt.seconds_to_ms(of("dur")), F.when(of("d").rlike("^[0-9]{1,12}$"), of("d")).cast("long"))
    return one.select("id", "ordinal", start.alias("start_ms"), length.alias("duration_ms"), body.alias("text")).where("start_ms is not null and text <> ''")
