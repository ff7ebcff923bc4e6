"""Captions: parsing of timed events and the joining of their texts by gaps."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, unquote_to_bytes, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as txt

# Hosts, with all below them, that serve captions, and the bounds within which nested urls are looked into.
HOSTS = ("youtube.com", "youtube-nocookie.com", "google.com", "googlevideo.com")
NESTED_DEPTH, NESTED_BYTES = 4, 4096


def from_json3(docs: DataFrame, key: str, body: str, most: int = 10_000) -> DataFrame:
    """``key, ordinal, start_ms, duration_ms, text`` of caption documents in JSON; text runs are joined. More than ``most`` events make the document fail as a whole."""
    schema = "struct<events: array<struct<tStartMs: long, dDurationMs: long, segs: array<struct<utf8: string>>>>>"
    parsed = docs.select(key, F.from_json(body, schema)["events"].alias("events")).where(F.size("events") <= most)
    each = parsed.select(key, F.posexplode("events").alias("ordinal", "e"))
    words = F.array_join(F.transform(F.coalesce("e.segs", F.array()), lambda s: s["utf8"]), "")
    return each.select(key, "ordinal", F.col("e.tStartMs").alias("start_ms"), F.col("e.dDurationMs").alias("duration_ms"), words.alias("text"))


def gap_join(events: DataFrame, key: str, gap_ms: int = 1500) -> DataFrame:
    """``key, transcript``: texts in order, a paragraph break where an event starts ``gap_ms`` or more after the last one with a start ended, else a blank.

    Without a start, or where nothing has ended yet, there is no break.
    """
    spoken = events.withColumn("text", txt.clean(F.col("text"))).where("text <> ''")
    w = Window.partitionBy(key).orderBy("ordinal")
    ended = F.last(F.when(F.col("start_ms").isNotNull(), F.col("start_ms") + F.coalesce("duration_ms", F.lit(0))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    mark = F.when(F.lag("ordinal").over(w).isNull(), "").when(F.col("start_ms") - ended >= gap_ms, "\n\n").otherwise(" ")
    parts = spoken.withColumn("part", F.concat(mark, F.col("text")))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "part")))
    return parts.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["part"]), "").alias("transcript"))


def choose_track(tracks: DataFrame, key: str, wanted: str | None) -> DataFrame:
    """One track of each video: the wanted language, then English, then one made by people, then any; ties go to the first."""
    asked = F.lit(wanted.lower()) if wanted and wanted.strip() else F.lit(None).cast("string")
    rank = F.when(F.lower("language") == asked, 0).when(F.lower("language").rlike("^en(-|$)"), 1).when(~F.col("generated"), 2).otherwise(3)
    whole = F.struct(*[c for c in tracks.columns if c != key])
    return tracks.groupBy(key).agg(F.min_by(whole, F.struct(rank, "ordinal")).alias("t")).select(key, "t.*")


def _parts_fault(url: str) -> str | None:
    try:
        parts = urlsplit(url.strip())
        port, host = parts.port, (parts.hostname or "").rstrip(".").lower()
    except ValueError:
        return "invalid"
    if parts.scheme.lower() != "https":
        return "scheme" if parts.scheme else "invalid"
    if "@" in parts.netloc:
        return "credentials"
    if port not in (None, 443):
        return "port"
    return None if any(host == h or host.endswith("." + h) for h in HOSTS) else "host"


def _nested_fault(value: str, depth: int) -> str | None:
    """What is wrong with a url, or a form of one that is escaped again, within a query's value."""
    while True:
        if len(value.encode("utf-8", "surrogatepass")) > NESTED_BYTES:
            return "long"
        if depth > NESTED_DEPTH:
            return "deep"
        if re.match(r"[\x00-\x20]*[A-Za-z][A-Za-z0-9+.-]*:", value):
            return "nested" if _parts_fault(value) else _query_fault(value, depth + 1)
        if not re.search("%[0-9A-Fa-f]{2}", value):
            return None
        try:
            value = unquote_to_bytes(value.encode("utf-8", "surrogatepass")).decode()
        except UnicodeDecodeError:
            return "encoding"
        depth += 1


def _query_fault(url: str, depth: int) -> str | None:
    pairs = parse_qsl(urlsplit(url).query, keep_blank_values=True, errors="replace")
    return next((f for f in (_nested_fault(value, depth) for _, value in pairs) if f), None)


@F.pandas_udf(StringType())
def url_fault(url: pd.Series) -> pd.Series:
    """Why a caption url may not be fetched, null where it may: invalid, scheme, credentials, port or host; of what its query's values hold, nested, long, deep or encoding.

    Urls within values are looked into wherever decoding again brings one out, up to a depth and a length; past these the
    url is refused. A null url is invalid.
    """
    return pd.Series([(_parts_fault(u) or _query_fault(u, 0)) if isinstance(u, str) else "invalid" for u in url], dtype=object)


def with_format(url: str, name: str = "json3") -> str:
    """The url with ``fmt`` set, once, after its other parameters."""
    parts = urlsplit(url)
    pairs = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if k != "fmt"]
    return urlunsplit(parts._replace(query=urlencode([*pairs, ("fmt", name)])))
