"""Responses as columns: headers, rate limits, errors and their JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Request headers that don't follow a redirect to another origin.
SENSITIVE = ("authorization", "cookie", "cookie2", "proxy-authorization", "www-authenticate")
# Messages of error codes; none repeats what a remote side sent.
MESSAGES = {
    "http_status": "the server answered with an error status",
    "rate_limited": "the server asks for fewer requests",
    "redirect_limit": "too many redirects",
    "too_large": "the body exceeds its limit",
    "layout": "the page has an unknown layout",
    "login_required": "the service asks for a login",
}


def header(headers: Column, name: str) -> Column:
    """The value of a header, whatever the case of its name; null where it is missing."""
    wanted = F.map_filter(headers, lambda k, _: F.lower(k) == name.lower())
    return F.get(F.map_values(wanted), F.lit(0))


def number(value: Column) -> Column:
    """A non-negative whole number, else null."""
    return F.when(F.trim(value).rlike("^[0-9]{1,18}$"), F.trim(value).try_cast("long"))


def rate_limit(headers: Column) -> Column:
    return F.struct(
        number(header(headers, "retry-after")).alias("retry_after_secs"),
        number(header(headers, "x-ratelimit-remaining")).alias("remaining"),
        number(header(headers, "x-ratelimit-reset")).alias("reset_epoch_secs"),
    )


def without_sensitive(headers: Column) -> Column:
    return F.map_filter(headers, lambda k, _: ~F.lower(k).isin(*SENSITIVE))


def repository_error(status: Column, remaining: Column, body: Column) -> Column:
    """As for any status, but 403 counts as a rate limit where none remain or the message says so."""
    limited = (status == 429) | ((status == 403) & ((remaining == 0) | F.coalesce(F.lower(F.get_json_object(body, "$.message")).contains("rate limit"), F.lit(False))))
    return F.when(status.between(200, 299), None).when(F.coalesce(limited, F.lit(False)), "rate_limited").when(status.isin(401), "login_required").otherwise("http_status")


def error_json(code: Column) -> Column:
    """``{"error":{"code":…,"message":…}}``; null where there is no error."""
    messages = F.create_map(*[F.lit(x) for pair in MESSAGES.items() for x in pair])
    return F.when(code.isNotNull(), F.to_json(F.struct(F.struct(code.alias("code"), F.coalesce(messages[code], F.lit("the request failed")).alias("message")).alias("error"))))


def within_bytes(body: Column, limit: int) -> Column:
    return F.when(F.octet_length(body) <= limit, body)


def decoded_file(content: Column) -> Column:
    """Text of base64 with line breaks; null where it isn't base64 of valid UTF-8."""
    raw = F.try_to_binary(F.regexp_replace(content, r"\s", ""), F.lit("base64"))
    return F.try_validate_utf8(raw.cast("string"))
