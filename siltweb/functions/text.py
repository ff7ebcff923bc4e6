"""Text of untrusted pages as columns: white space, bounds, escapes and envelopes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(text: Column) -> Column:
    """Unicode white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def truncate(text: Column, limit: int) -> Column:
    """At most ``limit`` code points."""
    return F.substring(text, 1, limit)


def bounded(text: Column, limit: int = 8192) -> Column:
    return truncate(clean(text), limit)


def escape_markdown(text: Column) -> Column:
    """Characters with a meaning in Markdown, each behind a backslash; markup brackets and ampersands as entities."""
    out = F.regexp_replace(text, r"([\\`*_{}\[\]()#+\-.!|~])", r"\\$1")
    return F.replace(F.replace(F.replace(out, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def escape_destination(url: Column) -> Column:
    return F.regexp_replace(url, r"([\\()])", r"\\$1")


def neutralize_boundaries(text: Column) -> Column:
    """The envelope's own boundary words can't be forged inside it."""
    return F.regexp_replace(F.regexp_replace(text, "(?i)BEGIN UNTRUSTED", "BEGIN[DATA] UNTRUSTED"), "(?i)END UNTRUSTED", "END[DATA] UNTRUSTED")


def envelope(label: str, text: Column) -> Column:
    """Untrusted text between boundaries, each line marked as data."""
    lines = F.transform(F.split(neutralize_boundaries(text), "\n"), lambda line: F.concat(F.lit("DATA: "), line))
    return F.concat(F.lit(f"BEGIN UNTRUSTED {label}\n"), F.array_join(lines, "\n"), F.lit(f"\nEND UNTRUSTED {label}"))


def limited(text: Column, limit: int, marker: str) -> Column:
    return F.when(F.length(text) > limit, F.concat(truncate(text, limit), F.lit(marker))).otherwise(text)


def word_count(text: Column) -> Column:
    cleaned = clean(text)
    return F.when(cleaned == "", 0).otherwise(F.size(F.split(cleaned, " ")))


def seconds_to_ms(text: Column) -> Column:
    """Whole and three fraction digits, without floating point; null where the text isn't a plain number."""
    whole, fraction = F.regexp_extract(text, r"^([0-9]+)", 1), F.regexp_extract(text, r"\.([0-9]*)$", 1)
    ms = whole.cast("long") * 1000 + F.rpad(F.substring(fraction, 1, 3), 3, "0").cast("long")
    return F.when(text.rlike(r"^[0-9]+(\.[0-9]*)?$"), ms)
