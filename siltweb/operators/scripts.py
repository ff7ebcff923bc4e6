"""State that pages carry in their scripts: named JSON values found by reading the script's tokens, not by searching its text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import construct

_LINE = r"[^\n\r\u2028\u2029]"
_TOKEN = re.compile(
    rf"""(?P<space>[\s\ufeff]+)
    |(?P<comment>(?://|<!--|-->){_LINE}*|/\*(?:[^*]|\*(?!/))*+(?:\*/|\*?\Z))
    |(?P<string>"(?:[^"\\]|\\.)*+(?:"|\\?\Z)|'(?:[^'\\]|\\.)*+(?:'|\\?\Z))
    |(?P<name>[^\W\d]\w*(?:\$\w*)*|\$[\w$]*)
    |(?P<number>\.?\d[\w.]*)
    |(?P<mark>\+\+|--|\.\.\.|=>|[=!]==?|.)""",
    re.X | re.S,
)
_REGEX = re.compile(rf"/(?:[^/\\\[\n\r\u2028\u2029]|\\{_LINE}|\[(?:[^\]\\\n\r\u2028\u2029]|\\{_LINE})*+\])++/[\w$]*")
_RAW = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*+", re.S)
_PART = re.compile(r'[^"{}]+|"(?:[^"\\]|\\.)*+"|[{}]|"', re.S)
_NESTING = re.compile(r'"(?:[^"\\]|\\.)*+"|[\[{\]}]', re.S)
#: Levels of nesting at which JSON is refused.
DEEPEST = 128
#: Words after which a slash begins a regular expression.
BEFORE_REGEX = frozenset("return typeof instanceof in of new delete void throw case do else yield await".split())


def _object_end(source: str, start: int) -> int | None:
    """Where the object that starts here ends, by braces outside of double quotes."""
    depth = 0
    for m in _PART.finditer(source, start):
        part = m[0]
        if part == "{":
            depth += 1
        elif part == "}":
            depth -= 1
            if not depth:
                return m.end()
        elif part == '"':
            return None
    return None


def _spelled(literal: str) -> str:
    return re.sub(r"\\(.)", r"\1", literal[1:-1], flags=re.S)


def assignments(source: str, names: list[str]) -> Iterator[tuple[int, str]]:
    """``(place in names, raw value)`` of what is assigned to ``name``, ``x.name`` or ``x["name"]``: objects and double-quoted strings.

    One pass over the script's tokens: comments, strings, templates with what they hold, and regular expressions are
    passed over. A value is read once; one that never ends ends the script, and so does such a regular expression.
    """
    at, nest = 0, []  # open braces of each template's expression that we are in
    regex_may_start, property_next = True, False
    last: tuple[str, str] | None = None  # the bracket and the string in it
    armed: int | None = None  # the name that has just been read, and then its equals sign
    assigned = False
    while at < len(source):
        m = _TOKEN.match(source, at)
        kind, word, at = m.lastgroup, m[0], m.end()
        if kind in ("space", "comment"):
            continue
        if kind == "mark" and word == "/" and regex_may_start:
            r = _REGEX.match(source, m.start())
            if not r:
                return
            kind, word, at = "regex", r[0], r.end()
        if kind == "mark" and (word == "`" or word == "}" and nest and not nest[-1]):
            # a template, or what follows an expression in one
            if word == "}":
                nest.pop()
            at = _RAW.match(source, at).end()
            if source.startswith("${", at):
                nest.append(0)
                at += 2
                regex_may_start, property_next, last, armed, assigned = True, False, None, None, False
                continue
            if at >= len(source) or source[at] != "`":
                return
            at += 1
            kind, word = "template", ""
        elif kind == "mark" and nest and word in "{}":
            nest[-1] += 1 if word == "{" else -1
        if assigned:
            value = None
            if word == "{" and kind == "mark":
                end = _object_end(source, m.start())
                if end is None:
                    return
                value, at, kind, word = source[m.start() : end], end, "mark", "}"
            elif kind == "string" and word[0] == '"':
                if len(word) < 2 or word[-1] != '"':
                    return
                value = word
            if value is not None:
                yield armed, value
            armed, assigned = None, False
        elif armed is not None:
            assigned = kind == "mark" and word == "="
            if not assigned:
                armed = None
        if armed is None and not nest:
            if kind == "name" and word in names:
                armed = names.index(word)
            elif word == "]" and last and last[0] == "[" and _spelled(last[1]) in names:
                armed = names.index(_spelled(last[1]))
        last = ("[", word) if kind == "string" and last and last[1] == "[" else ("", word) if word == "[" else None
        if kind == "name":
            regex_may_start = word in BEFORE_REGEX and not property_next
        elif kind != "mark" or word in (")", "]", "}"):
            regex_may_start = False
        elif word not in ("++", "--"):
            regex_may_start = True
        property_next = kind == "mark" and word == "."


def _refuse(constant: str):
    raise ValueError(constant)


def _shallow(value: str) -> bool:
    depth = 0
    for m in _NESTING.finditer(value):
        depth += 1 if m[0] in "[{" else -1 if m[0] in "]}" else 0
        if depth >= DEEPEST:
            return False
    return True


def parsed(raw: str) -> str | None:
    """The JSON that a raw value is, or that its string holds; null for anything else, and for values nested ``DEEPEST`` levels or more."""
    try:
        value = raw if raw.startswith("{") else json.loads(raw)
        if not _shallow(value):
            return None
        json.loads(value, parse_constant=_refuse)
    except (ValueError, RecursionError, TypeError):
        return None
    return value


def script_texts(html: str) -> Iterator[str]:
    """The text of each script element of a page, in document order."""
    below = [construct.build(html)]
    while below:
        node = below.pop()
        if node.tag == "script":
            yield "".join(c for c in node.children if isinstance(c, str))
        below += [c for c in reversed(node.children) if isinstance(c, construct.Node)]


def values(pages: DataFrame, names: list[str]) -> DataFrame:
    """``page_id, script, ordinal, priority, name, raw, json``: every value that a page's scripts assign to one of ``names``.

    ``priority`` is the name's place. ``json`` is null where the value isn't JSON. Null html and pages without scripts have
    no rows. Work is in proportion to a page's length, whatever is in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for page_id, html in zip(batch.column("page_id").to_pylist(), batch.column("html").to_pylist()):
                if html is None or not any(n in html for n in names) and "\\" not in html:
                    continue
                for k, source in enumerate(script_texts(html)):
                    for i, (priority, raw) in enumerate(assignments(source, names)):
                        held.append((page_id, k, i, priority, names[priority], raw, parsed(raw)))
            if held:
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=["page_id", "script", "ordinal", "priority", "name", "raw", "json"])

    schema = "page_id long, script int, ordinal int, priority int, name string, raw string, json string"
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, schema)


def named_json(pages: DataFrame, names: list[str], accepts: Column) -> DataFrame:
    """``page_id, name, json, accepted``: of each page, the first value of the first name that ``accepts`` (over ``json``), else the first that is JSON at all."""
    found = values(pages, names).where("json is not null").withColumn("accepted", F.coalesce(accepts, F.lit(False)))
    best = found.groupBy("page_id").agg(F.min_by(F.struct("name", "json", "accepted"), F.struct(~F.col("accepted"), "priority", "script", "ordinal")).alias("b"))
    return best.select("page_id", "b.*")


PLAYER_NAMES = ["ytInitialPlayerResponse", "playerResponse"]
_TRACKS = "captions struct<playerCaptionsTracklistRenderer: struct<captionTracks: array<struct<baseUrl: string, languageCode: string, kind: string, name: struct<simpleText: string, runs: array<struct<text: string>>>>>>>"


def caption_tracks(pages: DataFrame, most: int = 100) -> DataFrame:
    """``page_id, ordinal, url, language, name, generated`` of the caption tracks that a player page's state lists.

    The first ``most`` entries count; those without a url or language go. A track without a name has its language's.
    Tracks whose url `captions.url_fault` refuses are to be refused by the caller, with their page.
    """
    renderer = F.from_json("json", _TRACKS)["captions"]["playerCaptionsTracklistRenderer"]["captionTracks"]
    chosen = named_json(pages, PLAYER_NAMES, F.size(renderer) > 0).where("accepted")
    each = chosen.select("page_id", F.posexplode(F.slice(renderer, 1, most)).alias("ordinal", "t"))
    name = F.coalesce("t.name.simpleText", F.array_join(F.transform("t.name.runs", lambda r: F.coalesce(r["text"], F.lit(""))), ""))
    named = F.when(F.trim(name) != "", name).otherwise(F.col("t.languageCode"))
    kept = each.where("t.baseUrl is not null and trim(t.languageCode) <> ''")
    return kept.select("page_id", "ordinal", F.col("t.baseUrl").alias("url"), F.col("t.languageCode").alias("language"), named.alias("name"), F.coalesce(F.col("t.kind") == "asr", F.lit(False)).alias("generated"))
