"""Whole HTML pages as rows: every element and every piece of text, with selection by CSS and path, fingerprints and Markdown.

`construct` builds the tree of one page, which becomes numbered rows; all that follows are joins, windows and aggregates
over these rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as txt
from ..functions import urls
from ..storage import materialize
from . import construct
from .html import parse_path

# Elements whose content isn't the page's own, class words of the same kind, and elements that make blocks.
HIDDEN = frozenset("script style noscript template svg iframe canvas nav footer header aside form button select option input dialog head".split())
EXCLUDED_CLASSES = frozenset("ad ads advert advertisement banner promo cookie newsletter sidebar related-posts share social-share".split())
BLOCKS = frozenset("address article blockquote body caption dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 li main ol p pre section table td th tr ul".split())

SCHEMA = "page_id long, url string, pre int, post int, depth int, parent int, tag string, attrs map<string,string>, own boolean, kind string, text string"
PATH = "path array<struct<pre:int,tag:string,note:string,hidden:boolean>>"
#: Rows that a task hands on at once.
ROWS_AT_ONCE = 20_000


def _hidden(node: construct.Node) -> bool:
    a = node.attrs
    return node.tag in HIDDEN or "hidden" in a or a.get("aria-hidden") == "true" or not EXCLUDED_CLASSES.isdisjoint(re.split(r"[\t\n\f\r ]+", a.get("class", "")))


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"-?[0-9]{1,9}", text) else None


def page_rows(html: str | None, paths: bool) -> Iterator[tuple]:
    """``pre, post, depth, parent, tag, attrs, own, kind, text, path`` of one page. Text, breaks, rules and images carry their ancestors if asked to."""
    if html is None:
        return
    at, made = 0, []
    # open elements: row, children still to come, what leaves below say of it, the number of the last list item
    open_: list[list] = []

    def leaf(kind: str, text: str) -> None:
        nonlocal at
        at += 1
        made.append([at, None, len(open_), open_[-1][0][0], None, None, None, kind, text, [o[2] for o in open_] if paths else None])

    def enter(node: construct.Node) -> None:
        nonlocal at
        at += 1
        a, hidden = node.attrs, _hidden(node)
        note = a.get("href") if node.tag == "a" else a.get("class") if node.tag in ("pre", "code") else None
        if node.tag == "li" and open_:
            above = next((o for o in reversed(open_) if o[0][4] in ("ul", "ol")), open_[-1])
            own = _number(a.get("value"))
            above[3] = above[3] + 1 if own is None else own
            note = str(above[3]) if above[0][4] == "ol" else "-"
        row = [at, at, len(open_) + 1, open_[-1][0][0] if open_ else None, node.tag, list(a.items()), node.own, "element", None, None]
        made.append(row)
        if node.tag in ("br", "hr"):
            leaf(node.tag, "")
        elif node.tag == "img" and not hidden and a.get("alt", "").strip():
            leaf("img", json.dumps([a["alt"], a.get("src", "")]))
        if node.tag not in construct.VOID or node.children:
            first = _number(a.get("start")) if node.tag == "ol" else None
            open_.append([row, iter(node.children), (row[0], node.tag, note, hidden), 0 if first is None else first - 1])

    enter(construct.build(html))
    while open_:
        child = next(open_[-1][1], None)
        if child is None:
            at += 1
            open_.pop()[0][1] = at
        elif isinstance(child, str):
            leaf("text", child)
        else:
            enter(child)
    yield from made


def rows(pages: DataFrame, paths: bool = False) -> DataFrame:
    """A row for each element, piece of text, break, rule and image of ``page_id, url, html``, numbered in document order.

    The tree is the one that browsers build, with the elements that they imply; ``own`` tells those that have a start tag
    in the page from implied ones and copies. An element spans ``pre`` to ``post``; a void one is its own end. Null html has no rows; any
    other page has at least ``html``, ``head`` and ``body``. References are decoded, and what is in comments isn't seen.
    """
    fields = [("pre", pa.int32()), ("tag", pa.string()), ("note", pa.string()), ("hidden", pa.bool_())]
    names = [part.split()[0] for part in SCHEMA.split(", ")] + ["path"] * paths
    types = [pa.int64(), pa.string(), *[pa.int32()] * 4, pa.string(), pa.map_(pa.string(), pa.string()), pa.bool_(), pa.string(), pa.string()]

    def batch(held: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*held))
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        if paths:
            # field by field: an object for each ancestor of each piece would take longer than the page
            flat = list(zip(*(p for path in columns[-1] if path for p in path))) or [()] * len(fields)
            ends = list(accumulate((len(path or ()) for path in columns[-1]), initial=0))
            starts = pa.array([None if path is None else at for path, at in zip(columns[-1], ends)] + ends[-1:], pa.int32())
            arrays.append(pa.ListArray.from_arrays(starts, pa.StructArray.from_arrays([pa.array(v, t) for v, (_, t) in zip(flat, fields)], [name for name, _ in fields])))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for given in batches:
            for page_id, url, html in zip(*(given.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                for row in page_rows(html, paths):
                    held.append((page_id, url, *row[: len(names) - 2]))
                    if len(held) >= ROWS_AT_ONCE:
                        yield batch(held)
                        held = []
        if held:
            yield batch(held)

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, f"{SCHEMA}, {PATH}" if paths else SCHEMA)


def elements(pages: DataFrame) -> DataFrame:
    return rows(pages).where("kind = 'element'").drop("kind", "text")


def pieces(pages: DataFrame, tags: frozenset[str] | None = None, texts: bool = True) -> DataFrame:
    """Elements of ``tags`` (null: all), as `elements` has them, and with ``texts`` the text in them that isn't of scripts and styles, with its ``holders``: the elements of ``tags`` that it is in.

    What nobody asks for doesn't leave the task.
    """
    names = ["page_id", "url", "pre", "post", "depth", "parent", "tag", "attrs", "own", "text", "holders"]
    types = [pa.int64(), pa.string(), *[pa.int32()] * 4, pa.string(), pa.map_(pa.string(), pa.string()), pa.bool_(), pa.string(), pa.list_(pa.int32())]

    def kept(html: str | None) -> Iterator[tuple]:
        for pre, post, depth, parent, tag, attrs, own, kind, text, path in page_rows(html, texts):
            if kind == "element":
                if tags is None or tag in tags:
                    yield pre, post, depth, parent, tag, attrs, own, None, None
            elif kind == "text" and texts and not any(p[1] in construct.UNREAD for p in path):
                holders = [p[0] for p in path if tags is None or p[1] in tags]
                if holders:
                    yield pre, None, depth, parent, None, None, None, text, holders

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
        for given in batches:
            for page_id, url, html in zip(*(given.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                held += ((page_id, url, *row) for row in kept(html))
                if len(held) >= ROWS_AT_ONCE:
                    yield batch()
                    held = []
        if held:
            yield batch()

    schema = f"{SCHEMA.partition(', kind')[0]}, text string, holders array<int>"
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, schema)


def element_text(matches: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, pre, text`` of elements: their text joined by blanks and cleaned, without that of scripts and styles."""
    return _texts(matches, pieces(pages))


def _texts(matches: DataFrame, cut: DataFrame) -> DataFrame:
    inside = cut.where("tag is null").select("page_id", "pre", "text", F.explode("holders").alias("holder"))
    wanted = matches.select("page_id", F.col("pre").alias("holder"))
    gathered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda s: s["text"]), " ")
    found = inside.join(wanted, ["page_id", "holder"]).groupBy("page_id", "holder").agg(txt.clean(gathered).alias("text"))
    return wanted.join(found, ["page_id", "holder"], "left").select("page_id", F.col("holder").alias("pre"), F.coalesce("text", F.lit("")).alias("text"))


# -- selection

_SIMPLE = re.compile(r"(?P<tag>\*|[A-Za-z][\w-]*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<name>[\w-]+)\s*(?:(?P<op>[~^$*|]?=)\s*(?:\"(?P<d>[^\"]*)\"|'(?P<s>[^']*)'|(?P<w>[\w-]+))\s*)?\]|:(?P<pseudo>first-child|last-child)")


def _compound(rest: str) -> tuple[Column, str]:
    """The test of the compound selector that starts ``rest``, and what follows it."""
    test, at, a = F.lit(True), 0, lambda name: F.col("attrs")[name]
    while m := _SIMPLE.match(rest, at):
        if m["tag"]:
            if at:
                break
            test = test if m["tag"] == "*" else F.col("tag") == m["tag"].lower()
        elif m["id"]:
            test &= a("id") == m["id"]
        elif m["cls"]:
            test &= F.array_contains(F.split(F.coalesce(a("class"), F.lit("")), r"\s+"), m["cls"])
        elif m["pseudo"]:
            test &= F.col(m["pseudo"].replace("-", "_"))
        else:
            value, held = next((m[k] for k in "dsw" if m[k] is not None), ""), a(m["name"].lower())
            by = {None: held.isNotNull(), "=": held == value, "~=": F.array_contains(F.split(held, r"\s+"), value), "^=": held.startswith(value), "$=": held.endswith(value), "*=": held.contains(value), "|=": (held == value) | held.startswith(value + "-")}
            test &= by[m["op"]] & F.lit(m["op"] not in ("^=", "$=", "*=") or value != "")
        at = m.end()
    if not at:
        raise ValueError(f"not a supported selector: {rest!r}")
    return F.coalesce(test, F.lit(False)), rest[at:]


def _below(found: DataFrame, context: DataFrame, child: bool) -> DataFrame:
    c = context.select(F.col("page_id").alias("c_page"), F.col("pre").alias("c_pre"), F.col("post").alias("c_post"))
    on = (found.parent == c.c_pre) if child else (found.pre > c.c_pre) & (found.pre < c.c_post)
    return found.join(c, (found.page_id == c.c_page) & on, "left_semi")


def select_css(table: DataFrame, selector: str) -> DataFrame:
    """Elements that a selector matches: types, ids, classes, attributes, first and last children; descendants, children, ``,``."""
    if re.search(r":(first|last)-child", selector):
        own = Window.partitionBy("page_id", "parent")
        table = table.withColumn("first_child", F.col("pre") == F.min("pre").over(own)).withColumn("last_child", F.col("pre") == F.max("pre").over(own))
    out = None
    for part in re.split(r",(?![^\[]*\])", selector):
        context, rest, child = None, part.strip(), False
        while True:
            test, rest = _compound(rest)
            found = table.where(test)
            context = found if context is None else _below(found, context, child)
            m = re.match(r"\s*(>)\s*|\s+", rest)
            if not rest.strip():
                break
            if not m:
                raise ValueError(f"not a supported selector: {selector!r}")
            child, rest = bool(m[1]), rest[m.end() :]
        out = context if out is None else out.union(context)
    return out.drop("first_child", "last_child").dropDuplicates(["page_id", "pre"])


def select_path(table: DataFrame, path: str) -> DataFrame:
    """Elements that a path selects, of the forms of ``html.parse_path``; a position counts the candidates of its own step's context."""
    context = None
    for step in parse_path(path, every=True):
        found = table if step.tag == "*" else table.where(F.col("tag") == step.tag)
        for name, value, part in step.attributes:
            a = F.col("attrs")[name]
            found = found.where(F.coalesce(a.isNotNull() if value is None else a.contains(value) if part else a == value, F.lit(False)))
        if context is None:
            found = found if step.descendant else found.where("depth = 1")
        else:
            found = _below(found, context, not step.descendant)
        if step.position is not None:
            place = F.row_number().over(Window.partitionBy("page_id").orderBy("pre"))
            found = found.withColumn("place", place).where(F.col("place") == step.position).drop("place")
        context = found
    return context


def select(table: DataFrame, selector: str) -> DataFrame:
    """By path where it starts with a slash, else by CSS."""
    return select_path(table, selector) if selector.startswith("/") else select_css(table, selector)


def _named(selector: str) -> frozenset[str] | None:
    """The tags of elements that a selector looks at; null where it may look at any."""
    if selector.startswith("/"):
        tags = [step.tag for step in parse_path(selector, every=True)]
    elif re.search(r":(first|last)-child", selector):
        return None
    else:
        tags = []
        for part in re.split(r",(?![^\[]*\])", selector):
            rest = part.strip()
            while rest:
                tags.append(m["tag"].lower() if (m := _SIMPLE.match(rest)) and m["tag"] else "*")
                rest = re.sub(r"^\s*(>\s*)?", "", _compound(rest)[1])
    return None if "*" in tags else frozenset(tags)


def find(pages: DataFrame, selector: str) -> DataFrame:
    """Elements of pages that a selector matches. Each page is parsed once, whatever the number of steps."""
    return select(materialize(pieces(pages, _named(selector), False), "elements").drop("text", "holders"), selector)


def find_text(pages: DataFrame, selector: str, first: bool = False) -> DataFrame:
    """``page_id, pre, text`` of elements that match, or of each page's first, as `element_text` has it; pages are parsed once for both."""
    cut = materialize(pieces(pages, _named(selector)), "pieces")
    found = select(cut.where("tag is not null").drop("text", "holders"), selector)
    return _texts(found.groupBy("page_id").agg(F.min("pre").alias("pre")) if first else found, cut)


def first_text(pages: DataFrame, selector: str) -> DataFrame:
    """``page_id, text`` of the first element of each page that matches; pages without one have no row.

    A heading by its tag needs no rows of the page: tasks build each tree up to where its first is settled, only its text
    leaves them, and nothing is shuffled. Only a start tag makes one, so pages without it aren't parsed.
    """
    if (tag := selector.strip().lower()) not in construct.HEADINGS:
        return find_text(pages, selector, True).select("page_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            ids, pages_ = (given.column(c) for c in ("page_id", "html"))
            texts = pa.array([construct.first_text(html, tag) for html in pages_.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([ids, texts], names=["page_id", "text"]).filter(texts.is_valid())

    held = pages.where(F.col("html").rlike(f"(?i)<{tag}")).select(F.col("page_id").cast("long").alias("page_id"), "html")
    return materialize(held.mapInArrow(run, "page_id long, text string").select("page_id", txt.clean(F.col("text")).alias("text")), "first-texts")


def fingerprints(matches: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, pre, tag, id, classes, data, text`` as ``html.refind`` takes them; ``snippet`` is the text's first 80 characters."""
    own = matches.join(element_text(matches, pages), ["page_id", "pre"])
    data = F.map_filter("attrs", lambda k, _: k.startswith("data-"))
    classes = F.array_sort(F.array_distinct(F.filter(F.split(F.coalesce(F.col("attrs")["class"], F.lit("")), r"\s+"), lambda c: c != "")))
    return own.select("page_id", "pre", "tag", F.nullif(F.col("attrs")["id"], F.lit("")).alias("id"), classes.alias("classes"), data.alias("data"), "text", F.substring("text", 1, 80).alias("snippet"))


def remember(found: DataFrame, name: Column) -> DataFrame:
    """``name, memory``: the first fingerprint of each name as JSON with sorted keys, the same for the same element on every run."""
    first = found.withColumn("name", name).groupBy("name").agg(F.min_by(F.struct("classes", "data", "id", "snippet", "tag"), F.struct("page_id", "pre")).alias("m"))
    pairs = F.map_from_entries(F.array_sort(F.map_entries("m.data")))
    return first.select("name", F.to_json(F.struct("m.classes", pairs.alias("data"), "m.id", "m.snippet", "m.tag")).alias("memory"))


def recall(memory: DataFrame) -> DataFrame:
    """``name, tag, id, classes, data, snippet`` from ``name, memory``; what isn't such JSON has no row."""
    m = F.from_json("memory", "classes array<string>, data map<string,string>, id string, snippet string, tag string")
    return memory.select("name", m.alias("m")).where("m.tag is not null").select("name", "m.*")


# -- links


def anchors(pages: DataFrame) -> DataFrame:
    """``page_id, url, ordinal, href`` of every anchor with a target, in document order: any quoting, references decoded, none from comments or scripts. A page is parsed once, and only its anchors leave the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            held: list[tuple] = []
            for page_id, url, html in zip(*(given.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                below, n = [construct.build(html)] if html is not None else [], 0
                while below:
                    node = below.pop()
                    if node.tag == "a" and "href" in node.attrs:
                        held.append((page_id, url, n, node.attrs["href"].strip(" \t\n\f\r")))
                        n += 1
                    below += [c for c in reversed(node.children) if isinstance(c, construct.Node)]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.int64(), pa.string(), pa.int32(), pa.string()))], names=["page_id", "url", "ordinal", "href"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, ordinal int, href string")


# -- Markdown

def _hides() -> Column:
    """Whether an element's own row says that it isn't content."""
    a = F.col("attrs")
    classes = F.split(F.coalesce(a["class"], F.lit("")), r"[\t\n\f\r ]+")
    return F.coalesce(F.col("tag").isin(*sorted(HIDDEN)) | F.map_contains_key("attrs", "hidden") | a["aria-hidden"].eqNullSafe("true") | F.arrays_overlap(classes, F.array(*map(F.lit, sorted(EXCLUDED_CLASSES)))), F.lit(False))


def content_root(made: DataFrame) -> DataFrame:
    """``page_id, root`` (its ``pre``) from pages' rows with paths: the first of main, role=main and article, in this order of kinds, that isn't hidden and holds visible text or an image with a safe source; else the body."""
    e = made.where("kind = 'element'")
    kind = F.when(F.col("tag") == "main", 0).when(F.col("attrs")["role"] == "main", 1).when(F.col("tag") == "article", 2).when(F.col("tag") == "body", 3)
    shown = F.when(F.col("kind") == "text", F.col("text").rlike(r"(?U)\S")).when(F.col("kind") == "img", urls.resolve(F.col("url"), F.get(F.from_json("text", "array<string>"), F.lit(1))).isNotNull())
    visible = made.where("kind in ('text', 'img')").where(~F.exists("path", lambda p: p["hidden"])).where(shown)
    holders = visible.select("page_id", F.explode(F.transform("path", lambda p: p["pre"])).alias("pre")).distinct().withColumn("holds", F.lit(True))
    roots = e.withColumn("rank", kind).where("rank is not null").join(holders, ["page_id", "pre"], "left").where("holds or rank = 3")
    return roots.groupBy("page_id").agg(F.min_by("pre", F.struct("rank", "pre")).alias("root"))


def table_cells(e: DataFrame) -> DataFrame:
    """``page_id, grid, line, cell, place, heads, hides, align``: the cells that each table owns, by its sections' rows only, so those of a nested table are the nested one's.

    ``place`` counts a row's cells from 0. ``heads`` marks the header row: the first of a thead, else the table's first row if
    it has th cells and none of them heads a row. ``align`` is what col, colgroup, row and cell agree on in the whole column.
    """
    named = lambda df, *pairs: df.select("page_id", *(c.alias(n) for n, c in pairs))
    a, pre, parent = F.col("attrs"), F.col("pre"), F.col("parent")
    section = named(e.where("tag in ('thead', 'tbody', 'tfoot')"), ("section", pre), ("grid", parent), ("head", F.col("tag") == "thead"))
    line = named(e.where("tag = 'tr'"), ("line", pre), ("section", parent), ("row_align", a["align"]))
    cell = named(e.where("tag in ('td', 'th')"), ("cell", pre), ("line", parent), ("th", F.col("tag") == "th"), ("by_row", F.lower(F.trim(a["scope"])) == "row"), ("own_align", a["align"]), ("hides", F.col("hides")))
    owned = cell.join(line, ["page_id", "line"]).join(section, ["page_id", "section"])
    owned = owned.withColumn("place", F.row_number().over(Window.partitionBy("page_id", "line").orderBy("cell")) - 1)
    seen = F.col("th") & ~F.col("hides")
    lines = owned.groupBy("page_id", "grid", "line").agg(F.first("head").alias("head"), (F.bool_or(seen) & ~F.bool_or(seen & F.coalesce("by_row", F.lit(False)))).alias("titled"))
    first = lines.groupBy("page_id", "grid").agg(F.min(F.when(F.col("head"), F.col("line"))).alias("head"), F.min_by("titled", "line").alias("titled"), F.min("line").alias("first"))
    header = first.select("page_id", "grid", F.coalesce("head", F.when(F.col("titled"), F.col("first"))).alias("header"))
    # what is said of columns: a col stands for `span` of them, one without cols below it is a colgroup's own
    span = F.greatest(F.lit(1), F.least(F.lit(1000), F.coalesce(F.trim(a["span"]).try_cast("int"), F.lit(1))))
    group = named(e.where("tag = 'colgroup'"), ("group", pre), ("grid", parent), ("group_align", F.when(~F.col("hides"), a["align"])), ("group_span", span), ("group_hides", F.col("hides")))
    col = named(e.where("tag = 'col'"), ("at", pre), ("group", parent), ("col_align", F.when(~F.col("hides"), a["align"])), ("col_span", span))
    said = group.join(col, ["page_id", "group"], "left").withColumn("wide", F.coalesce("col_span", "group_span"))
    order = Window.partitionBy("page_id", "grid").orderBy(F.coalesce("at", "group"))
    said = said.withColumn("upto", F.sum("wide").over(order)).withColumn("aligns", F.array("group_align", F.when(~F.col("group_hides"), F.col("col_align"))))
    columns = said.select("page_id", "grid", F.explode(F.sequence((F.col("upto") - F.col("wide")).cast("int"), (F.col("upto") - 1).cast("int"))).alias("place"), "aligns").select("page_id", "grid", "place", F.explode("aligns").alias("align"))
    cells = owned.where(~F.col("hides")).select("page_id", "grid", "place", F.explode(F.array("row_align", "own_align")).alias("align"))
    value = F.lower(F.trim("align"))
    agreed = cells.unionByName(columns).select("page_id", "grid", "place", value.alias("align")).where(F.col("align").isin("left", "center", "right"))
    agreed = agreed.groupBy("page_id", "grid", "place").agg(F.when(F.min("align") == F.max("align"), F.min("align")).alias("align"))
    out = owned.join(header, ["page_id", "grid"]).join(agreed, ["page_id", "grid", "place"], "left")
    return out.select("page_id", "grid", "line", "cell", "place", (F.col("line") == F.col("header")).alias("heads"), "hides", "align")


def _in(tags: tuple[str, ...]) -> Column:
    return F.exists("path", lambda p: p["tag"].isin(*tags))


def _last(tags, field: str) -> Column:
    return F.try_element_at(F.filter("path", lambda p: p["tag"].isin(*tags)), F.lit(-1))[field]


def _ticks(c: Column, least: int) -> Column:
    longest = F.array_max(F.transform(F.regexp_extract_all(c, F.lit("(`+)"), 1), lambda t: F.length(t)))
    return F.repeat(F.lit("`"), F.greatest(F.lit(least), F.coalesce(longest, F.lit(0)) + 1))


def _joined(order: str, value: str, by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value]), by)


# Elements below html within each other, and characters of output, past which a page is refused.
DEEPEST_PAGE, LONGEST_MARKDOWN = 256, 1_000_000


def markdown_bounded(pages: DataFrame, most: int = LONGEST_MARKDOWN, deepest: int = DEEPEST_PAGE) -> DataFrame:
    """``page_id, markdown, error``: Markdown as `markdown` makes it, or null with what stands against it: ``html`` where elements are nested more than ``deepest`` levels, ``body_limit`` where it would have more than ``most`` characters.

    A page is whole or refused: nothing is cut, so whatever is opened is closed. Characters are code points, after white space
    is folded. Pages nested too deeply are left out before anything is joined. Null html gives the empty text.
    """
    cut = materialize(rows(pages, True), "page-rows")
    deep = cut.where(F.col("depth") > deepest + 1).select("page_id").distinct()
    ids = pages.select(F.col("page_id").cast("long").alias("page_id"))
    made = _markdown(cut.join(deep, "page_id", "left_anti"))
    told = ids.join(made, "page_id", "left").join(deep.withColumn("deep", F.lit(True)), "page_id", "left")
    text = F.coalesce("markdown", F.lit(""))
    error = F.when(F.col("deep"), "html").when(F.length(text) > most, "body_limit")
    return told.select("page_id", F.when(error.isNull(), text).alias("markdown"), error.alias("error"))


def markdown(pages: DataFrame) -> DataFrame:
    """``page_id, markdown`` of each page, empty where `markdown_bounded` refuses it with its usual bounds."""
    return markdown_bounded(pages).select("page_id", F.coalesce("markdown", F.lit("")).alias("markdown"))


def _markdown(cut: DataFrame) -> DataFrame:
    """``page_id, markdown`` of each page's content root, of rows with paths; pages without any have no row.

    Headings, paragraphs, rules, quotes, nested and numbered lists, tables, fenced and inline code, strong, emphasised and
    struck text, links, images and hard breaks. Navigation, forms, hidden parts and advertising go. Targets that don't
    resolve to http(s) leave their text. Each piece of text knows its ancestors, so blocks and runs are groups of rows.
    """
    roots = content_root(cut)
    found = cut.where("kind <> 'element'").join(roots, "page_id")
    kept = found.where(F.exists("path", lambda p: p["pre"] == F.col("root")) & ~F.exists(F.filter("path", lambda p: p["pre"] > F.col("root")), lambda p: p["hidden"]))
    block_tags = sorted(BLOCKS)
    # a table is the outermost one below the root; what is nested in a cell is the cell's text
    inner = F.filter("path", lambda p: p["pre"] > F.col("root"))
    outer = lambda path, *tags: F.get(F.filter(path, lambda p: p["tag"].isin(*tags)), F.lit(0))["pre"]
    grid = outer(inner, "table")
    cell = outer(F.filter(inner, lambda p: p["pre"] > grid), "td", "th")
    item = F.filter("path", lambda p: (p["tag"] == "li") & (p["pre"] > F.col("root")))
    marked = kept.select(
        "page_id", "url", "pre", "kind", "text",
        F.coalesce(cell, F.when(F.col("kind") == "hr", F.col("pre")).otherwise(_last(block_tags, "pre"))).alias("block"),
        F.when(cell.isNotNull(), "td").when(F.col("kind") == "hr", "hr").otherwise(_last(block_tags, "tag")).alias("holder"),
        F.size(item).alias("depth"), F.try_element_at(item, F.lit(-1))["pre"].alias("item"), F.try_element_at(item, F.lit(-1))["note"].alias("number"),
        F.size(F.filter("path", lambda p: (p["tag"] == "blockquote") & (p["pre"] > F.col("root")))).alias("quotes"),
        grid.alias("grid"), cell.alias("cell"),
        (_in(("pre",)) & cell.isNull()).alias("fenced"), F.coalesce(_last(("code",), "note"), _last(("pre",), "note")).alias("class"),
        _in(("strong", "b")).alias("strong"), _in(("em", "i")).alias("em"), _in(("del", "s", "strike")).alias("struck"),
        (_in(("code",)) & (~_in(("pre",)) | cell.isNotNull())).alias("code"), _last(("a",), "note").alias("href"),
    )
    marked = marked.withColumn("dest", F.coalesce(F.when(F.col("href").isNotNull(), urls.resolve(F.col("url"), F.col("href"))), F.lit(""))).drop("href")
    order = Window.partitionBy("page_id").orderBy("pre")
    changes = lambda key: F.sum(F.when(key.eqNullSafe(F.lag(key).over(order)), 0).otherwise(1)).over(order)
    style = F.struct("block", "strong", "em", "struck", "code", "dest", F.col("kind") == "img")
    runs = marked.withColumn("para", changes(F.struct("block"))).withColumn("run", changes(style))
    escaped = F.regexp_replace("text", r"([\\*_\[\]`~|<>])", r"\\$1")
    image = F.from_json("text", "array<string>")
    source = urls.resolve(F.col("url"), F.get(image, F.lit(1)))
    drawn = F.when(source.isNull(), txt.clean(F.get(image, F.lit(0)))).otherwise(F.concat(F.lit("!["), F.regexp_replace(txt.clean(F.get(image, F.lit(0))), r"([\\\[\]])", r"\\$1"), F.lit("]("), txt.escape_destination(source), F.lit(")")))
    piece = F.when(F.col("kind") == "br", F.when(F.col("cell").isNull(), F.lit("\x01")).otherwise(" ")).when(F.col("kind") == "img", drawn).when(F.col("fenced") | F.col("code"), F.col("text")).otherwise(escaped)
    firsts = [F.first(c).alias(c) for c in ("holder", "depth", "item", "number", "quotes", "grid", "cell", "fenced", "class", "strong", "em", "struck", "code", "dest")]
    run = runs.withColumn("piece", piece).groupBy("page_id", "para", "run").agg(*firsts, _joined("pre", "piece", "").alias("body"))
    # what is used more than once is a column of its own: written out where it is used, it would be computed as often
    run = run.withColumn("flat", F.regexp_replace("body", r"(?U)\s+", " ")).withColumn("core", F.trim("flat"))
    flat, core = F.col("flat"), F.col("core")
    run = run.withColumn("ticks", F.when(F.col("code"), F.concat(_ticks(core, 1), F.when(core.startswith("`") | core.endswith("`"), " ").otherwise(""))).otherwise(""))
    spelled = F.when(F.col("code") & F.col("cell").isNotNull(), F.replace(core, F.lit("|"), F.lit("\\|"))).otherwise(core)
    shown = [F.col("ticks"), spelled, F.reverse("ticks")]
    for flag, mark in (("struck", "~~"), ("em", "*"), ("strong", "**")):
        mark = F.when(F.col(flag), mark).otherwise("")
        shown = [mark, *shown, mark]
    linked = F.col("dest") != ""
    shown = [F.when(linked, "[").otherwise(""), *shown, F.when(linked, F.concat(F.lit("]("), txt.escape_destination(F.col("dest")), F.lit(")"))).otherwise("")]
    around = F.concat(F.when(flat.startswith(" "), " ").otherwise(""), *shown, F.when(flat.endswith(" "), " ").otherwise(""))
    part = F.when(F.col("fenced"), F.col("body")).when(core == "", F.when(F.col("body") == "", "").otherwise(" ")).otherwise(around)
    parts = run.withColumn("part", part).groupBy("page_id", "para").agg(*[F.first(c).alias(c) for c in ("holder", "depth", "item", "number", "quotes", "grid", "cell", "fenced", "class")], _joined("run", "part", "").alias("body"))
    parts = parts.withColumn("one", F.trim(F.regexp_replace(F.regexp_replace("body", " +", " "), " ?\x01 ?", "\x01")))
    one = F.col("one")
    safe = F.regexp_replace(F.regexp_replace(one, r"^([#\-+!=])", r"\\$1"), r"^([0-9]+)([.)])", r"$1\\$2")
    safe = F.when(one.rlike(r"^!\["), one).otherwise(safe)
    broken = F.regexp_replace(F.regexp_replace(safe, "^\x01+|\x01+$", ""), "\x01", "  \n")
    fence = _ticks(F.col("body"), 3)
    language = F.regexp_extract(F.coalesce("class", F.lit("")), r"(?:^|\s)lang(?:uage)?-([\w+#.-]+)", 1)
    block = F.concat(fence, language, F.lit("\n"), F.regexp_replace("body", r"^\n|\n$", ""), F.lit("\n"), fence)
    parts = parts.withColumn("level", F.regexp_extract("holder", "^h([1-6])$", 1))
    level = F.col("level")
    head = F.when(level != "", F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "))).otherwise("")
    text = F.when(F.col("holder") == "hr", "---").when(F.col("fenced"), block).otherwise(F.concat(head, broken))
    # Read by three branches below, each of which would make all blocks of all pages again. Empty ones go after it: a test of
    # what is made would be pushed below the columns above, and make it again from their expressions.
    blocks = parts.select("page_id", "para", "depth", "item", "number", "quotes", "grid", "cell", text.alias("out"))
    blocks = materialize(blocks, "page-blocks").where("out <> '' or grid is not null")

    texts = blocks.where("cell is not null").groupBy("page_id", "cell").agg(F.trim(_joined("para", "out", " ")).alias("out"))
    shown = found.select("page_id", grid.alias("grid"), F.struct(F.size(item).alias("depth"), F.try_element_at(item, F.lit(-1))["pre"].alias("item"), F.try_element_at(item, F.lit(-1))["note"].alias("number"), F.size(F.filter("path", lambda p: (p["tag"] == "blockquote") & (p["pre"] > F.col("root")))).alias("quotes")).alias("held"), F.exists(F.filter(inner, lambda p: p["pre"] <= grid), lambda p: p["hidden"]).alias("away"))
    grids = shown.where("grid is not null and not away").groupBy("page_id", "grid").agg(F.first("held").alias("held"))
    owned = table_cells(cut.where("kind = 'element'").withColumn("hides", _hides())).join(grids, ["page_id", "grid"]).join(texts, ["page_id", "cell"], "left")
    out = F.when(F.col("hides"), "").otherwise(F.coalesce("out", F.lit("")))
    lines = owned.withColumn("out", out).groupBy("page_id", "grid", "line").agg(_joined("place", "out", " | ").alias("out"), F.count("*").alias("wide"), F.first("heads").alias("heads"), F.first("held").alias("held"), F.collect_list(F.struct("place", "align")).alias("aligns"))
    whole = lines.groupBy("page_id", "grid").agg(F.array_sort(F.collect_list(F.struct((~F.col("heads")).cast("int").alias("after"), "line", "out", "wide"))).alias("all"), F.first("held").alias("held"), F.flatten(F.collect_list("aligns")).alias("aligns"))
    whole = whole.withColumn("width", F.array_max(F.transform("all", lambda x: x["wide"])))
    width = F.col("width")
    ruled = F.transform(F.sequence(F.lit(0), width.cast("int") - 1), lambda k: F.coalesce(F.element_at(F.create_map(F.lit("left"), F.lit(":---"), F.lit("center"), F.lit(":---:"), F.lit("right"), F.lit("---:")), F.get(F.filter("aligns", lambda x: x["place"] == k), F.lit(0))["align"]), F.lit("---")))
    rule = F.concat(F.lit("| "), F.array_join(ruled, " | "), F.lit(" |"))
    drawn = F.transform("all", lambda x: F.concat(F.lit("| "), x["out"], F.repeat(F.lit(" | "), (width - x["wide"]).cast("int")), F.lit(" |")))
    headed = F.get("all", F.lit(0))["after"] == 0
    none = F.concat(F.lit("|"), F.repeat(F.lit("  |"), width.cast("int")))
    body = F.when(headed, F.slice(drawn, 2, 1_000_000)).otherwise(drawn)
    table = F.array_join(F.concat(F.array(F.when(headed, F.get(drawn, F.lit(0))).otherwise(none), rule), body), "\n")
    places = blocks.where("grid is not null").groupBy("page_id", "grid").agg(F.min("para").alias("para"))
    tables = whole.join(places, ["page_id", "grid"]).select("page_id", "para", "held.*", table.alias("out"))

    plain = blocks.where("grid is null").select("page_id", "para", "depth", "item", "number", "quotes", "out")
    whole = plain.unionByName(tables.select(plain.columns))
    leads = F.row_number().over(Window.partitionBy("page_id", "item").orderBy("para")) == 1
    marker = F.when(F.col("item").isNull(), "").when(~leads, "    ").when(F.col("number") == "-", "- ").otherwise(F.concat("number", F.lit(". ")))
    indent = F.repeat(F.lit("    "), F.greatest(F.lit(0), F.col("depth") - 1))
    rest = F.concat(F.lit("\n"), F.repeat(F.lit("    "), F.col("depth")))
    listed = F.when(F.col("depth") > 0, F.concat(indent, marker, F.regexp_replace(F.col("out"), F.lit("\n"), rest))).otherwise(F.col("out"))
    quote = F.repeat(F.lit("> "), F.col("quotes"))
    quoted = F.when(F.col("quotes") > 0, F.concat(quote, F.regexp_replace(listed, F.lit("\n"), F.concat(F.lit("\n"), quote)))).otherwise(listed)
    # an item follows the one before it, or what it is nested in, on the next line
    here = Window.partitionBy("page_id").orderBy("para")
    tight = F.col("leads") & (F.col("depth") > 0) & (F.lag("depth").over(here) > 0)
    piece = F.concat(F.when(F.lag("para").over(here).isNull(), "").when(tight, "\n").otherwise("\n\n"), "piece")
    made = whole.withColumn("piece", quoted).withColumn("leads", leads).withColumn("piece", piece).groupBy("page_id").agg(_joined("para", "piece", "").alias("markdown"))
    return made
