"""HTML as rows: tokens, a node table, selection by path, refinding by fingerprint, and Markdown.

A page is cut into tokens by one regular expression inside Spark; everything after that is windows and aggregates over
the tokens of a page, so pages spread over the cluster and no document tree is built in Python.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as txt
from ..functions import urls

#: Comments, raw-text elements and advertising boxes are one token each, then tags, then text.
TOKEN = r'(?is)(<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>|<div class="ad">.*?</div>|<[^>]*>|[^<]+)'
# Elements without an end tag, and those whose end tag may be left out (here: outside the nesting).
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
LOOSE = ("p", "b", "i", "em", "strong", "li")
# Elements whose content isn't content, and those that end a block.
EXCLUDED = ("head", "nav", "footer", "aside", "header", "form", "template", "svg")
BLOCKS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "div", "article", "main", "section", "body", "blockquote", "pre", "table", "tr", "hr")
# Character references that pages use; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"))


#: Where an element that is never closed ends.
OPEN_END = 2**31 - 1


def decode_entities(c: Column) -> Column:
    for name, value in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(value))
    return c


def tokens(pages: DataFrame) -> DataFrame:
    """``page_id, url, pos, token, kind, tag``; kinds are open, close, raw and text."""
    cut = pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit(TOKEN), 1)).alias("pos", "token"))
    raw = F.lower("token").rlike(r'^(<!|<\?|<script\b|<style\b|<div class="ad">)')
    kind = F.when(~F.col("token").startswith("<"), "text").when(raw, "raw").when(F.col("token").startswith("</"), "close").otherwise("open")
    return cut.withColumn("kind", kind).withColumn("tag", F.lower(F.regexp_extract("token", r"^</?([A-Za-z][A-Za-z0-9]*)", 1)))


def attribute(token: Column, name: str) -> Column:
    return F.nullif(decode_entities(F.regexp_extract(token, rf'\s{name}="([^"]*)"', 1)), F.lit(""))


def nodes(pages: DataFrame) -> DataFrame:
    """``page_id, pre, post, depth, parent, tag, token``: the strictly nested elements of each page.

    The running sum of openings and closings gives depths. Within one page and depth, openings and closings alternate, so
    the next row of the level closes an element; and the last opening one level up is its parent.
    """
    strict = tokens(pages).where(F.col("kind").isin("open", "close") & ~F.col("tag").isin(*VOID, *LOOSE) & (F.col("tag") != ""))
    w = Window.partitionBy("page_id").orderBy("pos")
    depth = F.sum(F.when(F.col("kind") == "open", 1).otherwise(-1)).over(w)
    level = strict.withColumn("depth", depth + F.when(F.col("kind") == "close", 1).otherwise(0))
    close = F.lead("pos").over(Window.partitionBy("page_id", "depth").orderBy("pos"))
    ended = level.withColumn("post", F.coalesce(close, F.lit(OPEN_END))).where("kind = 'open'")
    own = ended.select("page_id", F.col("depth").alias("level"), "pos", F.lit(True).alias("above"), "post", "depth", "tag", "token")
    below = ended.select("page_id", (F.col("depth") - 1).alias("level"), "pos", F.lit(False).alias("above"), "post", "depth", "tag", "token")
    up = Window.partitionBy("page_id", "level").orderBy("pos", F.desc("above"))
    parent = F.last(F.when(F.col("above"), F.col("pos")), ignorenulls=True).over(up)
    both = own.union(below).withColumn("parent", parent).where(~F.col("above"))
    return both.select("page_id", F.col("pos").alias("pre"), "post", "depth", "parent", "tag", "token")


@dataclass(frozen=True)
class Step:
    descendant: bool
    tag: str
    position: int | None
    attributes: tuple[tuple[str, str, bool], ...]


def parse_path(path: str, every: bool = False) -> list[Step]:
    """``/a//b[2][@id][@class='x'][contains(@href,'y')]``: child and descendant steps with these predicates only.

    Elements that the node table leaves out can't be named; a path that does raises an error, unless ``every`` element has rows.
    """
    steps, rest = [], path
    pattern = re.compile(r"(//?)(\*|[A-Za-z][A-Za-z0-9]*)((?:\[[^\]]*\])*)")
    while rest:
        m = pattern.match(rest)
        if not m:
            raise ValueError(f"not a supported path: {path!r}")
        if not every and m[2].lower() in VOID + LOOSE:
            raise ValueError(f"the node table has no {m[2]} elements: {path!r}")
        position, attributes = None, []
        for p in re.findall(r"\[([^\]]*)\]", m[3]):
            if p.isdigit() and int(p) > 0:
                position = int(p)
            elif a := re.fullmatch(r"@([\w-]+)(?:='([^']*)')?", p):
                attributes.append((a[1], a[2], False))
            elif a := re.fullmatch(r"contains\(@([\w-]+),\s*'([^']*)'\)", p):
                attributes.append((a[1], a[2], True))
            else:
                raise ValueError(f"not a supported predicate: [{p}]")
        steps.append(Step(m[1] == "//", m[2].lower(), position, tuple(attributes)))
        rest = rest[m.end() :]
    return steps


def select(table: DataFrame, path: str) -> DataFrame:
    """Nodes that a path selects. A child step is an equality join on the parent, a descendant step an interval join within the page.

    A position counts the step's whole candidate list of the page in document order, after all other predicates.
    """
    context = None
    for step in parse_path(path):
        found = table
        if step.tag != "*":
            found = found.where(F.col("tag") == step.tag)
        for name, value, part in step.attributes:
            a = attribute(F.col("token"), name)
            found = found.where(a.isNotNull() if value is None else F.coalesce(a.contains(value) if part else a == value, F.lit(False)))
        if context is None:
            found = found if step.descendant else found.where("depth = 1")
        elif step.descendant:
            c = context.select(F.col("page_id").alias("c_page"), F.col("pre").alias("c_pre"), F.col("post").alias("c_post"))
            found = found.join(c, (found.page_id == c.c_page) & (found.pre > c.c_pre) & (found.pre < c.c_post), "left_semi")
        else:
            c = context.select(F.col("page_id").alias("c_page"), F.col("pre").alias("c_pre"))
            found = found.join(c, (found.page_id == c.c_page) & (found.parent == c.c_pre), "left_semi")
        if step.position is not None:
            place = F.row_number().over(Window.partitionBy("page_id").orderBy("pre"))
            found = found.withColumn("place", place).where(F.col("place") == step.position).drop("place")
        context = found
    return context


def node_text(table: DataFrame, pages: DataFrame) -> DataFrame:
    """``page_id, pre, text`` of each node: its text tokens in order, joined by blanks and cleaned."""
    words = tokens(pages).where("kind = 'text'").select(F.col("page_id").alias("t_page"), "pos", decode_entities(F.col("token")).alias("piece"))
    inside = table.join(words, (F.col("page_id") == F.col("t_page")) & (F.col("pos") > F.col("pre")) & (F.col("pos") < F.col("post")))
    gathered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda s: s["piece"]), " ")
    return inside.groupBy("page_id", "pre").agg(txt.clean(gathered).alias("text"))


def refind(candidates: DataFrame, remembered: DataFrame, least: float = 0.5) -> DataFrame:
    """The candidate of each page and name that is most like the remembered element; the first in document order wins ties.

    ``remembered``: name, tag, id, classes, data, snippet; ``candidates``: page_id, pre, tag, id, classes, data, text. Both
    are joined on the tag only. 0.2 for the tag, 0.45 for the id, 0.2 for each equal data attribute, up to 0.2 for shared
    classes and 0.35 for the text's beginning.
    """
    r = F.broadcast(remembered.select("name", "tag", *[F.col(c).alias(f"r_{c}") for c in ("id", "classes", "data", "snippet")]))
    both = candidates.join(r, "tag")
    same_id = F.when(F.col("r_id").isNotNull() & F.col("id").eqNullSafe(F.col("r_id")), 0.45).otherwise(0.0)
    shared = F.size(F.array_intersect("classes", "r_classes")) / F.greatest(F.size("r_classes"), F.lit(1))
    data = F.size(F.filter(F.map_keys("r_data"), lambda k: F.col("data")[k] == F.col("r_data")[k])) * 0.2
    text = F.when((F.col("r_snippet") != "") & F.col("text").startswith(F.col("r_snippet")), 0.35).otherwise(0.0)
    scored = both.withColumn("score", F.least(F.lit(1.0), F.lit(0.2) + same_id + data + shared * 0.2 + text)).where(F.col("score") >= least)
    best = scored.groupBy("page_id", "name").agg(F.max(F.struct("score", (-F.col("pre")).alias("before"))).alias("best"))
    return best.select("page_id", "name", (-F.col("best.before")).alias("pre"), F.col("best.score").alias("score"))


def facts(pages: DataFrame) -> DataFrame:
    """``page_id, title, heading, words, shell``: what a page says of itself, and whether it looks like an empty shell for scripts."""
    html = F.col("html")
    bare = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style|template|svg|title)\b.*?</\1>", " ")
    visible = txt.clean(decode_entities(F.regexp_replace(bare, "<[^>]*>", " ")))
    title = txt.clean(decode_entities(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), "<[^>]*>", "")))
    heading = txt.clean(decode_entities(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", "")))
    has_p = html.rlike(r"(?is)<p[^>]*>\s*[^<\s]")
    hint = F.lower("html").rlike("enable javascript|checking your browser|just a moment")
    words = txt.word_count(visible)
    shell = F.when(words == 0, True).when((words < 120) & hint, True).when((title != "") & has_p, False).otherwise(words < 3)
    return pages.select("page_id", title.alias("title"), heading.alias("heading"), words.alias("words"), shell.alias("shell"))


def _escaped(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\*_\[\]`~|<>&])", r"\\$1")


def markdown(pages: DataFrame) -> DataFrame:
    """``page_id, markdown``: headings, paragraphs, list items, strong runs and links of each page's content.

    Running counts over a page's tokens tell which block a text is in, whether a strong element is open (one that is never
    closed goes on in later blocks, as browsers have it) and which link is open. Runs of equal marks are joined, wrapped
    with their outer blanks left outside, and blocks are joined by blank lines. Links whose target isn't http(s) are text.
    """
    t = tokens(pages)
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opened = lambda tags: F.sum(F.when((F.col("kind") == "open") & F.col("tag").isin(*tags), 1).when((F.col("kind") == "close") & F.col("tag").isin(*tags), -1).otherwise(0)).over(w)
    is_block = F.col("tag").isin(*BLOCKS) & F.col("kind").isin("open", "close")
    marked = t.select(
        "page_id", "url", "pos", "token", "kind",
        opened(EXCLUDED).alias("excluded"),
        F.sum(is_block.cast("int")).over(w).alias("block"),
        F.last(F.when(is_block, F.when(F.col("kind") == "open", F.col("tag")).otherwise("")), ignorenulls=True).over(w).alias("holder"),
        (opened(("b", "strong")) > 0).alias("strong"),
        F.when(opened(("a",)) > 0, F.last(F.when((F.col("kind") == "open") & (F.col("tag") == "a"), attribute(F.col("token"), "href")), ignorenulls=True).over(w)).alias("href"),
    )
    dest = urls.resolve(F.col("url"), F.col("href"))
    texts = marked.where("kind = 'text' and excluded <= 0").select("page_id", "pos", "block", "holder", "strong", F.coalesce(dest, F.lit("")).alias("dest"), _escaped(decode_entities(F.col("token"))).alias("piece"))
    order = Window.partitionBy("page_id").orderBy("pos")
    key = F.struct("block", "strong", "dest")
    runs = texts.withColumn("run", F.sum(F.when(key.eqNullSafe(F.lag(key).over(order)), 0).otherwise(1)).over(order))
    gathered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "piece"))), lambda s: s["piece"]), "")
    run = runs.groupBy("page_id", "block", "run").agg(F.first("holder").alias("holder"), F.first("strong").alias("strong"), F.first("dest").alias("dest"), F.regexp_replace(gathered, r"(?U)\s+", " ").alias("body"))
    core = F.trim("body")
    linked = F.when(F.col("dest") != "", F.concat(F.lit("["), core, F.lit("]("), txt.escape_destination(F.col("dest")), F.lit(")"))).otherwise(core)
    wrapped = F.when(F.col("strong"), F.concat(F.lit("**"), linked, F.lit("**"))).otherwise(linked)
    around = F.concat(F.when(F.col("body").startswith(" "), " ").otherwise(""), wrapped, F.when(F.col("body").endswith(" "), " ").otherwise(""))
    part = run.withColumn("part", F.when(core == "", F.when(F.col("body") == "", "").otherwise(" ")).otherwise(around))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("run", "part"))), lambda s: s["part"]), "")
    blocks = part.groupBy("page_id", "block").agg(F.first("holder").alias("holder"), F.trim(F.regexp_replace(joined, " +", " ")).alias("line")).where("line <> ''")
    safe = F.regexp_replace(F.regexp_replace("line", r"^([#\-+!=])", r"\\$1"), r"^([0-9]+)([.)])", r"$1\\$2")
    level = F.regexp_extract("holder", "^h([1-6])$", 1)
    head = F.when(level != "", F.concat(F.repeat(F.lit("#"), level.cast("int")), F.lit(" "))).when(F.col("holder") == "li", "- ").otherwise("")
    lines = blocks.withColumn("line", F.concat(head, safe))
    page = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "line"))), lambda s: s["line"]), "\n\n")
    made = lines.groupBy("page_id").agg(page.alias("markdown"))
    return pages.select("page_id").join(made, "page_id", "left").select("page_id", F.coalesce("markdown", F.lit("")).alias("markdown"))
