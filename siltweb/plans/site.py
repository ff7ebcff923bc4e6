"""Queries over page trees, scripts, robots outcomes and crawls with a budget, each with the SQL that it must match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks, urls
from ..operators import captions, crawl, feeds, robots, scripts, tree
from ..storage import materialize, table
from .content import _clean, _entities
from .web import _parts

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


# -- trees

# Paragraphs of the snapshot's pages: what follows each start tag, up to the end of the paragraph or of the article.
_PARAGRAPHS = r"""pieces as (select page_id, unnest(string_split(html, '<p>')[2:]) piece, generate_subscripts(string_split(html, '<p>')[2:], 1) n from pages),
paras as (select page_id, n, regexp_replace(piece, '(?s)</(p|article)>.*$', '') body from pieces)"""


@query(f"""with {_PARAGRAPHS}, t as (select page_id, n, {_clean(_entities("regexp_replace(body, '<[^>]*>', ' ', 'g')"))} txt from paras)
select page_id, n, txt as text from t""")
def paragraph_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of each paragraph, by a path from the root; paragraphs without an end tag end where browsers end them."""
    texts = tree.find_text(table(spark, sf_dir, "pages"), "/html/body/article/p")
    return texts.select("page_id", F.expr("row_number() over (partition by page_id order by pre)").cast("long").alias("n"), "text")


@query(f"""with {_PARAGRAPHS}, b as (select page_id, min(n) first from paras where contains(body, '<b>') group by page_id)
select page_id, count(*) n from paras join b using (page_id) where n >= first group by page_id""")
def bold_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that hold bold text: the b elements of these pages are never closed, so each goes on in all later ones."""
    e = tree.elements(table(spark, sf_dir, "pages")).select("page_id", "pre", "post", "parent", "tag")
    e = materialize(e.where("tag in ('p', 'b')"), "p-and-b")
    p, b = e.where("tag = 'p'"), e.where("tag = 'b'").select(F.col("page_id").alias("b_page"), F.col("pre").alias("b_pre"))
    return p.join(b, (p.page_id == b.b_page) & (b.b_pre > p.pre) & (b.b_pre < p.post), "left_semi").groupBy("page_id").agg(F.count("*").alias("n"))


@query(r"""select page_id, regexp_extract_all(html, '<li><a href="([^"]*)">', 1)[3] href from pages where len(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) >= 3""")
def third_menu_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tree.find(table(spark, sf_dir, "pages"), "/html/body/nav/ul/li/a[@href][3]")
    return found.select("page_id", F.col("attrs")["href"].alias("href"))


@query(r"""select page_id, len(regexp_extract_all(html, '<li>'))::bigint items, regexp_extract(html, '<li><a[^>]*>([^<]*)</a>', 1) first from pages where contains(html, '<li>')""")
def menu_items_by_css(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = materialize(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "pages")
    e = materialize(tree.elements(pages), "elements")
    counts = tree.select_css(e, "body > nav ul > li").groupBy("page_id").agg(F.count("*").alias("items"))
    first = tree.element_text(tree.select_css(e, "nav li:first-child > a"), pages).select("page_id", F.col("text").alias("first"))
    return counts.join(first, "page_id")


@query("select page_id, case when page_id * 7 % 400 + 2 > 256 then 'html' else 'fits' end as told from pages")
def nesting_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages nested as deep as their number says: those past the bound are refused as a whole."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.concat(F.repeat(F.lit("<div>"), (F.col("page_id") * 7 % 400).cast("int")), F.lit("<p>"), F.substring(F.col("url"), 1, 20)).alias("html"))
    made = tree.markdown_bounded(pages)
    return made.select("page_id", F.coalesce("error", F.when(F.col("markdown") != "", "fits")).alias("told"))


# -- scripts


@query(r"""select page_id, 't' as name, regexp_extract(html, '<script>var t=("[^"]*")', 1) raw from pages where regexp_matches(html, '<script>var t="')""")
def script_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pages' own scripts assign to `t`: strings that hold tags."""
    return scripts.values(table(spark, sf_dir, "pages"), ["t"]).select("page_id", "name", "raw")


def state_pages(pages: DataFrame) -> DataFrame:
    """The pages, each with a script that keeps its number and url as state, among comments, templates and regular expressions that look like it."""
    state = F.to_json(F.struct(F.col("page_id").alias("id"), F.col("url").alias("at"), F.lit("}; state = {").alias("odd")))
    noise = F.when(F.col("page_id") % 3 == 0, "// state = {\"no\":1}\nvar r = /state = {[/\"]/g, q = `state = {${ `}` }`;\n").when(F.col("page_id") % 3 == 1, "/* state = {} */ window.old = {\"state\": 1}; state == {};\n").otherwise("other.state = {\"id\": null};\n")
    script = F.concat(F.lit("<script>"), noise, F.when(F.col("page_id") % 2 == 0, "window['state'] = ").otherwise("var state /* now */ = "), state, F.lit(";</script>"))
    return pages.select("page_id", "url", F.concat("html", script).alias("html"))


@query("select page_id, page_id as id, url as at from pages")
def script_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scripts.named_json(state_pages(table(spark, sf_dir, "pages")), ["state"], F.get_json_object("json", "$.id").isNotNull())
    state = F.from_json("json", "id long, at string")
    return found.select("page_id", state["id"].alias("id"), state["at"].alias("at"))


def player_pages(pages: DataFrame) -> DataFrame:
    """The pages as players: up to three caption tracks each, by the page's number, with urls of which some aren't to be fetched."""
    k = F.col("page_id")
    track = lambda lang, kind: F.struct(F.concat(F.when(k % 5 == 0, "http").otherwise("https"), F.lit("://www.youtube.com/api/timedtext?v="), k.cast("string"), F.when(k % 7 == 0, "&next=https%3A%2F%2Fevil.example%2F").otherwise("")).alias("baseUrl"), F.lit(lang).alias("languageCode"), F.lit(kind).cast("string").alias("kind"), F.struct(F.lit(lang.upper()).alias("simpleText")).alias("name"))
    tracks = F.concat(F.array(track("fr", None)), F.when(k % 2 == 0, F.array(track("en", "asr"))).otherwise(F.array().cast("array<struct<baseUrl:string,languageCode:string,kind:string,name:struct<simpleText:string>>>")), F.when(k % 3 == 0, F.array(track("de", "asr"))).otherwise(F.array().cast("array<struct<baseUrl:string,languageCode:string,kind:string,name:struct<simpleText:string>>>")))
    state = F.to_json(F.struct(F.struct(F.struct(tracks.alias("captionTracks")).alias("playerCaptionsTracklistRenderer")).alias("captions")))
    return pages.select("page_id", "url", F.concat(F.lit("<script>var ytInitialPlayerResponse = "), state, F.lit(";</script>"), F.col("html")).alias("html"))


@query("""select page_id, case when page_id % 3 = 0 then 'de' when page_id % 2 = 0 then 'en' else 'fr' end language, page_id % 2 = 0 or page_id % 3 = 0 as generated,
case when page_id % 5 = 0 then 'scheme' when page_id % 7 = 0 then 'nested' end fault from pages""")
def caption_track_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The German track of each player page, else the English, else the first made by people; and why its url may not be fetched."""
    chosen = captions.choose_track(scripts.caption_tracks(player_pages(table(spark, sf_dir, "pages"))), "page_id", "DE")
    return chosen.select("page_id", "language", "generated", captions.url_fault("url").alias("fault"))


# -- feeds


def page_feeds(pages: DataFrame) -> DataFrame:
    """A feed of each page, in RSS or Atom by its number: an entry that names itself by guid or id, one that has a date only, and one for the first link of its menu."""
    k, href = F.col("page_id").cast("string"), F.regexp_extract("html", '<li><a href="([^"]*)">', 1)
    rss = F.concat(F.lit("<rss><channel><item><title>Page "), k, F.lit("</title><guid>/p/"), k, F.lit("</guid><description><![CDATA[<p>Seen <b>"), k, F.lit("</b></p>]]></description></item><item><pubDate>Tue, 27 Aug 2024 16:00:00 GMT</pubDate></item><item><title>Menu</title><link>"), href, F.lit("</link><pubDate>Tue, 27 Aug 2024 16:00:00 +0200</pubDate></item></channel></rss>"))
    atom = F.concat(F.lit("<feed xmlns='http://www.w3.org/2005/Atom'><entry><title>Page "), k, F.lit("</title><id>/p/"), k, F.lit("</id><summary type='html'>&lt;p&gt;Seen &lt;b&gt;"), k, F.lit("&lt;/b&gt;</summary></entry><entry><updated>2024-08-27T16:00:00Z</updated></entry><entry><title>Menu</title><link rel='self' href='/self'/><link rel='alternate' href='"), href, F.lit("'/><updated>2024-08-27T16:00:00+02:00</updated></entry></feed>"))
    return pages.select(F.col("page_id").alias("feed_id"), "url", F.when(F.col("page_id") % 2 == 0, rss).otherwise(atom).alias("body"))


@query(f"""with {_parts("select page_id, url from pages")}, m as (select page_id, origin, regexp_extract(html, '<li><a href="([^"]*)">', 1) href from canon join (select page_id, html from pages) using (page_id))
select page_id feed_id, 0 as ordinal, 'Page ' || page_id title, origin || '/p/' || page_id link, 'Seen **' || page_id || '**' description, '' as date from m union all
select page_id, 1, 'Menu', origin || href, '', '2024-08-27T14:00:00+00:00' from m""")
def feed_whole_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.items(page_feeds(table(spark, sf_dir, "pages")))


# -- encodings

#: What each page is served as, by its number: the charset's label and the encoding that the bytes are in.
_SERVED = (("utf-8", "UTF-8"), ("Latin1", "ISO-8859-1"), ("UTF-16", "UTF-16LE"), ("utf-16be", "UTF-16BE"), ("nope", "UTF-8"), ("iso-8859-1", "ISO-8859-1"))


@query(r"""select page_id, regexp_replace(case when page_id % 6 in (1, 5) then regexp_replace(html, '[^\x{00}-\x{FF}]', '?', 'g') else html end, '[\x{80}-\x{9F}]', '', 'g') as text from pages""")
def bodies_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as bytes in several encodings, decoded by what their responses declare."""
    k = F.col("page_id") % len(_SERVED)
    pages = table(spark, sf_dir, "pages").withColumn("html", F.regexp_replace("html", "[\\x{80}-\\x{9F}]", ""))
    body = F.lit(None).cast("binary")
    label = F.lit(None).cast("string")
    for i, (name, encoding) in enumerate(_SERVED):
        sent = F.regexp_replace("html", "[^\\x{00}-\\x{FF}]", "?") if encoding == "ISO-8859-1" else F.col("html")
        body, label = F.when(k == i, F.encode(sent, encoding)).otherwise(body), F.when(k == i, name).otherwise(label)
    served = pages.select("page_id", body.alias("body"), F.concat(F.lit("text/html; charset="), label).alias("type"))
    return served.select("page_id", checks.decoded(F.col("body"), F.col("type")).alias("text"))


# -- robots and crawls


def robots_fetches(pages: DataFrame) -> DataFrame:
    """What came of asking for each origin's robots.txt, by the length of the origin: a file, none, an error, a page, a redirect elsewhere."""
    kind = F.length("origin") % 6
    return pages.select(urls.origin(F.col("url")).alias("origin")).distinct().select(
        "origin",
        F.when(kind == 1, 404).when(kind == 2, 503).otherwise(200).alias("status"),
        F.when(kind == 4, F.lit("https://elsewhere.example/robots.txt")).otherwise(F.concat("origin", F.lit("/robots.txt"))).alias("final_url"),
        F.when(kind == 5, 11).otherwise(0).alias("hops"),
        F.when(kind == 3, "text/html").otherwise("text/plain; charset=utf-8").alias("content_type"),
        F.lit("User-agent: *\nDisallow: /%66r\nDisallow: /d\nAllow: /de\n").alias("text"),
        F.lit(None).cast("string").alias("error"),
    )


_OUTCOMES = f"""{_parts('select page_id, url from pages')}, ro as (select page_id, origin, length(origin) % 6 kind, path from canon),
r as (select page_id, case kind when 0 then not (starts_with(path, '/fr') or (starts_with(path, '/d') and not starts_with(path, '/de'))) else kind = 1 end allowed,
case kind when 2 then 'http_503' when 3 then 'content_type' when 4 then 'cross_origin' when 5 then 'redirect_limit' end error from ro)"""


@query(f"with {_OUTCOMES} select page_id, allowed, error from r")
def robots_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each page may be fetched, given what came of asking its origin for its rules."""
    pages = table(spark, sf_dir, "pages")
    states = robots.outcomes(robots_fetches(pages))
    asked = pages.select("page_id", urls.origin(F.col("url")).alias("origin"), urls.path(F.col("url")).alias("path"))
    return robots.decide_by_outcome(asked, states, "siltweb/1.0", F.col("path")).select("page_id", "allowed", "error")


#: Pages 0 to a third of all are links' targets of one another: page i has i's double and one more, in this order, and repeats.
_LINKS = "select page_id src, v.k ordinal, page_id * 3 + v.d dst from pages, (values (0, 1), (1, 2), (2, 1), (3, 3)) v(k, d) where page_id * 3 + v.d < (select count(*) from pages)"
_CRAWL = f"""with recursive {_OUTCOMES}, links as (select distinct src, dst from ({_LINKS})),
p as (select page_id, (page_id % 4 <> 1 or allowed) allowed, page_id % 7 <> 3 ok from r),
found(node, depth) as (select 0::bigint, 0 union all select dst, depth + 1 from found join links on src = node join p on p.page_id = node where p.allowed and p.ok),
ranked as (select node, depth, allowed, ok, count_if(allowed) over (order by node) n from found join p on p.page_id = node),
budget as (select (select count(*) from pages) // 4 b),
known as (select r.*, case when node = 0 then true else (select q.n <= b from ranked q, budget where q.node = (r.node - 1) // 3) end heard from ranked r),
told as (select node, depth, case when heard and allowed and n <= b then n end place,
  case when n > b or (not allowed and n = b) then 'discarded' when not allowed then 'denied' when ok then 'succeeded' else 'failed' end outcome from known, budget where heard)"""


def _crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n = pages.count()
    steps = F.array(*[F.struct(F.lit(k).alias("ordinal"), F.lit(d).alias("d")) for k, d in ((0, 1), (1, 2), (2, 1), (3, 3))])
    links = pages.select(F.col("page_id").alias("src"), F.explode(steps).alias("s")).select("src", F.col("s.ordinal").alias("ordinal"), (F.col("src") * 3 + F.col("s.d")).alias("dst")).where(F.col("dst") < n)
    told = robots_outcomes(spark, sf_dir)
    nodes = told.select(F.col("page_id").alias("node"), ((F.col("page_id") % 4 != 1) | F.col("allowed")).alias("allowed"), (F.col("page_id") % 7 != 3).alias("ok"))
    return crawl.budgeted(pages.where("page_id = 0").select(F.col("page_id").alias("node")), links, materialize(nodes, "nodes"), n // 4)


@query(f"{_CRAWL} select node, depth, place, outcome from told")
def crawl_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl over derived links with a budget of a quarter of the pages: failures cost, denials don't, and what waits is promoted in order."""
    return _crawled(spark, sf_dir).select("node", "depth", "place", "outcome")


@query(f"""{_CRAWL} select 'attempted=' || count(place) || ' succeeded=' || count_if(outcome = 'succeeded') || ' failed=' || count_if(outcome = 'failed')
|| ' queued=' || count_if(outcome <> 'discarded') || ' skipped=' || count_if(outcome in ('denied', 'discarded')) summary from told""")
def crawl_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.summary(_crawled(spark, sf_dir))
