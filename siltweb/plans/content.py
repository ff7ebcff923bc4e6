"""Queries over the content of pages, events and conversations, each with the SQL that it must match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import captions, documents, html
from ..storage import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _entities(c: str) -> str:
    for name, value in html.ENTITIES:
        c = f"replace({c}, '{name}', '{value.replace(chr(39), chr(39) * 2)}')"
    return c


_BLANKS = r"'[\s\p{Z}\x{85}]+', ' ', 'g'"


def _clean(c: str) -> str:
    return f"trim(regexp_replace({c}, {_BLANKS}))"


def _bare(name: str) -> str:
    return _clean(_entities(f"regexp_replace(regexp_extract(html, '(?is)<{name}[^>]*>(.*?)</{name}>', 1), '<[^>]*>', '', 'g')"))


_VISIBLE = "html"
for _tag in ("script", "style", "template", "svg", "title"):
    _VISIBLE = f"regexp_replace({_VISIBLE}, '(?is)<{_tag}\\b.*?</{_tag}>', ' ', 'g')"
_VISIBLE = _clean(_entities(f"regexp_replace(regexp_replace({_VISIBLE}, '(?is)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g')"))


@query(f"""with t as (select page_id, html, {_bare('title')} title, {_bare('h1')} heading, {_VISIBLE} v from pages),
w as (select *, case when v = '' then 0 else len(string_split(v, ' ')) end words from t)
select page_id, title, heading, words, case when words = 0 then true when words < 120 and regexp_matches(lower(html), 'enable javascript|checking your browser|just a moment') then true
when title <> '' and regexp_matches(html, '(?is)<p[^>]*>\\s*[^<\\s]') then false else words < 3 end shell from w""")
def page_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.facts(table(spark, sf_dir, "pages")).withColumn("words", F.col("words").cast("long"))


_TOKENS = f"""tok as (select page_id, url, unnest(regexp_extract_all(html, '{html.TOKEN}', 1)) token, generate_subscripts(regexp_extract_all(html, '{html.TOKEN}', 1), 1) - 1 pos from pages),
t as (select *, case when not starts_with(token, '<') then 'text' when regexp_matches(lower(token), '^(<!|<\\?|<script\\b|<style\\b|<div class="ad">)') then 'raw' when starts_with(token, '</') then 'close' else 'open' end kind,
lower(regexp_extract(token, '^</?([A-Za-z][A-Za-z0-9]*)', 1)) tag from tok)"""
_list = lambda names: ", ".join(f"'{n}'" for n in names)
_NODES = f"""{_TOKENS}, strict as (select * from t where kind in ('open', 'close') and tag <> '' and tag not in ({_list(html.VOID + html.LOOSE)})),
d as (select *, sum(case when kind = 'open' then 1 else -1 end) over (partition by page_id order by pos) + case when kind = 'close' then 1 else 0 end depth from strict),
e as (select *, coalesce(lead(pos) over (partition by page_id, depth order by pos), {html.OPEN_END}) post from d),
nodes as (select page_id, pos pre, post, cast(depth as bigint) depth, tag, token from e where kind = 'open')"""


@query(f"""with {_NODES} select n.page_id, n.pre, n.post, n.depth, n.tag, (select max(p.pre) from nodes p where p.page_id = n.page_id and p.depth = n.depth - 1 and p.pre < n.pre) parent from nodes n""")
def html_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.nodes(table(spark, sf_dir, "pages")).select("page_id", "pre", "post", "depth", "tag", "parent")


@query(f"""with {_NODES}, a as (select page_id, pre, regexp_extract(token, '\\shref="([^"]*)"', 1) href, row_number() over (partition by page_id order by pre) n from nodes where tag = 'a')
select page_id, pre, {_entities('href')} href from a where n = 2""")
def xpath_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second link of each page's lists, by a path with child, descendant and position."""
    found = html.select(html.nodes(table(spark, sf_dir, "pages")), "/html/body//ul//a[@href][2]")
    return found.select("page_id", "pre", html.attribute(F.col("token"), "href").alias("href"))


@query(f"""with {_NODES}, a as (select n.page_id, n.pre, {_clean("string_agg(" + _entities("t.token") + ", ' ' order by t.pos)")} txt from nodes n join t on t.page_id = n.page_id and t.pos > n.pre and t.pos < n.post and t.kind = 'text' where n.tag = 'a' group by 1, 2),
s as (select page_id, pre, least(1e0, 2e-1 + case when starts_with(txt, 'the') then 35e-2 else 0e0 end) score from a)
select page_id, 'menu' as name, min(pre) pre, score from s where score >= 5e-1 and score = (select max(score) from s z where z.page_id = s.page_id) group by page_id, score""")
def fingerprint_refind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each page, the link most like a remembered one, whose text began with `the`."""
    pages = table(spark, sf_dir, "pages")
    nodes = html.nodes(pages).where("tag = 'a'")
    blank = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    described = html.node_text(nodes, pages).withColumns({"tag": F.lit("a"), "id": F.lit(None).cast("string"), "classes": F.array().cast("array<string>"), "data": blank})
    remembered = spark.range(1).select(F.lit("menu").alias("name"), F.lit("a").alias("tag"), F.lit(None).cast("string").alias("id"), F.array().cast("array<string>").alias("classes"), blank.alias("data"), F.lit("the").alias("snippet"))
    return html.refind(described, remembered).select("page_id", "name", "pre", "score")


_over = "over (partition by page_id order by pos rows unbounded preceding)"
_opened = lambda tags: f"sum(case when kind = 'open' and tag in ({_list(tags)}) then 1 when kind = 'close' and tag in ({_list(tags)}) then -1 else 0 end) {_over}"


@query(rf"""with {_TOKENS}, b as (select *, kind in ('open', 'close') and tag in ({_list(html.BLOCKS)}) is_block, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) origin from t),
m as (select *, {_opened(html.EXCLUDED)} excluded, sum(cast(is_block as int)) {_over} block,
  last_value(case when is_block then case when kind = 'open' then tag else '' end end ignore nulls) {_over} holder,
  {_opened(('b', 'strong'))} > 0 strong,
  case when {_opened(('a',))} > 0 then last_value(case when kind = 'open' and tag = 'a' then regexp_extract(token, '\shref="([^"]*)"', 1) end ignore nulls) {_over} end href from b),
x as (select page_id, pos, block, holder, strong, coalesce(origin || href, '') dest, regexp_replace({_entities('token')}, '([\\*_\[\]`~|<>&])', '\\\1', 'g') piece from m where kind = 'text' and excluded <= 0),
k as (select *, case when lag((block, strong, dest)) over (partition by page_id order by pos) = (block, strong, dest) then 0 else 1 end fresh from x),
r as (select *, sum(fresh) over (partition by page_id order by pos) run from k),
g as (select page_id, block, run, any_value(holder) holder, any_value(strong) strong, any_value(dest) dest, regexp_replace(string_agg(piece, '' order by pos), {_BLANKS}) body from r group by 1, 2, 3),
w as (select *, trim(body) core, case when dest <> '' then '[' || trim(body) || '](' || dest || ')' else trim(body) end linked from g),
p as (select page_id, block, run, holder, case when core = '' then case when body = '' then '' else ' ' end else
  case when starts_with(body, ' ') then ' ' else '' end || case when strong then '**' || linked || '**' else linked end || case when ends_with(body, ' ') then ' ' else '' end end part from w),
l as (select page_id, block, any_value(holder) holder, trim(regexp_replace(string_agg(part, '' order by run), ' +', ' ', 'g')) line from p group by 1, 2),
s as (select page_id, block, holder, regexp_replace(regexp_replace(line, '^([#\-+!=])', '\\\1'), '^([0-9]+)([.)])', '\1\\\2') line from l where line <> ''),
f as (select page_id, block, case when regexp_matches(holder, '^h[1-6]$') then repeat('#', cast(substr(holder, 2) as int)) || ' ' when holder = 'li' then '- ' else '' end || line as line from s),
q as (select page_id, string_agg(line, chr(10) || chr(10) order by block) markdown from f group by page_id)
select pages.page_id, coalesce(markdown, '') markdown from pages left join q using (page_id)""")
def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.markdown(table(spark, sf_dir, "pages"))


@query(rf"""with s as (select *, epoch_ms(ts) start_ms, 1000 * (event_id % 3) duration_ms, {_clean("event_type || '  ' || event_id")} word from events),
e as (select *, lag(event_id) over w is null as opens, last_value(start_ms + duration_ms ignore nulls) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding) ended from s window w as (partition by user_id order by event_id))
select user_id, string_agg(case when opens then '' when start_ms - ended >= 3600000 then chr(10) || chr(10) else ' ' end || word, '' order by event_id) transcript from e group by user_id""")
def caption_gap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as a transcript, with a paragraph after an hour's silence."""
    said = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("ordinal"), F.unix_millis(F.col("ts").cast("timestamp")).alias("start_ms"), (F.col("event_id") % 3 * 1000).alias("duration_ms"), F.concat("event_type", F.lit("  "), F.col("event_id").cast("string")).alias("text"))
    return captions.gap_join(said, "user_id", 3_600_000)


@query("""with s as (select conv_id, turn, text, role from conversations)
select conv_id, turn ordinal, trim(regexp_replace(text, '[\\s\\p{Z}\\x{85}]+', ' ', 'g')) text, turn * 1500 start_ms from s""")
def caption_json3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as caption documents and parsed back, a turn an event."""
    event = F.struct((F.col("turn") * 1500).alias("tStartMs"), F.lit(700).alias("dDurationMs"), F.array(F.struct(F.col("text").alias("utf8"))).alias("segs"))
    whole = F.array_sort(F.collect_list(F.struct("turn", event.alias("e"))))
    written = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.transform(whole, lambda x: x["e"]).alias("events"))).alias("body"))
    parsed = captions.from_json3(written, "conv_id", "body")
    return parsed.select("conv_id", F.col("ordinal").cast("long").alias("ordinal"), text.clean(F.col("text")).alias("text"), "start_ms")


@query("select conv_id, turn as ordinal, count(*) over (partition by conv_id) raw_count, turn as number, substr(text, 1, 40) title, role state from conversations qualify role <> 'assistant'")
def github_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages of an issue list, replies being its pull requests."""
    pull = F.when(F.col("role") == "assistant", F.struct(F.lit("x").alias("url")))
    issue = F.struct(F.col("turn").alias("number"), F.substring("text", 1, 40).alias("title"), F.col("role").alias("state"), pull.alias("pull_request"))
    whole = F.array_sort(F.collect_list(F.struct("turn", F.to_json(issue).alias("i"))))
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(F.transform(whole, lambda x: x["i"]), ","), F.lit("]")).alias("body"))
    return documents.issues(pages, "conv_id", "body").withColumn("ordinal", F.col("ordinal").cast("long")).withColumn("raw_count", F.col("raw_count").cast("long"))


@query(f"select conv_id, row_number() over (partition by conv_id order by turn) - 1 ordinal, substr({_clean('text')}, 1, 8192) title, '/r/' || conv_id || '/' || turn url, turn * 3 score from conversations where text <> '' and turn % 3 <> 1 qualify ordinal < 4")
def reddit_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as listings; every third post has no link."""
    link = F.when(F.col("turn") % 3 != 1, F.concat(F.lit("/r/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string")))
    post = F.struct(F.struct(F.col("text").alias("title"), link.alias("permalink"), (F.col("turn") * 3).alias("score")).alias("data"))
    whole = F.array_sort(F.collect_list(F.struct("turn", post.alias("p"))))
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.struct(F.transform(whole, lambda x: x["p"]).alias("children")).alias("data"))).alias("body"))
    return documents.listing(pages, "conv_id", "body", 4).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("select conv_id, turn as ordinal, 'BV' || lpad(cast(conv_id as varchar), 10, '0') bvid, 'turn ' || turn title from conversations where conv_id % 4 <> 0 and turn % 2 = 0")
def bilibili_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as result envelopes; one in four has an error code, and odd turns a malformed id."""
    bvid = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("BV"), F.lpad(F.col("conv_id").cast("string"), 10, "0"))).otherwise("av1")
    result = F.struct(bvid.alias("bvid"), F.concat(F.lit('<em class="k">turn</em> '), F.col("turn").cast("string")).alias("title"))
    whole = F.array_sort(F.collect_list(F.struct("turn", result.alias("r"))))
    code = F.when(F.col("conv_id") % 4 == 0, -1).otherwise(0)
    pages = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(whole, lambda x: x["r"]).alias("result"))
    return documents.envelope_results(pages.select("conv_id", F.to_json(F.struct(code.alias("code"), F.struct("result").alias("data"))).alias("body")), "conv_id", "body").withColumn("ordinal", F.col("ordinal").cast("long"))


@query(f"""with f as (select page_id // 10 feed, page_id, url, {_bare('title')} title from pages)
select feed, row_number() over (partition by feed order by page_id) - 1 ordinal, substr(title, 1, 8192) title, url link, '' description, 'Mon, 01 Jan 2024 00:00:00 GMT' date from f qualify ordinal < 6""")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten pages make a feed; its first six items are parsed back."""
    title = html.facts(table(spark, sf_dir, "pages")).select("page_id", "title")
    safe = F.replace(F.replace(F.replace(F.col("title"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    link = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    item = F.concat(F.lit("<item><title>"), safe, F.lit("</title><link>"), link, F.lit("</link><pubDate>Mon, 01 Jan 2024 00:00:00 GMT</pubDate></item>"))
    rows = table(spark, sf_dir, "pages").select("page_id", "url").join(title, "page_id").select(F.floor(F.col("page_id") / 10).alias("feed"), "page_id", item.alias("item"))
    whole = F.array_sort(F.collect_list(F.struct("page_id", "item")))
    feeds = rows.groupBy("feed").agg(F.concat(F.lit('<rss version="2.0"><channel>'), F.array_join(F.transform(whole, lambda x: x["item"]), ""), F.lit("</channel></rss>")).alias("body"))
    return documents.feed_items(feeds, "feed", "body", 6).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("select conv_id, turn, length(text) size from conversations where role = 'user'")
def json_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents, a conversation each, searched for one key at any depth."""
    entry = F.when(F.col("role") == "user", F.struct(F.struct(F.struct(F.col("turn"), F.length("text").alias("size")).alias("wanted")).alias("inner")))
    docs = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.to_json(F.struct(F.array(F.struct(F.collect_list(entry).alias("list"))).alias("outer"))).alias("body"))
    found = documents.json_search(docs, "conv_id", "body", "wanted")
    v = F.from_json("value", "struct<turn: long, size: long>")
    return found.select("conv_id", v["turn"].alias("turn"), v["size"].alias("size"))


@query("select event_id, cast(floor(value) as bigint) * 1000 + cast(rpad(substr(regexp_extract(cast(value as varchar), '\\.([0-9]*)$', 1), 1, 3), 3, '0') as bigint) ms from events")
def seconds_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.seconds_to_ms(F.col("value").cast("string")).alias("ms"))


