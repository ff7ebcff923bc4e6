"""Queries over pages: URLs, links, policy, robots, crawl and redirects, each with the SQL that it must match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import policy, responses, text, urls
from ..operators import crawl, hits, links, research, robots, search_pages
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


# Parts of a url in DuckDB, as a macro-like prefix of CTEs over any relation `u(page_id, url)`.
def _parts(source: str) -> str:
    rx = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
    part = lambda k: f"regexp_extract(url, '{rx}', {k})"
    return f"""
u as ({source}),
parts as (select *, lower({part(1)}) scheme, {part(2)} auth, {part(3)} path0, {part(4)} query from u),
hosts as (select *, regexp_replace(lower(regexp_replace(regexp_replace(auth, '^.*@', ''), ':[0-9]*$', '')), '\\.+$', '') host,
  regexp_extract(auth, ':([0-9]+)$', 1) port0, case when path0 = '' then '/' else path0 end path from parts),
o as (select *, case when port0 <> '' then cast(port0 as int) when scheme = 'https' then 443 when scheme = 'http' then 80 end port from hosts),
c as (select *, case when scheme in ('http', 'https') and host <> '' then scheme || '://' || host ||
  case when port = (case when scheme = 'https' then 443 else 80 end) then '' else ':' || port end end origin from o),
canon as (select *, case when origin is not null and not contains(auth, '@') then origin || path || query end canonical from c)"""


#: Spellings of the pages' own urls that canonical form must undo or refuse; the page's number picks one.
def spelled(pages: DataFrame) -> DataFrame:
    u, k = F.col("url"), F.col("page_id") % 8
    rest = F.regexp_extract(u, "^[a-z]+://(.*)$", 1)
    name, tail = F.regexp_extract(rest, "^([^/?#]*)", 1), F.regexp_extract(rest, "^[^/?#]*(.*)$", 1)
    out = (
        F.when(k == 1, F.concat(F.lit("HTTP://"), F.upper(name), F.lit(":80"), tail))
        .when(k == 2, F.concat(F.lit("https://"), name, F.lit(".:443"), tail))
        .when(k == 3, F.concat(F.lit("https://"), name, F.lit(":8443"), tail))
        .when(k == 4, F.concat(F.lit("https://user:pw@"), rest))
        .when(k == 5, F.concat(F.lit("ftp://"), rest))
        .when(k == 6, F.concat(F.lit("https://"), name, F.lit("?q=1#x")))
        .otherwise(u)
    )
    return pages.select("page_id", out.alias("url"))


_SPELLED = """
select page_id, case page_id % 8
  when 1 then 'HTTP://' || upper(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || ':80' || regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1)
  when 2 then 'https://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '.:443' || regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1)
  when 3 then 'https://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || ':8443' || regexp_extract(url, '^[a-z]+://[^/?#]*(.*)$', 1)
  when 4 then 'https://user:pw@' || regexp_extract(url, '^[a-z]+://(.*)$', 1)
  when 5 then 'ftp://' || regexp_extract(url, '^[a-z]+://(.*)$', 1)
  when 6 then 'https://' || regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '?q=1#x'
  else url end url from pages"""


@query(f"with {_parts(_SPELLED)} select page_id, canonical, origin, port, origin || '/robots.txt' robots from canon")
def url_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return spelled(table(spark, sf_dir, "pages")).select("page_id", urls.canonicalize(u).alias("canonical"), urls.origin(u).alias("origin"), urls.port(u).alias("port"), urls.robots_url(u).alias("robots"))


_ENDINGS = ("/logout", "/a/b", "?action=delete", "?note=delete", "/log-out/now", "?do[x]=remove", "/%64elete", "?a=1;signout=1", "/%2564%2565lete/x", "/deleted")


@query(f"""with t as (select page_id, case page_id % {len(_ENDINGS)} {' '.join(f"when {i} then '{e}'" for i, e in enumerate(_ENDINGS))} end ending from pages)
select page_id, ending, ending in ('/logout', '?action=delete', '/log-out/now', '?do[x]=remove', '/%64elete', '?a=1;signout=1', '/%2564%2565lete/x') destructive from t""")
def url_destructive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    ending = F.element_at(F.array(*map(F.lit, _ENDINGS)), (F.col("page_id") % len(_ENDINGS) + 1).cast("int"))
    return pages.select("page_id", ending.alias("ending"), urls.is_destructive(F.concat(urls.origin(F.col("url")), ending)).alias("destructive"))


_FOUND = r"""select page_id, url base_url, unnest(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1)) href, generate_subscripts(regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1), 1) - 1 ordinal from pages"""
# All links of the snapshot are root-relative; the oracle says so and resolves just these.
_RESOLVED = f"with {_parts('select page_id, url from pages')}, found as ({_FOUND}), resolved as (select f.page_id, ordinal, href, origin, origin || href target from found f join canon using (page_id) where starts_with(href, '/'))"


@query(f"{_RESOLVED} select page_id, ordinal, href, target from resolved")
def links_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.anchors(table(spark, sf_dir, "pages"))
    return found.select("page_id", "ordinal", "href", urls.resolve(F.col("url"), F.col("href")).alias("target"))


@query(f"{_RESOLVED} select page_id, target, min(ordinal) ordinal, cast(row_number() over (partition by page_id order by min(ordinal)) as int) place from resolved group by page_id, target qualify place <= 4")
def links_dedup_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.discover(table(spark, sf_dir, "pages"), per_page=4)


@query(f"""{_RESOLVED}, n as (select origin, count(*) pages from canon group by origin),
l as (select origin, count(*) links, count(distinct target) targets from resolved group by origin)
select n.origin, pages, coalesce(links, 0) links, coalesce(targets, 0) targets from n left join l on n.origin = l.origin""")
def origin_outlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.outlinks_by_origin(table(spark, sf_dir, "pages"))


def addresses(pages: DataFrame) -> DataFrame:
    """An address for each page, from the digits of its number, spread over public and other networks."""
    p = F.col("page_id")
    first = F.element_at(F.array(*map(F.lit, (8, 10, 100, 127, 169, 172, 192, 198, 203, 224, 93, 255))), (p % 12 + 1).cast("int"))
    second = F.element_at(F.array(*map(F.lit, (0, 64, 254, 16, 168, 18, 51))), (p % 7 + 1).cast("int"))
    return pages.select("page_id", F.concat_ws(".", first, second, (p * 37) % 256, (p * 11) % 256).alias("ip"))


_NETS = ", ".join(f"('{c}', {policy.network_bounds(c)[0]}, {policy.network_bounds(c)[1]})" for c in policy.DENIED_IPV4)


@query(f"""with a as (select page_id, concat_ws('.', list_value(8,10,100,127,169,172,192,198,203,224,93,255)[page_id % 12 + 1], list_value(0,64,254,16,168,18,51)[page_id % 7 + 1], (page_id * 37) % 256, (page_id * 11) % 256) ip from pages),
n as (select page_id, ip, cast(split_part(ip,'.',1) as bigint)*16777216 + cast(split_part(ip,'.',2) as bigint)*65536 + cast(split_part(ip,'.',3) as bigint)*256 + cast(split_part(ip,'.',4) as bigint) number from a),
nets(network, low, high) as (values {_NETS})
select page_id, ip, network, network is null as is_public from n left join nets on number between low and high""")
def ip_policy_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = addresses(table(spark, sf_dir, "pages")).withColumn("number", policy.ipv4_number(F.col("ip")))
    return policy.with_network(numbered, "number").select("page_id", "ip", "network", F.col("network").isNull().alias("is_public"))


@query(f"with {_parts('select page_id, url from pages')} select page_id, host, host = 'example.org' or ends_with(host, '.example.org') or host = 'thther.example.net' or ends_with(host, '.thther.example.net') allowed from canon")
def host_restriction(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = urls.host(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", h.alias("host"), policy.host_allowed(h, ["example.org", "thther.example.net"]).alias("allowed"))


_TYPES = ("text/html; charset=UTF-8", "Application/XHTML+xml", "application/ld+json; charset=\"latin1\"", "image/png", "text/plain", "application/octet-stream")


@query(f"""with t as (select page_id, case page_id % {len(_TYPES)} {' '.join(f"when {i} then '{v}'" for i, v in enumerate(_TYPES))} end ct, case when page_id % 17 = 0 then 404 when page_id % 13 = 0 then 429 when page_id % 11 = 0 then 302 else 200 end status from pages)
select page_id, page_id % 6 <> 3 and page_id % 6 <> 5 supported, page_id % 6 < 2 html,
case page_id % 6 when 0 then 'utf-8' when 2 then 'latin1' end charset, status,
case status when 404 then 'http_status' when 429 then 'rate_limited' when 302 then 'redirect' end error from t""")
def mime_and_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    ct = F.element_at(F.array(*map(F.lit, _TYPES)), (F.col("page_id") % len(_TYPES) + 1).cast("int"))
    s = status_of(F.col("page_id"))
    return table(spark, sf_dir, "pages").select("page_id", policy.is_supported_media(ct).alias("supported"), policy.is_html(ct).alias("html"), policy.charset(ct).alias("charset"), s.alias("status"), policy.status_error(s).alias("error"))


def status_of(page_id: Column) -> Column:
    """The snapshot has no statuses: a page's number gives one."""
    return F.when(page_id % 17 == 0, 404).when(page_id % 13 == 0, 429).when(page_id % 11 == 0, 302).otherwise(200)


def robots_texts(pages: DataFrame) -> DataFrame:
    """A robots.txt for each origin, one of three by the length of its name."""
    origin = urls.origin(F.col("url"))
    kinds = [
        "User-agent: *\nDisallow: /en/\nAllow: /en/1 # first\n\nUser-agent: silt\nDisallow: /de\nCrawl-delay: 2\n",
        "# all\nUser-agent: other\nUser-agent: *\nDisallow: /fr/\nDisallow: /es/\nAllow: /fr/\nCrawl-delay: 0.5\n",
        "User-agent: siltweb\nUser-agent: *\nDisallow: /e\n\nDisallow: /\n",
    ]
    return pages.select(origin.alias("origin")).distinct().withColumn("text", F.element_at(F.array(*map(F.lit, kinds)), (F.length("origin") % 3 + 1).cast("int")))


_RULES = """(values (0, false, '/de', 2.0), (1, false, '/fr/', 0.5), (1, false, '/es/', 0.5), (1, true, '/fr/', 0.5), (2, false, '/e', null)) r(kind, allow, prefix, delay)"""


@query(f"""with {_parts('select page_id, url from pages')}, m as (select page_id, path, origin, allow, length(prefix) n from canon join {_RULES} on kind = length(origin) % 3 and starts_with(path, prefix)),
best as (select page_id, arg_max(allow, n * 2 + cast(allow as int)) allow from m group by page_id)
select page_id, origin, coalesce(allow, true) allowed from canon left join best using (page_id)""")
def robots_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = robots.parse(robots_texts(pages), "siltweb/1.0")
    asked = pages.select("page_id", urls.origin(F.col("url")).alias("origin"), urls.path(F.col("url")).alias("path"))
    return robots.decide(asked, rules, F.col("path")).select("page_id", "origin", "allowed")


@query(f"with {_parts('select page_id, url from pages')} select distinct origin, cast(case length(origin) % 3 when 0 then 2.0 when 1 then 0.5 end as double) delay from canon where length(origin) % 3 < 2")
def robots_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = robots.parse(robots_texts(table(spark, sf_dir, "pages")), "siltweb/1.0")
    return rules.where("delay is not null").select("origin", "delay")


def derived_edges(pages: DataFrame) -> DataFrame:
    """Links between the pages of the snapshot, which has none of its own: page i to 2i+1 and 2i+2 modulo the count, some twice."""
    n = pages.agg(F.count("*").alias("n"))
    to = F.explode(F.array(F.col("page_id") * 2 + 1, F.col("page_id") * 2 + 2, F.col("page_id") * 2 + 1)).alias("to")
    return pages.crossJoin(F.broadcast(n)).select(F.col("page_id").alias("src"), "n", to).select("src", (F.col("to") % F.col("n")).alias("dst"))


@query("""with recursive n as (select count(*) n from pages), e as (select page_id src, (page_id * 2 + k) % n dst from pages, n, (values (1), (2)) v(k)),
b(node, depth) as (select 0::bigint, 0 union select dst, depth + 1 from b join e on node = src where depth < 40)
select node, cast(min(depth) as int) depth from b group by node""")
def crawl_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return crawl.breadth_first(derived_edges(pages), pages.where("page_id = 0").select(F.col("page_id").alias("node")))


@query(f"""with {_parts('select page_id, url from pages')}, m as (select page_id, allow, length(prefix) n from canon join {_RULES} on kind = length(origin) % 3 and starts_with(path, prefix)),
best as (select page_id, arg_max(allow, n * 2 + cast(allow as int)) allow from m group by page_id),
s as (select page_id, coalesce(allow, true) ok, page_id % 17 <> 0 and page_id % 13 <> 0 and page_id % 11 <> 0 good from canon left join best using (page_id))
select count(*) scheduled, count_if(ok and good) completed, count_if(ok and not good) failed, count_if(not ok) skipped from s""")
def crawl_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crawl.counters(robots_decision(spark, sf_dir), status_of(F.col("page_id")), F.col("allowed"))


@query(f"""with {_parts('select page_id, url from pages')} select page_id, origin, (row_number() over (partition by origin order by page_id) - 1) * case length(origin) % 3 when 0 then 2000 else 500 end start_ms,
list_value('p0', 'p1', 'p2')[page_id % 3 + 1] proxy from canon""")
def crawl_delay_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "pages").select("page_id", urls.origin(F.col("url")).alias("origin"))
    delay = F.when(F.length("origin") % 3 == 0, 2000).otherwise(500)
    out = crawl.rotate(crawl.schedule(asked, "origin", "page_id", delay), "page_id", ["p0", "p1", "p2"])
    return out.select("page_id", "origin", F.col("start_ms").cast("long").alias("start_ms"), "proxy")


@query("""with recursive r as (select page_id src, page_id - 1 dst from pages where page_id % 14 <> 0),
c(url, place, hops) as (select page_id, page_id, 0 from pages union all select url, dst, hops + 1 from c join r on place = src where hops <= 10)
select url, case when max(hops) <= 10 then min(place) end final, case when max(hops) <= 10 then cast(max(hops) as int) end hops, case when max(hops) > 10 then 'redirect_limit' end error from c group by url""")
def redirect_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    moved = pages.where("page_id % 14 <> 0").select(F.col("page_id").alias("src"), (F.col("page_id") - 1).alias("dst"))
    return crawl.follow_redirects(pages.select(F.col("page_id").alias("url")), moved)


@query("select page_id, page_id // 3 target, page_id = min(page_id) over (partition by page_id // 3) as owner from pages")
def redirect_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    attempts = table(spark, sf_dir, "pages").select("page_id", F.floor(F.col("page_id") / 3).alias("target"))
    return crawl.claim(attempts, "target", "page_id").select("page_id", "target", "owner")


@query(f"""{_RESOLVED}, h as (select page_id, ordinal, target, page_id % 3 engine, page_id // 3 query from resolved where page_id % 4 <> 0 or ordinal % 2 = 0)
select query, engine, target from h where engine = (select min(engine) from h h2 where h2.query = h.query) group by all""")
def engine_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits.first_answering(search_hits(spark, sf_dir), "query", "engine").select("query", "engine", "target").distinct()


def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of three engines for each query: the links of three neighbouring pages."""
    found = links_extract(spark, sf_dir).where("page_id % 4 <> 0 or ordinal % 2 = 0")
    return found.select("page_id", "ordinal", "target", (F.col("page_id") % 3).alias("engine"), F.floor(F.col("page_id") / 3).alias("query"))


@query(f"""{_RESOLVED}, h as (select page_id, ordinal, target, page_id % 3 engine, page_id // 3 query from resolved where page_id % 4 <> 0 or ordinal % 2 = 0),
f as (select query, target, min(engine * 10000 + ordinal) score from h group by query, target)
select query, target, score, cast(row_number() over (partition by query order by score, target) as int) rank from f qualify rank <= 5""")
def hits_dedup_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = search_hits(spark, sf_dir).withColumn("score", F.col("engine") * 10000 + F.col("ordinal"))
    once = hits.first_of_each(scored.select("query", "target", "score"), ["query", "target"], "score")
    return hits.top_k(once, "query", [F.col("score"), F.col("target")], 5).select("query", "target", "score", "rank")


@query("""with h as (select conv_id, turn, length(text) size, row_number() over (partition by conv_id order by turn) - 1 place, count(*) over (partition by conv_id) n from conversations)
select conv_id, turn, 1000 // n + case when place < 1000 % n then 1 else 0 end budget, cast(sum(size) over (partition by conv_id order by turn rows unbounded preceding) as bigint) used,
sum(size) over (partition by conv_id order by turn rows unbounded preceding) <= 3000 fits, sum(size) over (partition by conv_id) <= 3000 group_fits from h""")
def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    out = hits.running_budget(hits.split_budget(rows, "conv_id", "turn", 1000), "conv_id", "turn", "size", 3000)
    return out.select("conv_id", "turn", F.col("budget").cast("long").alias("budget"), "used", "fits", "group_fits")


@query("""select page_id, '7, ' || page_id % 5 || ' and ' || page_id % 9 || ',2 2' answer,
list_aggregate(list_transform(list_filter([7, page_id % 5, page_id % 9, 2], lambda x, i: x between 1 and 6 and list_position([7, page_id % 5, page_id % 9, 2], x) = i), lambda x: cast(x as varchar)), 'string_agg', ',') kept from pages""")
def filter_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.lit("7, "), (F.col("page_id") % 5).cast("string"), F.lit(" and "), (F.col("page_id") % 9).cast("string"), F.lit(",2 2"))
    kept = F.array_join(F.transform(hits.filter_indices(answer, F.lit(6)), lambda x: x.cast("string")), ",")
    return table(spark, sf_dir, "pages").select("page_id", answer.alias("answer"), F.nullif(kept, F.lit("")).alias("kept"))


@query(r"""select page_id, case when regexp_matches(url, '(v=|youtu\.be/|/embed/|/shorts/)[A-Za-z0-9_-]{11}') then 'video'
when contains(url, 'feed') or ends_with(url, '.xml') then 'feed' when regexp_matches(url, '^https?://') then 'page' else 'search' end route from pages""")
def smart_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    route = (
        F.when(u.rlike(r"(v=|youtu\.be/|/embed/|/shorts/)[A-Za-z0-9_-]{11}"), "video")
        .when(u.contains("feed") | u.endswith(".xml"), "feed")
        .when(u.rlike("^https?://"), "page")
        .otherwise("search")
    )
    return table(spark, sf_dir, "pages").select("page_id", route.alias("route"))


@query(r"""with t as (select doc_id, trim(regexp_replace(text, '[\s\p{Z}\x{85}]+', ' ', 'g')) c from documents)
select doc_id, substr(c, 1, 80) snippet, case when c = '' then 0 else len(string_split(c, ' ')) end words, length(c) n from t""")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = text.clean(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate(c, 80).alias("snippet"), text.word_count(F.col("text")).cast("long").alias("words"), F.length(c).cast("long").alias("n"))


@query(r"""with t as (select conv_id, turn, regexp_replace(regexp_replace('begin untrusted ' || text, 'BEGIN UNTRUSTED', 'BEGIN[DATA] UNTRUSTED', 'gi'), 'END UNTRUSTED', 'END[DATA] UNTRUSTED', 'gi') s from conversations)
select conv_id, turn, 'BEGIN UNTRUSTED turn' || chr(10) || 'DATA: ' || replace(s, chr(10), chr(10) || 'DATA: ') || chr(10) || 'END UNTRUSTED turn' as block from t""")
def untrusted_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.envelope("turn", F.concat(F.lit("begin untrusted "), F.col("text"))).alias("block"))


@query(r"""with e as (select conv_id, turn, replace(replace(replace(regexp_replace(substr(text, 1, 60), '([\\`*_{}\[\]()#+\-.!|~])', '\\\1', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') t from conversations),
l as (select conv_id, string_agg('## ' || (turn + 1) || '. ' || t, chr(10) || chr(10) order by turn) body, count(*) n from e where turn < 5 group by conv_id)
select conv_id, '# Report ' || conv_id || chr(10) || chr(10) || body as report, length(body) <= 1000000 bounded from l""")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each conversation's first five turns, its untrusted text escaped."""
    first = table(spark, sf_dir, "conversations").where("turn < 5")
    line = F.concat(F.lit("## "), (F.col("turn") + 1).cast("string"), F.lit(". "), text.escape_markdown(text.truncate(F.col("text"), 60)))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    body = first.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda s: s["line"]), "\n\n").alias("body"))
    return body.select("conv_id", F.concat(F.lit("# Report "), F.col("conv_id").cast("string"), F.lit("\n\n"), F.col("body")).alias("report"), (F.length("body") <= 1_000_000).alias("bounded"))




@query("""select page_id, case page_id % 5 when 0 then null when 3 then 'rate_limited' when 4 then case when page_id % 2 = 0 then 'rate_limited' else 'http_status' end when 2 then 'login_required' else 'http_status' end error,
case when page_id % 3 = 0 then page_id % 40 end retry_after_secs, cast(1 as bigint) kept_headers from pages""")
def response_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses, headers and bodies by the page's number: errors, rate limits and the headers that a redirect keeps."""
    p = F.col("page_id")
    status = F.element_at(F.array(*map(F.lit, (200, 500, 401, 429, 403))), (p % 5 + 1).cast("int"))
    retry = F.when(p % 3 == 0, (p % 40).cast("string")).otherwise("-1")
    headers = F.create_map(F.lit("Retry-After"), retry, F.lit("Cookie"), F.lit("x"), F.lit("AUTHORIZATION"), F.lit("y"))
    body = F.when(p % 2 == 0, '{"message":"API Rate Limit exceeded"}').otherwise("not json")
    limits = responses.rate_limit(headers)
    kept = F.size(responses.without_sensitive(headers)).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", responses.repository_error(status, limits["remaining"], body).alias("error"), limits["retry_after_secs"].alias("retry_after_secs"), kept.alias("kept_headers"))


_TITLED = f"{_RESOLVED}, k as (select page_id, ordinal, href, target, 'T & ' || substr(href, 2) title from resolved where ordinal < 3)"


@query(f"""{_TITLED} select page_id, case when page_id % 7 = 0 then 'empty' when page_id % 7 = 1 then 'layout' else 'ok' end status, cast(case when page_id % 7 > 1 then ordinal end as int) ordinal,
case when page_id % 7 > 1 then title end title, case when page_id % 7 > 1 then target end url, case when page_id % 7 > 1 then 's ' || ordinal end snippet from k where page_id % 7 > 1 or ordinal = 0""")
def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's first links written as a result page and parsed back; some pages have no results, some an unknown layout."""
    found = links_extract(spark, sf_dir).where("ordinal < 3")
    title = F.concat(F.lit("T &amp; "), F.substring("href", 2, 1 << 20))
    wrapped = F.concat(F.lit("//d/l/?x=1&amp;uddg="), F.url_encode("target"))
    hit = F.concat(F.lit('<div class="result x"><a rel="n" href="'), wrapped, F.lit('"><b>'), title, F.lit('</b></a><span class="result__snippet">s '), F.col("ordinal").cast("string"), F.lit("</span></div>"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", hit.alias("h")))), lambda s: s["h"]), "")
    body = F.when(F.col("page_id") % 7 == 0, "<p>No results.</p>").when(F.col("page_id") % 7 == 1, "<p>?</p>").otherwise(F.col("whole"))
    pages = found.groupBy("page_id").agg(whole.alias("whole")).select("page_id", body.alias("body"))
    return search_pages.results(pages, "page_id", "body", search_pages.DUCKDUCKGO)


@query(rf"""{_RESOLVED}, h as (select page_id query, cast(row_number() over (partition by page_id order by ordinal) as int) rank, href title, target url from resolved),
n as (select query, max(rank) n from h group by query),
picked as (select h.query, case when n >= 3 then case rank when 3 then 0 when 1 then 1 end else rank - 1 end place, title, url from h join n on h.query = n.query where case when n >= 3 then rank in (1, 3) else rank <= 5 end),
e as (select query, place, regexp_replace(title, '([\\`*_{{}}\[\]()#+\-.!|~])', '\\\1', 'g') t, url from picked)
select query, '# ' || query || chr(10) || chr(10) || string_agg('- [' || t || '](' || url || ')', chr(10) order by place) as report, count(*) <= 5 as valid from e group by query""")
def investigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's links as hits, chosen by a fixed answer (`3, 1`) and reported."""
    found = links_extract(spark, sf_dir).select(F.col("page_id").alias("query"), "ordinal", F.col("href").alias("title"), F.col("target").alias("url"))
    ranked = research.numbered(found, F.col("ordinal"))
    three = ranked.groupBy("query").agg(F.max("rank").alias("n")).where("n >= 3").select("query")
    some = research.choose(ranked.join(three, "query", "left_semi"), lambda block: F.lit("3, 1"))
    rest = research.choose(ranked.join(three, "query", "left_anti"), lambda block: F.lit("none"))
    return research.report(some.union(rest), ranked.where("false").select("query", F.col("title").alias("warning")))
