"""Page trees, selection and Markdown against what is expected of each; checks, renderers and cookie files."""

import random

import pytest
from pyspark.sql import functions as F

from siltweb.functions import checks, urls
from siltweb.operators import construct, render, tree

TREES = [
    ("", "html(head body)"),
    ("x", "html(head body('x'))"),
    ("<p>a<p>b", "html(head body(p('a') p('b')))"),
    ("<b>1<i>2<p>3</b>4", "html(head body(b('1' i('2')) i(p(b('3') '4'))))"),
    ("<b>1<p>2</b>3</p>", "html(head body(b('1') p(b('2') '3')))"),
    ("<div><b><div></b>x</div>y", "html(head body(div(b div(b 'x') 'y')))"),
    ("<a>1<a>2", "html(head body(a('1') a('2')))"),
    ("<table>x<tr><td>1</table>", "html(head body('x' table(tbody(tr(td('1'))))))"),
    ("<table><b>x<tr><td>1</table>y", "html(head body(b('x') table(tbody(tr(td('1')))) b('y')))"),
    ("<p><table></table>b", "html(head body(p(table 'b')))"),
    ("<!DOCTYPE html><p><table></table>b", "html(head body(p table 'b'))"),
    ("<title>T&amp;<b></title><body>hi</body>after", "html(head(title('T&<b>')) body('hiafter'))"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>", "html(head body(ul(li('a') li('b' ul(li('c'))))))"),
    ("<select><option>a<option>b<p>x</select>y", "html(head body(select(option('a') option('bx')) 'y'))"),
    ("<svg><g/><p>out</svg>z", "html(head body(svg(g) p('outz')))"),
    ("<table><caption>c<col><tr><th>x", "html(head body(table(caption('c') colgroup(col) tbody(tr(th('x'))))))"),
    ("<form><div></form>x</div>y", "html(head body(form(div('x')) 'y'))"),
    ("<script>if(a<b){'<p>'}", "html(head(script('if(a<b){\\'<p>\\'}')) body)"),
    ("</p><br></p>", "html(head body(br p))"),
    ("<html lang=a><body id=b><html lang=c dir=d><body id=e>", "html(head body)"),
]

KINDS = [
    ("<main><h2>A &amp; b</h2><p>one<p>two</main>", "## A & b\n\none\n\ntwo"),
    ("<main><p>x <b>bold</b> <em>it</em> <del>no</del></main>", "x **bold** *it* ~~no~~"),
    ("<ul><li>One<ul><li>Nested</ul><li>Two<ol><li>First</ol></ul>", "- One\n    - Nested\n- Two\n    1. First"),
    ("<p><code>a`b</code></p>", "``a`b``"),
    ("<pre><code class='language-py'>x = 1\n  y</code></pre>", "```py\nx = 1\n  y\n```"),
    ("<blockquote><p>q</p></blockquote>", "> q"),
    ("<table><tr><th>A<th>B<tr><td>1<td></table>", "| A | B |\n| --- | --- |\n| 1 |  |"),
    ("<p>a<br>b</p><hr><p>c</p>", "a  \nb\n\n---\n\nc"),
    ("<p><a href='/x?a=1&amp;b=2'>l</a> <a href='javascript:x'>js</a> <img src=/i.png alt=pic></p>", "[l](http://h/x?a=1&b=2) js ![pic](http://h/i.png)"),
    ("<main><nav>n</nav><div class='x ad'>junk</div><p hidden>h</p><p aria-hidden=true>i</p><p>kept</p></main>", "kept"),
    ("<body><p>around</p><article><p>in</p></article></body>", "in"),
    ("<p># no head</p><p>1. no list</p><p>a*b_c[d]</p>", "\\# no head\n\n1\\. no list\n\na\\*b\\_c\\[d\\]"),
    ("", ""),
    # no body tag, image only, misnested formatting
    ("<h1>T</h1><p>no body tag</p>", "# T\n\nno body tag"),
    ("<img src=/i.png alt=pic>", "![pic](http://h/i.png)"),
    ("<b><p>x</b>y</p>", "**x**y"),
    ("<p><b>one<p>two", "**one**\n\n**two**"),
    # class words and aria-hidden as they are; preferred roots need content
    ("<main><p class=AD>kept</p><p class='x promo'>no</p><p aria-hidden=TRUE>yes</p><dialog>no</dialog><object>in</object></main>", "kept\n\nyes\n\nin"),
    ("<main><hr></main><article><p>Fallback</p></article>", "Fallback"),
    ("<main><img src='javascript:bad' alt=x></main><article>Article</article>", "Article"),
    # tables: nested ones stay in their cell, headers, alignments, widths
    ("<table><tr><td>A<tr><td>B<td>C<tr><td>Outer<table><thead><tr><th>I1<th>I2</thead><tr><td>J1</table><td>D</table>", "|  |  |\n| --- | --- |\n| A |  |\n| B | C |\n| OuterI1I2J1 | D |"),
    ("<table><tr><th scope=row>Row<td>Value</table>", "|  |  |\n| --- | --- |\n| Row | Value |"),
    ("<table><tr><td>B1<td>B2<thead><tr><th>H1<th>H2<tfoot><tr><td>F1<td>F2</table>", "| H1 | H2 |\n| --- | --- |\n| B1 | B2 |\n| F1 | F2 |"),
    ("<table><col align=right><col align=center><col align=left><thead><tr><th>R<th>C<th>L</thead><tr><td align=right>1<td align=center>2<td align=left>3</table>", "| R | C | L |\n| ---: | :---: | :--- |\n| 1 | 2 | 3 |"),
    ("<table><thead><tr><th align=right>A<th align=center>B</thead><tr><td align=left>C<td align=center>D</table>", "| A | B |\n| --- | :---: |\n| C | D |"),
    ("<table><thead><tr><th>a<th>b</thead><tr><td>x|y<td hidden>h<tr><td><code>p|q</code><td>l<br>m</table>", "| a | b |\n| --- | --- |\n| x\\|y |  |\n| `p\\|q` | l m |"),
    ("<table>out<tr><td>in</table>", "out\n\n|  |\n| --- |\n| in |"),
]


def test_markdown_of_each_kind(spark):
    html = [h for h, _ in KINDS]
    pages = spark.createDataFrame([(k, "http://h/a/b", h) for k, h in enumerate(html)] + [(99, None, None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["markdown"] for r in tree.markdown(pages).collect()}
    assert got == {k: want for k, (_, want) in enumerate(KINDS)} | {99: ""}


@pytest.mark.parametrize("html, tree", TREES)
def test_trees_as_browsers_build_them(html, tree):
    def shown(node):
        if isinstance(node, str):
            return "'" + node.replace("'", "\\'") + "'"
        return node.tag + (f"({' '.join(map(shown, node.children))})" if node.children else "")

    assert shown(construct.build(html)) == tree


def test_any_tags_make_a_tree():
    draw = random.Random(3)
    tags = "a b p div table tr td caption col select option form li dd svg template script title button h1 nobr object body html head br pre noscript".split()
    for _ in range(1500):
        html = "".join(draw.choice(("<{}>", "</{}>", "<{}/>", "x", " ")).format(draw.choice(tags)) for _ in range(draw.randint(1, 50)))
        root = construct.build(html)
        below, seen = [root], 0
        while below:
            node = below.pop()
            seen += 1
            inner = [c for c in node.children if not isinstance(c, str)]
            assert all(c.parent is node for c in inner)
            below += inner
        assert root.tag == "html" and seen <= 60 * 50
        assert {"head", "body"} <= {c.tag for c in root.children if not isinstance(c, str)}


def test_deep_pages_take_time_in_proportion():
    for html in ("<div>" * 20_000, "<b>" * 5000 + "<p>x</b>" * 500, "<table>" * 3000, "<a>" * 5000):
        assert construct.build(html).tag == "html"


def test_paths_without_a_body_tag(spark):
    pages = spark.createDataFrame([(1, "http://h/", "<title>t</title><p>a<div><p>b</div>"), (2, "http://h/", "<table><tr><td>x</table>"), (3, "http://h/", None), (4, "http://h/", "")], "page_id long, url string, html string")
    e = tree.elements(pages)
    count = lambda q: sorted(r["page_id"] for r in tree.select(e, q).collect())
    assert count("/html/body") == [1, 2, 4] and count("/html/body/p") == [1] and count("/html/body/div/p") == [1] and count("//table/tbody/tr/td") == [2] and count("/html/head/title") == [1]
    assert sorted(r["tag"] for r in e.where("own").collect()) == ["div", "p", "p", "table", "td", "title", "tr"]


def test_bounded_markdown(spark):
    nested = lambda n: "<main>" + "<div>" * n + "x" + "</div>" * n + "</main>"
    html = ["<p>x          y</p>", "<p>a🦀b</p>", "<p>*</p><p>b", nested(254), nested(255), nested(600), None, "<p><b>abc"]
    pages = spark.createDataFrame([(k, "http://h/", h) for k, h in enumerate(html)], "page_id long, url string, html string")
    told = lambda most: [tuple(r)[1:] for r in tree.markdown_bounded(pages, most).orderBy("page_id").collect()]
    deep = (None, "html")
    assert told(100) == [("x y", None), ("a🦀b", None), ("\\*\n\nb", None), ("x", None), deep, deep, ("", None), ("**abc**", None)]
    over = (None, "body_limit")
    assert told(3) == [("x y", None), ("a🦀b", None), over, ("x", None), deep, deep, ("", None), over]
    assert told(2)[:2] == [over, over]
    assert {r["page_id"]: r["markdown"] for r in tree.markdown(pages).collect()}[5] == ""


def test_selection(spark):
    html = "<!-- <p>no --><body><p id=a class='x y'>1<p data-k=v>2<ul><li>a<li>b</ul><div><p><img src='s'></div><script>'<p>'</script></body>"
    e = tree.elements(spark.createDataFrame([(1, "http://h/", html)], "page_id long, url string, html string"))
    count = lambda q: tree.select(e, q).count()
    wanted = {"//p": 3, "p": 3, "//li": 2, "//li[2]": 1, "//img": 1, "//div/p/img": 1, "div > img": 0, "div img": 1, "#a": 1, ".y": 1, "p.x.y": 1, "[data-k]": 1, "[data-k=v]": 1, "[data-k^='w']": 0, "li:last-child, img": 2, "//p[@id='a']": 1}
    assert {q: count(q) for q in wanted} == wanted
    with pytest.raises(ValueError):
        tree.select(e, "p:hover")


def test_memory_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://h/", "<h1 id=t class='b a' data-z=1 data-a=2>Title</h1>")], "page_id long, url string, html string")
    memory = tree.remember(tree.fingerprints(tree.select(tree.elements(pages), "h1"), pages), F.lit("n"))
    assert memory.first()["memory"] == '{"classes":["a","b"],"data":{"data-a":"2","data-z":"1"},"id":"t","snippet":"Title","tag":"h1"}'
    assert tree.recall(memory).first()["snippet"] == "Title"
    assert tree.recall(spark.createDataFrame([("n", "{}")], "name string, memory string")).count() == 0


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_dot_segments(spark):
    r = lambda ref: one(spark, urls.resolve(F.lit("http://h/a/b/c?q"), F.lit(ref)))
    assert [r(x) for x in ("../up", "../../../x/.", "./d", "/x/./y/../z", "..", "%2e%2E/k?m=../n", "#f")] == ["http://h/a/up", "http://h/x/", "http://h/a/b/d", "http://h/x/z", "http://h/a/", "http://h/a/k?m=../n", "http://h/a/b/c?q"]


def test_addresses_unwrap_ipv4(spark):
    from siltweb.functions import addresses

    rows = ["::ffff:224.0.0.1", "::ffff:192.88.99.1", "::10.0.0.1", "::8.8.8.8", "3ffe::1", "2a00::1"]
    df = spark.createDataFrame([(a,) for a in rows], "a string")
    assert [r[0] for r in df.select(addresses.is_public_ipv6("a")).collect()] == [False, False, False, True, False, True]


def test_checks(spark):
    lit = lambda *x: F.array(*map(F.lit, x))
    fault = lambda *x: one(spark, checks.content_type_fault(lit(*x)))
    assert [fault("text/html"), fault("text/html; charset=utf8", "TEXT/HTML;charset=UTF-8"), fault("text/html", "text/plain"), fault("text/html;"), fault("a/b; charset=utf-8; charset=latin1")] == [None, None, "conflict", "invalid", "charset"]
    assert one(spark, checks.is_attachment(lit("inline", " Attachment ; filename=x")))
    assert one(spark, checks.decoded(F.lit(bytearray("é".encode("latin-1"))), F.lit("text/html; charset=Latin1"))) == "é"
    assert one(spark, checks.decoded(F.lit(bytearray(b"a\xff")), F.lit("text/html; charset=nope"))) == "a�"
    assert one(spark, checks.robots_octets(F.lit("/a%7eb%2f%c3é"))) == "/a~b%2F%C3%C3%A9"
    assert one(spark, checks.visible(F.lit("a‮b\x07\n"))) == "a<U+202E>b<U+0007><U+000A>"
    assert one(spark, checks.domain_suffix(F.lit(".Example.COM."))) == "example.com" and one(spark, checks.domain_suffix(F.lit("a..b"))) is None
    assert one(spark, checks.owner_and_repository(F.lit("o/r.x")))["repository"] == "r.x" and one(spark, checks.owner_and_repository(F.lit("o/r/x"))) is None
    assert one(spark, checks.asks_for_login("linkedin", F.lit("<a href=/UAS/login>"))) and not one(spark, checks.asks_for_consent(F.lit("plain")))
    assert one(spark, checks.generated_text(F.lit("a\n\tb"))) and not one(spark, checks.generated_text(F.lit("a\x0bb")))
    assert one(spark, checks.normalized_query(F.lit(" a   b "))) == "a b" and one(spark, checks.normalized_query(F.lit(" "))) is None
    assert one(spark, checks.runs_text(F.lit('{"runs":[{"text":"a"},{"text":"b"}]}'))) == "ab"
    assert one(spark, checks.search_url("http://s/", F.lit("a b&c"), F.lit(3))) == "http://s/?q=a+b%26c&count=3"
    assert not one(spark, checks.redirect_allowed(F.lit("https://a/"), F.lit("http://a/"))) and one(spark, checks.redirect_allowed(F.lit("https://a.b/"), F.lit("https://x.b/"), lit("b")))
    answers = spark.createDataFrame([("a", "1", True), ("a", "2", False), ("b", "3", True), ("c", None, None)], "host string, address string, public boolean")
    assert {r["host"]: r["allowed"] for r in checks.resolved_hosts(answers).collect()} == {"a": False, "b": True, "c": False}


BODIES = [
    (b"\x93a\x94 \x80 \x81\xe9", "text/html; charset=windows-1252", "\u201ca\u201d \u20ac \x81\xe9"),
    (b"\x93\x80", "text/html; charset=Latin1", "\u201c\u20ac"),
    (b"\x80", "text/html; charset=\"us-ascii\"", "\u20ac"),
    ("Привет".encode("cp1251"), "text/plain; charset=x-cp1251", "Привет"),
    ("日本語".encode("shift_jis"), "text/html; charset=Shift_JIS", "日本語"),
    ("日本語".encode("cp932"), "text/html; charset=x-sjis", "日本語"),
    ("日本語".encode("euc_jp"), "text/html; charset=euc-jp", "日本語"),
    ("中文€".encode("gb18030"), "text/html; charset=gb2312", "中文€"),
    ("한국어".encode("cp949"), "text/html; charset=ks_c_5601-1987", "한국어"),
    ("漢字".encode("big5"), "text/html; charset=Big5", "漢字"),
    ("é".encode("utf-16-be"), "text/html; charset=utf-16be", "é"),
    ("é".encode("utf-16-le"), "text/html; charset=utf-16", "é"),
    (b"\xff\xfe" + "é".encode("utf-16-le"), "text/html; charset=utf-8", "é"),
    (b"\xef\xbb\xbf\xc3\xa9", "text/html; charset=shift_jis", "é"),
    (b"\xef\xbb\xbf\xc3\xa9", None, "é"),
    (b"\xa4", "text/html; charset=iso-8859-15", "€"),
    (b"\xfe", "text/html; charset=l5", "ş"),
    (b"a\xff\xc3", "text/html", "a\ufffd\ufffd"),
    (b"", "text/html; charset=gbk", ""),
    (None, "text/html; charset=gbk", None),
]


def test_bodies_by_label(spark):
    df = spark.createDataFrame([(k, b, t) for k, (b, t, _) in enumerate(BODIES)], "k long, body binary, type string")
    got = {r["k"]: r["x"] for r in df.select("k", checks.decoded(F.col("body"), F.col("type")).alias("x")).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(BODIES)}


def test_renderers_and_cookies(spark):
    rows = [("q", 1, "T", "http://u", "s", None, None, "w"), ("q", 2, "U", "http://v", "", "md", "timeout", None), ("none", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "query string, rank int, title string, url string, snippet string, markdown string, error string, warning string")
    assert {r["query"]: r["text"] for r in render.hits(df).collect()} == {"q": "warning: w\n1. T\n   http://u\n   s\n2. U\n   http://v\nmd\n   scrape error: timeout", "none": "No results."}
    raw = "# Netscape HTTP Cookie File\n.h.com\tTRUE\t/\tTRUE\t0\tn\tv\n#HttpOnly_x.h.com\tFALSE\t/p\tfalse\t99\tm\tw\nother.org\tTRUE\t/\tTRUE\t0\tn\tv\nshort\tline"
    got = render.cookies(spark.createDataFrame([(1, "x.h.com", raw)], "id long, host string, raw string")).orderBy("line").collect()
    assert [(r["name"], r["domain"], r["secure"], r["http_only"], r["expires"], r["error"]) for r in got] == [("n", "h.com", True, False, None, None), ("m", None, False, True, 99, None), (None, None, None, None, None, "domain"), (None, None, None, None, None, "fields")]
    repo = '{"full_name":"o/r","stargazers_count":3,"forks_count":1,"license":{"spdx_id":"MIT"},"html_url":"https://github.com/o/r"}'
    docs = spark.createDataFrame([(1, repo), (2, repo.replace("github.com", "evil.com")), (3, "{}")], "id long, json string")
    assert [(r["id"], r["name"], r["license"]) for r in render.repositories(docs).collect()] == [(1, "o/r", "MIT")]
    xml = "<transcript><text start='1.5' dur='2'>a &amp;amp; b</text><text start='x'>no</text></transcript>"
    caps = render.xml_captions(spark.createDataFrame([(1, xml), (2, "<!DOCTYPE x>" + xml)], "id long, xml string")).collect()
    assert [(r["id"], r["start_ms"], r["duration_ms"], r["text"]) for r in caps] == [(1, 1500, 2000, "a & b")]


def test_queries_without_sql_cover_all_pages(spark, small):
    from siltweb import catalog

    n = spark.read.parquet(f"{small}/pages.parquet").count()
    got = {name: f(spark, small).collect() for name, f in catalog.TESTED.items()}
    assert len(got["markdown_whole_pages"]) == n and sum(r["markdown"] != "" for r in got["markdown_whole_pages"]) > n // 2
    assert 0 < len(got["first_heading_text"]) <= n and got["remembered_headings"]


ODD = [(1, "http://h/", "<nav><ul><li><a href='/a'>A</a><li><a>no</a><a href='/b'>B</a></ul></nav><div class=x>1<script>s</script><p>2<template><p>t</template></div><h1>one <b>two</b></h1><h1>no</h1>"), (2, "http://h/", None), (3, "http://h/", "plain"), (4, "http://h/", "<div><div class=x><h1></h1></div>y</div>")]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("selector", ["/html/body/nav/ul/li/a[@href][2]", "//div//p", "/html/body/*", "nav li > a[href], h1", "div .x", "li:first-child a"])
def test_pages_are_parsed_once_whatever_the_steps(spark, selector):
    pages = spark.createDataFrame(ODD, "page_id long, url string, html string")
    key = lambda df: sorted((r["page_id"], r["pre"], r["post"], r["tag"], tuple(sorted(r["attrs"].items()))) for r in df.collect())
    found = tree.find(pages, selector)
    assert "MapInArrow" not in _plan(found) and key(found) == key(tree.select(tree.elements(pages), selector)) != []


def test_first_texts_parse_pages_once(spark):
    pages = spark.createDataFrame(ODD, "page_id long, url string, html string")
    first = tree.first_text(pages, "h1")
    assert "MapInArrow" not in _plan(first) and sorted(map(tuple, first.collect())) == [(1, "one two"), (4, "")]
    assert sorted(tuple(r)[::2] for r in tree.find_text(pages, "div.x").collect()) == [(1, "1 2"), (4, "")]


def test_first_headings_are_settled_early_as_in_whole_trees(spark, monkeypatch):
    from siltweb.operators import construct

    rng, rows = random.Random(7), list(ODD)
    tags = "h1 h1 h2 table tr td caption b a p div form select template svg button li script nobr".split()
    for k in range(1500):
        rows.append((k + 10, "http://h/", "".join(rng.choice([f"<{t}>", f"<{t}>", f"</{t}>", f"x{i}\n "]) for i in range(rng.randrange(25)) for t in [rng.choice(tags)])))
    rows += [(5, "http://h/", "<table><tr><td><h1>in</h1></td></tr><h1>before</h1></table>"), (6, "http://h/", "<H1>A</H1>" + "<h1>b</h1>" * 9)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted((r["page_id"], r["text"]) for r in tree.find_text(pages, "h1", True).collect())
    monkeypatch.setattr(tree, "find_text", None)  # no rows of whole pages for a heading
    got = sorted(map(tuple, tree.first_text(pages, "h1").collect()))
    assert got == want and (5, "before") in got and (6, "A") in got and len(got) > 300
    assert len([c for c in construct.build(rows[-1][2], "h1").children[1].children]) == 1


def test_blocks_of_markdown_are_made_once(spark):
    html = "<p>a <b><i><s>b</s></i></b> <code>x `y`</code> <a href='/c_(d)'><code>e</code></a> z<table><tr><th>h<td><code>p|q</code></table><p> </p>"
    pages = spark.createDataFrame([(1, "http://h/", html), (2, "http://h/", None), (3, "http://h/", "")], "page_id long, url string, html string")
    made = tree.markdown(pages)
    assert r"(?U)\s+" not in _plan(made)
    assert {r["page_id"]: r["markdown"] for r in made.collect()} == {1: "a ***~~b~~*** `` x `y` `` [`e`](http://h/c_\\(d\\)) z\n\n| h | `p\\|q` |\n| --- | --- |", 2: "", 3: ""}


def test_common_encodings_stay_inside_spark(spark):
    import pandas as pd

    from siltweb.functions import charsets

    rng = random.Random(5)
    odd = [b"", b"a", b"\xff\xfe", b"\xfe\xff", b"\xff\xfea\x00\x3d\xd8\x00\xde", b"\xfe\xff\xd8\x3d\xde\x00", b"\x3d\xd8", b"\x00\xde\x3d\xd8", b"\xfe\xff\xff\xfe", b"\xff\xfe\xff\xfe", b"\xff\xfe\xfe\xff", b"a\x00\xfe\xff", b"\x00a\xff\xfe", b"a\x00b", bytes(range(256)), "ßØ é \U0001f600".encode("utf-16-le") * 40_000, b"\xef\xbb\xbfx\xff", None]
    odd += [bytes(rng.choice([0, 10, 0x61, 0x80, 0x9D, 0xD8, 0xDC, 0xDF, 0xE9, 0xFE, 0xFF]) for _ in range(rng.randrange(9))) for _ in range(400)]
    names = ["utf-16le", "utf-16be", "windows-1252", "koi8-r", "shift_jis", None]
    rows = [(k, None if b is None else bytearray(b), c) for k, (b, c) in enumerate((b, c) for b in odd for c in names)]
    df = spark.createDataFrame(rows, "k int, body binary, charset string")
    got = {r["k"]: r["text"] for r in df.select("k", charsets.decoded(F.col("body"), F.col("charset")).alias("text")).collect()}
    python = charsets._decoded.func
    for k, body, charset in rows:
        utf8 = body is not None and (body[:3] == b"\xef\xbb\xbf" or charset is None and body[:2] not in (b"\xfe\xff", b"\xff\xfe"))
        if not utf8:
            assert got[k] == python(pd.Series([body]), pd.Series([charset or "utf-16le"]))[0], (body, charset)
    plan = df.select(charsets.decoded(F.col("body"), F.col("charset")))
    assert "UTF-16LE" in _plan(plan) and "UTF-16BE" in _plan(plan)
