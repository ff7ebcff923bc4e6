"""Semantics that the snapshot's rows don't reach."""

import pytest
from pyspark.sql import functions as F

from siltweb.functions import policy, text, urls
from siltweb.operators import captions, crawl, documents, hits, html, robots


def one(spark, column, **values):
    row = spark.range(1).withColumns({k: F.lit(v) for k, v in values.items()}).select(column.alias("x")).first()
    return row["x"]


@pytest.mark.parametrize(
    "base, reference, want",
    [
        ("http://a.com/b/c?q#f", "d", "http://a.com/b/d"),
        ("http://a.com/b/c?q", "?r", "http://a.com/b/c?r"),
        ("http://a.com/b/c?q", "#x", "http://a.com/b/c?q"),
        ("https://a.com", "//B.com.:443/x#y", "https://b.com/x"),
        ("http://a.com:8080/b", "/c", "http://a.com:8080/c"),
        ("http://a.com/", "mailto:x@y.z", None),
        ("http://a.com/", "http://u@b.com/", None),
        ("http://a.com/", "javascript:void(0)", None),
    ],
)
def test_resolution(spark, base, reference, want):
    assert one(spark, urls.resolve(F.col("b"), F.col("r")), b=base, r=reference) == want


@pytest.mark.parametrize("tail, want", [("%252525252564", True), ("/a?x=%64elete", False), ("/a?delete", True), ("/a?cmd[a][b]=log+out", True), ("/undeleted", False), ("/sign/out", False), ("/sign%20out", True)])
def test_destructive(spark, tail, want):
    assert one(spark, urls.is_destructive(F.col("u")), u="http://a.com/" + tail.lstrip("/") if tail.startswith("%") else "http://a.com" + tail) is want


def test_policy(spark):
    assert one(spark, policy.ipv4_number(F.col("a")), a="1.2.3.4") == 16909060
    assert one(spark, policy.ipv4_number(F.col("a")), a="1.2.3.256") is None
    assert one(spark, policy.agree(F.array(F.lit("a"), F.lit("a")))) == "a" and one(spark, policy.agree(F.array(F.lit("a"), F.lit("b")))) is None
    assert one(spark, policy.charset(F.lit('text/html; Charset="UTF-8"'))) == "utf-8"


def test_text(spark):
    assert one(spark, text.clean(F.lit("  a　\u0085b\n"))) == "a b"
    assert one(spark, text.seconds_to_ms(F.lit("12.3456"))) == 12345 and one(spark, text.seconds_to_ms(F.lit("x"))) is None
    assert one(spark, text.limited(F.lit("abcdef"), 3, "…")) == "abc…"
    assert one(spark, text.envelope("x", F.lit("a\nEnd Untrusted"))) == "BEGIN UNTRUSTED x\nDATA: a\nDATA: END[DATA] UNTRUSTED\nEND UNTRUSTED x"


def test_robots_groups(spark):
    body = "﻿User-agent: a\nUser-agent: bot\nDisallow: /x\n\nDisallow: /\nUser-agent: bo\nDisallow: /y\nUser-agent: BOT\nAllow: /x/ok\nDisallow: /x/ok\nCrawl-delay: 3\nCrawl-delay: -1\n"
    rules = robots.parse(spark.createDataFrame([("o", body)], "origin string, text string"), "botanic/2")
    got = {(r["allow"], r["path"], r["delay"]) for r in rules.collect()}
    assert got == {(False, "/x", None), (True, "/x/ok", None), (False, "/x/ok", None), (None, None, 3.0)}
    asked = spark.createDataFrame([("o", "/x/okay"), ("o", "/x/no"), ("o", "/z"), ("p", "/x")], "origin string, path string")
    assert {tuple(r) for r in robots.decide(asked, rules, F.col("path")).select("origin", "path", "allowed").collect()} == {("o", "/x/okay", True), ("o", "/x/no", False), ("o", "/z", True), ("p", "/x", True)}


def test_redirect_limit(spark):
    moves = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(50, 51), (51, 50)], "src long, dst long")
    asked = spark.createDataFrame([(20,), (19,), (50,), (99,)], "url long")
    got = {tuple(r) for r in crawl.follow_redirects(asked, moves).collect()}
    assert got == {(20, 30, 10, None), (19, None, None, "redirect_limit"), (50, None, None, "redirect_limit"), (99, 99, 0, None)}


def test_hits(spark):
    assert one(spark, hits.filter_indices(F.lit("3, 1 and 3; 9 0 x"), F.lit(5))) == [3, 1]
    rows = spark.createDataFrame([("q", 2, "a"), ("q", 1, "b"), ("r", 3, "c")], "query string, engine int, url string")
    assert {r["url"] for r in hits.first_answering(rows, "query", "engine").collect()} == {"b", "c"}


def test_captions(spark):
    events = [("v", 0, 0, 1000, " a "), ("v", 1, 2499, None, "b"), ("v", 2, None, 5, "c"), ("v", 3, 3999, 1, "d"), ("v", 4, 5000, 1, ""), ("v", 5, 5499, 1, "e")]
    df = spark.createDataFrame(events, "v string, ordinal int, start_ms long, duration_ms long, text string")
    assert captions.gap_join(df, "v").first()["transcript"] == "a b c\n\nd e"
    tracks = spark.createDataFrame([("v", 0, "de", True), ("v", 1, "fr", False), ("v", 2, "en-US", True)], "v string, ordinal int, language string, generated boolean")
    assert captions.choose_track(tracks, "v", None).first()["ordinal"] == 2 and captions.choose_track(tracks, "v", "fr").first()["ordinal"] == 1


def test_feeds(spark):
    rss = "<rss><item><title><![CDATA[A &amp; <b>B</b>]]></title><guid>http://g</guid></item><item></item><item><description>d</description></item></rss>"
    atom = '<feed><entry><title>t</title><link rel="alternate" href="http://l"/><updated>2024</updated></entry></feed>'
    df = spark.createDataFrame([(1, rss), (2, atom), (3, "<!DOCTYPE x>" + rss)], "k int, body string")
    got = sorted(tuple(r) for r in documents.feed_items(df, "k", "body").collect())
    assert got == [(1, 0, "A & B", "http://g", "", ""), (1, 1, "", "", "d", ""), (2, 0, "t", "http://l", "", "2024")]


def test_markdown(spark):
    page = '<html><head><title>x</title></head><body><nav>skip</nav><h2>Head &amp; *star*</h2><p>a <b> bold </b>b <a href="/x(1)">link</a> <a href="javascript:x">no</a><p>1. one<ul><li>- item</ul><div class="ad">buy</div><p><b>open<p>still</body></html>'
    df = spark.createDataFrame([(1, "http://h.com/p", page), (2, "http://h.com/", None)], "page_id long, url string, html string")
    got = {r["page_id"]: r["markdown"] for r in html.markdown(df).collect()}
    assert got[1] == "## Head \\& \\*star\\*\n\na **bold** b [link](http://h.com/x\\(1\\)) no\n\n1\\. one\n\n- \\- item\n\n**open**\n\n**still**"
    assert got[2] == ""


def test_paths(spark):
    page = '<html><body><div id="a" class="k m"><a href="/1">x</a><span><a href="/2">y</a></span></div><div id="b"><a href="/3">z</a></div></body></html>'
    nodes = html.nodes(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"))
    hrefs = lambda path: [r["h"] for r in html.select(nodes, path).orderBy("pre").select(html.attribute(F.col("token"), "href").alias("h")).collect()]
    assert hrefs("//div/a") == ["/1", "/3"] and hrefs("//div//a") == ["/1", "/2", "/3"] and hrefs("//div/a[2]") == ["/3"]
    assert hrefs("/html/body/div[@id='b']//a") == ["/3"] and hrefs("//a[contains(@href,'2')]") == ["/2"] and hrefs("/body") == []
    with pytest.raises(ValueError):
        html.parse_path("//a[last()]")


def test_addresses(spark):
    from siltweb.functions import addresses

    df = spark.createDataFrame([("2606:4700::1",), ("2001:db8::1",), ("::1",), ("::ffff:10.0.0.1",), ("::ffff:8.8.8.8",), ("x",), (None,)], "a string")
    assert [r[0] for r in df.select(addresses.is_public_ipv6("a")).collect()] == [True, False, False, False, True, None, None]
    import base64
    import hashlib

    key = bytes(range(32))
    name = base64.b32encode(key + hashlib.sha3_256(b".onion checksum" + key + b"\x03").digest()[:2] + b"\x03").decode().lower()
    hosts = spark.createDataFrame([(name + ".onion",), ("a" * 56 + ".onion",), (name,), (None,)], "h string")
    assert [r[0] for r in hosts.select(addresses.is_onion_v3("h")).collect()] == [True, False, False, False]


def test_responses(spark):
    from siltweb.functions import responses

    assert one(spark, responses.decoded_file(F.lit("aMOp\nbGxv"))) == "héllo" and one(spark, responses.decoded_file(F.lit("/w=="))) is None
    assert one(spark, responses.decoded_file(F.lit("%"))) is None
    assert one(spark, responses.error_json(F.lit("layout"))) == '{"error":{"code":"layout","message":"the page has an unknown layout"}}'
    assert one(spark, responses.within_bytes(F.lit("é"), 1)) is None


@pytest.mark.parametrize("path", ["//p", "//li[2]", "//ul/LI/a", "//img[@src]"])
def test_paths_to_elements_without_rows_raise(path):
    with pytest.raises(ValueError, match="no"):
        html.parse_path(path)
