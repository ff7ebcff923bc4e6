"""Feeds of three kinds against the items that readers see."""

from siltweb.operators import feeds

RSS = """﻿<?xml version="1.0"?><!-- <item><guid>/no</guid></item> --><rss><channel><title>F</title>
<item><title>R &amp;amp; N</title><link>/posts/a</link><description><![CDATA[<p>First <strong>line</strong><br>Second &amp; final.</p>]]></description><pubDate>Tue, 27 Aug 2024 14:15:16 GMT</pubDate></item>
<item><title>Fallback</title><guid isPermaLink="true">/guid-post</guid><description>Plain &amp; simple</description></item>
<item><pubDate>Tue, 27 Aug 2024 16:00:00 GMT</pubDate></item>
<item><title>No permalink</title><guid isPermaLink='false'>/x</guid><x:encoded xmlns:x="u"><![CDATA[<ul><li>a</ul>]]></x:encoded></item>
<item><title>t</title><link>javascript:x</link><guid>https://other.com/y?a=1&amp;b=2</guid><pubDate>nonsense</pubDate></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>F</title>
<entry><title><![CDATA[A "T" & M]]></title><link rel="self" href="/self"/><link rel="alternate" href="/alt"/><summary type="html"><![CDATA[<p>Atom <em>s</em></p>]]></summary><updated>2024-09-02T05:04:05+02:00</updated></entry>
<entry><updated>2024-09-03T03:04:05Z</updated></entry>
<entry><title>b</title><link rel="self" href="/s"/><link href="/none"/><summary>x &lt;b&gt; y</summary></entry>
<entry><title>c</title><id>/by-id</id><content type="xhtml"><div><p>in <b>x</b></p></div></content></entry></feed>"""
JSON = '{"version":"https://jsonfeed.org/version/1.1","items":[{"id":"1","url":"/one","title":"J","content_html":"<p>J &amp; <strong>H</strong></p>","date_published":"2024-10-03T04:05:06Z"},{"id":"2","url":"/two","content_text":"Plain &amp; text"},{"id":"3"}]}'


def test_items(spark):
    rows = [(1, RSS), (2, ATOM), (3, JSON), (4, "<!DOCTYPE x>" + ATOM), (5, "<rss><item>"), (6, "[1]"), (7, None), (8, "<rss><channel/></rss>")]
    df = spark.createDataFrame([(k, "https://e.com/f/feed", b) for k, b in rows], "feed_id long, url string, body string")
    got = [tuple(r) for r in feeds.items(df).orderBy("feed_id", "ordinal").collect()]
    e = "https://e.com"
    assert got == [
        (1, 0, "R & N", e + "/posts/a", "First **line**  \nSecond & final.", "2024-08-27T14:15:16+00:00"),
        (1, 1, "Fallback", e + "/guid-post", "Plain & simple", ""),
        (1, 2, "No permalink", "", "- a", ""),
        (1, 3, "t", "https://other.com/y?a=1&b=2", "", ""),
        (2, 0, 'A "T" & M', e + "/alt", "Atom *s*", "2024-09-02T03:04:05+00:00"),
        (2, 1, "b", e + "/none", "x <b> y", ""),
        (2, 2, "c", e + "/by-id", "in **x**", ""),
        (3, 0, "J", e + "/one", "J & **H**", "2024-10-03T04:05:06+00:00"),
        (3, 1, "", e + "/two", "Plain & text", ""),
    ]
    assert {r["feed_id"]: r["error"] for r in feeds.entries(df).where("error is not null").collect()} == {4: "dtd", 5: "feed", 6: "feed", 7: "feed"}
    assert [r["ordinal"] for r in feeds.items(df.where("feed_id = 1"), 2).orderBy("ordinal").collect()] == [0, 1]
