"""Named values out of scripts against what each script says, and that hostile scripts are read once."""

import json
import time

import pytest

from siltweb.operators import captions, scripts

CASES = [
    ('s = {"a": 1};', ['{"a": 1}']),
    ('window.s={"a":"}"}', ['{"a":"}"}']),
    ("window [ /* c */ 's' ] = {\"a\": {}} ; other = {\"b\":1}", ['{"a": {}}']),
    ('x["\\s"] = {"esc":1}', ['{"esc":1}']),
    ('s = "{\\"a\\":1}"', ['"{\\"a\\":1}"']),
    ('// s = {"no":1}\ns={"yes":1}', ['{"yes":1}']),
    ('/* s = {"no":1} */ <!-- s = {"no":2}\n--> s = {"no":3}\n s /*c*/ = //d\n {"yes":1}', ['{"yes":1}']),
    ("a = 's = {}'; b = \"s = {}\"; c = `s = {} ${ `s = {}` + {s: '}'} } s = {}`; s = {\"yes\":1}", ['{"yes":1}']),
    ('a = /s = {"no":1}["/]/g; s = {"yes":1}', ['{"yes":1}']),
    ("a = b / c; d = '/'; s = {\"yes\":1}", ['{"yes":1}']),
    ("return /'/.test(x); s = {\"yes\":1}", ['{"yes":1}']),
    ("c = `${ /`}/ } ${ a.return / 2 } `; s = {\"yes\":1}", ['{"yes":1}']),
    ('ss = {"no":1}; s2 = {}; $s = {}; s == {}; s => {}; s: {}; s = [1]; s = 1; s = \'{}\'', []),
    ('s = {"a":1}; s = {"b":2}', ['{"a":1}', '{"b":2}']),
    ('s = {"open": 1', []),
    ('s = "open', []),
    ("x = `open s = {\"no\":1}", []),
    ('s = s = {"yes":1}', ['{"yes":1}']),
    ('var é = 1, s = {"é": "ü"}', ['{"é": "ü"}']),
]


@pytest.mark.parametrize("source, want", CASES)
def test_assignments(source, want):
    assert [raw for _, raw in scripts.assignments(source, ["s"])] == want


def test_parsed():
    assert scripts.parsed('{"a":1}') == '{"a":1}' and scripts.parsed('"{\\"a\\":1}"') == '{"a":1}'
    assert [scripts.parsed(x) for x in ("{a:1}", '{"a":NaN}', '"x"', '{"a":1,}', '{"a":' * 9000 + "1" + "}" * 9000)] == [None] * 5


def test_each_unended_value_is_read_once(monkeypatch):
    reads = []
    real = scripts._object_end
    monkeypatch.setattr(scripts, "_object_end", lambda source, start: reads.append(start) or real(source, start))
    assert list(scripts.assignments("s = {" * 20_000, ["s"])) == [] and len(reads) == 1
    reads.clear()
    assert len(list(scripts.assignments('s = {"no":true};' * 1000 + 's = {"yes":1}', ["s"]))) == 1001 == len(reads)


@pytest.mark.parametrize("piece", ["s = {", "`", "`${", "/", "/*", "s[", '"\\', "(", "x / ", "/[", "'", "${`", "s = \"", "-->", "*/*"])
def test_long_scripts_take_time_in_proportion(piece):
    def took(n):
        start = time.perf_counter()
        list(scripts.assignments(piece * n, ["s"]))
        return time.perf_counter() - start

    took(1000)
    assert took(40_000) < 10 * max(took(10_000), 0.02)


def pages(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "page_id long, html string")


def test_named_json_of_pages(spark):
    found = pages(
        spark,
        '<p>second = {"no":1}</p><script>second = {"k":1}</script><script>first = {"other":1}; first = {"k":2}</script>',
        '<script>second = {"k":3}; first = {"other":1}</script>',
        '<script>first = {"other":2}; first = {bad}</script><!-- <script>first = {"k":1}</script> -->',
        "<script>first = {</script>",
        None,
        "",
    )
    from pyspark.sql import functions as F

    got = scripts.named_json(found, ["first", "second"], F.get_json_object("json", "$.k").isNotNull())
    assert sorted(tuple(r) for r in got.collect()) == [(0, "first", '{"k":2}', True), (1, "second", '{"k":3}', True), (2, "first", '{"other":2}', False)]


def player(*tracks):
    return "<script>var ytInitialPlayerResponse = " + json.dumps({"captions": {"playerCaptionsTracklistRenderer": {"captionTracks": list(tracks)}}}) + ";</script>"


def test_caption_tracks_and_choice(spark):
    en = {"baseUrl": "https://www.youtube.com/api/timedtext?v=1&lang=en", "languageCode": "en", "name": {"simpleText": "English"}}
    asr = {"baseUrl": "https://www.youtube.com/api/timedtext?v=1&kind=asr", "languageCode": "en", "kind": "asr", "name": {"runs": [{"text": "En"}, {"text": "glish"}]}}
    fr = {"baseUrl": "https://www.youtube.com/api/timedtext?v=1&lang=fr", "languageCode": "fr", "name": {"simpleText": " "}}
    got = scripts.caption_tracks(pages(spark, player(asr, en, fr), player({"languageCode": "x"}, {**fr, "languageCode": " "}), player(fr), "<script>ytInitialPlayerResponse = {}</script>"))
    rows = sorted((r["page_id"], r["ordinal"], r["language"], r["name"], r["generated"]) for r in got.collect())
    assert rows == [(0, 0, "en", "English", True), (0, 1, "en", "English", False), (0, 2, "fr", "fr", False), (2, 0, "fr", "fr", False)]
    chosen = lambda wanted: {r["page_id"]: r["ordinal"] for r in captions.choose_track(got, "page_id", wanted).collect()}
    assert chosen("FR") == {0: 2, 2: 0} and chosen(None) == {0: 0, 2: 0} and chosen(" ") == {0: 0, 2: 0}


URLS = [
    ("https://www.youtube.com/api/timedtext?v=1", None),
    ("https://video.google.com:443/x", None),
    ("http://www.youtube.com/x", "scheme"),
    ("https://u:p@www.youtube.com/x", "credentials"),
    ("https://www.youtube.com:8443/x", "port"),
    ("https://youtube.com.evil.com/x", "host"),
    ("https://www.youtube.com/x?next=https%3A%2F%2Fevil.com%2F", "nested"),
    ("https://www.youtube.com/x?next=https%253A%252F%252Fevil.com%252F", "nested"),
    ("https://www.youtube.com/x?next=https%3A%2F%2Fwww.google.com%2F%3Fu%3Dhttp%253A%252F%252Fgoogle.com", "nested"),
    ("https://www.youtube.com/x?next=https%3A%2F%2Fwww.google.com%2F%3Fu%3Da", None),
    ("https://www.youtube.com/x?a=" + "b" * 4097, "long"),
    ("https://www.youtube.com/x?a=%25252525252525252561", "deep"),
    ("https://www.youtube.com/x?a=%25zz", None),
    ("https://www.youtube.com/x?a=%25ff", "encoding"),
    ("https://www.youtube.com/x?a=javascript:x", "nested"),
    ("not a url", "invalid"),
    (None, "invalid"),
]


def test_caption_urls(spark):
    df = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(URLS)], "k long, url string")
    got = {r["k"]: r["fault"] for r in df.select("k", captions.url_fault("url").alias("fault")).collect()}
    assert got == {k: want for k, (_, want) in enumerate(URLS)}
    assert captions.with_format("https://www.youtube.com/t?fmt=srv3&v=1&fmt=x#f") == "https://www.youtube.com/t?v=1&fmt=json3#f"
