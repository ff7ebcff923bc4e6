"""Crawls with a budget against a queue in plain Python; robots outcomes, octets and the numbering of a global order."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from siltweb.operators import crawl, links, robots


def queue(n, edges, allowed, ok, budget):
    """The same with one queue: ``node -> place, outcome``."""
    waiting, seen, told, spent = deque([0]), {0}, {}, 0
    while waiting:
        node = waiting.popleft()
        if spent >= budget:
            told[node] = (None, "discarded")
        elif not allowed.get(node, True):
            told[node] = (None, "denied")
        else:
            spent += 1
            told[node] = (spent, "succeeded" if ok.get(node, False) else "failed")
            if ok.get(node, False):
                for target in edges.get(node, []):
                    if target not in seen:
                        seen.add(target)
                        waiting.append(target)
    return told


@pytest.mark.parametrize("seed, budget", [(1, 7), (2, 25), (3, 1), (4, 1000)])
def test_budget_against_a_queue(spark, seed, budget):
    draw = random.Random(seed)
    n = 60
    edges = {k: [draw.randrange(n) for _ in range(draw.randint(0, 4))] for k in range(n)}
    edges[0] = [5, 9, 5, 0, 17, 3]
    allowed = {k: draw.random() > 0.25 for k in range(1, n)}
    ok = {k: draw.random() > 0.25 for k in range(1, n - 5)} | {0: True}
    links_ = spark.createDataFrame([(k, i, t) for k, ts in edges.items() for i, t in enumerate(ts)], "src long, ordinal int, dst long")
    nodes = spark.createDataFrame([(k, allowed.get(k), ok.get(k)) for k in range(n - 5)], "node long, allowed boolean, ok boolean")
    allowed = {k: v for k, v in allowed.items() if k < n - 5}
    got = crawl.budgeted(spark.range(1).select(F.col("id").alias("node")), links_, nodes, budget)
    assert {r["node"]: (r["place"], r["outcome"]) for r in got.collect()} == queue(n, edges, allowed, ok, budget)
    told = queue(n, edges, allowed, ok, budget)
    count = lambda *names: sum(o in names for _, o in told.values())
    assert crawl.summary(got).first()[0] == f"attempted={count('succeeded', 'failed')} succeeded={count('succeeded')} failed={count('failed')} queued={count('succeeded', 'failed', 'denied')} skipped={count('denied', 'discarded')}"


def test_denied_start_and_caps(spark):
    start = spark.range(1).select(F.col("id").alias("node"))
    links_ = spark.createDataFrame([(0, k, k + 1) for k in range(9)], "src long, ordinal int, dst long")
    nodes = spark.createDataFrame([(k, k > 0, True) for k in range(10)], "node long, allowed boolean, ok boolean")
    denied = crawl.budgeted(start, links_, nodes, 5)
    assert [tuple(r) for r in denied.collect()] == [(0, 0, None, "denied")]
    status = spark.createDataFrame([(k, 200 if k != 2 else 503) for k in range(10)], "node long, status int")
    assert crawl.strict_error(denied, 0, status).first()["error"] == "robots_denied"
    nodes = nodes.withColumn("allowed", F.lit(True))
    capped = crawl.budgeted(start, links_, nodes, 100, per_page=3)
    assert sorted(r["node"] for r in capped.collect()) == [0, 1, 2, 3]
    assert tuple(crawl.strict_error(capped, 0, status).first()) == (3, 2, "http_503")
    faults = spark.createDataFrame([(1, 1, 0), (0, 1, 0), (100, 17, 0), (100, 16, 9)], "p int, w int, x int").select(crawl.bounds_fault(F.col("p"), F.col("w"), F.col("x")))
    assert [r[0] for r in faults.collect()] == [None, "pages", "concurrency", "proxies"]


def test_numbers_over_a_global_order(spark):
    rows = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1000).alias("k"))
    got, totals = crawl.numbered(rows, ["k"], even=F.col("k") % 2 == 0, all=F.lit(True))
    assert totals == {"even": 500, "all": 1000}
    assert sorted(tuple(r) for r in got.select("k", "even", "all").collect()) == [(k, None if k % 2 else k // 2 + 1, k + 1) for k in range(1000)]
    assert crawl.numbered(rows.limit(0), ["k"], n=F.lit(True))[1] == {"n": 0}


def test_rules_are_compared_as_octets(spark):
    rules = spark.createDataFrame([("o", False, "/%70rivate"), ("o", False, "/ü"), ("o", True, "/private/%61"), ("o", False, "/x%2fy")], "origin string, allow boolean, path string")
    paths = {"/private": False, "/%70rivate/b": False, "/private/a": True, "/p": True, "/%c3%bc": False, "/ü": False, "/%C3": True, "/x%2Fy": False, "/x/y": True, "/%zz": True}
    asked = spark.createDataFrame([("o", p) for p in paths] + [("other", "/private")], "origin string, path string")
    got = {(r["origin"], r["path"]): r["allowed"] for r in robots.decide(asked, rules, F.col("path")).collect()}
    assert got == {("o", p): want for p, want in paths.items()} | {("other", "/private"): True}


def test_outcomes_of_asking_for_rules(spark):
    o = lambda k: f"https://h{k}.com"
    given = [
        (200, "/robots.txt", 0, "text/plain", None, "rules", None),
        (404, "/robots.txt", 0, None, None, "missing", None),
        (503, "/robots.txt", 0, "text/plain", None, "denied", "http_503"),
        (403, "/robots.txt", 0, "text/plain", None, "denied", "http_403"),
        (200, "/robots.txt", 0, "text/html", None, "denied", "content_type"),
        (200, "elsewhere", 1, "text/plain", None, "denied", "cross_origin"),
        (200, "/other.txt", 10, "text/plain", None, "rules", None),
        (200, "/robots.txt", 11, "text/plain", None, "denied", "redirect_limit"),
        (None, "/robots.txt", 0, None, "timeout", "denied", "timeout"),
        (None, "/robots.txt", 0, None, None, "denied", "http_none"),
    ]
    rows = [(o(k), s, "https://elsewhere.com/r" if f == "elsewhere" else o(k) + f, h, c, "User-agent: *\nDisallow: /no\n", e) for k, (s, f, h, c, e, _, _) in enumerate(given)]
    states = robots.outcomes(spark.createDataFrame(rows, "origin string, status int, final_url string, hops int, content_type string, text string, error string"))
    assert {r["origin"]: (r["state"], r["error"]) for r in states.collect()} == {o(k): (s, e) for k, (*_, s, e) in enumerate(given)}
    asked = spark.createDataFrame([(o(k), p) for k in range(len(given) + 1) for p in ("/no", "/yes")], "origin string, path string")
    got = {(r["origin"], r["path"]): r["allowed"] for r in robots.decide_by_outcome(asked, states, "siltweb", F.col("path")).collect()}
    state = lambda k: given[k][5] if k < len(given) else "missing"
    assert got == {(o(k), p): state(k) == "missing" or state(k) == "rules" and p == "/yes" for k in range(len(given) + 1) for p in ("/no", "/yes")}


def test_links_of_a_crawl_are_those_of_the_tree(spark):
    html = "<!-- <a href='/c'>x</a> --><script>'<a href=\"/s\">'</script><a href='/1?a=1&amp;b=2'>a</a><a href=/2>b</a><A HREF=\" /3 \">c</A><a name=x>d</a><a href='/1?a=1&b=2'>e</a>"
    pages = spark.createDataFrame([(1, "http://h/", html), (2, "http://h/", None)], "page_id long, url string, html string")
    assert [(r["page_id"], r["ordinal"], r["href"]) for r in links.anchors(pages).collect()] == [(1, 0, "/1?a=1&b=2"), (1, 1, "/2"), (1, 2, "/3"), (1, 3, "/1?a=1&b=2")]
    assert sorted((r["target"], r["place"]) for r in links.discover(pages).collect()) == [("http://h/1?a=1&b=2", 1), ("http://h/2", 2), ("http://h/3", 3)]
