"""Rules against direct evaluation, propagation against power iteration."""

from collections import defaultdict

from siltweb.llm import url_filter as U


def judge(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = tail[: min((i for i in (tail.find(c) for c in "?#") if i >= 0), default=len(tail))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best


def power(pages, rules, how):
    """Scores of hosts by plain iteration."""
    import re

    split = [(judge(u, rules), h) for _, u, h in pages]
    n, good, bad, links = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for (host, _, rule), html in split:
        if host:
            n[host] += 1
            good[host] += bool(rule and rule.action == "allow")
            bad[host] += bool(rule and rule.action == "block")
        for href in re.findall(U.HREF, html or ""):
            to = judge("http:" + href if href.startswith("//") else href, ())[0]
            if host and to and to != host:
                links[host, to] += 1
    out = []
    for seeds, a in ((good, 0), (bad, 1)):
        base = {h: seeds[h] / n[h] * (1 - how.damping) for h in n if seeds[h]}
        total = defaultdict(int)
        for e, c in links.items():
            total[e[a]] += c
        score = dict(base)
        for _ in range(how.rounds):
            new = defaultdict(float, base)
            for e, c in links.items():
                if e[a] in score:
                    new[e[1 - a]] += how.damping * score[e[a]] * c / total[e[a]]
            score = dict(new)
        out.append(score)
    return out


def check(spark, pages, how=U.Propagation()):
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, verdict string")
    trust, distrust = power(pages, U.RULES, how)
    got = sorted(tuple(r) for r in U.filter_urls(df, how=how).collect())
    want = []
    for page_id, url, _ in pages:
        host, path, rule = judge(url, U.RULES)
        t, d = trust.get(host, 0.0), distrust.get(host, 0.0)
        want.append((page_id, host, path, rule.text if rule else None, rule.action if rule else "block" if d - t >= how.threshold else "allow", t, d))
    for g, w in zip(got, sorted(want, key=lambda r: r[0])):
        assert g[:5] == w[:5] and abs(g[5] - w[5]) < 1e-9 and abs(g[6] - w[6]) < 1e-9
    assert len(got) == len(want)
    return got


def test_links_spread_trust_and_distrust(spark):
    a = lambda *to: "".join(f'<a href="{t}">x</a>' for t in to)
    pages = [
        (1, "http://bad.net/x", a("http://farm.com/", "/own")),
        (2, "http://farm.com/en/", a("https://bad.net/a", "//bad.net/b")),
        (3, "http://good.org/fr/1", a("http://farm2.com/", "http://nice.com/")),
        (4, "http://nice.com/", None),
        (5, "http://farm2.com/q", a("http://bad.net/", "http://good.org/")),
        (6, "http://EXAMPLE.net/en/?q", ""),
        (7, "http://www.example.com/de/x", a("HTTP://Nice.com")),
        (8, "http://www.example.com/en/x", ""),
        (9, None, a("http://bad.net/")),
        (10, "nonsense", ""),
        (11, "http://a.net", ""),
        (12, "x://y.org?/fr/", ""),
    ]
    got = {r[0]: r for r in check(spark, pages, U.Propagation(threshold=0.05))}
    assert got[2][4] == "block" and got[4][4] == "allow" and got[11][3] is None
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/pages.parquet").select("page_id", "url", "html").collect()]
    check(spark, rows + rows[:1])
