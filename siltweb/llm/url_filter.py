"""URL filter: explicit rules first, then trust and distrust propagated over the graph of hosts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

HREF = r"""(?i)href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: The rules of the query's contract.
RULES = (Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


@dataclass(frozen=True)
class Propagation:
    damping: float = 0.85
    rounds: int = 8
    #: A host whose distrust exceeds its trust by this much is blocked.
    threshold: float = 0.1


def ascii_lower(c: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; empty where there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching(rules: tuple[Rule, ...], host: Column, path: Column, value) -> Column:
    """``value`` of the longest rule that fits, as one CASE."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, share``: of a host's links to other hosts, the share that goes to each. Counted before any shuffle by host."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(HREF), 1)).alias("href"))
    dst = host_of(F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), "href")).otherwise(F.col("href")))
    return links.select("src", dst.alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, start: str, end: str, how: Propagation) -> DataFrame:
    """Personalised PageRank ``host, score`` along ``start -> end``; ``seeds(host, seed)`` are where it restarts."""
    total = edges.groupBy(start).agg(F.sum("n").alias("all"))
    step = materialize(edges.join(total, start).select(F.col(start).alias("a"), F.col(end).alias("b"), (F.col("n") / F.col("all")).alias("share")), "host-steps")
    base = seeds.where("seed > 0").select("host", (F.col("seed") * (1 - how.damping)).alias("base"))
    score = materialize(base.withColumnRenamed("base", "score"), "host-score")
    for k in range(how.rounds):
        flow = step.join(score, step.a == score.host).groupBy(F.col("b").alias("host")).agg((F.sum(F.col("share") * F.col("score")) * how.damping).alias("flow"))
        new = base.join(flow, "host", "full").select("host", (F.coalesce("base", F.lit(0.0)) + F.coalesce("flow", F.lit(0.0))).alias("score"))
        if k == 0 and step.isEmpty():
            return score  # nothing flows: the restart mass is the fixed point
        score = materialize(new, "host-score")
    return score


def filter_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, how: Propagation = Propagation()) -> DataFrame:
    """Judge every page's url: ``page_id, host, path, rule, verdict``, then ``trust, distrust`` of its host.

    The longest fitting rule decides. Where none fits, the method does: hosts restart trust in proportion to their pages
    that an allow rule fits and distrust in proportion to those that a block rule fits; trust flows along links,
    distrust against them, and a host is blocked where distrust exceeds trust by ``how.threshold``.

    A null url or one without ``://`` has an empty host and path, fits no rule, and is allowed. Null html has no links.
    Repeated rows are judged one by one; an empty table gives an empty result; other columns are left out.
    """
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    host, path = F.col("host"), F.col("path")
    judged = split.withColumn("rule", matching(rules, host, path, lambda r: r.text)).withColumn("said", matching(rules, host, path, lambda r: r.action))
    share = lambda action: F.avg(F.when(F.col("said") == action, 1.0).otherwise(0.0))
    seeds = materialize(judged.where("host <> ''").groupBy("host").agg(share("allow").alias("good"), share("block").alias("bad")), "host-seeds")
    edges = materialize(host_edges(pages), "host-edges")
    trust = propagate(edges, seeds.select("host", F.col("good").alias("seed")), "src", "dst", how).withColumnRenamed("score", "trust")
    distrust = propagate(edges, seeds.select("host", F.col("bad").alias("seed")), "dst", "src", how).withColumnRenamed("score", "distrust")
    hosts = trust.join(distrust, "host", "full")
    out = judged.join(hosts, "host", "left").na.fill(0.0, ["trust", "distrust"])
    method = F.when(F.col("distrust") - F.col("trust") >= how.threshold, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "trust", "distrust")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).drop("trust", "distrust")


def oracle(rules: tuple[Rule, ...] = RULES, how: Propagation = Propagation()) -> str:
    """The same in DuckDB, its rounds written out."""

    def case(value) -> str:
        fits = lambda r: f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
        return "case " + " ".join(f"when {fits(r)} then '{value(r)}'" for r in sorted(rules, key=lambda r: -len(r.text))) + " end"

    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    host = lambda u: f"coalesce(translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{upper.lower()}'), '')"
    href = HREF.replace("'", "''")
    parts = [
        f"split as (select page_id, {host('url')} host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path, html from pages)",
        f"judged as (select page_id, host, path, html, {case(lambda r: r.text)} rule, {case(lambda r: r.action)} said from split)",
        "seeds as (select host, avg(case when said = 'allow' then 1.0 else 0.0 end) good, avg(case when said = 'block' then 1.0 else 0.0 end) bad from judged where host <> '' group by host)",
        f"links as (select host src, unnest(regexp_extract_all(html, '{href}', 1)) href from judged)",
        f"edges as (select src, dst, count(*) n from (select src, {host('case when starts_with(href, ' + chr(39) + '//' + chr(39) + ') then ' + chr(39) + 'http:' + chr(39) + ' || href else href end')} dst from links) where src <> '' and dst <> '' and src <> dst group by all)",
    ]
    for name, seed, a, b in (("t", "good", "src", "dst"), ("d", "bad", "dst", "src")):
        parts.append(f"{name}step as (select {a} a, {b} b, n / sum(n) over (partition by {a}) share from edges)")
        parts.append(f"{name}base as (select host, {seed} * {1 - how.damping!r} base from seeds where {seed} > 0)")
        parts.append(f"{name}0 as (select host, base score from {name}base)")
        for k in range(how.rounds):
            parts.append(f"{name}{k + 1} as (select host, sum(s) score from (select host, base s from {name}base union all select b, share * score * {how.damping!r} from {name}step join {name}{k} on a = host) group by host)")
    last = how.rounds
    return f"with {', '.join(parts)} select page_id, j.host, path, rule, coalesce(said, case when coalesce(d.score, 0) - coalesce(t.score, 0) >= {how.threshold!r} then 'block' else 'allow' end) verdict from judged j left join t{last} t on t.host = j.host left join d{last} d on d.host = j.host"
