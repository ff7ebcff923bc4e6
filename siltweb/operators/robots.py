"""robots.txt as relations: lines to groups to rules, and decisions by longest prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks, urls


def parse(robots: DataFrame, agent: str) -> DataFrame:
    """``origin, allow, path, delay`` of the groups that speak to ``agent``: rules, and one row with a delay where given.

    Consecutive user-agent lines open a group; a blank line ends it. ``*`` has specificity 0, another name its length if the
    agent starts with it; equally specific groups merge. Wildcards in paths are literal.
    """
    lines = robots.select("origin", F.posexplode(F.split(F.regexp_replace("text", "^\\x{FEFF}", ""), r"\r?\n")).alias("n", "raw"))
    line = F.trim(F.regexp_replace("raw", "#.*$", ""))
    named = lines.select("origin", "n", (F.trim(F.col("raw")) == "").alias("blank"), F.lower(F.trim(F.split_part(line, F.lit(":"), F.lit(1)))).alias("field"), F.trim(F.regexp_extract(line, ":(.*)$", 1)).alias("value"))
    said = named.where(F.col("blank") | F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay"))
    w = Window.partitionBy("origin").orderBy("n")
    before = F.coalesce(F.lag(F.when(F.col("blank"), "").otherwise(F.col("field"))).over(w), F.lit(""))
    opens = (F.col("field") == "user-agent") & ~F.col("blank") & (before != "user-agent")
    ends = F.col("blank")
    grouped = said.withColumn("group", F.sum((opens | ends).cast("int")).over(w)).where(~F.col("blank"))
    fits = F.when(F.col("value") == "*", 0).when((F.col("value") != "") & F.lit(agent.lower()).startswith(F.lower("value")), F.length("value"))
    agents = grouped.where("field = 'user-agent'").select("origin", "group", fits.alias("rank")).where("rank is not null")
    best = agents.groupBy("origin").agg(F.max("rank").alias("rank"))
    chosen = agents.join(best, ["origin", "rank"], "left_semi").select("origin", "group").distinct()
    rules = grouped.where("field <> 'user-agent'").join(chosen, ["origin", "group"], "left_semi")
    paths = rules.where("field in ('allow', 'disallow') and value <> ''").select("origin", (F.col("field") == "allow").alias("allow"), F.col("value").alias("path"), F.lit(None).cast("double").alias("delay"))
    delay = F.col("value").try_cast("double")
    delays = rules.where("field = 'crawl-delay'").select("origin", delay.alias("delay")).where("delay >= 0 and delay < double('infinity')")
    longest = delays.groupBy("origin").agg(F.max("delay").alias("delay")).select("origin", F.lit(None).cast("boolean").alias("allow"), F.lit(None).cast("string").alias("path"), "delay")
    return paths.union(longest)


def _octets(path: Column) -> Column:
    """The form that rules are compared in; most paths are in it already."""
    # the path is computed once, as the variable of a lambda
    return F.get(F.transform(F.array(path), lambda p: F.when(p.rlike(r"%|[^\x00-\x7F]"), checks.robots_octets(p)).otherwise(p)), F.lit(0))


def decide(urls: DataFrame, rules: DataFrame, path: Column) -> DataFrame:
    """``urls`` with ``allowed``: the longest rule that starts the path decides, allow wins ties, no rule allows.

    Paths and rules are compared in one form: unreserved octets plain, all other escapes in upper case, what isn't ASCII
    escaped. Rules of one origin ride along as an array, so a popular origin's urls aren't moved or multiplied by its rules.
    """
    told = rules.where("path is not null").withColumn("path", _octets(F.col("path")))
    bundled = told.groupBy("origin").agg(F.collect_list(F.struct(F.length("path").alias("size"), "allow", "path")).alias("rules"))
    joined = urls.withColumn("asked_", _octets(path)).join(bundled, "origin", "left")
    fitting = F.filter("rules", lambda r: F.col("asked_").startswith(r["path"]))
    best = F.array_max(F.transform(fitting, lambda r: F.struct(r["size"], r["allow"])))
    return joined.withColumn("allowed", F.coalesce(best["allow"], F.lit(True))).drop("rules", "asked_")


def outcomes(fetches: DataFrame, max_hops: int = 10) -> DataFrame:
    """``origin, state, error, text``: what came of asking each origin for its rules.

    ``fetches``: origin, status, final_url, hops, content_type, text, error; one row an origin. A missing file (404) allows all:
    ``missing``. Text of 2xx gives ``rules``. Everything else denies all, as ``denied`` with its error: another status, more than
    ``max_hops`` redirects, a redirect to another origin, a type that isn't plain text, or the fetch's own.
    """
    away = urls.origin(F.col("final_url")) != F.col("origin")
    ok = F.col("status").between(200, 299)
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("hops") > max_hops, "redirect_limit")
        .when(F.coalesce(away, F.lit(True)), "cross_origin")
        .when(F.col("status") == 404, None)
        .when(~F.coalesce(ok, F.lit(False)), F.concat(F.lit("http_"), F.coalesce(F.col("status").cast("string"), F.lit("none"))))
        .when(~F.coalesce(checks.is_robots_text(F.col("content_type")), F.lit(False)), "content_type")
    )
    state = F.when(error.isNotNull(), "denied").when(F.col("status") == 404, "missing").otherwise("rules")
    return fetches.select("origin", state.alias("state"), error.alias("error"), F.when(state == "rules", F.coalesce("text", F.lit(""))).alias("text"))


def decide_by_outcome(asked: DataFrame, states: DataFrame, agent: str, path: Column) -> DataFrame:
    """``asked`` with ``allowed`` and ``error``: by the rules where an origin has them, all where it has none; an origin without a row in ``states`` is one whose file is missing."""
    rules = parse(states.where("state = 'rules'").select("origin", "text"), agent)
    by_rules = decide(asked, rules, path)
    known = states.select("origin", "state", "error")
    joined = by_rules.join(known, "origin", "left")
    denied = F.coalesce(F.col("state") == "denied", F.lit(False))
    return joined.withColumn("allowed", F.col("allowed") & ~denied).withColumn("error", F.when(denied, F.col("error"))).drop("state")
