"""Crawl over a snapshot: breadth-first frontier, redirects, politeness and counters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def breadth_first(edges: DataFrame, start: DataFrame, max_depth: int = 64) -> DataFrame:
    """``node, depth`` of what ``start(node)`` reaches over ``edges(src, dst)``.

    A level is one join of the frontier with the edges and an anti join with what is seen; it is written to the shared
    folder, so lineage stays short and a lost executor costs one level.
    """
    frontier = materialize(start.select("node", F.lit(0).alias("depth")).distinct(), "level-0")
    seen = frontier
    for depth in range(1, max_depth + 1):
        reached = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct()
        frontier = materialize(reached.join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth")), f"level-{depth}")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen


def numbered(rows: DataFrame, order: list[str], **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """``rows`` with a column for each of ``counts``: a row's number, from 1, among those that meet the condition, over the whole order; null for others. And how many there are.

    A prefix count without gathering: ranges of the order are written as partitions, each is counted, and what earlier
    ranges hold is added. The driver sees one row for each range.
    """
    held = materialize(rows.repartitionByRange(*order).withColumn("part_", F.spark_partition_id()).withColumns({f"{name}_": c for name, c in counts.items()}), "ranges")
    sizes = sorted(tuple(r) for r in held.groupBy("part_").agg(*[F.count_if(f"{name}_").alias(name) for name in counts]).collect())
    within = Window.partitionBy("part_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    made, totals = {}, {}
    for k, name in enumerate(counts, 1):
        before, total = [], 0
        for size in sizes:
            before += [F.lit(size[0]), F.lit(total)]
            total += size[k]
        offset = F.create_map(*before)[F.col("part_")] if before else F.lit(0)
        made[name], totals[name] = F.when(F.col(f"{name}_"), (offset + F.count_if(f"{name}_").over(within)).cast("long")), total
    return held.withColumns(made).drop("part_", *[f"{name}_" for name in counts]), totals


def budgeted(start: DataFrame, links: DataFrame, nodes: DataFrame, budget: int, per_page: int = 1024) -> DataFrame:
    """``node, depth, place, outcome`` of a crawl of at most ``budget`` attempts from ``start(node)``, in the order of discovery.

    ``links(src, ordinal, dst)`` are in document order; the first ``per_page`` of a page count, and the first that names a node
    discovers it. ``nodes(node, allowed, ok)`` says what robots rules allow and which attempts succeed; of nodes that aren't
    there attempts fail. Discovered nodes wait their turn: one that isn't allowed is ``denied`` and costs nothing, so the
    next in line is promoted in its stead; attempts, ``succeeded`` or ``failed``, are numbered by ``place``; what still waits when
    the budget is spent is ``discarded``. Only attempts that succeed discover links.

    A level is a join of its attempts with the links, a minimum for each node found, and a prefix count over the global order;
    what waits goes before all of the next level, so the queue is the order itself. Ends when a level attempts nothing.
    """
    order = ["above", "ordinal"]
    first = start.select("node", F.lit(0).cast("long").alias("above"), F.col("node").alias("ordinal"))
    some = links.select("src", F.col("ordinal").cast("long").alias("ordinal"), "dst")
    nth = F.row_number().over(Window.partitionBy("src").orderBy("ordinal"))
    some = some.groupBy("src", "dst").agg(F.min("ordinal").alias("ordinal")).withColumn("nth", nth).where(F.col("nth") <= per_page).drop("nth")
    level, depth, spent, seen = first, 0, 0, []
    while True:
        told = level.join(nodes, "node", "left").withColumns({"allowed": F.coalesce("allowed", F.lit(True)), "ok": F.coalesce("ok", F.lit(False))})
        ahead, totals = numbered(told, order, nth=F.col("allowed"), turn=F.lit(True))
        found = totals["nth"]
        # a node that is denied after the last attempt isn't looked at any more
        last = ahead.where(F.col("nth") == budget - spent).agg(F.min("turn")).first()[0] if spent + found >= budget else None
        late = F.lit(spent >= budget) if last is None else F.col("turn") > last
        outcome = F.when(late, "discarded").when(~F.col("allowed"), "denied").when(F.col("ok"), "succeeded").otherwise("failed")
        done = materialize(ahead.select("node", F.lit(depth).alias("depth"), F.when(~late, F.col("nth") + spent).alias("place"), outcome.alias("outcome")), f"crawl-{depth}")
        seen.append(done)
        spent = min(budget, spent + found)
        if not found or last is not None or spent >= budget:
            break
        reached = done.where("outcome = 'succeeded'").select(F.col("node").alias("src"), F.col("place").alias("above")).join(some, "src")
        best = reached.groupBy(F.col("dst").alias("node")).agg(F.min(F.struct(*order)).alias("o")).select("node", "o.*")
        level = materialize(best.join(reduce(DataFrame.union, seen).select("node"), "node", "left_anti"), f"level-{depth + 1}")
        depth += 1
        if level.isEmpty():
            break
    if spent >= budget:
        # what the last attempts found has nothing to wait for
        reached = seen[-1].where("outcome = 'succeeded'").select(F.col("node").alias("src")).join(some, "src").select(F.col("dst").alias("node")).distinct()
        fresh = reached.join(reduce(DataFrame.union, seen).select("node"), "node", "left_anti")
        seen.append(fresh.select("node", F.lit(depth + 1).alias("depth"), F.lit(None).cast("long").alias("place"), F.lit("discarded").alias("outcome")))
    return reduce(DataFrame.union, seen)


def summary(crawled: DataFrame) -> DataFrame:
    """One row, ``summary``: the counters of a crawl as text. Queued are all that had their turn."""
    of = lambda *names: F.count_if(F.col("outcome").isin(*names)).cast("string")
    parts = {"attempted": of("succeeded", "failed"), "succeeded": of("succeeded"), "failed": of("failed"), "queued": of("succeeded", "failed", "denied"), "skipped": of("denied", "discarded")}
    return crawled.agg(F.concat_ws(" ", *[F.concat(F.lit(name + "="), n) for name, n in parts.items()]).alias("summary"))


def strict_error(crawled: DataFrame, start: int, status: DataFrame) -> DataFrame:
    """What a crawl that must succeed as a whole fails with: ``place, node, error`` of the first attempt that failed or whose ``status(node, status)`` isn't 2xx, or of a start that rules deny; no row where all is well."""
    with_status = crawled.join(status, "node", "left")
    error = F.when((F.col("outcome") == "denied") & (F.col("node") == start), "robots_denied").when(F.col("outcome") == "failed", "failed").when((F.col("outcome") == "succeeded") & ~F.coalesce(F.col("status").between(200, 299), F.lit(False)), F.concat(F.lit("http_"), F.coalesce(F.col("status").cast("string"), F.lit("none"))))
    wrong = with_status.withColumn("error", error).where("error is not null").select(F.coalesce("place", F.lit(0)).alias("place"), "node", "error")
    return wrong.orderBy("place", "node").limit(1)


def bounds_fault(pages: Column, workers: Column, proxies: Column) -> Column:
    """Why a crawl's settings are refused, null where they aren't: 1 to 100 pages, 1 to 16 at a time, 8 proxies at most."""
    out = lambda c, low, high: ~F.coalesce(c.between(low, high), F.lit(False))
    return F.when(out(pages, 1, 100), "pages").when(out(workers, 1, 16), "concurrency").when(out(proxies, 0, 8), "proxies")


def follow_redirects(requests: DataFrame, redirects: DataFrame, max_hops: int = 10) -> DataFrame:
    """``url, final, hops, error`` of ``requests(url)`` over ``redirects(src, dst)``, one target each: at most ``max_hops`` are followed, then the request fails.

    Only requests that still move take part in the next hop's join.
    """
    active = requests.select("url", F.col("url").alias("at"), F.lit(0).alias("hops"))
    done = None
    for hop in range(max_hops + 1):
        joined = materialize(active.join(redirects, active["at"] == redirects["src"], "left").select("url", "at", "hops", "dst"), f"hop-{hop}")
        arrived = joined.where("dst is null").select("url", F.col("at").alias("final"), "hops", F.lit(None).cast("string").alias("error"))
        done = arrived if done is None else done.union(arrived)
        active = joined.where("dst is not null").select("url", F.col("dst").alias("at"), (F.col("hops") + 1).alias("hops"))
        if active.isEmpty():
            return done
    return done.union(active.select("url", F.lit(None).cast("string"), F.lit(None).cast("int"), F.lit("redirect_limit")))


def claim(attempts: DataFrame, target: str, order: str) -> DataFrame:
    """The first attempt owns a landing page; later ones that converge on it are skipped."""
    first = attempts.groupBy(target).agg(F.min(order).alias("first"))
    return attempts.join(first, target).withColumn("owner", F.col(order) == F.col("first")).drop("first")


def schedule(requests: DataFrame, origin: str, order: str, delay_ms: Column) -> DataFrame:
    """``start_ms`` of each request: an origin's requests stand one delay apart."""
    place = F.row_number().over(Window.partitionBy(origin).orderBy(order)) - 1
    return requests.withColumn("start_ms", place * delay_ms)


def rotate(requests: DataFrame, attempt: str, proxies: list[str]) -> DataFrame:
    return requests.withColumn("proxy", F.element_at(F.array(*map(F.lit, proxies)), (F.pmod(F.col(attempt), F.lit(len(proxies))) + 1).cast("int")))


def counters(pages: DataFrame, status: Column, allowed: Column) -> DataFrame:
    """One row of counts, each a partial sum in its task."""
    return pages.agg(
        F.count("*").alias("scheduled"),
        F.count_if(allowed & status.between(200, 299)).alias("completed"),
        F.count_if(allowed & ~status.between(200, 299)).alias("failed"),
        F.count_if(~allowed).alias("skipped"),
    )
