"""Near-duplicate embeddings: a neighbour graph refined by NN-descent, whose edges above a cosine are the links."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ann import rotation, usable
from .common import connected_components, hashed_sample, map_groups, materialize, table


@dataclass(frozen=True)
class Descent:
    cosine: float = 0.9
    #: Neighbours kept of each vector. A vector whose list fills up with links is compared with all rows.
    neighbours: int = 8
    #: Random-hyperplane trees that give the first neighbours, and how many vectors their leaves should hold.
    trees: int = 10
    leaf: int = 40
    least_rounds: int = 2
    most_rounds: int = 8
    #: Vectors whose links are counted by brute force to audit the graph, and the recall that ends refinement.
    audited: int = 256
    recall: float = 0.999
    #: Vectors in a block that are compared together, and centres of blocks that a task holds at a time.
    block: int = 256
    centres: int = 4096
    seed: int = 23


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _edges(one: list, near: list, similar: list) -> pd.DataFrame:
    if not one:
        return pd.DataFrame({"id": np.zeros(0, np.int64), "near": np.zeros(0, np.int64), "cos": np.zeros(0)})
    return pd.DataFrame({"id": np.concatenate(one), "near": np.concatenate(near), "cos": np.concatenate(similar)})


def _best(rows: DataFrame, k: int) -> DataFrame:
    """The k most similar neighbours of each id, ties to the smaller id."""
    once = rows.groupBy("id", "near").agg(F.max("cos").alias("cos"))
    order = Window.partitionBy("id").orderBy(F.desc("cos"), "near")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def first_neighbours(unit: DataFrame, n: int, size: int, how: Descent) -> DataFrame:
    """``id, near, cos`` from the leaves of random-hyperplane trees. A leaf that is too full is dealt into parts by a hash of the id."""
    bits = max(1, int(np.ceil(np.log2(max(2, n / how.leaf)))))
    planes = np.concatenate([rotation(size, how.seed + t) for t in range(-(-how.trees * bits // size))])[: how.trees * bits].reshape(how.trees, bits, size)

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            rows, weights = _matrix(batch["vector"]), 1 << np.arange(bits)
            for t in range(how.trees):
                leaf = ((rows @ planes[t].T > 0) * weights).sum(1)
                yield pd.DataFrame({"tree": t, "leaf": leaf, "id": batch["id"], "vector": batch["vector"]})

    coded = materialize(unit.mapInPandas(code, "tree int, leaf long, id long, vector array<double>"), "leaves")
    parts = materialize(coded.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (2.0 * how.leaf)).alias("parts")), "leaf-sizes")
    dealt = coded.join(parts, ["tree", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id", "tree"), F.col("parts")))

    def within(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        ids, rows = frame["id"].to_numpy(), _matrix(frame["vector"])
        one, near, similar = [], [], []
        for a, b in zip(starts[:-1], starts[1:]):
            k = min(how.neighbours, b - a - 1)
            if k < 1:
                continue
            cos = rows[a:b] @ rows[a:b].T
            np.fill_diagonal(cos, -2)
            top = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            one.append(np.repeat(ids[a:b], k))
            near.append(ids[a:b][top].ravel())
            similar.append(np.take_along_axis(cos, top, 1).ravel())
        return _edges(one, near, similar)

    pairs = map_groups(dealt.select("tree", "leaf", "part", "id", "vector"), ["tree", "leaf", "part"], within, "id long, near long, cos double")
    return materialize(_best(pairs, how.neighbours), "graph")


def refine(graph: DataFrame, unit: DataFrame, how: Descent) -> DataFrame:
    """One round: each vector's neighbours, and those whose neighbour it is, are compared with one another; lists keep the best.

    Of the vectors that have a common neighbour, the neighbour's task takes the most similar ones, twice the list's
    length at most; what that leaves out comes by other common neighbours, and the audit tells whether enough did.
    """
    back = graph.select(F.col("near").alias("id"), F.col("id").alias("near"), "cos")
    nearby = _best(graph.union(back), 2 * how.neighbours)
    worst = graph.groupBy("id").agg(F.when(F.count("*") < how.neighbours, -2.0).otherwise(F.min("cos")).alias("worst"))
    known = materialize(unit.join(worst, "id", "left").select(F.col("id").alias("near"), "vector", F.coalesce("worst", F.lit(-2.0)).alias("worst")), "known")
    rows = nearby.select(F.col("id").alias("hub"), "near").join(known, "near")

    def meet(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        ids, rows, floor = frame["near"].to_numpy(), _matrix(frame["vector"]), frame["worst"].to_numpy()
        one, near, similar = [], [], []
        for a, b in zip(starts[:-1], starts[1:]):
            cos = rows[a:b] @ rows[a:b].T
            np.fill_diagonal(cos, -3)
            i, j = np.nonzero(cos > floor[a:b, None])
            one.append(ids[a:b][i])
            near.append(ids[a:b][j])
            similar.append(cos[i, j])
        return _edges(one, near, similar)

    met = map_groups(rows, ["hub"], meet, "id long, near long, cos double")
    return materialize(_best(graph.union(met), how.neighbours), "graph")


def audit(found: DataFrame, unit: DataFrame, how: Descent, most: int | None = None) -> tuple[int, int]:
    """Links of a hashed sample of vectors by ``found(id, found)``, and those that there are: the sample against all rows, by their copies.

    With ``most``, a vector counts with that many at most, as its list can hold no more.
    """
    spark = unit.sparkSession
    sample = hashed_sample(unit, F.col("id"), how.audited, f"audit{how.seed}").toPandas()
    shared = spark.sparkContext.broadcast((sample["id"].to_numpy(), _matrix(sample["vector"])))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, rows = shared.value
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            if len(batch):
                hit = (rows @ _matrix(batch["vector"]).T) >= how.cosine
                total += (hit & (batch["id"].to_numpy() != ids[:, None])) @ batch["copies"].to_numpy()
        yield pd.DataFrame({"id": ids, "there": total})

    there = unit.mapInPandas(count, "id long, there long").groupBy("id").agg(F.sum("there").alias("there"))
    if most is not None:
        there = there.withColumn("there", F.least("there", F.lit(most)))
    both = there.join(found, "id", "left").agg(F.sum(F.least("there", F.coalesce("found", F.lit(0)))), F.sum("there")).first()
    return both[0] or 0, both[1] or 0


def _blocks(full: DataFrame, how: Descent) -> DataFrame:
    """``full`` with ``block``: members of one component, dealt by a hash. Components of a few members share blocks."""
    sizes = full.groupBy("component").agg(F.count("*").alias("n"))
    few = int(np.ceil(max(1, full.count()) / how.block))
    own = F.xxhash64("component", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / float(how.block))))
    block = F.when(F.col("n") >= how.neighbours, own).otherwise(F.pmod(F.xxhash64("component"), F.lit(few)))
    return materialize(full.join(materialize(sizes, "sizes"), "component").withColumn("block", block).drop("n"), "dealt")


def _visits(dealt: DataFrame, rows: DataFrame, how: Descent) -> DataFrame:
    """``rows`` with each ``block`` in which they can have links: no farther from its centre than its radius and the links' angle together.

    By the triangle inequality of angles nothing is lost. Centres go to the tasks in slices of a fixed number.
    """

    def centres(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        m, out = _matrix(frame["vector"]), []
        for a, b in zip(starts[:-1], starts[1:]):
            mean = m[a:b].mean(0)
            length = np.linalg.norm(mean)
            if length < 1e-9:
                out.append((frame["block"].iloc[a], mean.tolist(), -2.0))
                continue
            mean = mean / length
            reach = np.arccos(np.clip((m[a:b] @ mean).min(), -1, 1)) + np.arccos(np.clip(how.cosine, -1, 1)) + 1e-6
            out.append((frame["block"].iloc[a], mean.tolist(), float(np.cos(reach)) if reach < np.pi else -2.0))
        return pd.DataFrame(out, columns=["block", "centre", "least"])

    middle = materialize(map_groups(dealt.select("block", "vector"), ["block"], centres, "block long, centre array<double>, least double"), "centres")
    slices = -(-middle.count() // how.centres)
    out = None
    for k in range(slices):
        held = middle.where(F.pmod(F.xxhash64("block"), F.lit(slices)) == k).toPandas()
        if not len(held):
            continue
        shared = rows.sparkSession.sparkContext.broadcast((held["block"].to_numpy(), _matrix(held["centre"]), held["least"].to_numpy()))

        def visit(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            blocks, centre, least = shared.value
            for batch in batches:
                for at in range(0, len(batch), 512):
                    part = batch.iloc[at : at + 512]
                    i, j = np.nonzero(_matrix(part["vector"]) @ centre.T >= least)
                    for cut in range(0, len(i), 8192):
                        yield part.iloc[i[cut : cut + 8192]].assign(block=blocks[j[cut : cut + 8192]])

        some = materialize(rows.mapInPandas(visit, rows.withColumn("block", F.lit(0).cast("long")).schema), "visits")
        out = some if out is None else out.union(some)
    return out


def _compared_in_blocks(rows: DataFrame, how: Descent) -> DataFrame:
    """``edge, id, other``: of vectors whose list is full, exact, from comparing blocks of them with all rows that can link with them.

    ``rows``: id, copies, component, full, vector. Where ``edge``, a link joins the components ``id`` and ``other``; else
    ``other`` is a number of links of ``id``: all of a full vector, and with full ones of another. Each link with a full
    vector is seen, and only counts and pairs of components leave a task.
    """
    dealt = _blocks(rows.where("full"), how)
    visits = _visits(dealt, rows, how)
    if visits is None:
        return rows.sparkSession.createDataFrame([], "edge boolean, id long, other long")
    parts = materialize(visits.groupBy("block").agg(F.ceil(F.count("*") / (8.0 * how.block)).alias("parts")), "parts")
    columns = ["block", "part", "host", *rows.columns]
    guests = visits.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("host", F.lit(False))
    hosts = dealt.join(parts, "block").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).withColumn("host", F.lit(True))

    def meet(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        m, ids, copies, host, full, component = _matrix(frame["vector"]), *(frame[c].to_numpy() for c in ("id", "copies", "host", "full", "component"))
        out = [pd.DataFrame({"edge": np.zeros(0, bool), "id": np.zeros(0, np.int64), "other": np.zeros(0, np.int64)})]
        for a, b in zip(starts[:-1], starts[1:]):
            left, right = a + np.flatnonzero(host[a:b]), a + np.flatnonzero(~host[a:b])
            if not len(left) or not len(right):
                continue
            hit = (m[left] @ m[right].T >= how.cosine) & (ids[left][:, None] != ids[right])
            out.append(pd.DataFrame({"edge": False, "id": ids[left], "other": hit @ copies[right]}))
            listed = ~full[right]
            out.append(pd.DataFrame({"edge": False, "id": ids[right][listed], "other": hit[:, listed].T @ copies[left]}))
            i, j = np.nonzero(hit & (component[left][:, None] != component[right]))
            pairs = pd.DataFrame({"edge": True, "id": component[left][i], "other": component[right][j]}).drop_duplicates()
            out.append(pairs)
        both = pd.concat(out, ignore_index=True)
        return both[both["edge"] | (both["other"] > 0)]

    return materialize(map_groups(guests.select(columns).union(hosts.select(columns)), ["block", "part"], meet, "edge boolean, id long, other long"), "met")


def _counted(links: DataFrame, full: DataFrame, unit: DataFrame, how: Descent) -> DataFrame:
    """``id, component, links`` of every distinct vector: links with vectors of ``full(id)`` from comparing them with all rows, others from the lists."""
    component = connected_components(links.select(F.col("id").alias("a"), F.col("near").alias("b")), "groups").select(F.col("node").alias("id"), "component")
    rows = unit.join(component, "id", "left").withColumn("component", F.coalesce("component", "id"))
    rows = rows.join(full.withColumn("full", F.lit(True)), "id", "left").withColumn("full", F.coalesce("full", F.lit(False)))
    rows = materialize(rows.select("id", "copies", "component", "full", "vector"), "located")
    met = _compared_in_blocks(rows, how)
    in_blocks = met.where("not edge").groupBy("id").agg(F.sum("other").alias("links"))
    both = links.select("id", "near").union(links.select(F.col("near").alias("id"), F.col("id").alias("near"))).distinct()
    both = both.join(full, "id", "left_anti").join(full.withColumnRenamed("id", "near"), "near", "left_anti")
    listed = both.join(unit.select(F.col("id").alias("near"), "copies"), "near").groupBy("id").agg(F.sum("copies").alias("listed"))
    merged = connected_components(met.where("edge").select(F.col("id").alias("a"), F.col("other").alias("b")), "merged").select(F.col("node").alias("component"), F.col("component").alias("whole"))
    counted = rows.drop("vector").join(merged, "component", "left").join(listed, "id", "left").join(in_blocks, "id", "left")
    total = F.coalesce("links", F.lit(0)) + F.coalesce("listed", F.lit(0))
    return materialize(counted.select("id", "copies", F.coalesce("whole", "component").alias("component"), total.alias("links")), "counted")


def near_duplicates(vectors: DataFrame, how: Descent = Descent()) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vec_id, embedding``.

    Equal vectors collapse into their smallest id. Leaves of random trees give each vector its first neighbours;
    NN-descent rounds compare neighbours of neighbours until no round finds new links and the audit's recall is reached.
    Edges of at least ``cosine`` are the links. Where a list is full of links there may be more: such vectors are compared
    with all rows, block by block, leaving out only those that are too far from a block to link with anything in it. A last
    audit counts all links, however many; where it misses some, every vector is compared so.

    Unusable vectors (null, zero, null or non-finite components, or not of the most common length) link with nothing and
    are their own component. Repeated ids share a component if their vectors do; a null id is returned with null
    component. Ties in similarity go to the smaller id. An empty table gives no rows; other columns are left out.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    good = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    common = good.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    nothing = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    if common is None:
        return nothing
    good = good.where(F.size("embedding") == common["size"])
    key = F.md5(F.concat_ws(",", F.transform("embedding", lambda x: (x + F.lit(0.0)).cast("string"))))
    keyed = materialize(good.select("vec_id", key.alias("key"), "embedding"), "keyed")
    classes = materialize(keyed.groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.max("embedding").alias("embedding")), "distinct")
    largest = F.array_max(F.transform("embedding", F.abs))
    scaled = classes.withColumn("embedding", F.transform("embedding", lambda x: x / largest))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    unit = materialize(scaled.select("id", "copies", F.transform("embedding", lambda x: x / norm).alias("vector")), "unit")
    n = unit.count()

    graph = first_neighbours(unit.select("id", "vector"), n, common["size"], how)
    before = -1
    for k in range(how.most_rounds):
        links = graph.where(F.col("cos") >= how.cosine)
        now = links.count()
        found, there = audit(links.groupBy("id").agg(F.count("*").alias("found")), unit.withColumn("copies", F.lit(1).cast("long")), how, how.neighbours)
        if k >= how.least_rounds and now == before and found >= how.recall * there:
            break
        before = now
        graph = refine(graph, unit.select("id", "vector"), how)
    links = graph.where(F.col("cos") >= how.cosine)

    full = materialize(links.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= how.neighbours).select("id"), "full")
    counted = _counted(links, full, unit, how)
    found, there = audit(counted.select("id", F.col("links").alias("found")), unit, how)
    if found < how.recall * there:
        counted = _counted(links, unit.select("id"), unit, how)
    per_class = counted.select(F.col("id").alias("rep"), "component", (F.col("links") + F.col("copies") - 1).alias("links"))
    named = materialize(classes.select("key", F.col("id").alias("rep")).join(per_class, "rep").select("key", "component", "links"), "named")
    linked = keyed.select("vec_id", "key").join(named, "key").select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    linked = linked.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    lone = nothing.where(F.lit(False)).union(
        rows.where(F.col("vec_id").isNull() | ~usable(F.col("embedding")) | F.coalesce(F.size("embedding") != common["size"], F.lit(True))).select("vec_id", F.lit(0).cast("long"), "vec_id", F.lit(True))
    )
    return linked.union(lone)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = """
with recursive good as (
  select vec_id, cast(embedding as double[]) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id a, b.vec_id b from good a join good b on a.vec_id <> b.vec_id where list_cosine_similarity(a.v, b.v) >= 0.9),
reach as (select vec_id a, vec_id b from embeddings union select r.a, l.b from reach r join links l on r.b = l.a),
lowest as (select a, min(b) component_id from reach group by a),
degree as (select a, count(*) n from links group by a)
select vec_id, coalesce(n, 0) n_links, component_id, vec_id = component_id kept
from embeddings join lowest on vec_id = lowest.a left join degree on vec_id = degree.a
"""
