"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, shared_dir, table

__all__ = ["connected_components", "fresh_path", "hashed_sample", "map_groups", "materialize", "shared_dir", "table"]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def hashed_sample(df: DataFrame, key: Column, n: int, salt: str) -> DataFrame:
    """The ``n`` rows whose keys have the smallest hashes, ties by key.

    A first filter on the hash leaves about twice as many, so that tasks don't each send ``n`` rows to be sorted.
    """
    draw = F.crc32(F.concat(F.lit(salt + ":"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")) / float(1 << 32)
    share = min(1.0, (2.0 * n + 100) / max(1, df.count()))
    return df.where(draw < share).orderBy(draw, key).limit(n)


def map_groups(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    """Apply ``fn(frame, starts)`` to batches of whole groups; ``starts`` are the rows at which groups begin, and the end.

    For many small groups: it deals rows by key and sorts them, so a batch holds thousands of groups, where
    ``applyInPandas`` would build a frame for each. A group is held whole, so callers bound its size.
    """

    def run(batches):
        import numpy as np
        import pandas as pd

        def bounds(frame):
            change = np.zeros(len(frame), bool)
            change[0] = True
            for k in keys:
                v = frame[k].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            return np.flatnonzero(change)

        held = None
        for batch in batches:
            if not len(batch):
                continue
            frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
            starts = bounds(frame)
            last = starts[-1]
            held = frame.iloc[last:].reset_index(drop=True)
            if last:
                yield fn(frame.iloc[:last], starts)
        if held is not None:
            yield fn(held, np.array([0, len(held)]))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def _joined(a, b):
    """Distinct ids of an edge list and the smallest that each reaches by it."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low, new = np.minimum(label[x], label[y]), label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60, edges_per_task: int = 200_000) -> DataFrame:
    """Smallest reachable id of every node in ``edges(a, b)``: columns ``node, component``.

    Tasks first replace their edges by one from each node to the smallest that it reaches by them. Rounds over what is
    left alternate neighbour-minimum with pointer jumping, so long chains take a logarithmic number of them. Every step is
    a pre-aggregated minimum; no node's neighbours are gathered. Rounds go on until nothing changes.
    """
    schema = "node long, component long"

    def contract(batches):
        import numpy as np
        import pandas as pd

        held, a, b = [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= edges_per_task:
                a, b = _joined(np.concatenate([a, *(x["a"] for x in held)]), np.concatenate([b, *(x["b"] for x in held)]))
                held = []
        nodes, low = _joined(np.concatenate([a, *(x["a"] for x in held)]), np.concatenate([b, *(x["b"] for x in held)]))
        yield pd.DataFrame({"node": nodes, "component": low})

    edges = materialize(edges.select("a", "b").where("a is not null and b is not null and a <> b"), f"{name}-edges")
    tasks = max(1, -(-edges.count() // edges_per_task))
    local = materialize(edges.coalesce(tasks).mapInPandas(contract, schema), f"{name}-local")
    if tasks == 1:
        return local
    edges = local.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
    both = materialize(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    label = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), f"{name}-0")
    for k in range(max_rounds):
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("component").alias("low"))
        hop = label.join(near, label.node == near.a, "left").select("node", F.col("component").alias("old"), F.least("component", "low").alias("component"))
        up = label.select(F.col("node").alias("up"), F.col("component").alias("above"))
        jumped = hop.join(up, hop.component == up.up, "left").select("node", "old", F.least("component", F.coalesce("above", "component")).alias("component"))
        jumped = materialize(jumped, f"{name}-{k + 1}")
        moved = jumped.where("component <> old").limit(1).count()
        label = jumped.select("node", "component")
        if not moved:
            return label
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
