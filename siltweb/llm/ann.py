"""Approximate nearest neighbours by randomly rotated one-bit codes, with error bounds that choose what is reranked."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import hashed_sample, materialize, table


@dataclass(frozen=True)
class Search:
    k: int = 10
    #: Standard deviations of a code's error within which a vector is still reranked.
    sure: float = 2.75
    #: Vectors, at most, that fit the centre and give each query its first bound. All rows are indexed and scanned.
    sample: int = 2000
    #: Bytes of queries that one scan takes along; more queries take more scans.
    query_bytes: int = 16 << 20
    rows_at_once: int = 4096
    seed: int = 17


def usable(vector: Column) -> Column:
    """Not null, not zero, every component a finite number."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce(F.forall(vector, finite) & F.exists(vector, lambda x: x != 0), F.lit(False))


def rotation(size: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def build_index(vectors: DataFrame, centre: np.ndarray, how: Search) -> DataFrame:
    """``id, vector, code, far, fit``: the packed signs of the rotated, centred vector; its length; and the inner product of code and direction, which corrects estimates."""
    turn = rotation(len(centre), how.seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            moved = (stacked(batch["vector"]) - centre) @ turn.T
            far = np.linalg.norm(moved, axis=1)
            fit = np.abs(moved).sum(1) / np.sqrt(len(centre)) / np.where(far > 0, far, 1)
            codes = np.packbits(moved > 0, axis=1)
            yield pd.DataFrame({"id": batch["id"], "vector": batch["vector"], "code": [c.tobytes() for c in codes], "far": far, "fit": np.where(far > 0, fit, 1.0)})

    return vectors.mapInPandas(run, "id long, vector array<double>, code binary, far double, fit double")


def _nearest(ids: np.ndarray, dist: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best by distance, then id; an id counts once."""
    order = np.lexsort((ids, dist))
    ids, dist = ids[order], dist[order]
    if len(np.unique(ids)) < len(ids):
        first = np.sort(np.unique(ids, return_index=True)[1])
        ids, dist = ids[first], dist[first]
    return ids[:k], dist[:k]


def _distances(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((rows - query) ** 2).sum(1))


def _scan(how: Search, centre: np.ndarray, shared):
    turn = rotation(len(centre), how.seed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, queries, bound = shared.value
        size = len(centre)
        moved = (queries - centre) @ turn.T
        out = np.linalg.norm(moved, axis=1)
        bound = bound.copy()
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(query_ids)
        for batch in batches:
            for at in range(0, len(batch), how.rows_at_once):
                part = batch.iloc[at : at + how.rows_at_once]
                ids, rows = part["id"].to_numpy(), stacked(part["vector"])
                packed = np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1)
                signs = np.unpackbits(packed, axis=1, count=size).astype(np.float32) * 2 - 1
                far, fit = part["far"].to_numpy(), part["fit"].to_numpy()
                slack = how.sure * np.sqrt(np.maximum(0, 1 - fit**2)) / fit / np.sqrt(max(1, size - 1))
                for q in range(0, len(query_ids), 512):
                    z = slice(q, q + 512)
                    estimate = (moved[z].astype(np.float32) @ signs.T) / (np.sqrt(size) * fit)
                    least = far**2 + out[z, None] ** 2 - 2 * far * (estimate + out[z, None] * slack)
                    hits = (least <= bound[z, None] ** 2 * (1 + 1e-9)) & (ids != query_ids[z, None])
                    for i in np.flatnonzero(hits.any(1)):
                        j = np.flatnonzero(hits[i])
                        i += q
                        found, dist = best[i]
                        best[i] = _nearest(np.append(found, ids[j]), np.append(dist, _distances(rows[j], queries[i])), how.k)
                        if len(best[i][0]) == how.k:
                            bound[i] = min(bound[i], best[i][1][-1])
        for query, (found, dist) in zip(query_ids, best):
            if len(found):
                yield pd.DataFrame({"query_id": query, "vec_id": found, "score": dist})

    return run


def search(vectors: DataFrame, is_query: Column, how: Search = Search()) -> DataFrame:
    """``query_id, rank, vec_id, score``: of the rows ``id, vector`` (doubles), those for which ``is_query`` holds look for their nearest others.

    Every row is indexed: its signs after a random rotation about a sampled centre, packed to one bit a component. For
    each query the codes estimate all distances; a row is reranked by its exact vector where the lower bound of its
    distance is within the k-th best distance known so far, which starts from a sample's exact distances. Each task keeps
    k rows of each query, and the best of those are ranked. Queries travel in blocks of bounded size; rows stay in place.

    Unusable vectors, and any whose length isn't the most common one, take no part. An id that repeats counts once, with
    its nearest vector; as a query, with its smallest. Ties go to the smaller id. Fewer than k candidates are all
    returned. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    good = vectors.where(usable(F.col("vector")) & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), is_query.alias("asks"))
    common = good.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], schema)
    size = common["size"]
    good = good.where(F.size("vector") == size)
    sample = hashed_sample(good, F.col("id"), how.sample, f"search{how.seed}").toPandas()
    known_ids, known = sample["id"].to_numpy(), stacked(sample["vector"])
    centre = known.mean(0)
    index = materialize(build_index(good.select("id", "vector"), centre, how), "codes")
    asking = good.where("asks").groupBy("id").agg(F.min("vector").alias("vector"))
    blocks = -(-asking.count() * size * 8 // how.query_bytes)
    found = None
    for block in range(blocks):
        part = asking.where(F.pmod(F.xxhash64("id", F.lit("block")), F.lit(blocks)) == block).toPandas()
        if not len(part):
            continue
        ids, queries = part["id"].to_numpy(), stacked(part["vector"])
        bound = np.full(len(ids), np.inf)
        for i in range(len(ids)):
            near = _nearest(known_ids[known_ids != ids[i]], _distances(known[known_ids != ids[i]], queries[i]), how.k)[1]
            bound[i] = near[-1] if len(near) == how.k else np.inf
        shared = spark.sparkContext.broadcast((ids, queries, bound))
        mine = index.mapInPandas(_scan(how, centre, shared), "query_id long, vec_id long, score double")
        found = mine if found is None else found.union(mine)
    if found is None:
        return spark.createDataFrame([], schema)
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= how.k).select("query_id", "rank", "vec_id", "score")


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search(rows, F.col("id") % 100 == 0)


ORACLE = """
with good as (
  select vec_id, cast(embedding as double[]) v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs as (
  select q.vec_id query_id, c.vec_id vec_id, list_distance(q.v, c.v) score
  from good q join good c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, cast(row_number() over (partition by query_id order by score, vec_id) as integer) rank, vec_id, score
from pairs qualify rank <= 10
"""
