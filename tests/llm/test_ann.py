"""Nearest neighbours against brute force, bounds and odd rows."""

import numpy as np
from pyspark.sql import functions as F

from siltweb.llm import ann as A


def brute(rows, asks, k=10):
    good = {i: np.array(v, float) for i, v in rows}
    out = []
    for q in sorted(i for i in good if asks(i)):
        near = sorted((float(np.sqrt(((v - good[q]) ** 2).sum())), i) for i, v in good.items() if i != q)[:k]
        out += [(q, r, i, d) for r, (d, i) in enumerate(near, 1)]
    return out


def test_whole_table(spark, small):
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = sorted(tuple(r) for r in A.op6_nearest(spark, small).collect())
    want = brute(rows, lambda i: i % 100 == 0)
    hits = {(g[0], g[2]) for g in got} & {(w[0], w[2]) for w in want}
    assert len(got) == len(want) and len(hits) >= 0.98 * len(want)
    exact = {(w[0], w[2]): w[3] for w in brute(rows, lambda i: i % 100 == 0, 10**9)}
    assert all(abs(exact[g[0], g[2]] - g[3]) < 1e-12 for g in got)


def test_copies_clusters_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=16)
    rows = [(i, (base if i < 40 else base + rng.normal(size=16) * (0.01 if i < 80 else 3)).tolist()) for i in range(200)]
    odd = [(300, None), (400, [0.0] * 16), (500, [float("nan")] + [1.0] * 15), (600, [1.0] * 3), (700, [None] + [1.0] * 15), (None, [1.0] * 16), (100, rows[100][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows + odd], "id long, vector array<double>, code int").repartition(6)
    got = sorted(tuple(r) for r in A.search(df, F.col("id") % 20 == 0, A.Search(query_bytes=400)).collect())
    want = brute(rows, lambda i: i % 20 == 0)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    few = A.search(df.where("id < 3"), F.col("id") == 0).collect()
    assert [(r["rank"], r["vec_id"]) for r in sorted(few, key=lambda r: r["rank"])] == [(1, 1), (2, 2)]
    assert A.search(df.limit(0), F.lit(True)).count() == 0 and A.search(df.where("id = 400"), F.lit(True)).count() == 0
