"""Links and components of embeddings against all pairs."""

import numpy as np

from siltweb.llm import embed_dedup as E


def brute(rows, least=0.9):
    ids = [i for i, _ in rows]
    m = np.array([v for _, v in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    hit = m @ m.T >= least
    np.fill_diagonal(hit, False)
    part = np.array(ids)
    while True:
        new = np.array([min([part[k], *part[hit[k]]]) for k in range(len(ids))])
        if (new == part).all():
            return sorted((i, int(h.sum()), int(p), bool(i == p)) for i, h, p in zip(ids, hit, part))
        part = new


def test_groups_of_all_sizes_and_odd_rows(spark):
    rng = np.random.default_rng(9)
    rows, n = [], 0
    for size in (1,) * 150 + (2,) * 20 + (3, 7, 40, 150):
        base = rng.normal(size=24)
        for _ in range(size):
            rows.append((n, (base + rng.normal(size=24) * 0.1).tolist()))
            n += 1
    rows += [(n + k, rows[-1][1]) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows)
    odd = [(9001, None), (9002, [0.0] * 24), (9003, [float("inf")] * 24), (9004, [1.0] * 5), (9005, [None] * 24)]
    both = spark.createDataFrame([(i, v, "c") for i, v in rows + odd], "vec_id long, embedding array<double>, component string").repartition(4)
    got = sorted(tuple(r) for r in E.near_duplicates(both, E.Descent(block=32)).collect())
    assert got == want + [(i, 0, i, True) for i, _ in odd]
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_links_between_full_lists_of_different_groups(spark):
    rng = np.random.default_rng(4)
    axis, side = np.eye(40)[0], np.eye(40)[1]
    rows = []
    for k in range(80):
        turn = 0.18 if k % 2 else -0.18
        rows.append((k, (axis + turn * side + rng.normal(size=40) * 0.004).tolist()))
    rows += [(100 + k, rng.normal(size=40).tolist()) for k in range(60)]
    want = brute(rows)
    assert [w[1:3] for w in want[:80]] == [(79, 0)] * 80
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    assert sorted(tuple(r) for r in E.near_duplicates(df, E.Descent(block=16, centres=3)).collect()) == want


def test_missed_links_are_found_by_the_audit(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(40, 24))
    rows = [(3 * i + k, (base[i] + rng.normal(size=24) * 0.05).tolist()) for i in range(40) for k in range(3)]
    monkeypatch.setattr(E, "refine", lambda graph, unit, how: graph.limit(0))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in E.near_duplicates(df).collect()) == brute(rows)
