"""Language identification: held-out accuracy, exact marginals, odd rows."""

import itertools

import numpy as np

from siltweb.llm import language as L


def test_held_out_accuracy(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    out = L.op9_language_id(spark, small).collect()
    assert len(out) == len(truth)
    held = [r for r in out if r["held_out"]]
    assert held and sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in out)


def test_posteriors_match_enumeration():
    rng = np.random.default_rng(2)
    move, lengths = rng.uniform(0.1, 2, (3, 3)), np.array([4, 1, 3])
    score = rng.uniform(0.1, 2, (lengths.sum(), 3))
    got, moves = L.forward_backward(score, lengths, move)
    assert np.allclose(got, L.posteriors(score, lengths, move))
    at, both = 0, np.zeros((3, 3))
    for n in lengths:
        want, total, pairs = np.zeros((n, 3)), 0.0, np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.prod([score[at + t, y] for t, y in enumerate(path)]) * np.prod([move[a, b] for a, b in zip(path, path[1:])])
            total += p
            for t, y in enumerate(path):
                want[t, y] += p
            for a, b in zip(path, path[1:]):
                pairs[a, b] += p
        assert np.allclose(got[at : at + n], want / total)
        both += pairs / total
        at += n
    assert np.allclose(moves, both)


def test_switching_text_and_odd_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    field = L.train(docs)
    rows = [(1, None, "a"), (2, "123 !!", "a"), (3, "", "a"), (None, "Der die und ist nicht das.", "a"), (5, "the and of " * 30000, None)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.identify(odd, field).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[None][0] == "de" and got[5][0] == "en"
    assert L.identify(odd.limit(0), field).count() == 0
    assert {r["lang_pred"] for r in L.identify(odd, L.fit([], [], L.Training())).collect()} == {"und"}
    words = ("the and of was for with that this " * 4 + "der die und ist nicht das von mit " * 4).split()
    post = L.posteriors(np.exp(field.emissions(words)), np.array([len(words)]), np.exp(field.move))
    names = [field.labels[k] for k in post.argmax(1)]
    assert names[:28] == ["en"] * 28 and names[-28:] == ["de"] * 28
