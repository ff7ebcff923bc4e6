"""Base spans against the plain patterns, propagation against enumeration, odd rows."""

import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siltweb.llm import pii as P


def plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        double = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(d))]
        if 14 <= len(d) <= 19 and sum(x - 9 * (x > 9) for x in double) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


PIECES = st.sampled_from(["a", "b.c", "@", ".", "-", "+", " ", "\n", "(", ")", "1", "12", "255", "256", "4111111111111111", "4929 3483 8514 6306", "x@y.z", "%", "é", "10.0.0.1", "+1 (599) 555-3756"])


@settings(max_examples=400, deadline=None)
@given(st.lists(PIECES, max_size=25).map("".join))
def test_base_spans(text):
    assert P.base_spans(text) == plain(text)


def test_whole_table(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = P.op7_pii(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r["doc_id"]])
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == kind for _, k, _ in base) for kind in range(4)]
        assert set(P.shown(base).split(",")) <= set(r["spans"].split(",")) or not base
    assert any(r["n_email"] for r in rows)


def test_propagation_is_exact_on_trees():
    rng = np.random.default_rng(1)
    y = len(P.LABELS)
    field = P.Field(rng.normal(size=(16, y)), rng.normal(size=(y, y)), rng.normal(size=(y, y)))
    g = P.Graph([0] * 4, [0] * 4, [1] * 4, [[1, 2], [3], [4, 5, 6], [7]], [(0, 1), (1, 2)], [(1, 3)])
    post, on_chain, on_skip, _ = P.propagate(field, g, 20, 0.0)
    want, chain = np.zeros((4, y)), np.zeros((y, y))
    for labels in itertools.product(range(y), repeat=4):
        s = sum(field.emit[f, v].sum() for f, v in zip(g.features, labels))
        s += sum(field.chain[labels[a], labels[b]] for a, b in g.chain) + sum(field.skip[labels[a], labels[b]] for a, b in g.skip)
        p = np.exp(s)
        for k, v in enumerate(labels):
            want[k, v] += p
        chain[labels[0], labels[1]] += p
    assert np.allclose(post, want / want.sum(1, keepdims=True), atol=1e-6)
    assert np.allclose(on_chain[0], chain / chain.sum(), atol=1e-6) and on_skip.shape == (1, y, y)


def test_distant_mentions_pull_a_token_along():
    y = len(P.LABELS)
    emit = np.zeros((1 << 12, y))
    field = P.Field(emit, np.zeros((y, y)), np.eye(y) * 6)
    text = "Ask +49-30-1234567-88 first. Then 49-30-1234567-88 again."
    base, spans = P.find(field, [text])[0]
    assert P.shown(base) == "phone:4:21" and P.shown(spans) == "phone:4:21,phone:34:50"


def test_evidence_reaches_dozens_of_distant_repeats():
    y = len(P.LABELS)
    field = P.Field(np.zeros((1 << 12, y)), np.zeros((y, y)), np.eye(y) * 9)
    text = "Ask +49-30-1234567-88 first. " + "Then it is 49-30-1234567-88 again. " * 60
    base, spans = P.find(field, [text, "See 12 here and 12 there."])[0]
    assert len(base) == 1 and len(spans) == 61 and all(kind == 3 for _, kind, _ in spans)


def test_chain_edges_join_all_neighbouring_candidates():
    g = P.build_graph([" ".join(str(k) for k in range(30)) + " word 7"], 12)
    assert g.chain == [(k, k + 1) for k in range(29)]


def test_odd_rows(spark):
    rows = [(1, None, "q"), (2, "", "q"), (3, "mail a@b.cd " * 3, "q"), (None, "1" * 50_000 + "@" * 1000, "q"), (5, "x" * 100_000 + " a@b.cd", None), (5, "x" * 100_000 + " a@b.cd", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    field = P.train(docs)
    got = {r["doc_id"]: r for r in P.detect(docs, field).collect()}
    assert got[1]["spans"] == got[2]["spans"] == "" and got[3]["n_email"] == 3 and got[5]["spans"] == "email:100001:100007"
    clean = {r["doc_id"]: r["text"] for r in P.redact(docs, field).collect()}
    assert clean[1] is None and clean[3] == "mail [EMAIL] " * 3
    assert P.detect(docs.limit(0), field).count() == 0


def test_field_finds_secrets_that_no_pattern_names(spark):
    import random

    rng = random.Random(8)
    hexed = lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40))
    fill = lambda n: " ".join(rng.choice(("the", "of", "reading", "plain", "words", "in", "2019")) for _ in range(n))
    train = [f'{fill(12)} token = "{hexed()}" {fill(9)}' if k % 2 else fill(25) for k in range(600)]
    field = P.fit(train, P.Settings())
    unseen, repeated = hexed(), hexed()
    texts = [f"{fill(8)} {unseen} {fill(8)}", f'{fill(3)} token = "{repeated}" {fill(200)} {repeated}, {fill(4)}', fill(60)]
    found = [[(k, text[a:b]) for a, k, b in spans] for text, (_, spans) in zip(texts, P.find(field, texts))]
    assert found == [[(4, unseen)], [(4, repeated), (4, repeated)], []]
