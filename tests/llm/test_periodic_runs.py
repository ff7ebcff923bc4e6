"""Runs against their definition, words one by one and all at once, planted periods, odd rows."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltweb.llm import periodic_runs as P


def plain(words, exponent=4, shortest=6):
    """Every stretch of each period that can't be made longer, without those that have a smaller period."""
    n, out = len(words), []
    for p in range(1, n // 2 + 1):
        at = 0
        while at + p < n:
            end = at
            while end + p < n and words[end] == words[end + p]:
                end += 1
            length = end - at + p
            if end > at and length >= max(shortest, exponent * p) and not any(p % q == 0 and all(words[k] == words[k + q] for k in range(at, end + p - q)) for q in range(1, p)):
                out.append((at, length, p))
            at = end + 1
    return sorted(out)


PERIODIC = st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=9), st.integers(1, 8)), max_size=6).map(lambda parts: [x for word, times in parts for x in word * times])


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.lists(st.integers(0, 1), max_size=80), PERIODIC), st.integers(1, 40), st.sampled_from([(4, 6), (2, 2), (3, 4)]))
def test_runs(words, step, least):
    a, want = np.array(words, np.int64), plain(words, *least)
    assert P.runs_of(a, *least) == want
    assert P.runs_of(a, *least, step=step) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(PERIODIC, max_size=6), st.integers(1, 200))
def test_many_sequences_in_one_stream(seqs, most):
    assert list(P.runs_of_many([np.array(s, np.int64) for s in seqs], most=most)) == [plain(s) for s in seqs]


def test_told_once_it_has_ended():
    c = P.Catchers()
    told = [(k, run) for k in range(40) for run in c.append(np.array([k % 2 if k < 20 else 100 + k]))]
    assert [run for _, run in told] == [(0, 20, 2)] and 20 <= told[0][0] < 30
    assert c.finish() == []


@pytest.mark.parametrize("words", [np.zeros(60_000, np.int64), np.arange(60_000) % 7, np.arange(60_000) % 15_000, np.arange(300_000) % 1000])
def test_long_texts(words):
    assert P.runs_of(words) == [(0, len(words), len(np.unique(words)))]


def answer(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {k for s, m, p in runs for k in range(s + p, s + m)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *((*best, best[1] * 1000 // best[2]) if best else (None,) * 4), sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_small_table(spark, small):
    docs = [r for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    short = [r for r in docs if len(r["text"] or "") < 6000]
    rows = {r["doc_id"]: tuple(r) for r in P.op13_periodic_runs(spark, small).collect()}
    assert len(rows) == len(docs)
    for r in short:
        assert rows[r["doc_id"]] == answer(r["doc_id"], r["text"])
    assert any(r[1] for r in rows.values())


def test_odd_rows(spark):
    rows = [(1, "", "x"), (1, "", "x"), (2, None, "x"), (None, "a " * 9, None), (3, "a\u00a0b " * 5 + "\v\f" + "x y " * 4 + "x", "x"), (4, "  \t\n", "x"), (5, "one", "x"), (6, "ab " * 40_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    got = sorted((tuple(r) for r in P.find_runs(docs).collect()), key=str)
    empty = hashlib.sha256(b"").hexdigest()
    assert [r for r in got if r[0] in (1, 2, 4)] == [(k, 0, None, None, None, None, empty, empty) for k in (1, 1, 2, 4)]
    assert [r[:6] for r in got if r[0] is None] == [(None, 1, 0, 9, 1, 9000)]
    assert [r[:6] for r in got if r[0] == 3] == [(3, 1, 5, 9, 2, 4500)]
    assert [r[:6] for r in got if r[0] == 6] == [(6, 1, 0, 40_000, 1, 40_000_000)]
    assert P.find_runs(docs.limit(0)).collect() == []
