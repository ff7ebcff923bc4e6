"""Repeated passages against counting every window."""

import hashlib
import re
from collections import Counter

from siltweb.llm import substring_dedup as S


def brute(rows, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for (doc_id, _), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i : i + width])] > 1:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()), key=repr)


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute(rows, 35)
    assert result(S.remove_repeats(docs)) == want
    assert sum(r[2] for r in want) > 0


def test_shuffled_names_and_short_windows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(S.remove_repeats(docs, S.Repeats(window=12, anchor=3, broadcast_ids=0))) == brute(rows, 12)


def test_odd_rows(spark):
    a = [f"a{k}" for k in range(80)]
    rows = [
        (1, " ".join(a[:50])),
        (2, "x y " + "\t".join(a[10:60]) + "\nz"),
        (3, "q " * 200),
        (4, None),
        (5, ""),
        (None, " ".join(a[20:54])),
        (7, "u v"),
        (8, " ".join(a[:36] + ["!"] + a[30:66])),
        (8, " ".join(a[:36] + ["!"] + a[30:66])),
    ]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, print int")
    assert result(S.remove_repeats(docs)) == brute(rows, 35)
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_matching_statistics_against_counting():
    import random

    rng = random.Random(4)
    for _ in range(60):
        texts = [[b"abc"[k : k + 1] for k in (rng.randrange(3) for _ in range(rng.randrange(1, 30)))] for _ in range(rng.randrange(1, 5))]
        times = [rng.choice((1, 1, 2)) for _ in texts]
        seen = Counter()
        for words, n in zip(texts, times):
            for i in range(len(words)):
                for j in range(i + 1, len(words) + 1):
                    seen[tuple(words[i:j])] += n
        automaton = S.Automaton(texts, times)
        for words in texts:
            want = [max((n for n in range(1, e + 1) if seen[tuple(words[e - n : e])] > 1), default=0) for e in range(1, len(words) + 1)]
            assert list(automaton.matches(words)) == want


def test_anchors_with_more_passages_than_an_automaton_takes(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert result(S.remove_repeats(docs, S.Repeats(window=12, anchor=3, passages=4))) == brute(rows, 12)
