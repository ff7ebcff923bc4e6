"""Packing: ids as the tokenizer gives them, no gap, no overlap, few sequences."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltweb.llm import packing as P

HOW = P.Packing()
TOKENIZER = Tokenizer.from_file(public_tokenizers.path(HOW.tokenizer))


def check(rows, docs, capacity):
    """Every id once, in order; every sequence gapless."""
    seen, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        seen[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text in docs:
        ids = np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, HOW.end_id], "<u4")
        parts = sorted(seen.pop(doc_id), key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert [r["length"] for r in parts[:-1]] == [capacity] * (len(parts) - 1)
        at = 0
        for r in parts:
            assert r["start"] == at and 0 < r["length"] <= capacity
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not seen
    for places in bins.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(5)
    rows = P.pack(docs).collect()
    bins = check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], HOW.capacity)
    assert bins <= 1.03 * -(-sum(r["length"] for r in rows) // HOW.capacity)


def test_tree_of_rounds(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").repartition(8)
    rows = P.pack(docs, P.Packing(capacity=512, bins_per_task=4)).collect()
    check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 512)


def test_odd_rows(spark):
    rows = [(1, None, "q"), (2, "", "q"), (3, "hello " * 9000, "q"), (4, "<|endoftext|> IT'S x\x1cy İSTANBUL ΣΑΣ é é", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bin string")
    out = P.pack(docs).collect()
    check(out, [r[:2] for r in rows], HOW.capacity)
    assert P.pack(docs.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_words_encode_as_texts(text):
    assert np.frombuffer(ENCODER.encode(text), "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_best_fit_is_valid(sizes):
    fills = defaultdict(list)
    for (b, offset), size in zip(P.best_fit(sizes, 64), sizes):
        fills[b].append((offset, size))
    for places in fills.values():
        end = 0
        for offset, size in sorted(places):
            assert offset == end
            end += size
        assert end <= 64
    assert len(fills) <= max(1, 2 * -(-sum(sizes) // 64))


ENCODER = P.WordEncoder(HOW.tokenizer, 1000)
