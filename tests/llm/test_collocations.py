"""Phrases against counting all of them, with few slots and many shards, and odd rows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltweb.llm import collocations as C


def pieces(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def plain(rows, how):
    out = []
    for lang in {r[1] or "und" for r in rows}:
        f, n = Counter(), 0
        for p in (p for r in rows if (r[1] or "und") == lang for p in pieces(r[0])):
            n += len(p)
            f.update(tuple(p[i : i + k]) for k in range(1, how.longest + 1) for i in range(len(p) - k + 1))
        found = []
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= how.least}
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= how.covered * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[: how.top])]
    return sorted(out)


def corpus():
    draw = random.Random(5)
    common = ["alpha beta gamma delta", "New York", "new york city", "a a a a a", "x\u00a0y ß", "of the"]
    rows = []
    for k in range(240):
        words = [draw.choice([*common, *"bcdefgh", "Wort", "k!", "m;n"]) for _ in range(draw.randint(1, 40))]
        rows.append((draw.choice([" ", "\t", "  ", " "]).join(words), draw.choice(["en", "de", None, "und"]), k))
    return rows + [(None, "en", 1), ("", "en", 1), (".,;\n", "fr", 1), ("lone", "es", 1)] + [("same same words here", "en", 2)] * 30


@pytest.mark.parametrize("how", [C.Settings(least=6, shards=2, bits=20), C.Settings(least=9, shards=5, bits=20, words_at_once=200), C.Settings(least=8, shards=3, bits=16, top=5)])
def test_against_counting(spark, how):
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string, rank long").repartition(4)
    got = sorted(tuple(r) for r in C.collocations(docs, how).collect())
    assert got == plain(rows, how) and got


def test_crowded_slots(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string, rank long").repartition(3)
    how = C.Settings(least=6, shards=3, bits=6)  # nearly every slot is reached by something
    assert sorted(tuple(r) for r in C.collocations(docs, how).collect()) == plain(rows, how)


def test_longer_phrases_start_late_and_run_one_cycle(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string, rank long").repartition(4)
    counted = []
    step = C.count_step

    def seen(shard, slots, at, how):
        out = step(shard, slots, at, how)
        counted.append({(r["k"], r["start"]) for r in out.collect()})
        return out

    C.count_step = seen
    try:
        C.frequent_phrases(docs.select("text", "lang"), C.Settings(least=6, shards=3, bits=20))
    finally:
        C.count_step = step
    assert counted[0] == {(0, 0), (1, 0)}
    assert all(start <= at < start + 3 for at, found in enumerate(counted) for _, start in found)
    assert {1, 2} <= {k for k, _ in counted[1]}  # words and pairs are counted in one scan
    assert max(k for found in counted for k, _ in found) == 4


def test_no_words(spark):
    docs = spark.createDataFrame([(None, None), ("", "en"), (".", "en")], "text string, lang string")
    assert C.collocations(docs).collect() == [] == C.collocations(docs.limit(0)).collect()


def test_texts_are_split_and_numbered_once(spark, monkeypatch):
    import numpy as np

    how, texts = C.Settings(least=3, shards=2, bits=16, words_at_once=7), ["A b. a c", "", ".", "b\tb;C d e f g h", "a"] * 4
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").coalesce(1)
    got = []
    for r in C.encode(docs, how).collect():
        names = bytes(r["names"]).split(b" ")
        got += [names[k] for k in np.frombuffer(r["ids"], np.int32)]
    assert sorted(got) == sorted(w for t in texts for w in [*C.split_words(t), b"."])
    step, given = C.count_step, []
    monkeypatch.setattr(C, "count_step", lambda shard, *rest: given.append(shard.columns) or step(shard, *rest))
    C.frequent_phrases(docs, how)
    assert given and all(columns == ["lang", "names", "ids"] for columns in given)


def test_scans_shuffle_numbers_and_words_are_spelled_once(spark, monkeypatch):
    how = C.Settings(least=6, shards=3, bits=20)
    # occurrences by shard: a phrase just frequent, one that might have been by its shares, one that can't be
    shares = {"p q": (4, 1, 1), "t u": (3, 2, 0), "r s": (2, 1, 1)}
    texts = [".".join(phrase for phrase, n in shares.items() for _ in range(n[shard])) for shard in range(3)]
    docs = spark.createDataFrame([("en", t) for t in texts], "lang string, text string").coalesce(1)
    step, spell, scans, spelled = C.count_step, C.spell, [], []
    monkeypatch.setattr(C, "count_step", lambda *a: scans.append(step(*a)) or scans[-1])
    monkeypatch.setattr(C, "spell", lambda *a: spelled.append(a[0].columns) or spell(*a))
    got = {(r["k"], r["phrase"], r["f"]) for r in C.frequent_phrases(docs, how).collect()}
    assert got == {(0, "", 30), (1, "p", 6), (1, "q", 6), (2, "p q", 6)}
    assert scans and all(t in ("int", "bigint") for df in scans for _, t in df.dtypes) and len(spelled) == 1


def test_last_scan_goes_by_turns_of_bounded_sums(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string, rank long").repartition(4)
    how = C.Settings(least=6, shards=3, bits=20, words_at_once=300, sums_at_once=60)
    spell, turns, sums = C.spell, [], []

    def seen(whole, *rest):
        out = spell(whole, *rest)
        turns.append({(r["lang"], r["phrase"]) for r in out.collect()})
        sums.append(max(Counter(p for p, *_ in out.select(F.spark_partition_id(), "lang", "phrase").distinct().collect()).values(), default=0))
        return out

    monkeypatch.setattr(C, "spell", seen)
    assert sorted(tuple(r) for r in C.collocations(docs, how).collect()) == plain(rows, how)
    every = set().union(*turns)
    assert len(turns) > 2 and sum(map(len, turns)) == len(every) and {("en", ""), ("de", "")} <= turns[0]
    assert max(sums) < len(every) / 2


def test_scans_read_files_in_few_tasks(spark, monkeypatch):
    docs = spark.createDataFrame([("en", f"w{k} a b c") for k in range(400)], "lang string, text string").repartition(40)
    step, spell, parts = C.count_step, C.spell, []
    monkeypatch.setattr(C, "count_step", lambda shard, *rest: parts.append(shard.rdd.getNumPartitions()) or step(shard, *rest))
    monkeypatch.setattr(C, "spell", lambda whole, *rest: parts.append(whole.rdd.getNumPartitions()) or spell(whole, *rest))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        assert {r["phrase"]: r["f"] for r in C.frequent_phrases(docs).collect() if r["k"] == 3} == {"a b c": 400}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert parts and max(parts) <= spark.sparkContext.defaultParallelism


def test_tasks_hold_little_beside_what_they_count():
    import tracemalloc
    import zlib
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    draw = np.random.default_rng(3)
    names = b" ".join([b".", *(b"word%d" % i for i in range(3000))])
    ids = [draw.integers(0, 3001, 50_000).astype(np.int32) for _ in range(4)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 4, "names": pa.array([names] * 4, pa.binary()), "ids": pa.array([i.tobytes() for i in ids], pa.binary())})
    frame = SimpleNamespace(mapInArrow=lambda run, schema: run)
    slots = SimpleNamespace(value=zlib.compress(np.ones(1 << 16, np.uint8).tobytes()))
    # occurrences of each length within pieces
    on, places = np.concatenate(ids) > 0, {}
    for k in range(2, 5):
        places[k] = int(np.logical_and.reduce([on[j : len(on) - k + 1 + j] for j in range(k)]).sum())
    for step in (lambda how: C.count_step(frame, slots, 3, how), lambda how: C.spell(frame, slots, how)):
        how, sums, most = C.Settings(bits=16, batch_rows=10_000), Counter(), 0
        tracemalloc.start()
        for b in step(how)(iter([batch])):
            most = max(most, len(b))
            for k, c in zip(b.column("k").to_pylist(), b.column("c").to_pylist()):
                sums[k] += c
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert {k: sums[k] for k in places} == places
        assert most <= how.batch_rows and peak / len(on) < 120  # bytes a word


def test_python_gets_batches_of_bounded_bytes(spark, monkeypatch):
    import pyarrow as pa

    rows = corpus()
    docs = spark.createDataFrame(rows, "text string, lang string, rank long").coalesce(1)
    how = C.Settings(least=6, shards=3, bits=20, words_at_once=300, batch_bytes=3000)
    before, spell, sizes = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"), C.spell, []

    def seen(whole, *rest):
        sizes.extend(r["n"] for r in whole.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").collect())
        return spell(whole, *rest)

    monkeypatch.setattr(C, "spell", seen)
    assert sorted(tuple(r) for r in C.collocations(docs, how).collect()) == plain(rows, how)
    assert len(sizes) > 8 and max(sizes) < 6000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
