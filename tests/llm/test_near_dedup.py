"""Near-duplicate classes against comparing all pairs."""

import hashlib

import numpy as np

from siltweb.llm import near_dedup as N


def brute(rows, how=N.NearDup()):
    known = N._Hashes()
    words = [N.word_hashes(t, known) if t else np.zeros(0, np.uint64) for _, t in rows]
    df, n = np.zeros(1 << how.df_bits), sum(t is not None for _, t in rows)
    for w in words:
        df[np.unique(w >> np.uint64(64 - how.df_bits))] += 1
    idf = 1.0 + np.log((1.0 + n) / (1.0 + df))
    sets = [N.shingles(w, how.words, idf, how.df_bits) for w in words]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(words[i]) and len(words[j]) and N.weighted_jaccard(sets[i], sets[j]) >= how.similarity:
                a, b = sorted((root(i), root(j)), key=lambda k: rows[k][0])
                parent[b] = a
    return {rows[i][0]: rows[root(i)][0] for i in range(len(rows))}


def test_classes_match_all_pairs(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").orderBy("doc_id").collect()]
    want = brute(rows)
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(docs).collect()}
    assert got == want
    assert len(set(want.values())) < len(want)


def test_odd_rows(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(1, long, "x"), (2, long, "y"), (3, None, None), (4, "", "x"), (5, " \n", "x"), (6, "a b", "x"), (7, "a b", None), (8, long + " more", "x"), (8, long + " more", "x"), (9, "c", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = sorted((r["doc_id"], r["class_id"], r["kept"]) for r in N.near_duplicates(docs).collect())
    assert got == [(1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True), (5, 5, True), (6, 6, True), (7, 6, False), (8, 1, False), (8, 1, False), (9, 9, True)]
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_samples_agree_as_often_as_sets_are_similar():
    rng, sampler = np.random.default_rng(5), N.WeightedSampler(400, 3)
    for share in (0.1, 0.3):
        keys, weights = np.sort(rng.integers(0, 1 << 63, 500, dtype=np.uint64)), rng.uniform(1, 9, 500)
        other = keys.copy()
        other[: int(500 * share)] ^= np.uint64(1 << 40)
        a, b = (keys, weights), (np.sort(other), weights[np.argsort(other)])
        agree = (sampler.sample(*a) == sampler.sample(*b)).mean()
        assert abs(agree - N.weighted_jaccard(a, b)) < 0.1


def signed(texts, sketches, keys):
    """Rows as ``signatures`` gives them, for texts whose buckets and samples are set by hand."""
    rows = [(r, hashlib.md5(t.encode()).hexdigest(), [int(k) for k in keys[r]], np.asarray(sketches[r], np.uint32).tobytes(), 1.0, 1.0) for r, t in texts.items()]
    return lambda docs, idf, how: docs.sparkSession.createDataFrame(rows, "doc_id long, text_key string, bands array<long>, sketch binary, total double, words double")


def drifting(n, step, size, tag):
    """Texts of which each differs from the last in some more words."""
    words, out = [f"{tag}{k}" for k in range(size)], []
    for k in range(n):
        out.append(" ".join(words))
        words = words[:]
        for x in range(step):
            words[(k * step + x) % size] = f"{tag}new{k}x{x}"
    return out


def test_pair_that_shares_one_crowded_bucket(spark, monkeypatch):
    # unlike texts crowd a bucket that the two copies share, and no other
    texts = {k: " ".join(f"u{k}x{j}" for j in range(60)) for k in range(1, 41)}
    texts[20], texts[33] = " ".join(f"same{j}" for j in range(300)), " ".join(f"same{j}" for j in range(300)) + " more"
    sketches = {r: np.arange(48) + 1000 * r for r in texts}
    sketches[33] = sketches[20].copy()
    keys = {r: [7, *(1000 * r + k for k in range(11))] for r in texts}
    for r in (1, 2):  # hubs that aren't the copies
        keys[r] = [7, 8, *(1000 * r + k for k in range(10))]
    monkeypatch.setattr(N, "signatures", signed(texts, sketches, keys))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(docs, N.NearDup(block=4)).collect()}
    assert got == {r: 20 if r == 33 else r for r in texts}


def test_chain_whose_buckets_all_hold_the_same_hub(spark, monkeypatch):
    chain = drifting(14, 6, 300, "c")
    texts = dict(enumerate(chain, 1))
    sketches = {r: np.concatenate([np.full(40, 9), np.arange(8) + 100 * r]) for r in texts}
    keys = {r: [7, 8, *(1000 * r + k for k in range(10))] for r in texts}
    monkeypatch.setattr(N, "signatures", signed(texts, sketches, keys))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = brute(list(texts.items()))
    assert set(want.values()) == {1}
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(docs, N.NearDup(block=4)).collect()}
    assert got == want


def test_crowded_table_matches_all_pairs(spark):
    # one template whose copies drift around the threshold, rows that only share a passage, and repeats of some
    rng = np.random.default_rng(3)
    words = np.array([f"v{k}" for k in range(400)])
    base, passage = rng.choice(words, 80), rng.choice(words, 30)
    texts = []
    for k in range(900):
        own = base.copy() if k % 3 else np.concatenate([passage, rng.choice(words, 40)])
        spots = rng.permutation(len(own))[: int(rng.integers(0, 6))]
        own[spots] = rng.choice(words, len(spots))
        texts.append(" ".join(own))
    texts += texts[:60]
    how = N.NearDup(block=64, text_block=32)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in N.near_duplicates(docs, how).collect()}

    known = N._Hashes()
    hashed = [N.word_hashes(t, known) for t in texts]
    df = np.zeros(1 << how.df_bits)
    for w in hashed:
        df[np.unique(w >> np.uint64(64 - how.df_bits))] += 1
    idf = 1.0 + np.log((1.0 + len(texts)) / (1.0 + df))
    sets = [dict(zip(*(x.tolist() for x in N.shingles(w, how.words, idf, how.df_bits)))) for w in hashed]
    holders: dict[int, list[int]] = {}
    for k, s in enumerate(sets):
        for key in s:
            holders.setdefault(key, []).append(k)
    both = np.zeros((len(texts), len(texts)))
    for key, who in holders.items():
        v = np.array([sets[k][key] for k in who])
        both[np.ix_(who, who)] += np.minimum(v[:, None], v)
    total = np.diag(both)
    linked = both >= 0.8 * (total[:, None] + total - both) - 1e-9
    label = np.arange(len(texts))
    while True:
        new = np.array([label[row].min() for row in linked])
        if (new == label).all():
            break
        label = new
    assert 20 < len(set(label)) < 700
    assert [got[k] for k in range(len(texts))] == label.tolist()


def test_ids_that_are_null_or_repeat(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rows = [(None, long), (None, long + " more"), (5, "one text"), (5, "quite another text"), (9, "one text")]
    got = sorted(((r["doc_id"], r["class_id"]) for r in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == [(5, 5), (5, 5), (9, 5), (None, None), (None, None)]


def test_a_meeting_of_few_texts_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    place, owner = np.repeat(np.arange(40), 2), np.tile([0, 1], 40)
    root = rng.random(80)
    tracemalloc.start()
    both = N._shared(place, owner, root, 2, np.array([0]), np.array([1]))
    assert tracemalloc.get_traced_memory()[1] < 1_000_000  # a slice of full width has 32 MB
    tracemalloc.stop()
    assert np.allclose(both, (root[::2] * root[1::2]).sum())
    assert N._shared(place[:0], owner[:0], root[:0], 2, np.array([0]), np.array([1])).tolist() == [[0.0]]
    # more elements than a slice is wide
    rows, many = 70_000, 200
    wide = N._shared(np.repeat(np.arange(many), 2), np.tile([5, 9], many), np.ones(2 * many), rows, np.array([5]), np.array([9, 6]))
    assert wide.tolist() == [[many, 0.0]]
