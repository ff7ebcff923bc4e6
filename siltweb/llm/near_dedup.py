"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, then verified."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, map_groups, materialize, table


@dataclass(frozen=True)
class NearDup:
    words: int = 5
    similarity: float = 0.8
    bands: int = 12
    rows: int = 4
    #: Words share this many document-frequency counters; a fixed size, whatever the vocabulary.
    df_bits: int = 16
    #: Tables of short rows (buckets, candidates, classes) up to this long go to every task; longer ones are joined by shuffle.
    broadcast_rows: int = 1_000_000
    #: Members of a bucket whose samples are compared together, and members of a group whose texts are, if of ``usual_words`` at most.
    block: int = 1024
    text_block: int = 256
    usual_words: int = 1000
    #: Standard errors below the threshold at which samples alone turn a pair away.
    slack: float = 3.5
    seed: int = 11

    @property
    def least_agreeing(self) -> float:
        """Samples in which a pair must agree not to be turned away."""
        samples = self.bands * self.rows
        return samples * (self.similarity - self.slack * (self.similarity * (1 - self.similarity) / samples) ** 0.5)


class _Hashes(dict):
    """Word to 64-bit hash, computed once."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def word_hashes(text: str, known: _Hashes) -> np.ndarray:
    words = text.lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_counts(words: np.ndarray, size: int, idf: np.ndarray, df_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, the mean inverse document frequency of their words, and how often they occur. Fewer words than ``size`` form one shingle."""
    if not len(words):
        return words, np.zeros(0), np.zeros(0, np.int64)
    size = min(size, len(words))
    n = len(words) - size + 1
    mixed = np.zeros(n, np.uint64)
    for k in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n] + np.uint64(size)
        mixed ^= mixed >> np.uint64(31)
    rare = np.concatenate([[0.0], np.cumsum(idf[words >> np.uint64(64 - df_bits)])])
    weight = (rare[size:] - rare[:n]) / size
    keys, first, times = np.unique(mixed, return_index=True, return_counts=True)
    return keys, weight[first], times


def shingles(words: np.ndarray, size: int, idf: np.ndarray, df_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles and their weights, frequency times inverse document frequency."""
    keys, weight, times = shingle_counts(words, size, idf, df_bits)
    return keys, weight * times


class WeightedSampler:
    """Improved consistent weighted sampling: two sets agree in a sample with probability their weighted Jaccard similarity.

    A shingle's Gamma and uniform variates come from its hash by tables of quantiles, so no random number is stored.
    """

    def __init__(self, samples: int, seed: int):
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(1, 1 << 62, samples, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        draws = np.sort(rng.gamma(2.0, size=1 << 16))
        self.gamma = draws.astype(np.float32)
        self.log_gamma = np.log(draws).astype(np.float32)

    def sample(self, keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """One 64-bit value for each sample, of the chosen shingle and its level."""
        log_w = np.log(weights).astype(np.float32)
        n = len(self.odd)
        best, out, row = np.full(n, np.inf, np.float32), np.zeros(n, np.uint64), np.arange(n)
        for at in range(0, len(keys), 2048):
            key, lw = keys[at : at + 2048], log_w[at : at + 2048]
            z = key[None, :] * self.odd[:, None]
            z ^= z >> np.uint64(29)
            z *= np.uint64(0xBF58476D1CE4E5B9)
            # 16 bits each, the lowest first
            bits = z.astype("<u8", copy=False).view("<u2").reshape(n, -1, 4)
            r = self.gamma.take(bits[:, :, 3])
            beta = bits[:, :, 1].astype(np.float32)
            beta *= np.float32(1 / 65536)
            level = lw / r
            level += beta
            np.floor(level, out=level)
            log_a, step = self.log_gamma.take(bits[:, :, 2]), level - beta
            step += np.float32(1)
            step *= r
            log_a -= step
            k = log_a.argmin(1)
            low = log_a[row, k]
            value = key[k] ^ (level[row, k].astype(np.int64).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            out = np.where(low < best, value, out)
            best = np.minimum(best, low)
        return out


def inverse_frequencies(docs: DataFrame, how: NearDup) -> np.ndarray:
    """Smoothed IDF by word bucket, counted over all documents. Each task counts into one array; the sums have a fixed size."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, df, n = _Hashes(), np.zeros(1 << how.df_bits, np.int64), 0
        for batch in batches:
            for text in batch["text"].array:
                if isinstance(text, str):
                    n += 1
                    df[np.unique(word_hashes(text, known) >> np.uint64(64 - how.df_bits))] += 1
        filled = np.flatnonzero(df)
        yield pd.DataFrame({"bucket": np.append(filled, -1), "df": np.append(df[filled], n)})

    rows = docs.select("text").mapInPandas(count, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(1 << how.df_bits)
    real = rows[rows["bucket"] >= 0]
    df[real["bucket"].to_numpy()] = real["df"].to_numpy()
    n = rows.loc[rows["bucket"] < 0, "df"].sum()
    return 1.0 + np.log((1.0 + n) / (1.0 + df))


def text_key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.md5(text.cast("binary"))


def signatures(docs: DataFrame, idf, how: NearDup) -> DataFrame:
    """``doc_id, text_key, bands, sketch, total, words`` of every document, null where there are no words; the sketch is 32 bits of each sample, ``total`` the weight of all shingles."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, sampler = _Hashes(), WeightedSampler(how.bands * how.rows, how.seed)
        fold = np.uint64(0x9E3779B97F4A7C15) ** np.arange(1, how.rows + 1, dtype=np.uint64)
        nothing, seen = (None, None, None, None, None), {}

        def signed(text: str | None, key: str | None) -> tuple:
            words = word_hashes(text, known) if isinstance(text, str) else ()
            if not len(words):
                return nothing
            keys, weights = shingles(words, how.words, idf.value, how.df_bits)
            picked = sampler.sample(keys, weights).reshape(how.bands, how.rows)
            picked ^= picked >> np.uint64(32)
            band = (picked * fold).sum(1, dtype=np.uint64) + np.arange(how.bands, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
            return key, (band ^ (band >> np.uint64(29))).view(np.int64), picked.astype(np.uint32).tobytes(), float(weights.sum()), float(len(words))

        for batch in batches:
            rows = []
            for text, key in zip(batch["text"].array, batch["text_key"].array):
                if len(seen) > 20_000:  # equal texts in one task are sampled once
                    seen.clear()
                if key not in seen:
                    seen[key] = signed(text, key)
                rows.append(seen[key])
            out = pd.DataFrame(rows, columns=["text_key", "bands", "sketch", "total", "words"])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    fields = [*docs.select("doc_id").schema.fields, T.StructField("text_key", T.StringType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.BinaryType()), T.StructField("total", T.DoubleType()), T.StructField("words", T.DoubleType())]
    return docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key")).mapInPandas(run, T.StructType(fields))


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    either = a[1].sum() + b[1].sum() - both
    return float(both / either) if either > 0 else 0.0


def _sketches(frame: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(frame["sketch"]), np.uint32).reshape(len(frame), -1)


def _agreement(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """In how many samples each row of one agrees with each of the other."""
    agree = np.zeros((len(one), len(other)), np.uint8)
    for k in range(one.shape[1]):
        agree += one[:, k, None] == other[:, k]
    return agree


def _fit(one: np.ndarray, other: np.ndarray, how: NearDup) -> np.ndarray:
    """No pair is more similar than the share that the lighter one weighs of the heavier."""
    return np.minimum(one, other) >= (how.similarity - 1e-9) * np.maximum(one, other)


def _stars(rows: DataFrame, how: NearDup) -> DataFrame:
    """``leader, member, central, key``: members of each block of a bucket under leaders; where a bucket has other blocks, leaders are members of themselves too.

    ``rows``: key, block, blocks, central, node, total, sketch. The most central member leads all those whose samples and
    weights don't rule the threshold out; of the others again the most central one, until none is left.
    """

    def lead(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        node, key, blocks, central, total = (frame[c].to_numpy() for c in ("node", "key", "blocks", "central", "total"))
        values = _sketches(frame)
        two = starts[:-1][(np.diff(starts) == 2) & (blocks[starts[:-1]] == 1)]
        two = two[((values[two] == values[two + 1]).sum(1) >= how.least_agreeing) & _fit(total[two], total[two + 1], how)]
        first = np.where((central[two] > central[two + 1]) | (central[two] == central[two + 1]) & (node[two] < node[two + 1]), two, two + 1)
        leader, member = [first], [2 * two + 1 - first]
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a <= 2 and blocks[a] == 1:
                continue
            left = a + np.lexsort((node[a:b], -central[a:b]))
            while len(left):
                near = ((values[left] == values[left[0]]).sum(1) >= how.least_agreeing) & _fit(total[left], total[left[0]], how)
                near[0] = True
                leader.append(np.repeat(left[0], near.sum()))
                member.append(left[near])
                left = left[~near]
        x, y = np.concatenate(leader), np.concatenate(member)
        some = (x != y) | (blocks[x] > 1)
        return pd.DataFrame({"leader": node[x], "member": node[y], "central": central[x], "key": key[x]})[some]

    return map_groups(rows.select("key", "block", "blocks", "central", "node", "total", "sketch"), ["key", "block"], lead, "leader long, member long, central long, key long")


def _all_stars(waiting: DataFrame, how: NearDup) -> DataFrame:
    """``leader, member, central`` from the stars of every bucket. Leaders of a large bucket's blocks go up a tree of stars until no level joins any."""
    blocks = F.ceil(F.col("n") / float(how.block)).cast("long")
    rows = waiting.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    found, before, out = materialize(_stars(rows, how), "stars"), None, None
    for level in range(1, 64):
        more = found.where("leader <> member").select("leader", "member", "central")
        out = more if out is None else out.union(more)
        leaders = found.where("leader = member").select("key", F.col("leader").alias("node"))
        size = leaders.count()
        if not size or before is not None and size >= before:
            break
        before = size
        up = leaders.join(leaders.groupBy("key").agg(F.count("*").alias("n")), "key").join(waiting.drop("n"), ["key", "node"])
        up = up.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node", F.lit(level)), F.col("blocks")))
        found = materialize(_stars(up, how), "stars")
    return out


def _meetings(members: DataFrame, group: str, block: int, how: NearDup) -> DataFrame:
    """``members`` with ``i, j, own`` for each meeting of two blocks of their ``group`` that they take part in; ``own`` is the block that they are from.

    Members are of ``part`` and take ``size``; a block has room for ``block``. Those of a group's largest part don't meet
    each other, and groups of a single part have no meetings.
    """
    parts = materialize(members.groupBy(group, "part").agg(F.sum("size").alias("held")), "parts")
    mixed = parts.groupBy(group).agg(F.max_by("part", F.struct("held", "part")).alias("main"), F.max("held").alias("most"), F.sum("held").alias("all"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda held: F.ceil(held / float(block)).cast("long")
    mixed = materialize(mixed.select(group, "main", blocks(F.col("all") - F.col("most")).alias("rest"), blocks(F.col("most")).alias("mains"), (F.col("all") <= block).alias("small")), "mixed")
    dealt = members.join(F.broadcast(mixed) if mixed.count() <= how.broadcast_rows else mixed, group)
    draw = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    # Blocks of the rest come first; small groups are one block.
    zero, is_main = F.lit(0).cast("long"), F.col("part") == F.col("main")
    dealt = dealt.withColumn("own", F.when(F.col("small"), zero).when(is_main, F.col("rest") + draw("mains")).otherwise(draw("rest")))
    others = F.when(F.col("small"), F.array(zero)).when(is_main, F.sequence(zero, F.col("rest") - 1)).otherwise(F.sequence(zero, F.col("rest") + F.col("mains") - 1))
    sent = dealt.select(*members.columns, "own", F.explode(others).alias("other"))
    return sent.select(*members.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own")


def _two_sides(frame: pd.DataFrame, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
    """Of each meeting its first row, the rows of either block, and whether these are one."""
    own, first, second = (frame[c].to_numpy() for c in ("own", "i", "j"))
    for a, b in zip(starts[:-1], starts[1:]):
        left, right = (a + np.flatnonzero(own[a:b] == x) for x in (first[a], second[a]))
        if len(left) and len(right):
            yield a, left, right, first[a] == second[a]


def _shared(place: np.ndarray, owner: np.ndarray, root: np.ndarray, rows: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What each of rows ``x`` has in common with each of ``y``: matrix products over slices of the elements, which are sorted by ``place``. A slice is no wider than the elements that there are, as most meetings are of a few texts."""
    elements = int(place[-1]) + 1 if len(place) else 0
    both, width = np.zeros((len(x), len(y))), min(elements, max(64, (1 << 22) // rows))
    for at in range(0, elements, max(1, width)):
        p, q = np.searchsorted(place, (at, at + width))
        piece = np.zeros((rows, width))
        piece[owner[p:q], place[p:q] - at] = root[p:q]
        both += piece[x] @ piece[y].T
    return both


def _likely_between(members: DataFrame, how: NearDup) -> DataFrame:
    """``a, b``: members of a bucket that are in different classes and groups, where neither samples nor weights turn the pair away.

    A pair that shares several bands comes from the first of them alone.
    """

    def meet(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        node, part, group, total, band = (frame[c].to_numpy() for c in ("node", "part", "coarse", "total", "band"))
        values, one, other = _sketches(frame), [], []
        for a, left, right, same in _two_sides(frame, starts):
            x, y = np.nonzero((_agreement(values[left], values[right]) >= how.least_agreeing) & (part[left][:, None] != part[right]) & (group[left][:, None] != group[right]))
            u, v = left[x], right[y]
            earlier = (values[u] == values[v])[:, : band[a] * how.rows].reshape(len(u), int(band[a]), how.rows).all(2).any(1)
            some = ~earlier & _fit(total[u], total[v], how)
            if same:
                some &= node[u] < node[v]
            one.append(node[u[some]])
            other.append(node[v[some]])
        one, other = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (one, other))
        return pd.DataFrame({"a": np.minimum(one, other), "b": np.maximum(one, other)})

    sent = _meetings(members.withColumn("size", F.lit(1.0)), "key", how.block, how)
    return map_groups(sent.drop("size", "central"), ["key", "i", "j"], meet, "a long, b long")


def _similar_within(members: DataFrame, texts: DataFrame, idf, how: NearDup) -> DataFrame:
    """``a, b``: of each group's members in different classes, similar pairs, exactly compared; of those in one meeting, as many as join the same classes.

    A shingle that occurs k times counts as k elements, so what two texts share is a sum over common elements, and all
    pairs of a meeting come from one matrix product, over slices of the elements.
    """

    def meet(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        node, part, known = frame["node"].to_numpy(), frame["part"].to_numpy(), _Hashes()
        out = []
        for _, left, right, _ in _two_sides(frame, starts):
            rows = np.unique(np.concatenate([left, right]))
            ids, weights, who = [], [], []
            for k, r in enumerate(rows):
                keys, weight, times = shingle_counts(word_hashes(frame["text"].iat[r], known), how.words, idf.value, how.df_bits)
                level = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                ids.append(np.repeat(keys, times) ^ (level.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
                weights.append(np.repeat(weight, times))
                who.append(np.full(len(level), k))
            ids, weights, who = np.concatenate(ids), np.concatenate(weights), np.concatenate(who)
            total = np.bincount(who, weights, len(rows))
            _, element, often = np.unique(ids, return_inverse=True, return_counts=True)
            shared = often[element] > 1
            place = (np.cumsum(often > 1) - 1)[element[shared]]
            order = np.argsort(place, kind="stable")
            place, owner, root = place[order], who[shared][order], np.sqrt(weights[shared][order])
            x, y = np.searchsorted(rows, left), np.searchsorted(rows, right)
            both = _shared(place, owner, root, len(rows), x, y)
            similar = both >= (how.similarity - 1e-9) * (total[x][:, None] + total[y] - both)
            u, v = np.nonzero(similar & (part[left][:, None] != part[right]))
            u, v = left[u], right[v]
            low, high = np.minimum(part[u], part[v]), np.maximum(part[u], part[v])
            out.append(pd.DataFrame({"a": node[u], "b": node[v], "low": low, "high": high}).drop_duplicates(["low", "high"])[["a", "b"]])
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

    sized = members.withColumn("size", F.greatest(F.lit(1.0), F.col("words") / how.usual_words))
    sent = _meetings(sized.select("node", "part", "coarse", "size"), "coarse", how.text_block, how).drop("size")
    return map_groups(sent.join(texts, "node"), ["coarse", "i", "j"], meet, "a long, b long")


def _verify(pairs: DataFrame, texts: DataFrame, idf, how: NearDup) -> DataFrame:
    """``a, b, similar`` of each pair: the weighted Jaccard similarity of the whole texts reaches the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, made, held = _Hashes(), {}, 0

        def of(node: int, text: str) -> tuple[np.ndarray, np.ndarray]:
            nonlocal held
            if node not in made:
                if held > 1_000_000:  # shingles
                    made.clear()
                    held = 0
                made[node] = shingles(word_hashes(text, known), how.words, idf.value, how.df_bits)
                held += len(made[node][0])
            return made[node]

        for batch in batches:
            rows = zip(batch["a"].array, batch["text_a"].array, batch["b"].array, batch["text_b"].array)
            good = [weighted_jaccard(of(a, x), of(b, y)) >= how.similarity - 1e-9 for a, x, b, y in rows]
            yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "similar": good})

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    few = F.broadcast(pairs) if pairs.count() <= how.broadcast_rows else pairs
    return left.join(few, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long, similar boolean")


def _merged(joined: DataFrame, links: DataFrame) -> DataFrame:
    """Classes ``node, part`` after more links; earlier classes stand for their edges."""
    if links.isEmpty():
        return joined
    edges = links.select("a", "b").union(joined.where("node <> part").select(F.col("node").alias("a"), F.col("part").alias("b")))
    return connected_components(edges, "classes").withColumnRenamed("component", "part")


def near_duplicates(docs: DataFrame, how: NearDup = NearDup()) -> DataFrame:
    """``doc_id, class_id, kept, text_key`` of every row: classes of documents that links of similarity join, named by their smallest doc_id, which alone is kept.

    Equal texts collapse first; links are sought between different texts only. In each band's bucket, block by block, the
    members that share buckets with most others lead those that look alike, and leaders of blocks meet again. Texts with
    one leader are a group, whose classes are compared exactly, blocks of them with one another. Then all members of a
    bucket that are in different classes and groups meet, in blocks. Samples and total weights turn clearly different
    pairs away; all others are compared exactly on their whole texts. Members of one class have no need to be compared.

    Lower-cased white-space words count; fewer than five form one shingle. Null and blank texts are alone in their class.
    Repeated rows are copies of each other; of rows that tie, all with the class's id are kept. Texts, not ids, are
    compared: rows that share an id but not a text may be in different classes, and a null doc_id joins its text's class
    but is never its name unless all are null. An empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    idf = spark.sparkContext.broadcast(inverse_frequencies(docs, how))
    light = lambda df: F.broadcast(df) if df.count() <= how.broadcast_rows else df
    signed = materialize(signatures(docs, idf, how), "signatures")
    texts = signed.where("text_key is not null")
    reps = texts.groupBy("text_key").agg(F.min("doc_id").alias("rep"), *[F.max(c).alias(c) for c in ("bands", "sketch", "total", "words")])
    # Written once, so that the numbers stay what they are.
    reps = materialize(reps.withColumn("node", F.monotonically_increasing_id()), "representatives")
    members = reps.select("node", "total", "words", "sketch", F.posexplode("bands").alias("band", "key"))
    crowded = members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = light(materialize(crowded, "crowded"))
    waiting = materialize(members.join(crowded, "key"), "members")
    # The text that copies were made from shares buckets with more of them than they do with each other.
    central = materialize(waiting.groupBy("node").agg(F.sum("n").alias("central")), "central")
    waiting = materialize(waiting.join(light(central), "node"), "waiting")

    wanted = light(central.select("node").join(reps.select("node", "text_key", "rep"), "node"))
    known = docs.select("doc_id", "text", text_key(F.col("text")).alias("text_key"))
    known = known.join(wanted, (known.text_key == wanted.text_key) & known.doc_id.eqNullSafe(wanted.rep)).select("node", "text")
    chosen = materialize(known.dropDuplicates(["node"]), "candidate-texts")

    stars = _all_stars(waiting.drop("words", "band"), how)
    pairs = materialize(stars.select(F.least("leader", "member").alias("a"), F.greatest("leader", "member").alias("b")).distinct(), "pairs")
    edges = materialize(_verify(pairs, chosen, idf, how).where("similar").select("a", "b"), "verified")
    joined = connected_components(edges, "classes").withColumnRenamed("component", "part")
    # Texts under one leader are a group; its classes meet and are compared exactly.
    led = stars.select(F.col("member").alias("node"), "leader", "central").union(stars.select(F.col("leader").alias("node"), "leader", "central"))
    own = materialize(led.groupBy("node").agg(F.max_by("leader", F.struct("central", -F.col("leader"))).alias("leader")), "leaders")
    above = own.select(F.col("node").alias("leader"), F.col("leader").alias("coarse"))
    coarse = materialize(own.join(light(above), "leader").select("node", "coarse"), "groups")
    located = central.select("node").join(light(joined), "node", "left").join(light(coarse), "node", "left")
    located = materialize(located.select("node", F.coalesce("part", "node").alias("part"), F.coalesce("coarse", "node").alias("coarse")), "located")
    new = materialize(_similar_within(located.join(reps.select("node", "words"), "node"), chosen, idf, how), "similar")
    joined = _merged(joined, new)
    # What is still in different classes and groups meets in its buckets.
    located = light(materialize(located.drop("part").join(light(joined), "node", "left").withColumn("part", F.coalesce("part", "node")), "located"))
    pairs = materialize(_likely_between(waiting.drop("n", "words").join(located, "node"), how).join(light(pairs), ["a", "b"], "left_anti"), "pairs")
    new = materialize(_verify(pairs, chosen, idf, how).where("similar").select("a", "b"), "verified")
    joined = _merged(joined, new)
    named = reps.select("text_key", "node", "rep").join(light(joined), "node", "left")
    least = named.where("part is not null").groupBy("part").agg(F.min("rep").alias("class"))
    named = named.join(light(materialize(least, "names")), "part", "left").select("text_key", F.coalesce("class", "rep").alias("class"))
    out = signed.join(named, "text_key", "left").select("doc_id", "text_key", F.coalesce("class", "doc_id").alias("class_id"))
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"), "text_key")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key")
