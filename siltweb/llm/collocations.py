"""Phrases that stand out, by dynamic itemset counting: lengths interleaved over cyclic scans of shards."""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, table

#: Step of a slot whose phrases haven't reached the threshold.
NEVER = 255

# What ends a piece; words are parted by space and tab.
_ENDS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Settings:
    #: Least count of a candidate, and so of every part of it.
    least: int = 30
    #: Words in the longest candidate.
    longest: int = 4
    #: Shards of the cycle. A phrase is counted over as many shards from where it was activated, and then is done.
    shards: int = 3
    #: Size of the table of activated phrases, ``2^bits`` bytes (40 bits at most), whatever the corpus. Phrases that share a slot share its
    #: step: some are then counted that needn't be, none is missed.
    bits: int = 24
    #: Words that a task counts before it hands its sums on.
    words_at_once: int = 1_500_000
    #: Bytes of the batches that Spark hands to Python, about, and rows of those that it gets back at most: both are held twice or more on
    #: either side, next to what a task counts.
    batch_bytes: int = 4_000_000
    batch_rows: int = 100_000
    #: Bytes of the encoded corpus that a task of a scan, and of the last one, reads, about. Each task sums up what it has seen: larger ones
    #: shuffle less, and hold more.
    scan_bytes: int = 6_000_000
    last_bytes: int = 16_000_000
    #: Sums that a task of the last scan shuffles at a time, about; past that the scan is made in several turns.
    sums_at_once: int = 1_500_000
    #: A candidate goes if a longer one that holds it has this percentage of its count.
    covered: int = 80
    #: Rows of each language.
    top: int = 2000
    #: Bytes of phrases, at most, that a join sends to all executors; past that it is a shuffle.
    broadcast_bytes: int = 64_000_000


def split_words(text: str) -> list[bytes]:
    """Lower-cased words, with ``.`` where a piece ends."""
    return text.encode().lower().translate(_ENDS).replace(b".", b" . ").split()


def encode(text: DataFrame, how: Settings) -> DataFrame:
    """``lang, shard, names, ids``: the words of some texts of ``lang, text`` at a time, each spelled once, and their numbers in order, 0 where a piece ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], tuple[dict[bytes, int], list[np.ndarray]]] = {}
        total, row = 0, 0

        def packed() -> Iterator[pa.RecordBatch]:
            for (lang, shard), (number, parts) in held.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang], pa.string()), "shard": np.array([shard], np.int32), "names": pa.array([b" ".join(number)], pa.binary()), "ids": pa.array([np.concatenate(parts).tobytes()], pa.binary())})

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                key, row = (lang, row % how.shards), row + 1
                if key not in held:
                    number = defaultdict()
                    number.default_factory = number.__len__
                    held[key] = (number, [])
                    number[b"."]
                number, parts = held[key]
                words = split_words(text)
                words.append(b".")
                parts.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                total += len(words)
                if total >= how.words_at_once:
                    yield from packed()
                    held, total = {}, 0
        yield from packed()

    return text.mapInArrow(run, "lang string, shard int, names binary, ids binary")


def _turn(h: np.ndarray) -> np.ndarray:
    return (h << np.uint64(21)) | (h >> np.uint64(43))


def _number(lang: str) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(lang.encode(), 42)], np.uint64)


def _hashes(names: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in names), np.uint64, len(names))


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray]]:
    """Language, names and numbers of each row. The numbers are those of the batch, not a copy."""
    for batch in batches:
        for lang, names, ids in zip(*(batch.column(c) for c in ("lang", "names", "ids"))):
            yield lang.as_py(), names.as_py().split(b" "), np.frombuffer(ids.as_buffer(), np.int32)


def count_step(shard: DataFrame, slots: Broadcast, step: int, how: Settings) -> DataFrame:
    """Counts of the phrases of encoded texts that are active at ``step``: ``k, start, hash, c``; ``k = 0``, the empty phrase, is the number of words.

    Words are active from step 0. A longer phrase is active from the step at which both parts that lack one end word had
    reached the threshold, as the packed ``slots`` say, for one full cycle. A phrase is a hash of 64 bits here, made of its
    language and then word by word: turn by 21 bits, exclusive or with the word's. A task sums what it has seen of some
    million words by sorting these. Phrases that share a hash share a count, so none is counted too low.
    """
    shift = np.uint64(64 - how.bits)

    def frame(k: int, start: int, h: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        n = len(h)
        return pa.RecordBatch.from_pydict({"k": np.full(n, k, np.int32), "start": np.full(n, start, np.int32), "hash": h.view(np.int64), "c": c.astype(np.int64)})

    def summed(k: int, start: int, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        """``h`` is sorted in place."""
        if len(h):
            h.sort()
            at = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
            for first in range(0, len(at) - 1, how.batch_rows):
                some = at[first : first + how.batch_rows + 1]
                yield frame(k, start, h[some[:-1]], np.diff(some))

    def counted(lang: str, words: np.ndarray, ends: np.ndarray, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        empty = _number(lang)
        h = _turn(empty) ^ words
        if step < how.shards:
            yield frame(0, 0, empty, np.array([len(ends) - ends.sum()]))
            yield from summed(1, 0, h[~ends])
        # at each place: the step at which the phrase of k words that starts there was activated
        reached = np.where(ends, NEVER, table[h >> shift]).astype(np.int16)
        for k in range(2, how.longest + 1):
            start = np.maximum(reached[:-1], reached[1:])
            h = _turn(h[:-1]) ^ words[k - 1 :]
            for s in range(max(1, step - how.shards + 1), step + 1):
                yield from summed(k, s, h[start == s])
            if k < how.longest:
                # reached at the earliest a step after the start
                reached = np.where(start < step, np.maximum(table[h >> shift], start + 1), NEVER).astype(np.int16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(zlib.decompress(slots.value), np.uint8)
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        total = 0
        flush = lambda: (b for lang, it in held.items() for b in counted(lang, *map(np.concatenate, zip(*it)), table))
        for lang, names, ids in _encoded(batches):
            held[lang].append((_hashes(names)[ids], ids == 0))
            total += len(ids)
            if total >= how.words_at_once:
                yield from flush()
                held.clear()
                total = 0
        yield from flush()

    return shard.mapInArrow(run, "k int, start int, hash long, c long")


def spell(corpus: DataFrame, slots: Broadcast, how: Settings, turn: int = 0, turns: int = 1) -> DataFrame:
    """Exact counts of the phrases whose slots were reached, and whose parts' were, with their words: ``lang, k, phrase, c``; ``k = 0``, the empty phrase, is the number of words.

    Of several turns each has the phrases of other first words; the empty phrase is in turn 0.
    """
    shift = np.uint64(64 - how.bits)

    def counted(lang: str, number: dict[bytes, int], parts: list[np.ndarray], table: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, of_names = np.concatenate(parts), _hashes(list(number))
        names = pa.array(number, pa.binary()).cast(pa.string())
        words, mine = of_names[ids], (of_names % np.uint64(turns) == turn)[ids]

        def frame(k: int, phrases: pa.Array, c: np.ndarray) -> pa.RecordBatch:
            n = len(phrases)
            return pa.RecordBatch.from_pydict({"lang": pa.repeat(pa.scalar(lang, pa.string()), n), "k": np.full(n, k, np.int32), "phrase": phrases, "c": c.astype(np.int64)})

        def spelled(k: int, at: np.ndarray, c: np.ndarray) -> Iterator[pa.RecordBatch]:
            """The phrases of k words at some places, spelled only as they are handed on."""
            for first in range(0, len(at), how.batch_rows):
                some = at[first : first + how.batch_rows]
                yield frame(k, pc.binary_join_element_wise(*(names.take(pa.array(ids[some + i])) for i in range(k)), " "), c[first : first + how.batch_rows])

        if turn == 0:
            yield frame(0, pa.array([""]), np.array([np.count_nonzero(ids)]))
        h = _turn(_number(lang)) ^ words
        on = (ids > 0) & (table[h >> shift] != NEVER)
        # at each place that is on and of this turn: the number of the phrase of k words that starts there, among those counted
        seen = ids
        for k in range(1, how.longest + 1):
            if k > 1:
                h = _turn(h[:-1]) ^ words[k - 1 :]
                on = on[:-1] & on[1:] & (table[h >> shift] != NEVER)
            at = np.flatnonzero(on & mine[: len(on)]).astype(np.int32)
            key = seen[at].astype(np.int64)
            if k > 1:
                key *= len(names)
                key += ids[at + (k - 1)]
            order = np.argsort(key)
            key, at = key[order], at[order]
            del order
            begins = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1]))).astype(np.int32)
            del key
            c, place = np.diff(begins, append=np.int32(len(at))), at[begins]
            seen = np.zeros(len(on), np.int32)
            seen[at] = np.repeat(np.arange(len(c), dtype=np.int32), c)
            del at, begins
            yield from spelled(k, place, c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(zlib.decompress(slots.value), np.uint8)
        held: dict[str, tuple[dict[bytes, int], list[np.ndarray]]] = {}
        total = 0
        for lang, names, ids in _encoded(batches):
            if lang not in held:
                number = defaultdict()
                number.default_factory = number.__len__
                held[lang] = (number, [])
            number, parts = held[lang]
            parts.append(np.fromiter(map(number.__getitem__, names), np.int32, len(names))[ids])
            total += len(ids)
            if total >= how.words_at_once:
                for name, it in held.items():
                    yield from counted(name, *it, table)
                held, total = {}, 0
        for name, it in held.items():
            yield from counted(name, *it, table)

    return corpus.mapInArrow(run, "lang string, k int, phrase string, c long")


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _bytes(spark: SparkSession, path: str) -> int:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


@contextmanager
def _while_counting(spark: SparkSession, how: Settings) -> Iterator[None]:
    """Shuffle files go with the query that wrote them, else those of all scans would wait for the driver's garbage collection; Python gets batches of bounded bytes."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(how.batch_bytes)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def frequent_phrases(docs: DataFrame, how: Settings = Settings()) -> DataFrame:
    """Phrases of up to ``longest`` words with at least ``least`` occurrences within pieces: ``lang, k, phrase, f``; ``k = 0`` has each language's number of words.

    The corpus is split into words and numbered once, and written in ``shards`` shards, read in turn again and again. Each
    step counts all lengths that are active at once: words in the first cycle; longer phrases as soon as both parts have
    reached the threshold in what was read so far. Scans count hashes, pre-aggregated, so no hot phrase is gathered. A
    phrase that has the threshold's share in no shard of its cycle can't be frequent, so a step leaves only those that
    have it; where a phrase hasn't, it is taken to have all that it can have without. The driver gets which of the
    ``2^bits`` slots were reached, as bitmaps; it ends when no phrase can still be active. No frequent phrase's slot is
    missed by then, and a last scan of all shards counts what is in these slots by its words, exactly. How much that shuffles
    is known from the counts before; if it is more than ``sums_at_once`` a task, it is made in turns, each for the
    phrases of other first words, and the shuffle files of one go before the next.
    """
    spark = docs.sparkSession
    home = fresh_path(spark, "phrases")
    text = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    encode(text, how).write.partitionBy("shard").option("compression", "zstd").parquet(f"{home}/corpus")
    corpus = spark.read.schema("lang string, names binary, ids binary, shard int").parquet(f"{home}/corpus")
    counts = lambda: spark.read.schema("key long, c long, step int").parquet(f"{home}/counts")
    # tasks, so many that all cores are busy in each round of them
    cores, size = spark.sparkContext.defaultParallelism, _bytes(spark, f"{home}/corpus")
    scan_tasks = max(1, math.ceil(size / (how.shards * how.scan_bytes * cores))) * cores
    last_tasks = max(1, math.ceil(size / (how.last_bytes * cores))) * cores
    # sums of reached phrases that the last scan shuffles, a task's at most one of each; places of reached words that no reached phrase of full length starts at, where one may that only shares a slot
    wanted, places = 0, 0
    # one number for the shuffle: the first 40 bits of the hash, then start and length; fewer bits to tell phrases apart only make counts higher
    key = F.col("hash").bitwiseAND(F.lit(-1 << 24)).bitwiseOR(F.shiftleft(F.col("start").cast("long"), 8)).bitwiseOR(F.col("k").cast("long"))
    start_of, k_of = F.shiftright("key", 8).bitwiseAND(F.lit(255)), F.col("key").bitwiseAND(F.lit(255)).cast("int")
    # the last step at which phrases of each length reached slots
    slots, step, newest = np.full(1 << how.bits, NEVER, np.uint8), 0, [0] * (how.longest + 1)
    # the most that a phrase can have in a shard without the threshold's share
    light = (how.least - 1) // how.shards

    def last_start() -> int:
        """A frequent phrase starts when its parts have reached their slots, or a step after these started, if the slots were reached before."""
        start = newest[1] if how.longest > 1 else 0
        for k in range(3, how.longest + 1):
            start = max(newest[k - 1], start + 1)
        return start

    while step < last_start() + how.shards:
        shared = spark.sparkContext.broadcast(zlib.compress(slots.tobytes(), 1))
        shard = corpus.where(F.col("shard") == step % how.shards).select("lang", "names", "ids").coalesce(scan_tasks)
        now = count_step(shard, shared, step, how)
        sums = now.where("k > 0").groupBy(key.alias("key")).agg(F.sum("c").alias("c"))
        sums.where(F.col("c") > light).write.parquet(f"{home}/counts/step={step}")
        shared.destroy()
        first = step - how.shards + 1
        found = counts().groupBy("key").agg(F.sum("c").alias("c"), F.count("*").alias("shards"))
        most = F.col("c") + (how.shards - F.col("shards")) * light
        slot = F.shiftrightunsigned("key", 64 - how.bits)
        reached = found.where((F.col("c") >= how.least) | (start_of == first) & (most >= how.least)).select(k_of.alias("k"), slot.alias("slot"), F.when(start_of == first, most).alias("done"))
        sizes = (F.sum(F.least("done", F.lit(last_tasks))), F.sum("done"))
        bitmaps = reached.groupBy("k", F.bitmap_bucket_number("slot").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits"), *(F.coalesce(n, F.lit(0)) for n in sizes)).collect()
        # position 0 of bucket 1 is value 1; bucket 0 has value 0 only
        for k, b, bits, sent, met in bitmaps:
            wanted += sent
            places += met * ((k == 1) - (k == how.longest))
            at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")) + (b - 1) * 32768 + 1
            at = at[at < len(slots)] if b else np.zeros(1, np.int64)
            new = at[slots[at] > step]
            slots[new] = step + 1
            if len(new):
                newest[k] = step + 1
        if first >= 0:
            _remove(spark, f"{home}/counts/step={first}")  # all that started by then has had its cycle
        step += 1
        if step >= NEVER:
            raise RuntimeError("more steps than four cycles can take")
    shared = spark.sparkContext.broadcast(zlib.compress(slots.tobytes(), 1))
    turns = max(1, math.ceil((wanted + np.mean(slots != NEVER) * max(0, places)) / (last_tasks * how.sums_at_once)))
    whole = corpus.select("lang", "names", "ids").coalesce(last_tasks)
    for turn in range(turns):
        exact = spell(whole, shared, how, turn, turns).groupBy("lang", "k", "phrase").agg(F.sum("c").alias("f"))
        exact.where((F.col("f") >= how.least) | (F.col("k") == 0)).write.mode("append").parquet(f"{home}/done")
    shared.destroy()
    _remove(spark, f"{home}/corpus")
    return spark.read.schema("lang string, k int, phrase string, f long").parquet(f"{home}/done")


def collocations(docs: DataFrame, how: Settings = Settings()) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` counts the phrase, ``l`` and ``r`` the parts at its weakest cut, ``n`` all words; the score is
    ``floor(2000000 a / (l + r))``, in decimals. Texts are lower-cased (A to Z only) and cut into pieces; null text is
    empty, null languages are ``und`` together with a language of that name. Ties go by count, then by bytes of the phrase.
    Repeated rows count each time. Tables without words give no rows; other columns are left out.
    """
    spark = docs.sparkSession
    with _while_counting(spark, how):
        found = frequent_phrases(docs.select("lang", "text"), how)
    longer = found.where("k >= 2")
    words = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda k: F.struct(k.alias("cut"), F.array_join(F.slice(words, F.lit(1), k), " ").alias("first"), F.array_join(F.slice(words, k + 1, F.col("k") - k), " ").alias("rest")))
    cut = longer.select("lang", "k", "phrase", F.col("f").alias("a"), F.explode(cuts).alias("x")).select("lang", "k", "phrase", "a", "x.*")
    parts = found.where(F.col("k").between(1, how.longest - 1)).select("lang", "phrase", "f")
    size = parts.agg(F.sum(F.octet_length("phrase") + F.octet_length("lang") + 32)).first()[0] or 0
    side = F.broadcast if size <= how.broadcast_bytes else lambda df: df
    for name, part in (("l", "first"), ("r", "rest")):
        cut = cut.join(side(parts.select("lang", F.col("phrase").alias(part), F.col("f").alias(name))), ["lang", part])
    decimal = lambda c: F.col(c).cast("decimal(20,0)")
    score = F.expr("cast((cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as long)")
    best = cut.withColumn("score", score).groupBy("lang", "k", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a")).alias("b"))
    best = best.select("lang", "k", "phrase", "b.a", "b.l", "b.r", "b.score")
    # what longer candidates hold: every part of two words or more, with the largest count of one that holds it
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    holds = longer.where("k >= 3").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = best.join(holds, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (decimal("longer") * 100 < decimal("a") * how.covered))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the first rows of every part of a language, then of the language
    part = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(max(12, int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    first = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= how.top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= how.top)
    totals = found.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def oracle(how: Settings = Settings()) -> str:
    """The same by counting all phrases of all lengths."""
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS phrase FROM pieces WHERE len(w) >= {k}" for k in range(1, how.longest + 1)
    )
    return f"""
    WITH texts AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS text FROM documents),
    pieces AS (SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') AS w FROM texts),
    f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING count(*) >= {how.least}),
    n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
    cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
    cut AS (SELECT *, unnest(range(1, k)) AS c FROM cand),
    scored AS (
        SELECT cut.lang, cut.phrase, cut.a, c, x.f AS l, y.f AS r, (2000000::HUGEINT * cut.a // (x.f + y.f))::BIGINT AS score
        FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(cut.w[1:c], ' ') JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(cut.w[c + 1:], ' ')),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
    parts AS (SELECT lang, a, k, w, unnest(range(2, k)) AS m FROM cand),
    holds AS (SELECT lang, unnest(list_transform(range(1, k - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase, a FROM parts),
    kept AS (SELECT b.* FROM best b LEFT JOIN (SELECT lang, phrase, max(a) AS longer FROM holds GROUP BY ALL) h USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < {how.covered}::HUGEINT * b.a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang)
    QUALIFY rank <= {how.top}"""
