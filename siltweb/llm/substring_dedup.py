"""Removal of long passages that occur more than once in a corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_groups, materialize, table

_BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Repeats:
    #: Words of a window; a passage of this length that occurs again is removed.
    window: int = 35
    #: Words of an anchor: each window is filed under its anchor of the smallest hash.
    anchor: int = 8
    #: Passages under one anchor that make up one automaton; windows of anchors with more are counted by hash.
    passages: int = 2000
    #: Up to this many documents with repeated anchors are named to every task; more are joined by shuffle.
    broadcast_ids: int = 1_000_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as long as the longest document so far."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                factors = np.full(size, base, np.uint64)
                factors[0] = 1
                setattr(self, name, np.cumprod(factors, dtype=np.uint64))
        return self.up, self.down


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Text:
    """The words of a document and hashes of any of its runs."""

    def __init__(self, text: str | None, known: _Hashes, powers: _Powers):
        # bytes.split() splits at the six ASCII blanks, which are the contract's
        self.words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
        values = np.fromiter(map(known.__getitem__, self.words), np.uint64, len(self.words))
        up, self.down = powers.upto(len(values) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)], dtype=np.uint64)])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def anchors(self, how: Repeats):
        """Windows filed under one anchor stand in a row: ``hash, context hash, first window, windows`` of each such row."""
        n = len(self.words) - how.window + 1
        if n < 1:
            return None
        at = np.arange(len(self.words) - how.anchor + 1)
        grams = self.runs(at, at + how.anchor)
        place = np.arange(n) + np.lib.stride_tricks.sliding_window_view(grams, how.window - how.anchor + 1).argmin(1)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.append(first, n))
        context = self.runs(first, first + count - 1 + how.window) + (place[first] - first).astype(np.uint64) * np.uint64(1_000_003) + count.astype(np.uint64)
        return grams[place[first]].view(np.int64), mixed(context).view(np.int64), first, count

    def windows(self, first: int, count: int, how: Repeats) -> np.ndarray:
        at = np.arange(first, first + count)
        return self.runs(at, at + how.window).view(np.int64)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _anchor_rows(how: Repeats):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, powers = _Hashes(), _Powers()
        for batch in batches:
            parts = []
            for doc_id, print_, text in zip(batch["doc_id"].array, batch["print"].array, batch["text"].array):
                got = Text(text, known, powers).anchors(how)
                if got is not None:
                    parts.append((doc_id, print_, *got))
            if parts:
                size = [len(p[2]) for p in parts]
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array([p[0] for p in parts], "Int64").repeat(size),
                        "print": np.repeat([p[1] for p in parts], size),
                        **{name: np.concatenate([p[k] for p in parts]) for k, name in enumerate(("anchor", "context", "first", "windows"), 2)},
                    }
                )

    return run


class Automaton:
    """Suffix automaton of word sequences, each state with how often its words occur: a sequence counts as often as the corpus holds it."""

    def __init__(self, sequences: list[list[bytes]], times: list[int]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]
        for words, n in zip(sequences, times):
            last = 0
            for word in words:
                last = self._extend(last, word)
                self.count[last] += n
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def _state(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """The state of p's words with ``word``, which q holds among longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        own = self._state(self.length[p] + 1, self.link[q], self.next[q].copy())
        self.link[q] = own
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = own
            p = self.link[p]
        return own

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._split(last, word, self.next[last][word])
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, word, self.next[p][word])
        return new

    def matches(self, words: list[bytes]) -> Iterator[int]:
        """At each word, the length of the longest sequence ending there that occurs twice or more."""
        s, n = 0, 0
        for word in words:
            while s and word not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if word in self.next[s]:
                s, n = self.next[s][word], n + 1
            while s and self.count[s] < 2:
                s = self.link[s]
                n = self.length[s]
            yield n


def _passage_rows(how: Repeats):
    """The words of passages, as they stand in the text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text, spots in zip(batch["text"].array, batch["spots"].array):
                words = text.encode("utf-8", "surrogatepass").split()
                rows += [(s["anchor"], s["context"], s["times"], s["n"], b" ".join(words[s["first"] : s["first"] + s["windows"] + how.window - 1])) for s in spots]
            yield pd.DataFrame(rows, columns=["anchor", "context", "times", "n", "words"])

    return run


def _streamed(how: Repeats):
    """``anchor, context, part``: each anchor's passages are streamed through their automaton; a match of a window's length sets that window's bit."""

    def stream(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        texts, times, parts = frame["words"].to_numpy(), frame["times"].to_numpy(), np.zeros(len(frame), np.int64)
        for a, b in zip(starts[:-1], starts[1:]):
            passages = [t.split() for t in texts[a:b]]
            automaton = Automaton(passages, times[a:b].tolist())
            for k, words in enumerate(passages, a):
                bits = 0
                for end, n in enumerate(automaton.matches(words), 1):
                    if n >= how.window:
                        bits |= 1 << (end - how.window)
                parts[k] = bits
        return frame[["anchor", "context"]].assign(part=parts)

    return stream


def _window_rows(how: Repeats):
    """Hashes of the windows of passages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, powers = _Hashes(), _Powers()
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                texts = [Text(w.decode("utf-8", "surrogatepass"), known, powers) for w in part["words"]]
                got = [t.windows(0, len(t.words) - how.window + 1, how) for t in texts]
                size = [len(g) for g in got]
                yield pd.DataFrame({"window": np.concatenate(got), **{c: part[c].to_numpy().repeat(size) for c in ("anchor", "context", "times")}, "place": np.concatenate([np.arange(n, dtype=np.int32) for n in size])})

    return run


def _kept_rows(how: Repeats, with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, hits in zip(batch["text"].array, batch["hits"].array):
                words = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
                kept = words
                if hits is not None and len(hits):
                    edge = np.zeros(len(words) + 1, np.int64)
                    for h in hits:
                        mask = h["mask"]
                        starts = [h["first"] + k for k in range(how.window) if mask >> k & 1]
                        np.add.at(edge, starts, 1)
                        np.add.at(edge, [s + how.window for s in starts], -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    kept = [w for w, k in zip(words, keep) if k]
                out.append((len(words), len(words) - len(kept), _digest(kept), b" ".join(kept).decode("utf-8", "surrogatepass") if with_text else None))
            frame = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256", "kept_text"])
            frame.insert(0, "doc_id", batch["doc_id"].array)
            yield frame if with_text else frame.drop(columns="kept_text")

    return run


def remove_repeats(docs: DataFrame, how: Repeats = Repeats(), with_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept_text``) of every row: words in a window that occurs again are removed.

    1. Every window is filed under the anchor of the smallest hash in it, so equal windows share one. Neighbouring windows
       with one anchor make one passage; its context hash covers all their words. There is one for fourteen words or so.
    2. Anchors that occur once leave. Passages of one anchor with equal contexts repeat in all their windows.
    3. Where an anchor has passages with other contexts too, one of each context goes into the anchor's suffix automaton,
       counted as often as it occurs, and all are streamed through it: matching statistics give the longest repeated
       sequence that ends at each word. Those of a window's length or more are the maximal spans, found to the word.
       Anchors with more passages than an automaton takes have their windows counted by hash.
    4. The windows found go back to their documents as one bit each, and words that one covers are removed.

    Counts are pre-aggregated and joins are by hash, so a passage in a third of all documents is counted where it lies.
    Null text has no words. Repeated rows repeat each other's words. Documents shorter than a window keep all. A null
    doc_id is kept. An empty table gives no rows; other columns are left out.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("print", F.coalesce(F.xxhash64("text"), F.lit(0)))
    rows = "doc_id long, print long, anchor long, context long, first int, windows int"
    filed = materialize(own.select("doc_id", "print", "text").mapInPandas(_anchor_rows(how), rows), "anchors")
    again = materialize(filed.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "repeated-anchors")
    rows_again = materialize(filed.join(again, "anchor", "left_semi"), "repeated-rows")

    spot = F.min(F.struct("doc_id", "print", "first", "windows")).alias("spot")
    contexts = materialize(rows_again.groupBy("anchor", "context").agg(F.count("*").alias("times"), spot), "contexts")
    mixed_up = contexts.groupBy("anchor").agg(F.count("*").alias("n"), F.min("times").alias("least")).where("n > 1 and least = 1").select("anchor", "n")
    unsure = materialize(contexts.join(materialize(mixed_up, "unsure-anchors"), "anchor"), "unsure")

    touched = materialize(rows_again.select("doc_id", "print").distinct(), "touched")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["print"] == b["print"])
    named = F.broadcast(touched) if touched.count() <= how.broadcast_ids else touched
    texts = materialize(own.join(named, same(own, named), "left_semi"), "touched-texts")
    texts_once = texts.dropDuplicates(["doc_id", "print"])

    spots = unsure.select(F.col("spot.doc_id").alias("doc_id"), F.col("spot.print").alias("print"), F.struct("anchor", "context", "times", "n", F.col("spot.first").alias("first"), F.col("spot.windows").alias("windows")).alias("one"))
    spots = materialize(spots.groupBy("doc_id", "print").agg(F.collect_list("one").alias("spots")), "spots")
    opened = texts_once.join(spots, same(texts_once, spots)).select("text", "spots")
    passages = materialize(opened.mapInPandas(_passage_rows(how), "anchor long, context long, times long, n long, words binary"), "passages")
    few, many = passages.where(F.col("n") <= how.passages), passages.where(F.col("n") > how.passages)
    partly = map_groups(few.drop("n"), ["anchor"], _streamed(how), "anchor long, context long, part long").where("part <> 0")
    windows = materialize(many.mapInPandas(_window_rows(how), "window long, anchor long, context long, times long, place int"), "windows")
    twice = windows.groupBy("window").agg(F.sum("times").alias("n")).where("n > 1").select("window")
    counted = windows.join(materialize(twice, "repeated-windows"), "window", "left_semi").groupBy("anchor", "context").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("part"))
    partly = partly.union(counted)
    partly = materialize(partly, "partly")
    marks = contexts.join(partly, ["anchor", "context"], "left").select("anchor", "context", F.when(F.col("times") > 1, F.expr("shiftleft(1L, spot.windows) - 1")).otherwise(F.col("part")).alias("mask"))
    marks = materialize(marks.where("mask is not null"), "marks")
    hits = rows_again.join(marks, ["anchor", "context"]).select("doc_id", "print", F.struct("first", "mask").alias("hit"))
    hits = materialize(hits.groupBy("doc_id", "print").agg(F.collect_set("hit").alias("hits")), "hits")

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    clean = own.join(named, same(own, named), "left_anti").select("doc_id", "text", F.lit(None).cast(hits.schema["hits"].dataType).alias("hits"))
    marked = texts.join(hits, same(texts, hits), "left").select(texts["doc_id"], "text", "hits")
    return clean.union(marked).mapInPandas(_kept_rows(how, with_text), schema)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE = r"""
with texts as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') words from documents),
windows as (select doc_id, i, array_to_string(words[i : i + 34], ' ') win from texts, unnest(range(1, len(words) - 33)) t(i)),
repeated as (select win from windows group by win having count(*) > 1),
covered as (select distinct doc_id, unnest(range(i, i + 35)) p from windows semi join repeated using (win)),
placed as (select doc_id, unnest(words) word, generate_subscripts(words, 1) p from texts),
kept as (
  select placed.doc_id, count(covered.p) n_removed, string_agg(word, ' ' order by placed.p) filter (where covered.p is null) kept
  from placed left join covered on placed.doc_id = covered.doc_id and placed.p = covered.p group by placed.doc_id)
select doc_id, len(words) n_words, coalesce(n_removed, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256
from texts left join kept using (doc_id)
"""
