"""Periodic runs of words, found while words are appended: catchers over completed power-of-two blocks."""

from __future__ import annotations

import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cmp_to_key
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


class Run(NamedTuple):
    start: int
    length: int
    period: int


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Catchers:
    """Runs of a stream of word numbers, of at least ``exponent`` periods and ``shortest`` words.

    The words behind us are cut into blocks of every size ``2^k``. The first half of any square of half-length
    ``2 * 2^k - 1`` to ``4 * 2^k - 2`` holds a whole block of that size, and the second half repeats it one half-length
    later. So when a block is complete its catcher waits for that range of distances: at every word appended, two catchers
    of each size compare their block with the suffix of equal size. Blocks in a row that are caught at one distance are
    squares of one stretch and merge; when the stretch ends, its ends are found word by word, and it is a run unless a
    run of a smaller period holds it. Suffixes are compared by hash; every stretch is then checked by its words.

    ``append`` takes any number of words at a time, to the same result. Memory grows with the words appended.
    """

    def __init__(self, exponent: int = 4, shortest: int = 6, longest: int | None = None):
        self.exponent, self.shortest, self.longest = exponent, shortest, longest
        self.n, self.words = 0, np.zeros(1024, np.int64)
        self.levels: list[tuple[int, np.ndarray]] = []  # first start kept, hashes of the windows from there
        self.open: list[dict[int, tuple[int, int]]] = []  # distance -> first and last block of the stretch
        self.ended: list[tuple[int, int, int, int]] = []  # distance, size, first and last block
        self.known: dict[int, tuple[list[int], list[int]]] = {}  # period -> starts and ends of runs, in order

    def append(self, words: np.ndarray) -> list[Run]:
        """The runs that are certain to have ended by now."""
        if not len(words):
            return []
        old, self.n = self.n, self.n + len(words)
        if self.n > len(self.words):
            self.words = np.concatenate([self.words[:old], np.empty(max(self.n, old), np.int64)])
        self.words[old : self.n] = words
        fresh, first, level = _mixed(words.astype(np.uint64)), old, 0
        while True:
            size = 1 << level
            if level == len(self.levels):
                self.levels.append((0, np.zeros(0, np.uint64)))
                self.open.append({})
            base, held = self.levels[level]
            held = np.concatenate([held, fresh])
            self._catch(level, first, base, held)
            up = max(0, old - 2 * size + 1)
            go_on = self.n >= 2 * size and (self.longest is None or 4 * size - 1 <= self.longest)
            if go_on:
                fresh = _mixed(held[up - base : self.n - 2 * size + 1 - base] * np.uint64(0x9E3779B97F4A7C15) + held[up + size - base : self.n - size + 1 - base])
            keep = max(base, self.n - 5 * size)
            self.levels[level] = (keep, held[keep - base :])
            if not go_on:
                break
            first, level = up, level + 1
        return self._settle(False)

    def finish(self) -> list[Run]:
        """The runs that reach the end, and those not told yet."""
        for level, at in enumerate(self.open):
            self.ended += [(p, 1 << level, a, b) for p, (a, b) in at.items()]
            at.clear()
        return self._settle(True)

    def _catch(self, level: int, first: int, base: int, held: np.ndarray) -> None:
        size, last = 1 << level, self.n - (1 << level)
        start = np.arange(max(first, 2 * size - 1), last + 1)
        found, at = [], self.open[level]
        if len(start):
            here, block = held[start - base], (start - 2 * size + 1) >> level
            for _ in range(2):
                ok = block >= 0
                ok[ok] = held[(block[ok] << level) - base] == here[ok]
                found.append(np.stack([start[ok] - (block[ok] << level), block[ok]]))
                block = block - 1
        p, b = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
        order = np.lexsort((b, p))
        p, b = p[order], b[order]
        new = np.ones(len(p), bool)
        new[1:] = (p[1:] != p[:-1]) | (b[1:] != b[:-1] + 1)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(p))[: len(heads)] - 1
        p, low, high = p[heads], b[heads], b[tails]
        newest = (last - p) >> level  # the last block that could be caught at this distance by now
        oldest = np.maximum(0, -((p - first) >> level))  # and the first that could be since the last call
        apart = (low > oldest) & (high < newest)
        whole = apart & (high - low + 1 >= self._needed(p, size))
        self.ended += [(int(w), size, int(x), int(y)) for w, x, y in zip(p[whole], low[whole], high[whole])]
        touched = {}
        for w, x, y in zip(p[~apart].tolist(), low[~apart].tolist(), high[~apart].tolist()):
            touched.setdefault(w, []).append((x, y))
        for w in [w for w in at if (last - w) >> level > at[w][1]]:
            a, z = at.pop(w)
            if w in touched and touched[w][0][0] == z + 1:
                touched[w][0] = (a, touched[w][0][1])
            else:
                self.ended.append((w, size, a, z))
        for w, stretches in touched.items():
            for x, y in stretches:
                if y >= (last - w) >> level:
                    at[w] = (x, y)
                else:
                    self.ended.append((w, size, x, y))

    def _needed(self, p, size: int):
        """Blocks in a row that a stretch of equal words at this distance must hold to be long enough."""
        return np.maximum(1, (np.maximum(self.exponent * p, self.shortest) - p - size + 1) // size)

    def _settle(self, at_end: bool) -> list[Run]:
        """Ended stretches whose smaller periods have all been told, by rising period."""
        ready, later = [], []
        for it in self.ended:
            p, size, a, b = it
            if b - a + 1 >= self._needed(p, size):
                (ready if at_end or self._end(p, size, b) + 2 * size <= self.n else later).append(it)
        self.ended, out = later, []
        for p, size, a, b in sorted(ready):
            x, y = a * size, (b + 1) * size
            if self._held(x, y + p, p):
                continue
            lo, hi = max(0, x - size), min(y + size, self.n - p)
            same = np.zeros(hi - lo + 2, np.int8)
            same[1:-1] = self.words[lo:hi] == self.words[lo + p : hi + p]
            turns = np.flatnonzero(np.diff(same)) + lo
            for s, e in zip(turns[::2].tolist(), turns[1::2].tolist()):
                length = e - s + p
                if length >= max(self.shortest, self.exponent * p) and not self._held(s, e + p, p, True):
                    starts, ends = self.known.setdefault(p, ([], []))
                    at = bisect_right(starts, s)
                    starts.insert(at, s)
                    ends.insert(at, e + p)
                    out.append(Run(s, length, p))
        return out

    def _end(self, p: int, size: int, last: int) -> int:
        """Where the words end that go on with this distance; a run of a smaller period that holds them ends there too, and has been caught two blocks later."""
        y = (last + 1) * size
        top = min(y + size, self.n - p)
        other = np.flatnonzero(self.words[y:top] != self.words[y + p : top + p])
        return (y + int(other[0]) if len(other) else max(y, top)) + p

    def _held(self, start: int, end: int, p: int, same: bool = False) -> bool:
        """Whether a run, of a period that divides ``p``, holds these words."""
        for q, (starts, ends) in self.known.items():
            if p % q == 0 and (q < p or same):
                at = bisect_right(starts, start) - 1
                if at >= 0 and ends[at] >= end:
                    return True
        return False


def runs_of(words: np.ndarray, exponent: int = 4, shortest: int = 6, step: int = 1 << 17) -> list[Run]:
    """The runs of one sequence, by start, then period."""
    catchers = Catchers(exponent, shortest, len(words) // exponent)
    out = []
    for at in range(0, len(words), step):
        out += catchers.append(words[at : at + step])
    return sorted(out + catchers.finish())


def runs_of_many(sequences: list[np.ndarray], exponent: int = 4, shortest: int = 6, most: int = 1 << 17) -> Iterator[list[Run]]:
    """The runs of each sequence. Short ones follow each other in one stream, parted by words that occur nowhere else."""
    at = 0
    while at < len(sequences):
        end, total = at, 0
        while end < len(sequences) and (end == at or total + len(sequences[end]) < most):
            total += len(sequences[end]) + 1
            end += 1
        group = sequences[at:end]
        if len(group) == 1:
            yield runs_of(group[0], exponent, shortest)
        else:
            parts, starts, place = [], [], 0
            for k, words in enumerate(group):
                starts.append(place)
                parts += [words, np.array([-1 - k], np.int64)]
                place += len(words) + 1
            catchers = Catchers(exponent, shortest, max(map(len, group)) // exponent)
            found: list[list[Run]] = [[] for _ in group]
            for run in catchers.append(np.concatenate(parts)) + catchers.finish():
                k = bisect_right(starts, run.start) - 1
                found[k].append(Run(run.start - starts[k], run.length, run.period))
            yield from map(sorted, found)
        at = end


def strongest(runs: list[Run]) -> Run | None:
    """The run of greatest length over period, compared exactly; ties by start, then period."""

    def order(a: Run, b: Run) -> int:
        return b.length * a.period - a.length * b.period or a.start - b.start or a.period - b.period

    return min(runs, key=cmp_to_key(order)) if runs else None


def kept_places(n: int, runs: list[Run]) -> np.ndarray:
    """Places of the words that stay when each run keeps its first period only."""
    keep = np.ones(n, bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return np.flatnonzero(keep)


def repeated_tail(n: int, doc_id) -> np.ndarray | None:
    """The contract's planted periods: places of the original words, for documents with ``crc32(doc_id) % 10 = 0``."""
    if n == 0 or doc_id is None:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def find_runs(docs: DataFrame, exponent: int = 4, shortest: int = 6, planted: bool = False) -> DataFrame:
    """A row per document: how many runs its words have, the strongest, and digests of all runs and of the words left.

    Words are parted by ASCII white space. Null and empty texts have no words, no runs, four nulls and the digests of the
    empty string. A null doc_id stays null, and nothing is planted in it. Repeated rows are each answered; an empty table
    gives no rows; other columns are left out. A text is one row and is held whole by its task; work grows with its
    words times their logarithm. With ``planted`` the periods of ``repeated_tail`` are put in first.
    """

    def answers(ids: list, texts: list) -> list[tuple]:
        number: dict[bytes, int] = {}
        words, seqs = [], []
        for doc_id, text in zip(ids, texts):
            w = text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []
            seq = np.fromiter((number.setdefault(x, len(number)) for x in w), np.int64, len(w))
            if planted and (places := repeated_tail(len(w), doc_id)) is not None:
                seq, w = seq[places], [w[k] for k in places.tolist()]
            words.append(w)
            seqs.append(seq)
        rows = []
        for doc_id, w, runs in zip(ids, words, runs_of_many(seqs, exponent, shortest)):
            best = strongest(runs)
            left = [w[k] for k in kept_places(len(w), runs).tolist()] if runs else w
            told = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
            rows.append((doc_id, len(runs), *((*best, 1000 * best.length // best.period) if best else (None,) * 4), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(left)).hexdigest()))
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        for batch in batches:
            ids, texts = [int(x) if isinstance(x, str) else None for x in batch["doc_id"].array], list(batch["text"].array)
            rows, at, size = [], 0, 0
            for k, text in enumerate(texts):
                size += len(text) if isinstance(text, str) else 0
                if size >= 2_000_000 or k + 1 == len(texts):
                    rows += answers(ids[at : k + 1], texts[at : k + 1])
                    at, size = k + 1, 0
            out = pd.DataFrame(rows, columns=names)
            for name in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli"):
                out[name] = out[name].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(run, SCHEMA)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_runs(table(spark, sf_dir, "documents"), planted=True)
