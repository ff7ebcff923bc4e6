"""Best-fit packing of tokenized documents into fixed-length sequences, by hierarchical residual packing."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table


@dataclass(frozen=True)
class Packing:
    capacity: int = 4096
    #: Bins at least this full are emitted as they are; the others travel up the tree as items.
    nearly_full: float = 0.995
    #: Underfull bins that one task of a merge round gets.
    bins_per_task: int = 50_000
    tokenizer: str = "word_bpe_49k.json"
    end_id: int = 1
    cached_words: int = 500_000


class _Filled(dict):
    """Values made by a function when they are first asked for."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        value = self[key] = self.make(key)
        return value


class WordEncoder:
    """Ids of texts, exactly those of the library's tokenizer, with whole words remembered.

    The tokenizer never looks across white space (its pattern's pieces hold none, and NFC and lower-casing don't join
    across it), so a text's ids are those of its words in turn. Texts with the control characters that Python, but not
    the tokenizer, splits at go through the tokenizer whole, as do words that hold a special token, a capital sigma or a
    letter whose case mapping is longer than itself.
    """

    _odd = re.compile("[\x1c-\x1f]")
    _direct = re.compile(r"<\||[^\x00-˿‐-⁄]")

    def __init__(self, name: str, limit: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.model, self.limit = self.tokenizer.model, limit
        self.words, self.pieces = _Filled(self._word), _Filled(self._piece)
        # The pattern in the tokenizer's file.
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = iter(range(256, 512))
        self.byte = {b: chr(b if b in set(printable) else next(rest)) for b in range(256)}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        shown = piece if piece.isascii() and piece.isprintable() else "".join([self.byte[b] for b in piece.encode()])
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])

    def _word(self, word: str) -> bytes:
        if self._direct.search(word):
            return self._whole(word)
        pieces = self.pieces
        return b"".join([pieces[p] for p in self.split((word if word.isascii() else unicodedata.normalize("NFC", word)).lower())])

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        if self._odd.search(text):
            return self._whole(text)
        for known in (self.words, self.pieces):
            if len(known) > self.limit:
                known.clear()
        return b"".join(map(self.words.__getitem__, text.split()))


def best_fit(sizes: Iterable[int], capacity: int) -> list[tuple[int, int]]:
    """``(bin, offset)`` of each item, largest first, each into the open bin that it fills best; ties go to the first item and the last opened bin.

    Open bins stand in one stack for each size of gap; a bit mask finds the smallest gap that is large enough.
    """
    sizes = list(sizes)
    gaps: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins, out = 0, 0, [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        if fits := mask >> size:
            gap = size + (fits & -fits).bit_length() - 1
            b = gaps[gap].pop()
            if not gaps[gap]:
                mask &= ~(1 << gap)
        else:
            gap, b, bins = capacity, bins, bins + 1
        out[i] = (b, capacity - gap)
        if left := gap - size:
            gaps[left].append(b)
            mask |= 1 << left
    return out


def _pack_partition(how: Packing):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, rows, end = WordEncoder(how.tokenizer, how.cached_words), [], how.end_id.to_bytes(4, "little")
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].array, batch["text"].array):
                ids = np.frombuffer((encoder.encode(text) if isinstance(text, str) else b"") + end, "<u4")
                for k, start in enumerate(range(0, len(ids), how.capacity)):
                    part = ids[start : start + how.capacity]
                    rows.append((doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
        if not rows:
            return
        first = TaskContext.get().partitionId() << 32
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
        place = best_fit(out["length"].tolist(), how.capacity)
        yield out.assign(bin=[first + b for b, _ in place], place=[o for _, o in place])

    return run


def _merge_partition(how: Packing):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins = pd.concat(list(batches) or [pd.DataFrame({"bin": [], "fill": []})]).sort_values(["fill", "bin"], ascending=[False, True])
        if not len(bins):
            return
        place = best_fit(bins["fill"].tolist(), how.capacity)
        own = bins["bin"].tolist()
        parent: dict[int, int] = {}
        for (b, offset), name in zip(place, own):
            if offset == 0:
                parent[b] = name
        yield pd.DataFrame({"bin": own, "parent": [parent[b] for b, _ in place], "base": [o for _, o in place]})

    return run


def pack(docs: DataFrame, how: Packing = Packing()) -> DataFrame:
    """Place every document's pieces: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    Each scan partition tokenizes its documents and packs them best-fit. Bins that are nearly full are done. Underfull
    ones become items of the next round, in which fewer tasks each merge up to ``bins_per_task`` of them, until one task
    has seen all that is left. Only bin numbers and fills travel; texts and ids are read once.

    Null text is an empty document: one piece holding only ``end_id``. Documents of more than ``capacity`` tokens are cut
    into full pieces, of which the last may be shorter. Repeated rows are packed once each; ties in size keep row order.
    A null doc_id is kept. An empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long"
    placed = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(_pack_partition(how), schema), "packed")
    bins = placed.groupBy("bin").agg(F.sum("length").alias("fill")).where(F.col("fill") < how.capacity * how.nearly_full)
    bins = materialize(bins, "underfull")
    moves, waiting, tasks = None, bins.count(), None
    while waiting > 1:
        wanted = -(-waiting // how.bins_per_task)
        tasks = wanted if tasks is None else max(1, min(wanted, tasks // 2))
        merged = materialize(bins.coalesce(tasks).mapInPandas(_merge_partition(how), "bin long, parent long, base long"), "merged")
        if moves is None:
            moves = merged
        else:
            up = merged.select(F.col("bin").alias("parent"), F.col("parent").alias("top"), F.col("base").alias("more"))
            moves = materialize(moves.join(up, "parent", "left").select("bin", F.coalesce("top", "parent").alias("parent"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base")), "moves")
        if tasks == 1:
            break
        bins = bins.join(merged, "bin").groupBy(F.col("parent").alias("bin")).agg(F.sum("fill").alias("fill")).where(F.col("fill") < how.capacity * how.nearly_full)
        bins = materialize(bins, "underfull")
        waiting = bins.count()
    if moves is None:
        moves = spark.createDataFrame([], "bin long, parent long, base long")
    out = placed.join(moves, "bin", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("parent", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("base", F.lit(0))).alias("offset"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
