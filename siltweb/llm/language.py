"""Language identification: a linear-chain conditional random field labels the words of code-switched text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[]^_`{|}~«»„“”‚‘’¡¿…–—0123456789"


@dataclass(frozen=True)
class Training:
    #: Documents of each language, at most, that the field is fitted on; everything else sees the whole corpus.
    docs_per_language: int = 250
    #: Words taken from a training document, spread over it in runs.
    words_per_doc: int = 400
    run: int = 16
    epochs: int = 4
    batch: int = 64
    rate: float = 0.05
    decay: float = 1e-5
    bits: int = 16
    seed: int = 7
    #: The pipeline rejects documents below this mean posterior.
    min_score: float = 0.5


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def word_features(words: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words at once, ``(hashes, first feature of each word)``.

    Character n-grams of one to four within the marked word: those at its ends are its affixes. The whole word is one
    more, which is its place in the lexicon. Words without letters have the end marks alone.
    """
    text = "".join("\x02" + w.strip(_EDGES).lower() + "\x03" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    starts = np.flatnonzero(codes == 2)
    word = np.cumsum(codes == 2) - 1
    n, mix = len(codes), np.uint64(0x9E3779B97F4A7C15)
    gram, features, owners = np.zeros(n, np.uint64), [], []
    for size in range(1, 5):
        if n < size:
            break
        gram = (gram[: n - size + 1] * np.uint64(1_000_003) + codes[size - 1 :] + np.uint64(size)) * mix
        inside = word[: n - size + 1] == word[size - 1 :]
        features.append(gram[inside])
        owners.append(word[: n - size + 1][inside])
    place = np.arange(n, dtype=np.uint64) - starts[word].astype(np.uint64)
    whole = np.add.reduceat((codes + np.uint64(7)) * mix * (place * np.uint64(2) + np.uint64(1)) ** np.uint64(3), starts)
    features.append(whole * np.uint64(0xC2B2AE3D27D4EB4F))
    owners.append(np.arange(len(starts)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    hashed = (np.concatenate(features)[order] >> np.uint64(64 - bits)).astype(np.int64)
    first = np.searchsorted(owner[order], np.arange(len(starts)))
    return hashed, first


def forward_backward(score: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the labels of many chains laid end to end, and the summed posterior moves.

    ``score``: exponentiated emissions, a row for each word; ``move``: exponentiated transitions. Chains advance together,
    longest first, each step over those that are still running; values are rescaled at every step.
    """
    order = np.argsort(-lengths, kind="stable")
    sizes, begin = lengths[order], (np.cumsum(lengths) - lengths)[order]
    longest = int(sizes[0]) if len(sizes) else 0
    running = np.searchsorted(-sizes, -np.arange(longest), side="left")
    ahead = np.empty_like(score)
    state = None
    for t in range(longest):
        at = begin[: running[t]] + t
        now = score[at] if t == 0 else (state[: running[t]] @ move) * score[at]
        state = now / now.sum(1, keepdims=True)
        ahead[at] = state
    moves = np.zeros_like(move)
    back = np.ones((len(sizes), score.shape[1]), score.dtype)
    for t in range(longest - 1, 0, -1):
        k = running[t]
        at = begin[:k] + t
        seen = back[:k] * score[at]
        before = ahead[at - 1]
        joint = before.T @ (seen / np.einsum("ni,ij,nj->n", before, move, seen)[:, None]) * move
        moves += joint
        new = seen @ move.T
        back[:k] = new / new.sum(1, keepdims=True)
        ahead[at - 1] = before * back[:k]
    return ahead / ahead.sum(1, keepdims=True) if len(ahead) else ahead, moves


def posteriors(score: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> np.ndarray:
    """As forward_backward, without the moves."""
    order = np.argsort(-lengths, kind="stable")
    sizes, begin = lengths[order], (np.cumsum(lengths) - lengths)[order]
    longest = int(sizes[0]) if len(sizes) else 0
    running = np.searchsorted(-sizes, -np.arange(longest), side="left")
    ahead, state = np.empty_like(score), None
    for t in range(longest):
        at = begin[: running[t]] + t
        state = score[at] if t == 0 else (state[: running[t]] @ move) * score[at]
        state /= state.sum(1, keepdims=True)
        ahead[at] = state
    back, turned = np.ones((len(sizes), score.shape[1]), score.dtype), move.T.copy()
    for t in range(longest - 1, 0, -1):
        k = running[t]
        at = begin[:k] + t
        new = (back[:k] * score[at]) @ turned
        new /= new.sum(1, keepdims=True)
        back[:k] = new
        ahead[at - 1] *= new
    ahead /= ahead.sum(1, keepdims=True)
    return ahead


@dataclass(frozen=True)
class Field:
    labels: tuple[str, ...]
    emit: np.ndarray
    move: np.ndarray
    bits: int

    def emissions(self, words: list[str]) -> np.ndarray:
        hashed, first = word_features(words, self.bits)
        return np.add.reduceat(self.emit[hashed], first, axis=0)


def fit(texts: list[str], langs: list[str], how: Training) -> Field:
    """Fit by stochastic gradient on the conditional likelihood. Training chains splice runs of documents of all languages, so that the field learns when text switches."""
    labels = tuple(sorted(set(langs)))
    rng = np.random.default_rng(how.seed)
    runs: list[tuple[int, list[str]]] = []
    for text, lang in zip(texts, langs):
        words = text.split()
        pieces = [words[i : i + how.run] for i in range(0, len(words), how.run)]
        keep = max(1, how.words_per_doc // how.run)
        picked = rng.permutation(len(pieces))[:keep]
        runs += [(labels.index(lang), pieces[i]) for i in picked]
    emit = np.zeros((1 << how.bits, len(labels)), np.float32)
    seen = np.zeros_like(emit)
    move = np.eye(len(labels), dtype=np.float64)
    for _ in range(how.epochs if len(labels) > 1 else 0):
        order = rng.permutation(len(runs))
        per = how.batch * 4
        for b in range(0, len(order), per):
            chosen = [runs[i] for i in order[b : b + per]]
            words = [w for _, ws in chosen for w in ws]
            gold = np.array([y for y, ws in chosen for _ in ws])
            chains = [chosen[i : i + 4] for i in range(0, len(chosen), 4)]
            lengths = np.array([sum(len(ws) for _, ws in c) for c in chains])
            hashed, first = word_features(words, how.bits)
            raw = np.add.reduceat(emit[hashed], first, axis=0).astype(np.float64)
            post, moves = forward_backward(np.exp(raw - raw.max(1, keepdims=True)), lengths, np.exp(move))
            error = -post
            error[np.arange(len(gold)), gold] += 1
            counts = np.diff(np.append(first, len(hashed)))
            each = np.repeat(error, counts, axis=0).astype(np.float32)
            change = np.stack([np.bincount(hashed, each[:, y], 1 << how.bits) for y in range(len(labels))], 1).astype(np.float32)
            seen += change**2
            emit += how.rate * change / (np.sqrt(seen) + 1e-2)
            emit *= 1 - how.decay
            real = np.zeros_like(move)
            ends = np.cumsum(lengths)[:-1]
            follows = np.ones(len(gold) - 1, bool)
            follows[ends - 1] = False
            np.add.at(real, (gold[:-1][follows], gold[1:][follows]), 1)
            move += how.rate * (real - moves) / max(1, follows.sum()) * 10
    return Field(labels, emit, move, how.bits)


def train(docs: DataFrame, how: Training = Training()) -> Field:
    """Fit on a bounded sample of the labelled rows that aren't held out: of each language, the ``docs_per_language`` with the smallest hashes.

    Counts of languages come first, then one pass takes each language's share of small hashes and cuts it to the number.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out(F.col("doc_id")))
    draw = F.crc32(F.concat(F.lit("train:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    share = known.groupBy("lang").count().select("lang", F.least(F.lit(1.0), 1.5 * how.docs_per_language / F.col("count")).alias("share"))
    few = known.select("lang", "text", draw.alias("draw")).join(F.broadcast(share), "lang").where(F.col("draw") < F.col("share") * float(1 << 32))
    order = Window.partitionBy("lang").orderBy("draw", "text")
    some = few.withColumn("place", F.row_number().over(order)).where(F.col("place") <= how.docs_per_language)
    rows = some.orderBy("lang", "place").select("lang", "text").collect()
    return fit([r["text"] for r in rows], [r["lang"] for r in rows], how)


class _Rows:
    """Emission rows of words, remembered up to a bounded number of words."""

    def __init__(self, field: Field, most: int):
        self.field, self.most = field, most
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(field.labels)), np.float32)

    def full(self) -> bool:
        return len(self.known) > self.most

    def clear(self) -> None:
        self.known.clear()
        self.rows = self.rows[:0]

    def index(self, words: list[str]) -> np.ndarray:
        known = self.known
        return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))

    def emitted(self, index: np.ndarray, at_once: int = 10_000) -> np.ndarray:
        fresh = list(islice(reversed(self.known), len(self.known) - len(self.rows)))[::-1]
        new = [self.rows]
        for k in range(0, len(fresh), at_once):  # their n-grams take most memory
            raw = self.field.emissions(fresh[k : k + at_once])
            new.append(np.exp(raw - raw.max(1, keepdims=True)).astype(np.float32) + np.float32(1e-12))
        self.rows = np.concatenate(new) if len(new) > 1 else self.rows
        return self.rows[index]


def _word_runs(text: str, chars: int) -> Iterator[list[str]]:
    """The words of a text, those of some ``chars`` at a time."""
    at = 0
    while at < len(text):
        end = at + chars
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end].split()
        at = end


def label_texts(field: Field, texts: Iterable[str | None], words_at_once: int = 300_000, cached: int = 250_000) -> Iterator[tuple[int, str, float]]:
    """``(index, language, score)`` of each text: the label of the largest mean posterior over its words, ties to the first label.

    Words are turned into numbers as texts come, so what is held of a text is four bytes a word. Chains of like lengths
    wait for each other and advance together, some ``words_at_once``; a longer text is a chain alone.
    """
    move, rows = np.exp(field.move).astype(np.float32), _Rows(field, cached)
    waiting: dict[int, list[tuple[int, np.ndarray]]] = {}
    held: dict[int, int] = {}

    def flush(classes: list[int]):
        for c in classes:
            some = waiting.pop(c)
            held.pop(c)
            lengths = np.array([len(x) for _, x in some])
            post = posteriors(rows.emitted(np.concatenate([x for _, x in some])), lengths, move)
            mean = np.add.reduceat(post, np.cumsum(lengths) - lengths, axis=0, dtype=np.float64) / lengths[:, None]
            for (i, _), k, m in zip(some, mean.argmax(1), mean):
                yield i, field.labels[k], float(min(1.0, m[k]))

    for i, text in enumerate(texts):
        if not isinstance(text, str) or not field.labels or not _LETTER.search(text):
            yield i, UNDETERMINED, 0.0
            continue
        if rows.full():
            yield from flush(list(waiting))
            rows.clear()
        index = np.concatenate([rows.index(w) for w in _word_runs(text, 400_000)])
        c = len(index).bit_length()
        waiting.setdefault(c, []).append((i, index))
        held[c] = held.get(c, 0) + len(index)
        if held[c] >= words_at_once:
            yield from flush([c])
    yield from flush(list(waiting))


def identify(docs: DataFrame, field: Field) -> DataFrame:
    """All rows and columns of ``docs``, with ``lang_pred`` and ``score`` (any columns of these names are replaced).

    The whole text is labelled word by word; a document's language is the label with the largest mean posterior, which is
    its score; ties go to the alphabetically first. Null texts and those without letters are ``und`` with score 0, and so
    is everything where there was nothing to learn from. Repeated rows are labelled alike. An empty table gives no rows.
    Only texts are looked at; all other columns pass as they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kept = docs.drop("lang_pred", "score")
    schema = kept.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [""] * batch.num_rows, [0.0] * batch.num_rows
            for i, lang, score in label_texts(shared.value, (t.as_py() for t in batch.column("text"))):
                langs[i], scores[i] = lang, score
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
