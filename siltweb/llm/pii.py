"""Personal data in text: exact base patterns, and a skip-chain conditional random field that keeps a document's labels consistent."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hashed_sample, table

BASE_KINDS = ("email", "ip", "card", "phone")
#: Secrets have no base pattern: the field alone finds them.
KINDS = (*BASE_KINDS, "secret")
LABELS = ("other", *KINDS)

# The base patterns of the contract. The look-behind of `ip` only spares restarts within a run of digits.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Mentions that say themselves what they are; they label the field's examples of secrets, and are not used to find any.
_NAMED = re.compile(r"""\b(?:token|secret|passw(?:or)?d|api[_-]?key|key|auth)["']?\s?[:=]\s?["']?([A-Za-z0-9+/_-]{16,})""", re.I)

_WORDLIKE = re.compile(r"[A-Za-z0-9+/_-]+")

#: Messages that change by no more have settled.
SETTLED = 1e-6

_SPACE = re.compile(r"\s")
_HIT = re.compile(r"[0-9@]+")
_EDGE = " \t\n\r\f\v.,;:!?\"'()[]{}<>"
_RUNS = re.compile(r"([0-9]+)|([^\W\d_]+)|(.)", re.S)


@dataclass(frozen=True)
class Settings:
    #: Documents, at most, that the field is fitted on.
    training_docs: int = 4000
    bits: int = 12
    epochs: int = 60
    rate: float = 0.5
    edge_rate: float = 0.2
    edge_decay: float = 2e-4
    #: Log-odds that a base span adds to its tokens, from which the field carries it on.
    evidence: float = 14.0
    decay: float = 2e-3
    #: Rounds of propagation in each epoch of training; afterwards they go on until messages settle.
    rounds: int = 8
    damping: float = 0.3
    #: Least posterior of a label for a span that the base patterns don't give.
    least: float = 0.9


Span = tuple[int, int, int]  # start, index of the kind, end


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if k % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The contract's spans: leftmost, non-overlapping for each kind, failing matches dropped; by start, then kind."""
    out: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def named_secrets(text: str) -> list[Span]:
    """Long words with digits and letters that are introduced by name."""
    return [(m.start(1), 4, m.end(1)) for m in _NAMED.finditer(text) if any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1])]


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


@dataclass
class Graph:
    """Tokens that hold a digit or an at sign, of many documents; all other tokens are `other` and only seen as context."""

    doc: list[int]
    start: list[int]
    end: list[int]
    features: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def _shape(token: str) -> str:
    return "".join(f"d{min(len(m[1]), 6)}" if m[1] else "x" if m[2] else m[3] for m in _RUNS.finditer(token[:60]))


def build_graph(texts: list[str | None], bits: int, context: bool = True) -> Graph:
    """Without ``context``, tokens are seen without the words before them. A chain edge joins neighbouring candidate tokens; a skip edge joins a token to the last one before it in its document that has the same digits, or the same letters if it has none."""
    g = Graph([], [], [], [], [], [])
    mask = (1 << bits) - 1
    hashed = lambda s: zlib.crc32(s.encode("utf-8", "surrogatepass")) & mask
    for i, text in enumerate(texts):
        if not isinstance(text, str) or not (first := _HIT.search(text)):
            continue
        flat = _SPACE.sub(" ", text)
        words: list[tuple[int, int]] = []
        hit, done = first, 0
        while hit:
            a = flat.rfind(" ", done, hit.start()) + 1 or done
            b = flat.find(" ", hit.end())
            b = len(flat) if b < 0 else b
            words.append((a, b))
            done = b
            hit = _HIT.search(flat, b)
        before: dict[str, int] = {}
        # a run of neighbouring candidates, eight at most, is judged by its digits together; chain edges go on past it
        k = 0
        while k < len(words):
            e = k + 1
            while e < len(words) and words[e][0] == words[e - 1][1] + 1 and e - k < 8:
                e += 1
            run = flat[words[k][0] : words[e - 1][1]]
            digits = "".join(c for c in run if "0" <= c <= "9")
            whole = [f"n{min(len(digits), 20)}", f"plus{run[:1] == '+'}", f"size{e - k}"]
            for j in range(k, e):
                a, b = words[j]
                raw = flat[a:b]
                token = raw.strip(_EDGE)
                own = "".join(c for c in token if "0" <= c <= "9")
                parts = token.split(".")
                names = [f"s:{_shape(token)}", f"c{min(len(own), 20)}", f"luhn{14 <= len(own) <= 19 and luhn(own)}", f"at{token.count('@')}"]
                names.append(f"ip{len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) < 4 and int(p) < 256 for p in parts)}")
                names.append(f"dot{'@' in token and '.' in token.rpartition('@')[2]}")
                runs = min(len(_RUNS.findall(token[:60])), 8)
                hexed = bool(token) and all(c in "0123456789abcdefABCDEF" for c in token)
                names += [f"runs{runs}", f"len{min(len(token) // 4, 12)}", f"hex{hexed}:{min(len(token) // 8, 6)}", f"mixed{hexed}:{runs}:{len(token) > 15}:{'@' in token}:{'.' in token}"]
                names += [f"w{j - k}:{x}" for x in whole]
                if j == k and context:
                    p = flat.rfind(" ", 0, max(0, a - 1)) + 1
                    q = flat.rfind(" ", 0, max(0, p - 1)) + 1
                    names.append("p:" + flat[p : max(0, a - 1)][-20:].lower().strip(_EDGE))
                    names.append("q:" + flat[q : max(0, p - 1)][-20:].lower().strip(_EDGE))
                g.doc.append(i)
                g.start.append(a)
                g.end.append(b)
                g.features.append([hashed(x) for x in names])
                here = len(g.doc) - 1
                if j > k or k and words[k][0] == words[k - 1][1] + 1:
                    g.chain.append((here - 1, here))
                key = own if len(own) >= 4 else token.casefold()
                if key in before:
                    g.skip.append((before[key], here))
                before[key] = here
            k = e
    return g


@dataclass(frozen=True)
class Field:
    emit: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def propagate(field: Field, g: Graph, rounds: int | None, damping: float, evidence: np.ndarray | None = None):
    """Loopy sum-product over all documents at once: posteriors of tokens, of chain edges and of skip edges.

    Without ``rounds`` each document goes on until its messages settle; only loops that never settle end after twice as
    many rounds as it takes to cross all tokens.
    """
    n, y = len(g.doc), len(LABELS)
    counts = np.array([len(f) for f in g.features])
    flat = np.fromiter((x for f in g.features for x in f), np.int64, counts.sum())
    unary = np.add.reduceat(field.emit[flat], np.cumsum(counts) - counts, axis=0)
    if evidence is not None:
        unary = unary + evidence
    chain, skip = np.array(g.chain, np.int64).reshape(-1, 2), np.array(g.skip, np.int64).reshape(-1, 2)
    pairs = np.concatenate([chain, skip])
    theta = np.concatenate([np.broadcast_to(field.chain, (len(chain), y, y)), np.broadcast_to(field.skip, (len(skip), y, y))])
    src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    both = np.concatenate([theta, theta.transpose(0, 2, 1)])
    m, turned = np.zeros((len(src), y)), np.roll(np.arange(len(src)), len(pairs))
    belief = unary.copy()
    doc = np.array(g.doc, np.int64)[src] if len(src) else src
    act = np.arange(len(src))
    for _ in range(0 if not len(pairs) else 2 * n + 50 if rounds is None else rounds):
        out = (belief[src[act]] - m[turned[act]])[:, :, None] + both[act]
        top = out.max(1, keepdims=True)
        new = np.log(np.exp(out - top).sum(1)) + top[:, 0]
        new = damping * m[act] + (1 - damping) * (new - new.max(1, keepdims=True))
        moved = np.abs(new - m[act]).max(1) > SETTLED
        m[act] = new
        nodes, place = np.unique(dst[act], return_inverse=True)
        for k in range(y):
            belief[nodes, k] = unary[nodes, k] + np.bincount(place, new[:, k], len(nodes))
        if rounds is None:
            act = act[np.isin(doc[act], doc[act[moved]])]
            if not len(act):
                break
    post = np.exp(belief - belief.max(1, keepdims=True))
    post /= post.sum(1, keepdims=True)
    joint = np.zeros((len(pairs), y, y))
    if len(pairs):
        e = len(pairs)
        joint = (belief[src[:e]] - m[e:])[:, :, None] + (belief[dst[:e]] - m[:e])[:, None, :] + theta
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        joint /= joint.sum((1, 2), keepdims=True)
    return post, joint[: len(chain)], joint[len(chain) :], (flat, counts)


def base_labels(g: Graph, spans: list[list[Span]]) -> np.ndarray:
    """The label that the base spans give each token; 0 where none touches it."""
    gold, doc, at = np.zeros(len(g.doc), np.int64), -1, 0
    for k, (d, a, b) in enumerate(zip(g.doc, g.start, g.end)):
        if d != doc:
            doc, at = d, 0
        while at < len(spans[d]) and spans[d][at][2] <= a:
            at += 1
        for s, kind, e in spans[d][at : at + 4]:
            if s < b and a < e:
                gold[k] = kind + 1
    return gold


def fit(texts: list[str], how: Settings) -> Field:
    """Fit by gradient on the conditional likelihood, with beliefs from loopy propagation for the expectations.

    The base patterns and secrets introduced by name give the labels. Every second round of training hides the words
    before the tokens, so that the field also learns to do without them.
    """
    y = len(LABELS)
    field = Field(np.zeros((1 << how.bits, y)), np.zeros((y, y)), np.eye(y))
    graphs = [build_graph(texts, how.bits, context) for context in (True, False)]
    g = graphs[0]
    if not g.doc:
        return field
    gold = base_labels(g, [sorted(base_spans(t) + named_secrets(t)) for t in texts])
    seen, seen_edges = np.full_like(field.emit, 1e-2), np.full((2, y, y), 1e-2)
    chain, skip = np.array(g.chain, np.int64).reshape(-1, 2), np.array(g.skip, np.int64).reshape(-1, 2)
    for k in range(how.epochs):
        post, on_chain, on_skip, (flat, counts) = propagate(field, graphs[k % 2], how.rounds, how.damping)
        error = -post
        error[np.arange(len(gold)), gold] += 1
        each = np.repeat(error, counts, axis=0)
        change = np.stack([np.bincount(flat, each[:, k], 1 << how.bits) for k in range(y)], 1)
        seen += change**2
        emit = (field.emit + how.rate * change / np.sqrt(seen)) * (1 - how.decay)
        tables = []
        for old, edges, joint, past in ((field.chain, chain, on_chain, seen_edges[0]), (field.skip, skip, on_skip, seen_edges[1])):
            step = -joint.sum(0)
            np.add.at(step, (gold[edges[:, 0]], gold[edges[:, 1]]), 1)
            past += step**2
            tables.append((old + how.edge_rate * step / np.sqrt(past)) * (1 - how.edge_decay))
        field = Field(emit, tables[0], tables[1])
    return field


def train(docs: DataFrame, how: Settings = Settings()) -> Field:
    """Fit on the ``training_docs`` with the smallest hashes among those that hold a digit or an at sign and are shorter than 20,000 characters."""
    some = docs.where(F.col("text").rlike("[0-9@]") & (F.length("text") < 20_000)).select("doc_id", "text")
    return fit([r["text"] for r in hashed_sample(some, F.col("doc_id"), how.training_docs, "pii").collect()], how)


def find(field: Field, texts: list[str | None], how: Settings = Settings()) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text. The field adds tokens that it labels surely and that touch no base span; neighbours of one label form one span."""
    base = [base_spans(t) if isinstance(t, str) else [] for t in texts]
    added: list[list[Span]] = [[] for _ in texts]
    g = build_graph(texts, how.bits)
    if g.doc:
        given = base_labels(g, base)
        evidence = np.zeros((len(given), len(LABELS)))
        evidence[np.flatnonzero(given), given[given > 0]] = how.evidence
        post = propagate(field, g, None, how.damping, evidence)[0]
        for k in np.flatnonzero(post[:, 0] < 1 - how.least):
            kind = int(post[k, 1:].argmax())
            if post[k, kind + 1] < how.least:
                continue
            d, a, b = g.doc[k], g.start[k], g.end[k]
            text = texts[d]
            while a < b and text[a] in _EDGE:
                a += 1
            while a < b and text[b - 1] in _EDGE:
                b -= 1
            if kind == 4 and (core := max(_WORDLIKE.finditer(text, a, b), key=lambda m: m.end() - m.start(), default=None)):
                a, b = core.span()
            if a == b or any(s < b and a < e for s, _, e in base[d]):
                continue
            near = added[d]
            if near and near[-1][1] == kind and a - near[-1][2] <= 2:
                near[-1] = (near[-1][0], kind, b)
            else:
                near.append((a, kind, b))
    return [(x, sorted(x + more)) for x, more in zip(base, added)]


def _in_parts(texts: list, most: int = 2_000_000) -> Iterator[tuple[int, list]]:
    start, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t) if isinstance(t, str) else 0
        if held >= most:
            yield start, texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]


def detect(docs: DataFrame, field: Field, how: Settings = Settings()) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row's whole text.

    Counts and digest are of the base spans; ``spans`` also holds the field's, of these kinds and of secrets. Offsets count code points. Null text is
    empty. Repeated rows are each answered; an empty table gives no rows; other columns are left out. A token that
    repeats many times is linked to its last occurrence only, so edges grow with the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for _, texts in _in_parts(list(batch["text"].array)):
                for base, spans in find(shared.value, texts, how):
                    rows.append((*(sum(k == kind for _, k, _ in base) for kind in range(4)), hashlib.sha256(shown(base).encode()).hexdigest(), shown(spans)))
            out = pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])
            out.insert(0, "doc_id", batch["doc_id"].array)
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, field: Field, how: Settings = Settings()) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind in brackets; overlapping spans by the first's."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def masked(text: str | None, spans: list[Span]) -> str | None:
        if not spans:
            return text
        out, at = [], 0
        for a, k, b in spans:
            if a >= at:
                out += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = max(at, b)
        return "".join(out) + text[at:]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(batch["text"].array)
            new = []
            for _, part in _in_parts(texts):
                new += [masked(t, spans) for t, (_, spans) in zip(part, find(shared.value, part, how))]
            yield batch.assign(text=pd.Series(new, dtype=object, index=batch.index))

    return docs.mapInPandas(run, docs.schema)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return detect(docs, train(docs.select("doc_id", "text")))
