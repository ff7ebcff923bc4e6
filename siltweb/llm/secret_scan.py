"""Secrets in text: exact base patterns, and corpus-wide ownership that parts copied examples from credentials of one owner."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

BASE_KINDS = ("assign", "access", "hex")
#: Words that the base patterns don't give and that ownership and look mark as credentials.
KINDS = (*BASE_KINDS, "live")

# The base patterns of the contract; that of `hex` asks for its least length at once.
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20, "hex": 24}

_WORD = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
#: Parts of values that are meant to be replaced.
PLACEHOLDERS = ("example", "sample", "dummy", "changeme", "placeholder", "your", "xxxx", "test", "redacted", "1234567")


@dataclass(frozen=True)
class Settings:
    #: A value that so many owners hold is an example that is passed on.
    owners: int = 3
    #: So is one of several owners that so many repositories hold.
    repositories: int = 20
    #: Least length and least number of different characters of a value that looks like a credential.
    length: int = 16
    different: int = 9


Span = tuple[int, int, int, str]  # start, index of the kind, end, value


def base_spans(text: str) -> list[Span]:
    """The contract's spans: leftmost, non-overlapping for each kind, failing matches dropped; by start, then kind."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def other_words(text: str, base: list[Span]) -> list[Span]:
    """Long words of upper and lower case letters and digits that touch no base span: what might be a credential."""
    out, at, reach = [], 0, 0
    for m in _WORD.finditer(text):
        a, z = m.span()
        while at < len(base) and base[at][0] < z:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= a and re.search("[0-9]", m[0]) and re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]):
            out.append((a, 3, z, m[0]))
    return out


def looks_live(value: str, how: Settings = Settings()) -> bool:
    """Long, of many different characters, and no placeholder."""
    small = value.lower()
    return len(value) >= how.length and len(set(value)) >= how.different and not any(p in small for p in PLACEHOLDERS)


def shown(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z, _ in spans)


CANDIDATES = "candidates array<struct<start: long, kind: int, end: long, value: binary, live: boolean>>"


def scan(docs: DataFrame, owner: str, repository: str, how: Settings = Settings()) -> DataFrame:
    """Each row's id, owner and repository, the digest of its base spans and its ``candidates``; a value is the SHA-256 of its text.

    Offsets count code points. Null text is empty. Whole texts, whatever their length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"].array:
                text = text if isinstance(text, str) else ""
                base = base_spans(text)
                both = sorted(base + other_words(text, base))
                found = [{"start": a, "kind": k, "end": z, "value": hashlib.sha256(v.encode()).digest(), "live": looks_live(v, how)} for a, k, z, v in both]
                rows.append((*(sum(s[1] == k for s in base) for k in range(3)), hashlib.sha256(shown(base).encode()).hexdigest(), found))
            out = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "candidates"])
            for at, name in enumerate(("doc_id", "owner", "repository")):
                out.insert(at, name, batch[name])
            yield out

    rows = docs.select(*(F.col(c).cast("string").alias(name) for c, name in (("doc_id", "doc_id"), (owner, "owner"), (repository, "repository"))), "text")
    found = rows.mapInPandas(run, f"doc_id string, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, {CANDIDATES}")
    return found.withColumn("doc_id", F.col("doc_id").cast("long"))


def ownership(found: DataFrame, how: Settings = Settings()) -> DataFrame:
    """``value, owners, repositories, copied`` of candidates ``value, owner, repository``.

    Distinct owners and repositories are made by groups of the whole triple first, so no hot value or owner is gathered;
    counts of owners are sums over what each task has summed. Rows without an owner are together one owner; a repository is
    one of its owner's.
    """
    triples = found.groupBy("value", "owner", "repository").agg(F.lit(1).alias("one"))
    pairs = triples.groupBy("value", "owner").agg(F.sum("one").alias("repositories"))
    counts = pairs.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    copied = (F.col("owners") >= how.owners) | ((F.col("owners") > 1) & (F.col("repositories") >= how.repositories))
    return counts.withColumn("copied", copied)


def judge(scanned: DataFrame, how: Settings = Settings()) -> DataFrame:
    """A row per candidate: ``row, doc_id, start, kind, end, value, owners, repositories, verdict``.

    A value is ``example`` if it is copied, ``live`` if it looks like a credential and few own it, else ``weak``. The
    join on values has plain exchanges on both sides, so adaptive execution splits a value that a third of the rows hold.
    """
    each = scanned.select("row", "doc_id", "owner", "repository", F.explode("candidates").alias("c")).select("row", "doc_id", "owner", "repository", "c.*")
    owned = ownership(each.select("value", "owner", "repository"), how)
    verdict = F.when(F.col("copied"), "example").when(F.col("live"), "live").otherwise("weak")
    return each.join(owned, "value").select("row", "doc_id", "start", "kind", "end", "value", "owners", "repositories", verdict.alias("verdict"))


def find_secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", how: Settings = Settings()) -> DataFrame:
    """A row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, live``.

    Counts and digest are of the base spans. ``spans`` also holds the words that only ownership and look mark as
    credentials, as kind ``live``; ``live`` are all spans, base ones included, whose value is judged so, and ``n_example``
    counts those that are copied. Every document is a repository of its ``owner`` unless a column names it; rows without an
    owner are of one nameless one.
    Repeated rows are each answered, and are one repository; null ids are one repository of each owner; null and empty
    texts have no spans; an empty table gives no rows; other columns are left out. What a document gathers are its own
    candidates only.
    """
    scanned = materialize(scan(docs, owner, repository, how).withColumn("row", F.monotonically_increasing_id()), "secret-scan")
    some = scanned.where(F.size("candidates") > 0)
    judged = judge(some, how)
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    told = F.concat_ws(":", name, F.col("start"), F.col("end"))
    item = F.struct("start", "kind", "end", told.alias("told"), "verdict")
    spans = judged.where((F.col("kind") < 3) | (F.col("verdict") == "live")).groupBy("row").agg(F.array_sort(F.collect_list(item)).alias("s"))
    joined = lambda s: F.array_join(F.transform(s, lambda x: x["told"]), ",")
    live = F.filter("s", lambda x: x["verdict"] == "live")
    example = F.filter("s", lambda x: x["verdict"] == "example")
    spans = spans.select("row", joined(F.col("s")).alias("spans"), joined(live).alias("live"), F.size(live).cast("long").alias("n_live"), F.size(example).cast("long").alias("n_example"))
    head = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"]
    n = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    s = lambda c: F.coalesce(c, F.lit("")).alias(c)
    with_some = some.join(spans, "row", "left").select(*head, s("spans"), n("n_live"), n("n_example"), s("live"))
    without = scanned.where(F.size("candidates") == 0).select(*head, F.lit("").alias("spans"), *(F.lit(0).cast("long").alias(c) for c in ("n_live", "n_example")), F.lit("").alias("live"))
    return with_some.unionByName(without)


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def oracle(how: Settings = Settings()) -> str:
    """The same by splitting texts at the matches: the lengths of gaps and matches give the places."""
    both = lambda word: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    names = "|".join((both("password"), both("passwd"), both("secret"), both("token"), "[Aa][Pp][Ii]_?[Kk][Ee][Yy]"))
    assign = f"""({names})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    word = "[A-Za-z0-9+/_-]{20,}={0,2}"
    kinds = (("assign", assign, 2), ("access", "AKIA[A-Z0-9]+", 0), ("hex", "[0-9a-f]{24,}", 0), ("live", word, 0))

    def matches(k: int, kind: str, pattern: str, group: int) -> str:
        pieces = f"string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS hits, regexp_extract_all(text, '{pattern}', {group}) AS vals"
        least = LEAST.get(kind, 0)
        return f"""
        SELECT r, doc_id, source, {k} AS kind, '{kind}' AS name, e - length(hit) AS a, e AS z, val FROM (
            SELECT r, doc_id, source, hits[i] AS hit, vals[i] AS val,
                list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(hits[1:i], lambda x: length(x))) AS e
            FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT r, doc_id, source, {pieces} FROM docs)))
        WHERE length(val) >= {least}"""

    placeholders = " AND ".join(f"NOT contains(lower(val), '{p}')" for p in PLACEHOLDERS)
    return f"""
    WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
    found AS MATERIALIZED ({" UNION ALL ".join(matches(k, *kind) for k, kind in enumerate(kinds))}),
    base AS (SELECT * FROM found WHERE kind < 3),
    cand AS MATERIALIZED (
        SELECT * FROM base UNION ALL
        SELECT * FROM found f WHERE kind = 3 AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[a-z]') AND regexp_matches(val, '[A-Z]')
            AND NOT EXISTS (SELECT 1 FROM base b WHERE b.r = f.r AND b.a < f.z AND f.a < b.z)),
    owned AS (
        SELECT val, count(*) AS owners, sum(n) AS repositories FROM (
            SELECT val, source, count(*) AS n FROM (SELECT DISTINCT val, source, doc_id FROM cand) GROUP BY val, source) GROUP BY val),
    judged AS (
        SELECT c.*, CASE WHEN owners >= {how.owners} OR (owners > 1 AND repositories >= {how.repositories}) THEN 'example'
            WHEN length(val) >= {how.length} AND len(list_distinct(string_split(val, ''))) >= {how.different} AND {placeholders} THEN 'live' ELSE 'weak' END AS verdict,
            name || ':' || a || ':' || z AS told
        FROM cand c JOIN owned USING (val)),
    spans AS (
        SELECT r, string_agg(told, ',' ORDER BY a, kind) FILTER (kind < 3 OR verdict = 'live') AS spans,
            string_agg(told, ',' ORDER BY a, kind) FILTER (verdict = 'live') AS live,
            count(*) FILTER (verdict = 'live') AS n_live, count(*) FILTER (verdict = 'example' AND kind < 3) AS n_example
        FROM judged GROUP BY r),
    based AS (
        SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
            string_agg(name || ':' || a || ':' || z, ',' ORDER BY a, kind) AS told
        FROM base GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(told, '')) AS base_sha256,
        coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example, coalesce(live, '') AS live
    FROM docs LEFT JOIN based USING (r) LEFT JOIN spans USING (r)"""
