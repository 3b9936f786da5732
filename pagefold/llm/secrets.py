"""Secret scan over a trigram inverted index.

Every rule's regular expression is parsed once and turned into a Boolean query over lower-cased byte trigrams that each
match must contain. Documents are indexed in blocks: the postings of the trigrams that any query names are built with
numpy, the query is evaluated by intersecting and uniting postings, and only the candidates are verified with the
expression itself. A rule without mandatory trigrams (such as a bare run of hexadecimal digits) is a full scan.
The plan is one narrow pass without a shuffle, so it grows in proportion to the text and has no hot keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as rc
from re import _parser as rp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks

#: A conjunction ("and"), a disjunction ("or") or one trigram; None stands for "every document".
Query = tuple | str | None

#: Alternatives that an exact set may hold before it is flushed into a query, and members a character class may add.
MAX_EXACT = 64
MAX_CLASS = 8


@dataclass(frozen=True)
class Rule:
    """kind: the name of its spans. group and least: a match counts only if that group has so many characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII)


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)


def _all(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(p for p in parts if p is not None))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", *parts)


def _any(parts: list[Query]) -> Query:
    if not parts or any(p is None for p in parts):
        return None
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", *parts)


def _of_strings(strings: set[str]) -> Query:
    """Trigrams are of UTF-8 bytes, each written as the Latin-1 letter of its number."""
    coded = [s.encode("utf-8", "surrogatepass").decode("latin-1") for s in sorted(strings)]
    return _any([_all([s[i : i + 3] for i in range(len(s) - 2)]) for s in coded])


def _low(c: int) -> str:
    """Expressions are compiled so that only ASCII letters are compared without case."""
    return chr(c).lower() if c < 128 else chr(c)


def _walk(items) -> tuple[set[str] | None, Query]:
    """Of a sequence: the exact set of lower-cased strings if it is small, and what any match must contain."""
    exact: set[str] | None = {""}
    pending: set[str] = {""}
    needs: list[Query] = []
    for op, arg in items:
        one, query = _node(op, arg)
        if one is not None and len(pending) * len(one) <= MAX_EXACT:
            pending = {a + b for a in pending for b in one}
            continue
        needs += [_of_strings(pending), query]
        if one is not None:
            pending = one
        else:
            pending = {""}
        exact = None
    needs.append(_of_strings(pending))
    return (pending if exact is not None else None), _all(needs)


def _node(op, arg) -> tuple[set[str] | None, Query]:
    if op is rc.LITERAL:
        return {_low(arg)}, None
    if op is rc.IN:
        found: set[str] = set()
        for kind, value in arg:
            if kind is rc.LITERAL:
                found.add(_low(value))
            elif kind is rc.RANGE and value[1] - value[0] < MAX_CLASS:
                found |= {_low(c) for c in range(value[0], value[1] + 1)}
            else:
                return None, None
        return (found if len(found) <= MAX_CLASS else None), None
    if op is rc.SUBPATTERN:
        return _walk(arg[3])
    if op is rc.BRANCH:
        parts = [_walk(branch) for branch in arg[1]]
        if all(e is not None for e, _ in parts) and sum(len(e) for e, _ in parts) <= MAX_EXACT:
            return set().union(*(e for e, _ in parts)), None
        return None, _any([q if e is None else _of_strings(e) for e, q in parts])
    if op in (rc.MAX_REPEAT, rc.MIN_REPEAT, rc.POSSESSIVE_REPEAT):
        low, high, body = arg
        one, query = _walk(body)
        if one is not None and high == 1:
            return one | ({""} if low == 0 else set()), None
        if low == 0:
            return None, None
        return None, query if one is None else _of_strings(one)
    if op is rc.AT:
        return {""}, None
    return None, None


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query of a regular expression; None if it has no mandatory trigram.

    It is necessary, not sufficient: each match lies in a document that satisfies it.
    """
    exact, query = _walk(rp.parse(pattern, re.ASCII))
    return _of_strings(exact) if exact is not None else query


def trigrams_of(query: Query) -> set[str]:
    if query is None:
        return set()
    return {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1:]))


class BlockIndex:
    """Inverted index of one block of texts: trigram to the sorted ordinals of the texts that contain it."""

    def __init__(self, wanted: set[str]):
        self.codes = {t: int.from_bytes(t.encode("latin-1"), "big") for t in wanted}
        self.slot = np.zeros(1 << 24, dtype=np.uint8 if len(wanted) < 256 else np.uint16 if len(wanted) < 1 << 16 else np.uint32)
        for k, code in enumerate(sorted(self.codes.values()), 1):
            self.slot[code] = k
        self.rank = {t: int(self.slot[c]) for t, c in self.codes.items()}

    def fill(self, texts: list[bytes]) -> None:
        buffer = np.frombuffer(b"\0\0".join(texts).lower(), dtype=np.uint8)
        self.n = len(texts)
        self.postings: dict[int, np.ndarray] = {}
        if len(buffer) < 3 or not self.codes:
            return
        codes = buffer[:-2].astype(np.uint32)
        codes <<= 8
        codes |= buffer[1:-1]
        codes <<= 8
        codes |= buffer[2:]
        slots = self.slot[codes]
        at = np.flatnonzero(slots)
        ends = np.cumsum(np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts)))
        pairs = np.unique(slots[at].astype(np.int64) * self.n + np.searchsorted(ends, at, side="right"))
        for k in np.unique(pairs // self.n):
            own = pairs[(pairs >= k * self.n) & (pairs < (k + 1) * self.n)] - k * self.n
            self.postings[int(k)] = own

    def search(self, query: Query) -> np.ndarray:
        if query is None:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings.get(self.rank[query], np.empty(0, dtype=np.int64))
        parts = [self.search(q) for q in query[1:]]
        if query[0] == "or":
            return np.unique(np.concatenate(parts))
        parts.sort(key=len)
        found = parts[0]
        for p in parts[1:]:
            if not len(found):
                break
            found = np.intersect1d(found, p, assume_unique=True)
        return found


def find_spans(texts: list[str], rules: tuple[Rule, ...], index: BlockIndex, queries: list[Query]) -> list[list[tuple]]:
    """Spans (start, rule number, end) of each text of a block, in order."""
    index.fill([t.encode("utf-8", "surrogatepass") for t in texts])
    out: list[list[tuple]] = [[] for _ in texts]
    for k, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        finditer = rule.compiled().finditer
        for i in index.search(query):
            for m in finditer(texts[i]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out[i].append((m.start(), k, m.end()))
    for found in out:
        found.sort()
    return out


def scan_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES, block_chars: int = 4 << 20
) -> DataFrame:
    """One row per document: its id and ``spans``, an array of (kind, start, end) in code points, end exclusive.

    Null and empty texts have no spans; repeated rows each give a row; other columns are ignored; an empty table gives an
    empty frame; a text of any length is scanned whole and a text larger than ``block_chars`` is a block of its own.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries = [trigram_query(r.pattern) for r in rules]
        index = BlockIndex(set().union(*map(trigrams_of, queries)))
        kinds = [r.kind for r in rules]
        for frame in batches:
            found: list[list[tuple]] = []
            for part in blocks(frame["text"].fillna("").tolist(), block_chars):
                found += find_spans([t for _, t in part], rules, index, queries)
            yield pd.DataFrame({"id": frame["id"], "spans": [[{"kind": kinds[k], "start": s, "end": e} for s, k, e in x] for x in found]})

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInPandas(scan, f"id {id_type}, spans array<struct<kind:string,start:int,end:int>>").withColumnRenamed("id", id_col)


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document, with a digest of the base kinds' spans."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans")
    )
