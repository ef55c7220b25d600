"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query of trigrams that any match must hold (after
Cox's work on code search): literals in sequence are joined by AND, alternatives by OR, and whatever may be
absent is dropped. A block of texts gets an index of posting lists for the trigrams that some query names;
the lists are combined as each query says, and only the texts left are searched. A rule without mandatory
trigrams scans every text. Trigrams and texts are compared with A-Z in lower case, so a query never misses
a match that ignores case.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.llm import text


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, the group whose length counts, and the least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    ignore_case: bool = False

    @property
    def flags(self) -> int:
        return re.ASCII | (re.IGNORECASE if self.ignore_case else 0)


#: The base kinds, in their order.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),  # the runs of [0-9a-f]+ of 24 characters or more
)
#: Further kinds with well-known public forms.
MORE = (
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,12}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@[A-Za-z0-9.-]+"),
)
RULES = BASE + MORE

#: A query: True (any text), a trigram, or ("and" | "or", queries).
Query = object
ALL = True


def _and(parts: list) -> Query:
    flat = []
    for p in parts:
        if p is not ALL:
            flat += p[1] if isinstance(p, tuple) and p[0] == "and" else [p]
    flat = list(dict.fromkeys(flat))
    return ALL if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))


def _or(parts: list) -> Query:
    if not parts or any(p is ALL for p in parts):
        return ALL
    flat = list(dict.fromkeys(parts))
    return flat[0] if len(flat) == 1 else ("or", tuple(flat))


def _of(literal: bytes) -> Query:
    return _and([literal[k : k + 3] for k in range(len(literal) - 2)])


#: Strings that one node may stand for, at most, before it stands for any text.
EXPAND = 16


def _walk(tree) -> tuple[Query, set[bytes] | None]:
    """(the query of a parsed sequence, all the strings that it may be, or None if they are too many)."""
    queries: list[Query] = []
    run: set[bytes] | None = {b""}

    def close() -> None:
        nonlocal run
        queries.append(_or([_of(s) for s in sorted(run)]))
        run = {b""}

    exact = True
    for op, value in tree:
        if op is C.LITERAL:
            q, strings = ALL, {chr(value).encode().lower()}
        elif op is C.IN and all(k is C.LITERAL for k, _ in value) and len(value) <= EXPAND:
            q, strings = ALL, {chr(v).encode().lower() for _, v in value}
        elif op is C.SUBPATTERN:
            q, strings = _walk(value[-1])
        elif op is C.BRANCH:
            found = [_walk(v) for v in value[1]]
            q = _or([f[0] for f in found])
            strings = None if any(f[1] is None for f in found) else set().union(*(f[1] for f in found))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = value
            q, strings = _walk(inner)
            if high == 1 and low == 0:
                q, strings = ALL, None if strings is None else strings | {b""}
            elif not low:
                q, strings = ALL, None
            elif low == high and low <= 8 and strings and len(strings) == 1:
                strings = {next(iter(strings)) * low}
            elif not (low == high == 1):
                strings = None
        elif op is C.AT:
            continue
        else:
            q, strings = ALL, None
        joined = None if strings is None or len(run) * len(strings) > EXPAND else {a + b for a in run for b in strings}
        if joined is None:
            close()
            exact = False
            queries.append(q)
            run = {b""} if strings is None or len(strings) > EXPAND else set(strings)
        else:
            run = joined
    whole = set(run) if exact else None
    close()
    return _and(queries), whole


def query(rule: Rule) -> Query:
    """The Boolean trigram query that every text with a match of the rule meets."""
    return _walk(_parser.parse(rule.pattern, rule.flags))[0]


def _leaves(q: Query) -> set[bytes]:
    return set() if q is ALL else {q} if isinstance(q, bytes) else set().union(*map(_leaves, q[1]))


class Scanner:
    """The rules, their queries, and an index over one block of texts at a time."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.found = [re.compile(r.pattern, r.flags) for r in rules]
        self.queries = [query(r) for r in rules]
        self.trigrams = sorted(set().union(*map(_leaves, self.queries)))
        self.slot = np.zeros(1 << 24, np.uint8 if len(self.trigrams) < 255 else np.uint16)
        for k, t in enumerate(self.trigrams):
            self.slot[t[0] << 16 | t[1] << 8 | t[2]] = k + 1

    def postings(self, data: np.ndarray, at: np.ndarray) -> dict[bytes, np.ndarray]:
        """For each trigram that a query names, the texts that hold it, in order."""
        if len(data) < 3 or not self.trigrams:
            return {}
        low = text.lowered(data).astype(np.int32)
        slot = self.slot[low[:-2] << 16 | low[1:-1] << 8 | low[2:]]
        place = np.flatnonzero(slot)
        doc = text.owners(place, at)
        inside = place + 3 <= at[doc + 1]
        pair = np.unique(slot[place[inside]].astype(np.int64) * len(at) + doc[inside])
        kind, doc = pair // len(at), pair % len(at)
        ends = np.searchsorted(kind, np.arange(1, len(self.trigrams) + 2))
        return {t: doc[ends[k] : ends[k + 1]] for k, t in enumerate(self.trigrams)}

    def candidates(self, q: Query, postings: dict[bytes, np.ndarray], docs: int) -> np.ndarray:
        if q is ALL:
            return np.arange(docs)
        if isinstance(q, bytes):
            return postings.get(q, np.zeros(0, np.int64))
        parts = sorted((self.candidates(x, postings, docs) for x in q[1]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if q[0] == "and" else np.union1d(out, p)
        return out

    def scan(self, column: pa.Array) -> list[list[tuple[int, int, int]]]:
        """For each text its spans (start, rule, end) in code points, by start, then by the rules' order."""
        data, at = text.view(column)
        postings = self.postings(data, at)
        out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
        texts: dict[int, str] = {}
        for k, (rule, pattern, q) in enumerate(zip(self.rules, self.found, self.queries, strict=True)):
            for d in self.candidates(q, postings, len(column)).tolist():
                t = texts.get(d)
                if t is None:
                    t = texts[d] = column[d].as_py()
                for m in pattern.finditer(t):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[d].append((m.start(), k, m.end()))
        for spans in out:
            spans.sort()
        return out


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array of (kind, start, end)) for each row of docs; code points, end exclusive.

    Of each kind the leftmost matches that don't overlap, those too short left out after matching. A null
    text counts as empty; repeated rows repeat; an empty table gives an empty one; other columns play no part.
    """
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for b in batches:
            column = text.strings(b.column(1))
            for x, y in text.slices(column):
                got = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in spans] for spans in scanner.scan(column[x:y])]
                yield pa.RecordBatch.from_arrays([b.column(0)[x:y], pa.array(got, arrow)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("spans", T.ArrayType(span))]))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) from scan() over all rules."""
    found = scan(docs, RULES, id_col, text_col)
    base = [r.kind for r in BASE]
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    line = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return found.select("doc_id", *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in base), F.sha2(line(of(*base)), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
