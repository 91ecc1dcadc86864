"""Secret scans over a trigram inverted index.

Each rule's regular expression gives a Boolean trigram query: an alternation of
conjunctions of three-byte strings that every match must contain. A batch of
documents is indexed in a few array passes (postings of the trigrams that any
rule asks for), the postings are intersected, and only the surviving documents
are verified with the expression itself. A rule without a mandatory trigram
(long runs of hex digits) scans every document.

The index is local to a batch, like a segment of a search engine, so no row is
shuffled and a long document costs what its length costs.

Defined results: null text is empty; an empty table gives no rows; repeated
rows, and rows with a null id, are scanned each; extra input columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import _text
from ._spark import clean


@dataclass(frozen=True)
class Rule:
    """A kind of secret: leftmost, non-overlapping matches of ``pattern``.

    ``group`` of a match must have ``least`` characters; a match that fails is
    dropped. ``base`` rules are those of the fixed contract.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False

    @cached_property
    def regex(self) -> re.Pattern:
        return re.compile(self.pattern)

    @cached_property
    def trigrams(self) -> tuple[frozenset[bytes], ...]:
        """Alternatives, each a set of lower-case trigrams; empty: scan fully."""
        return trigram_query(self.pattern)


#: The parse trees of the standard library's own expressions; the public name of this module is deprecated.
_PARSER = re._parser
_MOST_STRINGS = 64


def _exact(items) -> set[str] | None:
    """All strings a parsed sequence can match, lower case; None if too many."""
    out = {""}
    for op, arg in items:
        got = _exact_one(op, arg)
        if got is None or len(out) * len(got) > _MOST_STRINGS:
            return None
        out = {a + b for a, b in product(out, got)}
    return out


def _exact_one(op, arg) -> set[str] | None:
    name = str(op)
    if name == "LITERAL":
        return {chr(arg).lower()}
    if name == "IN":
        out: set[str] = set()
        for kind, x in arg:
            if str(kind) != "LITERAL":
                return None
            out.add(chr(x).lower())
        return out
    if name == "SUBPATTERN":
        return _exact(arg[3])
    if name == "BRANCH":
        parts = [_exact(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if name == "MAX_REPEAT":
        low, high, body = arg
        one = _exact(body)
        if one is None or high == _PARSER.MAXREPEAT or high > 4:
            return None
        out = set()
        for n in range(low, high + 1):
            out |= {"".join(x) for x in product(one, repeat=n)}
            if len(out) > _MOST_STRINGS:
                return None
        return out
    return None


def trigram_query(pattern: str) -> tuple[frozenset[bytes], ...]:
    """The Boolean query of a pattern: a disjunction of trigram conjunctions.

    Consecutive parts whose strings can be listed are multiplied out; the run
    whose shortest string is longest gives the query. No string of three
    bytes: no query.
    """
    runs: list[set[str]] = []
    current: set[str] = {""}
    for op, arg in _PARSER.parse(pattern):
        got = _exact_one(op, arg)
        if got is None and str(op) == "MAX_REPEAT" and arg[0] >= 1:
            got = _exact(arg[2])  # one occurrence is certain; nothing is known after it
            if got is not None and len(current) * len(got) <= _MOST_STRINGS:
                runs.append({a + b for a, b in product(current, got)})
            runs.append(current)
            current = {""}
        elif got is None or len(current) * len(got) > _MOST_STRINGS:
            runs.append(current)
            current = {""} if got is None else got
        else:
            current = {a + b for a, b in product(current, got)}
    runs.append(current)
    best = max(runs, key=lambda r: min(len(x.encode()) for x in r))
    if min(len(x.encode()) for x in best) < 3:
        return ()
    sets = {frozenset(x.encode()[i : i + 3] for i in range(len(x.encode()) - 2)) for x in best}
    return tuple(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


_KEYWORDS = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")

_PEM_BANNER = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
#: What follows the banner: all up to the END line; without one, the headers and lines of base64. Line ends may be escaped.
_PEM_BODY = (
    r"(?:[^-]*(?:-{1,4}[^-]+)*-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:\r?\n(?:Proc-Type|DEK-Info):[^\r\n]*)*(?:(?:[\x20\t\r\n]|\\[rn])*[A-Za-z0-9+/]{40,}={0,2})*(?:(?:\r?\n|(?:\\r)?\\n)[A-Za-z0-9+/]+={0,2}\r?(?m:$))*)"
)

RULES: tuple[Rule, ...] = (
    Rule("assign", rf"({_KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", group=2, least=8, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=16, base=True),
    Rule("hex", r"[0-9a-f]{32,}", least=32, base=True),
    Rule("private_key", _PEM_BANNER + _PEM_BODY),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPREAD = np.uint32(0x9E3779B1)


class TrigramIndex:
    """Postings, over one batch, of the trigrams that rules ask for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: list[bytes]) -> None:
        self.n = len(offsets) - 1
        codes = np.array([t[0] << 16 | t[1] << 8 | t[2] for t in wanted], dtype=np.uint32)  # in order, as wanted is
        at, which = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(data) >= 3 and len(codes):
            low = _LOWER[data]
            code = low[:-2] << 16 | low[1:-1] << 8 | low[2:]
            # a small table of hashes sorts most positions out
            table = np.zeros(1 << 16, dtype=bool)
            table[codes * _SPREAD >> 16] = True
            at = np.flatnonzero(table[code * _SPREAD >> 16])
            which = np.searchsorted(codes, code[at])
            same = codes[np.minimum(which, len(codes) - 1)] == code[at]
            at, which = at[same], which[same]
        doc = np.searchsorted(offsets, at, side="right") - 1
        fits = at + 3 <= offsets[doc + 1]
        pairs = np.unique(which[fits] * self.n + doc[fits])
        cuts = np.searchsorted(pairs, np.arange(len(wanted) + 1) * self.n)
        self.postings = {t: pairs[cuts[i] : cuts[i + 1]] - i * self.n for i, t in enumerate(wanted)}

    def candidates(self, query: tuple[frozenset[bytes], ...]) -> np.ndarray:
        """Documents that satisfy a Boolean query; all of them for an empty one."""
        if not query:
            return np.arange(self.n)
        found = []
        for conjunction in query:
            lists = sorted((self.postings[t] for t in conjunction), key=len)
            hit = lists[0]
            for other in lists[1:]:
                if not len(hit):
                    break
                hit = hit[np.isin(hit, other, assume_unique=True)]
            found.append(hit)
        return np.unique(np.concatenate(found))


def find(rules: tuple[Rule, ...], texts: pa.Array) -> list[list[tuple[int, int, str]]]:
    """For each text its ``(start, end, kind)`` by start, then by the rules' order."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
    data, offsets = _text.utf8(texts)
    wanted = sorted({t for r in rules for q in r.trigrams for t in q})
    for a, b in _text.chunks(offsets):
        part = offsets[a : b + 1] - offsets[a]
        index = TrigramIndex(data[offsets[a] : offsets[b]], part, wanted)
        for order, rule in enumerate(rules):
            search = rule.regex.finditer
            for i in index.candidates(rule.trigrams).tolist():
                text = texts[a + i].as_py() or ""
                for m in search(text):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[a + i].append((m.start(), order, m.end()))
    return [[(s, e, rules[o].kind) for s, o, e in sorted(x)] for x in out]


_SCHEMA = "spans array<struct<start: long, end: long, kind: string>>"


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``key``, the text and its secret spans, in code points, one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = find(rules, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in spans], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])))], names=[key, "spans"])

    kept = clean(df, key, text)
    return kept.mapInArrow(run, f"`{key}` {kept.schema[0].dataType.simpleString()}, {_SCHEMA}")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each run of overlapping spans replaced by ``[secret]``."""
    parts, done = [], 0
    for start, end, _ in spans:
        if start >= done:
            parts += [text[done:start], "[secret]"]
        done = max(done, end)
    return "".join([*parts, text[done:]])


def redact(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``df`` with every secret in ``text`` masked; null stays null, all rows and columns stay."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            spans = find(rules, column)
            if any(spans):
                values = column.to_pylist()
                for i, x in enumerate(spans):
                    if x:
                        values[i] = masked(values[i], x)
                column = pa.array(values, column.type)
            yield pa.RecordBatch.from_arrays([column if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return df.mapInArrow(run, df.schema)


def digest(df: DataFrame, text: str = "text", key: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans as one string."""
    base = [r.kind for r in rules if r.base]
    listed = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = find(rules, batch.column(1))
            kept = [[x for x in spans if x[2] in base] for spans in found]
            counts = [pa.array([sum(x[2] == k for x in spans) for spans in kept], pa.int64()) for k in base]
            digests = pa.array([hashlib.sha256(listed(x).encode()).hexdigest() for x in kept])
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digests, pa.array([listed(x) for x in found])], names=[key, *(f"n_{k}" for k in base), "base_sha256", "spans"])

    kept = clean(df, key, text)
    columns = "".join(f", n_{k} long" for k in base)
    return kept.mapInArrow(run, f"`{key}` {kept.schema[0].dataType.simpleString()}{columns}, base_sha256 string, spans string")
