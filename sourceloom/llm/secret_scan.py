"""Secret scan over a trigram inverted index.

Each rule's regex is turned into a Boolean query over trigrams: AND over what must follow one another, OR over
alternatives. Every block of documents gets an inverted index, trigram to postings, of the trigrams that the queries name
(no query can read another posting). The queries intersect and unite postings; the regex verifies the documents that are
left. A rule whose regex forces no trigram, such as a run of hex digits, scans every document. The index of a block lives and dies
in the task that reads the block, so nothing is shuffled, and what it finds equals a full scan by construction:
the query is a necessary condition.

Defined cases: a null text counts as empty and has no spans; repeated rows get equal results; an empty table gives an empty
result; very long texts are indexed and scanned whole; only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sourceloom.llm.text import LOWER, Block, blocks, sha256_hex, span_text, well_formed

MAX_STRINGS = 64  # alternatives of an exact string that are followed before it counts as "anything"


@dataclass(frozen=True)
class SecretRule:
    """A kind of secret: ``pattern`` finds, ``accept`` then judges each match; ``base`` rules are always reported."""

    kind: str
    pattern: str
    accept: Callable[[re.Match], bool] = field(default=lambda m: True)
    base: bool = False


#: Patterns of the query's contract, then those of the method.
RULES = (
    SecretRule(
        "assign",
        r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        lambda m: m.end(2) - m.start(2) >= 6,
        True,
    ),
    SecretRule("access", r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 20, True),
    SecretRule("hex", r"[0-9a-f]{24,}", base=True),
    SecretRule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)

# A query is True (anything), a trigram, ("and", {queries}) or ("or", {queries}).
Query = bool | str | tuple


def _all(*parts: Query) -> Query:
    kept = frozenset(p for p in parts if p is not True)
    return True if not kept else next(iter(kept)) if len(kept) == 1 else ("and", kept)


def _any(parts: list[Query]) -> Query:
    kept = frozenset(parts)
    return True if True in kept else next(iter(kept)) if len(kept) == 1 else ("or", kept)


def _of_string(text: str) -> Query:
    return _all(*(text[i : i + 3] for i in range(len(text) - 2)))


@dataclass
class _Part:
    """What is known of a piece of regex: all its strings if few (else None), and a query that its matches satisfy."""

    strings: frozenset[str] | None
    query: Query = True

    def needs(self) -> Query:
        return _all(self.query, _any([_of_string(s) for s in self.strings]) if self.strings else True)


def _members(items: list) -> frozenset[str] | None:
    found: set[str] = set()
    for what, value in items:
        if what is op.LITERAL:
            found.add(chr(value).lower())
        elif what is op.RANGE and value[1] - value[0] < 200:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(found) if len(found) <= MAX_STRINGS and all(c.isascii() for c in found) else None


def _concat(parts: list[_Part]) -> _Part:
    """Strings of neighbours are joined while they stay few; where the join ends, its trigrams are kept as a condition."""
    query, run, whole = True, frozenset([""]), True
    for part in parts:
        query = _all(query, part.query)
        if part.strings is not None and len(run) * len(part.strings) <= MAX_STRINGS:
            run = frozenset(a + b for a in run for b in part.strings)
        else:
            query = _all(query, _Part(run).needs())
            run, whole = (part.strings, False) if part.strings is not None else (frozenset([""]), False)
    return _Part(run, query) if whole else _Part(None, _all(query, _Part(run).needs()))


def _analyse(tree) -> _Part:
    parts = []
    for what, value in tree:
        if what is op.LITERAL:
            parts.append(_Part(frozenset([chr(value).lower()]) if value < 128 else None))
        elif what is op.IN:
            parts.append(_Part(_members(value)))
        elif what is op.SUBPATTERN:
            parts.append(_analyse(value[-1]))
        elif what is op.BRANCH:
            branches = [_analyse(b) for b in value[1]]
            if all(b.strings is not None for b in branches):
                parts.append(_Part(frozenset().union(*(b.strings for b in branches)), _any([b.query for b in branches])))
            else:
                parts.append(_Part(None, _any([b.needs() for b in branches])))
        elif what in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, body = value
            inner = _analyse(body)
            if (low, high) == (0, 1) and inner.strings is not None:
                parts.append(_Part(inner.strings | {""}))
            elif low == high == 1:
                parts.append(inner)
            else:
                parts.append(_Part(None, inner.needs() if low else True))
        elif what in (op.AT, op.ASSERT, op.ASSERT_NOT):
            parts.append(_Part(frozenset([""])))
        else:
            parts.append(_Part(None))
    return _concat(parts)


def trigram_query(pattern: str) -> Query:
    """The Boolean trigram query that every lower-cased match of ``pattern`` satisfies; True if it forces no trigram."""
    return _analyse(parser.parse(pattern)).needs()


def named_trigrams(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set() if query is True else set().union(*map(named_trigrams, query[1]))


def _code(trigram: str) -> int:
    a, b, c = trigram.encode()
    return a << 16 | b << 8 | c


class TrigramIndex:
    """Postings, by trigram, of the documents of one block; A-Z are folded."""

    def __init__(self, block: Block, vocabulary: np.ndarray):
        self.n = len(block)
        low = LOWER[block.data].astype(np.int32)
        codes = low[:-2] << 16 | low[1:-1] << 8 | low[2:] if len(low) > 2 else np.zeros(0, np.int32)
        at = np.flatnonzero(vocabulary[codes])
        row = np.searchsorted(block.offsets, at, "right") - 1
        inside = at + 3 <= block.offsets[row + 1]
        pairs = np.unique(codes[at[inside]].astype(np.int64) * self.n + row[inside])
        self.codes, self.rows = np.divmod(pairs, max(self.n, 1))

    def postings(self, trigram: str) -> np.ndarray:
        a, b = np.searchsorted(self.codes, [_code(trigram), _code(trigram) + 1])
        return self.rows[a:b]

    def select(self, query: Query) -> np.ndarray:
        """The rows, ascending, that satisfy a query."""
        if query is True:
            return np.arange(self.n)
        if isinstance(query, str):
            return self.postings(query)
        lists = sorted(map(self.select, query[1]), key=len)
        found = lists[0]
        for other in lists[1:]:
            found = np.intersect1d(found, other, True) if query[0] == "and" else np.union1d(found, other)
        return found


def vocabulary_of(queries: list[Query]) -> np.ndarray:
    flags = np.zeros(1 << 24, bool)
    for q in queries:
        flags[[_code(t) for t in named_trigrams(q)]] = True
    return flags


def find_secrets(block: Block, rules: tuple[SecretRule, ...], compiled: list, queries: list, vocabulary: np.ndarray) -> list[list]:
    """For each row of a block the spans (start, rule number, end), in code points."""
    index, texts, spans = TrigramIndex(block, vocabulary), {}, [[] for _ in range(len(block))]
    raw = list(block.texts())
    for k, (rule, regex, query) in enumerate(zip(rules, compiled, queries)):
        for row in index.select(query).tolist():
            if row not in texts:
                texts[row] = raw[row].decode()
            spans[row] += [(m.start(), k, m.end()) for m in regex.finditer(texts[row]) if rule.accept(m)]
    return spans


def secret_spans(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: its spans as an array of (kind, start, end), by start, then kind as listed."""
    queries = [trigram_query(r.pattern) for r in rules]
    kinds = [r.kind for r in rules]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, vocabulary = [re.compile(r.pattern) for r in rules], vocabulary_of(queries)
        for block in blocks(batches, text):
            found = find_secrets(block, rules, compiled, queries, vocabulary)
            rows = [[{"kind": kinds[k], "start": a, "end": b} for a, k, b in sorted(x)] for x in found]
            shape = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([block.rows.column(0), pa.array(rows, shape)], names=["id", "spans"])

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int>>"
    return docs.select(id_col, text).mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def redact_secrets(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, text: str = "text", mark: str = "<secret>") -> DataFrame:
    """``docs`` with every span (overlapping ones united) of its texts replaced by ``mark``; null texts stay null."""
    queries = [trigram_query(r.pattern) for r in rules]
    place = docs.columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, vocabulary = [re.compile(r.pattern) for r in rules], vocabulary_of(queries)
        for block in blocks(batches, text):
            found = find_secrets(block, rules, compiled, queries, vocabulary)
            if any(found):
                column = block.rows.column(place)
                texts = [_cover(t, s, mark) if s else t for t, s in zip(well_formed(column).to_pylist(), found)]
                arrays = list(block.rows.columns)
                arrays[place] = pa.array(texts, column.type)
                yield pa.RecordBatch.from_arrays(arrays, schema=block.rows.schema)
            else:
                yield block.rows

    return docs.mapInArrow(scan, docs.schema)


def _cover(text: str, spans: list, mark: str) -> str:
    out, at = [], 0
    for a, _, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def spans_digest(docs: DataFrame, rules: tuple[SecretRule, ...] = RULES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The spans as the query's digest columns: a count a base kind, the base spans' SHA-256 and all spans as one string."""
    queries, kinds = [trigram_query(r.pattern) for r in rules], [r.kind for r in rules]
    base = {k for k, r in enumerate(rules) if r.base}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, vocabulary = [re.compile(r.pattern) for r in rules], vocabulary_of(queries)
        for block in blocks(batches, text):
            found = find_secrets(block, rules, compiled, queries, vocabulary)
            counts = [pa.array([sum(k == b for _, k, _ in x) for x in found], pa.int64()) for b in sorted(base)]
            digests = pa.array([sha256_hex(span_text([s for s in x if s[1] in base], kinds)) for x in found])
            spans = pa.array([span_text(x, kinds) for x in found])
            yield pa.RecordBatch.from_arrays([block.rows.column(0), *counts, digests, spans], names=names)

    names = ["id", *(f"n_{rules[b].kind}" for b in sorted(base)), "base_sha256", "spans"]
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:-2]) + ", base_sha256 string, spans string"
    return docs.select(id_col, text).mapInArrow(scan, schema).withColumnRenamed("id", id_col)
