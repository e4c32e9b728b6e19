"""Quality rules as a short-circuit cascade.

A sample of the documents gives each rule's cost (nanoseconds a byte) and its rejection rate. The cascade then asks the rules
by falling rejection per cost and stops at the first that rejects. The order changes the time that it takes and the rule
that is named, never the verdict: a document is kept if no rule rejects it.

Defined cases: a null text counts as empty and is rejected (too few words); rows are judged one by one, so ties and
repeated rows get equal verdicts; an empty table gives an empty result and the rules' listed order; very long texts are
judged whole; other columns pass through ``keep_good`` untouched, and ``judge`` reads only the id and the text.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.text import Block, blocks, mix64, word_hashes

SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))


def _without(text: bytes, chars: bytes) -> int:
    """How many bytes of the text are among ``chars``."""
    return len(text) - len(text.translate(None, chars))


def repeated_words(hashes: np.ndarray, window: int = 3) -> int:
    """Words that lie in a window of ``window`` words which the text holds twice or more, each word once."""
    n = len(hashes) - window + 1
    if n < 2:
        return 0
    codes = hashes[:n].copy()
    for k in range(1, window):
        codes = mix64(codes) + hashes[k : k + n]
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n + window, np.int64)
    found = np.zeros(n, bool)
    found[order[1:][same]] = True
    found[order[:-1][same]] = True
    again[:n] += found
    again[window : window + n] -= found
    return int((np.cumsum(again)[: n + window - 1] > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def word_chars(text: bytes) -> int:
    """Code points in words, so that scripts of two or three bytes a letter count like others."""
    return len(b"".join(text.split()).decode())


@dataclass
class Document:
    """One text and what rules may ask of it."""

    text: bytes
    hashes: np.ndarray

    @property
    def n_words(self) -> int:
        return len(self.hashes)

    @cached_property
    def repeats(self) -> int:
        return repeated_words(self.hashes)

    @cached_property
    def same_lines(self) -> int:
        return repeated_lines(self.text)


@dataclass(frozen=True)
class Rule:
    """``rejects`` says whether a document fails; it must depend on the document alone."""

    name: str
    rejects: Callable[[Document], bool]


#: The first two are the base rules of the query's contract.
RULES = (
    Rule("few_words", lambda d: d.n_words < 50),
    Rule("repeated_words", lambda d: 100 * d.repeats > 50 * d.n_words),
    Rule("symbols", lambda d: 10 * _without(d.text, SYMBOLS) > d.n_words),
    Rule("shouting", lambda d: 10 * _without(d.text, UPPER) > 3 * _without(d.text, LETTERS)),
    Rule("exclamations", lambda d: 10 * d.text.count(b"!!") > d.n_words),
    Rule("repeated_lines", lambda d: 2 * d.same_lines > d.text.count(b"\n") + 1),
    Rule("word_length", lambda d: not 2 * d.n_words <= word_chars(d.text) <= 20 * d.n_words),
)


def _documents(block: Block) -> Iterator[Document]:
    hashes, first = word_hashes(block, fold=False)
    for text, a, b in zip(block.texts(), first, first[1:]):
        yield Document(text, hashes[a:b])


def rule_costs(docs: DataFrame, rules: tuple[Rule, ...] = RULES, fraction: float = 0.01, seed: int = 7, text: str = "text") -> DataFrame:
    """(rule, ns, bytes, rejected, n): each rule's time and rejections on a sample of the rows."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            found = list(_documents(block))
            rows = []
            for rule in rules:
                began = time.perf_counter_ns()
                rejected = sum(map(rule.rejects, found))
                rows.append((rule.name, time.perf_counter_ns() - began, len(block.data), rejected, len(found)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["rule", "ns", "bytes", "rejected", "n"])

    sample = docs.select(text).sample(fraction=fraction, seed=seed)
    made = sample.mapInArrow(measure, "rule string, ns long, bytes long, rejected long, n long")
    return made.groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("ns", "bytes", "rejected", "n")))


def plan_cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, fraction: float = 0.01, seed: int = 7, text: str = "text") -> tuple[Rule, ...]:
    """The rules by falling rejection per cost. One row a rule reaches the driver."""
    found = {r.rule: (r.rejected / max(r.n, 1)) / max(r.ns / max(r.bytes, 1), 1e-9) for r in rule_costs(docs, rules, fraction, seed, text).collect()}
    return tuple(sorted(rules, key=lambda r: -found.get(r.name, 0.0)))


def first_rejection(document: Document, order: tuple[Rule, ...]) -> str | None:
    """The name of the first rule that rejects; the rules after it are not asked."""
    return next((r.name for r in order if r.rejects(document)), None)


_CONTINUES = (np.arange(256) & 0xC0) == 0x80


def _prefix(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set within each row of a block."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_STARTS_CHAR = ~_CONTINUES & ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def judge(docs: DataFrame, order: tuple[Rule, ...], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: its counts, whether a base rule fails, whether it is kept, and the rule that rejects it."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            found = list(_documents(block))
            repeats = [d.repeats for d in found]
            verdicts = [first_rejection(d, order) for d in found]
            words = [d.n_words for d in found]
            yield pa.RecordBatch.from_arrays(
                [
                    block.rows.column(0),
                    pa.array(words, pa.int64()),
                    pa.array(_prefix(_STARTS_CHAR[block.data], block.offsets)),
                    pa.array(_prefix(_IS_SYMBOL[block.data], block.offsets)),
                    pa.array([d.same_lines for d in found], pa.int64()),
                    pa.array(repeats, pa.int64()),
                    pa.array([n < 50 or 100 * r > 50 * n for n, r in zip(words, repeats)]),
                    pa.array([v is None for v in verdicts]),
                    pa.array(verdicts, pa.string()),
                ],
                names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"
    return docs.select(id_col, text).mapInArrow(score, schema).withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, order: tuple[Rule, ...] | None = None, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that no rule rejects."""
    order = order or plan_cascade(docs, text=text)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            yield block.rows.filter(pa.array([first_rejection(d, order) is None for d in _documents(block)]))

    return docs.mapInArrow(passing, docs.schema)
