"""Personal data by patterns and a skip-chain conditional random field.

The patterns (base) give sure spans. The field labels the tokens that hold a digit or an ``@`` with none, email, ip, card or
phone: a node potential by the token's shape, a chain potential between tokens that only a blank separates, and a skip
potential between consecutive mentions of the same token (equal digits, or equal lower-cased text) anywhere in the
document, so one sure mention helps the others. Tokens without digit or ``@`` are "none" with certainty and split the chain, so they are left
out without changing any marginal. Loopy sum-product message passing gives the marginals; labels of probability 0.9 or more
that a plain check of the kind supports become additional spans where no base span lies. All potentials come from counts over
all documents with the base spans as labels (piecewise training); their number is bounded by the shapes, not by the data.

Defined cases: a null text counts as empty; a text without digit and ``@`` has no span; repeated rows get equal results;
an empty table trains on the prior alone and gives an empty result; long texts are read whole; only id and text are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.text import SPACE, Block, blocks, sha256_hex, span_text

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
SURE = 0.9
PRIOR_WEIGHT = 5.0
ROUNDS = 12
FLOOR = -4.0  # log-odds
AGREED = 1000  # what repeated mentions have agreed before any count

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_LETTER = re.compile(r"[A-Za-z]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping; each ``@`` is tried once, so the time is linear."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns of the query's contract, sorted."""
    spans = [(a, 0, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


_MARKED = np.zeros(256, bool)
_MARKED[[*range(48, 58), 64]] = True
_CORE = re.compile(r"[+(]*[0-9A-Za-z](?:.*[0-9A-Za-z)])?", re.S)


def shape(token: str) -> str:
    """A token's shape: digits up to 20, letters up to 3, dots up to 4, and which of ``+()-@`` it holds."""
    digits = len(_NOT_DIGIT.sub("", token))
    letters = len(_LETTER.findall(token))
    return f"{min(digits, 20)}/{min(letters, 3)}/{min(token.count('.'), 4)}/{''.join(c for c in '+()-@' if c in token)}"


def key_of(token: str) -> str:
    """What two mentions of one thing share: the digits if there are four or more, else the lower-cased text."""
    digits = _NOT_DIGIT.sub("", token)
    return token.lower() if "@" in token or len(digits) < 4 else digits


class Tokens:
    """The candidate tokens of a block: row, start and end (code points), shape, key, base label, and the edges."""

    def __init__(self, block: Block):
        n, data = len(block.data), block.data
        self.rows, self.starts, self.ends, self.shapes, self.labels, self.groups = [], [], [], [], [], []
        self.spans: dict[int, list] = {}
        self.texts: dict[int, str] = {}
        self.adjacent: list[tuple[int, int]] = []
        self.skips: list[tuple[int, int]] = []
        if not n:
            return
        marked = np.flatnonzero(_MARKED[data])
        if not len(marked):
            return
        rows = np.unique(np.searchsorted(block.offsets, marked, "right") - 1)
        raw = data.tobytes()
        for row in rows.tolist():
            a, b = int(block.offsets[row]), int(block.offsets[row + 1])
            self._add_row(row, raw[a:b], data[a:b])

    def _add_row(self, row: int, raw: bytes, data: np.ndarray) -> None:
        text = raw.decode()
        spans = base_spans(text)
        self.spans[row], self.texts[row] = spans, text
        points = np.cumsum((data & 0xC0) != 0x80)  # code points up to and with each byte
        blank = np.flatnonzero(SPACE[data])
        at = np.searchsorted(blank, np.flatnonzero(_MARKED[data]))
        words = np.unique(at)
        left = np.append(-1, blank)[words] + 1
        right = np.append(blank, len(data))[words]
        last_key: dict[str, int] = {}
        before, k = (-2, -1), 0
        for w, a, b in zip(words.tolist(), left.tolist(), right.tolist()):
            begin, end = int(points[a]) - 1, int(points[b - 1])
            m = _CORE.search(text, begin, end)
            if m is None:
                continue
            token, number = m[0], len(self.rows)
            while k < len(spans) and spans[k][2] <= m.start():
                k += 1
            self.rows.append(row)
            self.starts.append(m.start())
            self.ends.append(m.end())
            self.shapes.append(shape(token))
            self.labels.append(spans[k][1] + 1 if k < len(spans) and spans[k][0] < m.end() else 0)
            if before[0] == w - 1:
                self.adjacent.append((before[1], number))
            before = (w, number)
            key = key_of(token)
            if key in last_key:
                self.skips.append((last_key[key], number))
            self.groups.append(self.groups[last_key[key]] if key in last_key else number)
            last_key[key] = number


def field_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(part, a, b, n): how often a shape has a label, adjacent labels follow one another, and repeated tokens that both have a label agree.

    A token without label that repeats a labelled one is what the field is to decide, so it counts for neither.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for block in blocks(batches, text):
            t = Tokens(block)
            sure = {g for g, x in zip(t.groups, t.labels) if x}
            seen.update(("shape", s, LABELS[x]) for s, x, g in zip(t.shapes, t.labels, t.groups) if x or g not in sure)
            seen.update(("next", LABELS[t.labels[i]], LABELS[t.labels[j]]) for i, j in t.adjacent)
            seen.update(("same", str(t.labels[i] == t.labels[j]), "") for i, j in t.skips if t.labels[i] and t.labels[j])
        rows = list(zip(*((*k, n) for k, n in seen.items()))) or [[], [], [], []]
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], names=["part", "a", "b", "n"])

    made = docs.select(text).mapInArrow(count, "part string, a string, b string, n long")
    return made.groupBy("part", "a", "b").agg(F.sum("n").alias("n"))


class Field:
    """The potentials, from counts."""

    def __init__(self, counts: list[tuple[str, str, str, int]]):
        number = {x: k for k, x in enumerate(LABELS)}
        shapes: dict[str, np.ndarray] = {}
        follow, same = np.full((5, 5), 1.0), {"True": AGREED, "False": 1}
        for part, a, b, n in counts:
            if part == "shape":
                shapes.setdefault(a, np.zeros(5))[number[b]] += n
            elif part == "next":
                follow[number[a], number[b]] += n
            else:
                same[a] += n
        prior = sum(shapes.values(), np.ones(5))
        self.prior = prior / prior.sum()
        # However often a shape stands there without label, a kind keeps ``FLOOR``, so the skip edges of a sure mention decide alike in corpora of any size.
        node = lambda c: np.maximum(c, c[0] + FLOOR)
        self.shapes = {s: node(np.log((c + PRIOR_WEIGHT * self.prior) / (c.sum() + PRIOR_WEIGHT))) for s, c in shapes.items()}
        self.unseen = node(np.log(self.prior))
        joint = follow / follow.sum()
        self.follow = np.clip(np.log(joint / np.outer(joint.sum(1), joint.sum(0))), -2.0, 2.0)
        self.same = np.eye(5) * np.clip(np.log(same["True"] / same["False"]), 0.0, 12.0)

    def node(self, shape_: str) -> np.ndarray:
        return self.shapes.get(shape_, self.unseen)

    def marginals(self, t: Tokens) -> np.ndarray:
        """Loopy sum-product over all tokens of a block at once; a base label is certain."""
        local = np.array([self.node(s) for s in t.shapes])
        fixed = np.array(t.labels)
        local[fixed > 0] = -50.0
        local[np.flatnonzero(fixed), fixed[fixed > 0]] = 0.0
        edges = np.array(t.adjacent + t.skips, np.int64).reshape(-1, 2)
        if not len(edges):
            return _softmax(local)
        pair = np.concatenate([np.repeat(self.follow[None], len(t.adjacent), 0), np.repeat(self.same[None], len(t.skips), 0)])
        src, dst = np.concatenate([edges, edges[:, ::-1]]).T
        pair = np.exp(np.concatenate([pair, pair.transpose(0, 2, 1)]))
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        messages = np.zeros((len(src), 5))
        for _ in range(ROUNDS):
            belief = local.copy()
            np.add.at(belief, dst, messages)
            out = np.log(np.einsum("ea,eab->eb", _softmax(belief[src] - messages[back]), pair) + 1e-12)
            new = out - out.max(1, keepdims=True)
            moved = np.abs(new - messages).max()
            messages = 0.5 * messages + 0.5 * new
            if moved < 1e-3:
                break
        belief = local.copy()
        np.add.at(belief, dst, messages)
        return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _supported(kind: int, found: str) -> bool:
    """The check that an additional span must pass."""
    digits = _NOT_DIGIT.sub("", found)
    if kind == 0:
        return "@" in found
    if kind == 1:
        return found.count(".") == 3
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 7 <= len(digits) <= 15


def all_spans(block: Block, model: Field) -> dict[int, tuple[list, list]]:
    """For each row that has candidates: the base spans, and all spans."""
    t = Tokens(block)
    found = {row: (spans, list(spans)) for row, spans in t.spans.items()}
    if not t.rows:
        return found
    p = model.marginals(t)
    best = np.where(p.max(1) >= SURE, p.argmax(1), 0)
    joined = {j for i, j in t.adjacent if best[i] == best[j] and best[j] and not t.labels[i] and not t.labels[j]}
    runs: list[list] = []
    for k in np.flatnonzero(best).tolist():
        if t.labels[k]:
            continue
        if k in joined and runs:
            runs[-1][2] = t.ends[k]
        else:
            runs.append([t.rows[k], t.starts[k], t.ends[k], int(best[k]) - 1])
    reach: dict[int, tuple[list, list]] = {}
    for row, a, b, kind in runs:
        base, every = found[row]
        if row not in reach:
            reach[row] = [s for s, *_ in base], list(accumulate((e for *_, e in base), max))
        starts, ends = reach[row]
        k = bisect_left(starts, b)
        if _supported(kind, t.texts[row][a:b]) and not (k and ends[k - 1] > a):
            every.append((a, kind, b))
    return found


def train_field(docs: DataFrame, text: str = "text") -> Field:
    """The field's potentials from counts over all documents; at most a few thousand rows (the shapes) reach the driver."""
    return Field([tuple(r) for r in field_counts(docs, text).collect()])


def personal_data(docs: DataFrame, model: Field | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: its spans as an array of (kind, start, end, base), by start, then kind as listed."""
    model = model or train_field(docs, text)
    shape_ = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            found = all_spans(block, model)
            rows = []
            for row in range(len(block)):
                base, every = found.get(row, ((), ()))
                sure = set(base)
                rows.append([{"kind": KINDS[s[1]], "start": s[0], "end": s[2], "base": s in sure} for s in sorted(every)])
            yield pa.RecordBatch.from_arrays([block.rows.column(0), pa.array(rows, shape_)], names=["id", "spans"])

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int,base:boolean>>"
    return docs.select(id_col, text).mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def personal_data_digest(docs: DataFrame, model: Field | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The spans as the query's digest columns."""
    model = model or train_field(docs, text)
    kinds = list(KINDS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text):
            found = all_spans(block, model)
            got = [found.get(row, ((), ())) for row in range(len(block))]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in got], pa.int64()) for k in range(4)]
            digests = pa.array([sha256_hex(span_text(base, kinds)) for base, _ in got])
            spans = pa.array([span_text(every, kinds) for _, every in got])
            yield pa.RecordBatch.from_arrays([block.rows.column(0), *counts, digests, spans], names=names)

    names = ["id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{n} long" for n in names[1:5]) + ", base_sha256 string, spans string"
    return docs.select(id_col, text).mapInArrow(scan, schema).withColumnRenamed("id", id_col)
