"""Texts as byte blocks: what the Arrow-side operators of this subpackage share.

A Spark string may hold bytes that are no UTF-8 (a cast from binary makes one). One rule holds for all operators that read texts by ``blocks``: each ill-formed
sequence of bytes counts as one U+FFFD, and where an operator returns a changed text, it returns that; rows that pass as they are keep their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20  # a block ends with the text that passes this size, so memory follows the longest text

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_TABLE = LOWER.tobytes()
#: ``[^\x20\x09-\x0D]+`` is what bytes.split() takes as a word.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass
class Block:
    """Some consecutive rows: ``data[offsets[i]:offsets[i + 1]]`` is the UTF-8 text of row i (null: empty)."""

    rows: pa.RecordBatch
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def texts(self) -> Iterator[bytes]:
        raw, off = self.data.tobytes(), self.offsets.tolist()
        return (raw[a:b] for a, b in zip(off, off[1:]))


def well_formed(column: pa.Array) -> pa.Array:
    """A column of texts with ill-formed sequences replaced; nearly always the same column, after one pass of Arrow's validation."""
    try:
        column.validate(full=True)
    except pa.ArrowInvalid:
        raw = column.cast(pa.binary()).to_pylist()
        column = pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw], pa.large_string())
    return column


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut Arrow batches into blocks of about ``limit`` bytes of text, without copying."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = well_formed(batch.column(batch.schema.get_field_index(text))).cast(pa.large_binary())
        if column.null_count:
            column = column.fill_null(b"")
        _, where, what = column.buffers()
        off = np.frombuffer(where, np.int64, len(column) + 1, 8 * column.offset)
        data = np.frombuffer(what, np.uint8) if what is not None else np.zeros(0, np.uint8)
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
            last = min(last, len(column))
            yield Block(batch.slice(first, last - first), data[off[first] : off[last]], off[first : last + 1] - off[first])
            first = last


def span_text(spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    """``kind:start:end`` by start, then kind as listed, comma-joined; spans are (start, kind number, end)."""
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))


def sha256_hex(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64), element by element."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_LANE = np.array([0xFFFFFFFFFFFFFFFF >> (64 - 8 * k) if k else 0 for k in range(9)], np.uint64)  # the low k bytes
LONG_WORD = 64  # bytes; longer words take a cryptographic hash


def word_hashes(block: Block, fold: bool = True, between: np.ndarray = SPACE, longest: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of a block's words (``fold``: A-Z in lower case; ``between``: the bytes that part words;
    ``longest``: only that many bytes of each word count), and for each row the place of its first word (one more at the end).

    A word is read eight bytes at a time, and a bijection mixes each piece in, so no two words of up to eight bytes and one length share a hash.
    A word of more than ``LONG_WORD`` bytes is hashed by BLAKE2b.
    """
    n = len(block.data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(block) + 1, np.int64)
    inside = ~between[block.data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = block.offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    begins[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    end = end if longest is None else np.minimum(end, start + longest)
    data = np.zeros(n + 8, np.uint8)
    data[:n] = LOWER[block.data] if fold else block.data
    pieces = np.lib.stride_tricks.sliding_window_view(data, 8)
    size = end - start
    hashes = mix64(pieces[start].view(np.uint64).ravel() & _LANE[np.minimum(size, 8)])
    more, done = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
    while len(more):
        left = size[more] - done
        hashes[more] = mix64(mix64(hashes[more] + np.uint64(done)) + (pieces[start[more] + done].view(np.uint64).ravel() & _LANE[np.minimum(left, 8)]))
        done += 8
        more = more[left > 8]
    for k in np.flatnonzero(size > LONG_WORD).tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(data[start[k] : end[k]], digest_size=8).digest(), "little")
    return mix64(hashes + size.astype(np.uint64)), np.searchsorted(start, block.offsets)


def words_block(texts: list[str]) -> Block:
    """A block of a few texts that are not rows of a table, such as templates."""
    column = pa.array(texts, pa.string())
    return next(blocks(iter([pa.RecordBatch.from_arrays([column], names=["text"])]), limit=1 << 40))


def letters_only() -> np.ndarray:
    """The bytes that part words of digits, ASCII letters and characters beyond ASCII."""
    between = np.ones(256, bool)
    between[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
    return between
