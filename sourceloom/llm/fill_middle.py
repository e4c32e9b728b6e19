"""Fill-in-the-middle transformation: a wavelet matrix over character classes counts and finds the units that a text is cut at.

A unit is a run of ASCII letters or any other character. Each byte of a block of texts has a class: a character that is no letter, the first letter of a run, a later letter, a
further byte of a character. Two levels of bit vectors hold the classes; the ranks of the first two classes sum to the number of units before a place, the
rank of the last one turns bytes into code points, and bisection on the summed ranks finds both cuts of all texts of a block at once.
A text's hash decides the cuts and the form: plain, or prefix, suffix and middle in one of two orders with a mark before each.

Defined cases: a null text counts as empty, and an empty text and one that holds a mark stay plain; a null id hashes as an empty one; repeated rows get equal results; an empty table gives an
empty result; texts are read whole, a block at a time, and only id and text are read, so other columns may have any name. Ill-formed UTF-8 is replaced as ``text`` says.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.text import Block, blocks

OTHER, FIRST, INNER, FURTHER = range(4)  # classes of bytes
LEVELS = 2  # bits of a class
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


class BitVector:
    """Bits in 64-bit words with a running count, so a rank is one look-up and one population count."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = np.zeros(len(bits) // 64 + 1, "<u8")
        words.view(np.uint8)[: len(packed)] = packed
        self.words, self.ones = words, np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many of the first i bits are set, for each i."""
        word = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.ones[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Ranks of symbols of ``levels`` bits: each level holds one bit of every symbol, in the order that stable partitions by the bits above give."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.levels = []
        for shift in range(levels - 1, -1, -1):
            bit = (symbols >> shift & 1).astype(bool)
            self.levels.append((BitVector(bit), int(len(bit) - np.count_nonzero(bit))))
            if shift:
                symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: int, i: np.ndarray) -> np.ndarray:
        """How often the symbol occurs before each place."""
        begin, end = np.zeros(1, np.int64), i
        for k, (bits, zeros) in enumerate(self.levels):
            if symbol >> (len(self.levels) - 1 - k) & 1:
                begin, end = zeros + bits.rank(begin), zeros + bits.rank(end)
            else:
                begin, end = begin - bits.rank(begin), end - bits.rank(end)
        return end - begin


@dataclass(frozen=True)
class Recipe:
    """The seed that texts' hashes begin with, and how many of a hundred texts are transformed, and how many of those put the suffix first."""

    seed: str = "1"
    transformed: int = 90
    suffix_first: int = 20


def byte_classes(block: Block) -> np.ndarray:
    letter = _LETTER[block.data]
    after = np.zeros(len(letter), bool)
    after[1:] = letter[:-1]
    begins = block.offsets[:-1]
    after[begins[begins < len(letter)]] = False  # a run ends with its text
    classes = np.where(letter, np.where(after, INNER, FIRST), OTHER).astype(np.uint8)
    classes[(block.data & 0xC0) == 0x80] = FURTHER
    return classes


def cut_places(block: Block, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, the bytes at which its prefix and its middle end, and code points before its begin and those places; ``shares``: two hashes a text."""
    matrix = WaveletMatrix(byte_classes(block))
    units = lambda i: matrix.rank(OTHER, i) + matrix.rank(FIRST, i)
    off = block.offsets.astype(np.int64)
    before = units(off)
    n = np.diff(before)
    wanted = np.sort(shares.astype(np.int64) % (n + 1)[:, None], axis=1)
    # The byte that a unit begins at is the last place before which it is not counted yet; past the last unit that is the end.
    target = (before[:-1, None] + wanted + 1).ravel()
    low, high = np.repeat(off[:-1], 2), np.repeat(off[1:] + 1, 2)
    while (low < high).any():
        mid = (low + high) >> 1
        reached = units(np.minimum(mid, off[-1])) >= target
        open_ = low < high
        high = np.where(open_ & reached, mid, high)
        low = np.where(open_ & ~reached, mid + 1, low)
    cuts = (low - 1).reshape(-1, 2)
    places = np.column_stack([off[:-1], cuts])
    return n, cuts - off[:-1, None], places - matrix.rank(FURTHER, places.ravel()).reshape(-1, 3)


def transform(docs: DataFrame, recipe: Recipe = Recipe(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output): each text's units, its form (plain, psm or spm), code points of the parts and the transformed text."""
    key = F.sha2(F.concat(F.lit(f"{recipe.seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, s, m = marks
        for block in blocks(batches, "text"):
            hashes = np.frombuffer(bytes.fromhex("".join(block.rows.column(2).to_pylist())), ">u4").reshape(-1, 8)
            n, cuts, chars = cut_places(block, hashes[:, :2])
            forms, outputs = [], []
            for raw, (a, b), h3, h4 in zip(block.texts(), cuts.tolist(), hashes[:, 2].tolist(), hashes[:, 3].tolist()):
                if not raw or h3 % 100 >= recipe.transformed or any(x in raw for x in marks):
                    forms.append("plain")
                    outputs.append(raw)
                elif h4 % 100 < recipe.suffix_first:
                    forms.append("spm")
                    outputs.append(b"".join((s, raw[b:], p, raw[:a], m, raw[a:b])))
                else:
                    forms.append("psm")
                    outputs.append(b"".join((p, raw[:a], s, raw[b:], m, raw[a:b])))
            plain = np.array([f == "plain" for f in forms], bool)
            sizes = [pa.array(x, pa.int64(), mask=plain) for x in np.diff(chars, axis=1).T]
            yield pa.RecordBatch.from_arrays([block.rows.column(0), pa.array(n, pa.int64()), pa.array(forms), *sizes, pa.array(outputs, pa.binary()).cast(pa.string())], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), key.alias("key"))
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def restore(output: Column, form: Column) -> Column:
    """The text that a transformed one was made of. A transformed text held no mark, so the first of each mark is the one that was put in."""

    def parts(marks: tuple[str, str]) -> tuple[Column, Column, Column]:
        rest = F.substr(output, F.lit(4))
        one = F.substring_index(rest, marks[0], 1)
        rest = F.substr(rest, F.length(one) + 4)
        two = F.substring_index(rest, marks[1], 1)
        return one, two, F.substr(rest, F.length(two) + 4)

    prefix, suffix, middle = parts((SUFFIX, MIDDLE))
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts((PREFIX, MIDDLE))
    return F.when(form == "psm", psm).when(form == "spm", F.concat(prefix, middle, suffix)).otherwise(output)


def transform_digest(docs: DataFrame, recipe: Recipe = Recipe(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``transform`` with SHA-256 of the transformed text and of the text restored from it, in place of the text."""
    made = transform(docs, recipe, id_col, text)
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select(id_col, "n", "form", "prefix_chars", "middle_chars", *digests)
