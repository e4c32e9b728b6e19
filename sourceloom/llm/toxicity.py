"""Toxicity by class-conditional Kneser-Ney bigram models with shared backoff counts.

Toxic and ordinary texts each have a discounted bigram model over their own discounted words, over their own discounted
stems (first bytes of words, so that inflected and unseen forms count). Only pairs weigh by their frequency: words, stems and
the counts shared by both classes, to which all back off, weigh by their continuation counts (in how many distinct words before they stand), and
a count of ``DISCOUNT`` or less is left to the backoff whole, so rare expressions weigh alike. The score is a logistic function of
the length-normalised log-likelihood ratio and of what its largest terms say (the number and share of words whose ratio passes ``HOT``,
the largest ratio), fitted on ratios that models of the other half of the training rows give. Every labelled training row counts
in the models and every document in the shared backoff; at most ``MAX_LABELLED`` labelled rows, those with the smallest MD5 of their
id, fit the logistic function alone. Counts are grouped and smoothed by Spark joins, and those that no ratio depends on do not leave the executors. Of the entries
the ``MAX_ENTRIES`` of the largest counts are broadcast; the others stay a table with a broadcast filter of bounded size, and the words that may have
an entry there are scored by joins, so every entry counts at every size. Labels are joined by a broadcast up to ``MAX_BROADCAST`` of them and by a shuffle beyond.

Defined cases: null, empty and wordless texts have ratio 0 and get the score of that; repeated rows get equal scores; a
document labelled twice is toxic if any label says so; documents of one MD5 order are taken by id; null labels are left out; without labelled rows of both classes every score is the prior; an empty
table gives an empty result; texts are read whole; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.llm.text import Block, blocks, letters_only, mix64, word_hashes
from sourceloom.plans.durable import Workspace

MAX_LABELLED = 4000
DISCOUNT = 2.0
STEM_BYTES = 5
HOT = 1.5
HELD_TOKENS = 5 << 19  # a task counts this many words at once
N_FEATURES = 6
MAX_ENTRIES = 1 << 22  # broadcast for scoring, 16 bytes each
SAMPLE_ENTRIES = 1 << 18  # broadcast for the classifier's sample, 24 bytes each
FILTER_WORDS = 1 << 22  # 64-bit words of the filter of the other entries
MAX_BROADCAST = 1 << 22
_BETWEEN = letters_only()


def remainder(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % 4


def _codes(block: Block) -> tuple[np.ndarray, ...]:
    """Hashes of words (48 bits), of their stems, of the word before (40 bits; a mark at a text's start) and of both words; row starts."""
    h, first = word_hashes(block, between=_BETWEEN)
    stem, _ = word_hashes(block, between=_BETWEEN, longest=STEM_BYTES)
    h >>= np.uint64(16)  # shorter hashes are most of what is saved in the shuffle
    before = np.zeros_like(h)
    before[1:] = h[:-1] >> np.uint64(8)
    before[first[:-1][first[:-1] < len(h)]] = 1
    return h, stem, before, mix64(before) + h, first


def _half(id_col: str) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(2)).cast("int")


def training_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, toxic) of every labelled training row."""
    known = labels.where(f"toxic is not null and {id_col} is not null").groupBy(id_col).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    return known.where(remainder(id_col) != 2)


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, toxic, half) of at most ``limit`` labelled training rows, for the classifier alone."""
    chosen = training_labels(labels, id_col).orderBy(F.md5(F.col(id_col).cast("string")), id_col).limit(limit)  # so its broadcast is bounded
    return docs.select(id_col, text).join(F.broadcast(chosen), id_col).select(text, "toxic", _half(id_col).alias("half"))


def marked(docs: DataFrame, labels: DataFrame, work: Workspace, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(text, mark) of every row: 0 without a training label, else 1 + 2 * toxic + half. Where the ids and marks are few enough, they are broadcast, so no text is shuffled."""
    known = work.keep(training_labels(labels, id_col).select(id_col, (1 + 2 * F.col("toxic") + _half(id_col)).alias("mark")))
    small = known.count() <= MAX_BROADCAST
    return docs.select(id_col, text).join(F.broadcast(known) if small else known, id_col, "left").select(text, F.coalesce("mark", F.lit(0)).alias("mark"))


#: Of each distinct word its stem, itself and the numbers of its unlabelled and labelled pairs; of the pairs the words before, of labelled ones with mark and count; labelled contexts.
_PACKED = {"stem": "<u8", "word": "<u4", "word_low": "<u2", "plain": 4, "known": 4, "before": 3, "known_before": 3, "known_low": "<u2", "mark": "u1", "n": 4, "context": "<u8", "context_mark": "u1", "context_n": 4}
CONTEXT_BITS = 24  # of an unlabelled word before


def _planes(values: np.ndarray, size: int) -> bytes:
    """Numbers of some bytes with each byte apart, so that the upper ones compress."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T[:size]).tobytes()


def _from_planes(raw: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(raw) // size, 4), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8).reshape(size, -1).T
    return out.view("<u4").ravel()


def _column(parts: list[bytes], kind: str | int) -> np.ndarray:
    return np.concatenate([_from_planes(x, kind) if isinstance(kind, int) else np.frombuffer(x, kind) for x in parts])


def packed_counts(rows: DataFrame, bits: int, text: str = "text") -> DataFrame:
    """(bucket, columns of ``_PACKED`` as bytes): counted word pairs by the bucket of their stem, and contexts by their own bucket.

    All pairs of a stem, and so of a word, are in one bucket. A pair without label is kept for the word that stands before alone, by ``CONTEXT_BITS`` of its hash, as only the number of distinct ones
    is asked; linear counting corrects it for shared bits.
    """

    def counted(parts: list[tuple]) -> pa.RecordBatch:
        stem, word, before, mark = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        order = np.lexsort((mark, before, word, stem))  # within a word by what stands before, so upper bytes repeat
        new = np.zeros(len(order), bool)
        new[0] = True
        for key in (mark, before, word, stem):  # one sorted copy at a time, as two workers share an executor's memory
            key = key[order]
            new[1:] |= key[1:] != key[:-1]
        one, n = order[new], np.diff(np.r_[np.flatnonzero(new), len(order)])
        del order, new, key
        stem, word, before, mark = stem[one], word[one], before[one], mark[one]
        first = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (stem[1:] != stem[:-1])])
        some = mark > 0
        known = np.add.reduceat(some.astype(np.int64), first)
        total = np.diff(np.r_[first, len(word)])
        found = {"stem": stem[first], "word": word[first] >> np.uint64(16), "word_low": word[first] & np.uint64(0xFFFF), "plain": total - known, "known": known, "before": before[~some] >> np.uint64(16), "known_before": before[some] >> np.uint64(16),
                 "known_low": before[some] & np.uint64(0xFFFF), "mark": mark[some], "n": n[some]}
        context, c_mark = before[some], mark[some]
        _, c_first, of = np.unique(mix64(context) + c_mark, return_index=True, return_inverse=True)
        c_total = np.bincount(of, n[some], len(c_first)) if len(c_first) else np.zeros(0)
        by = np.argsort(context[c_first])
        found |= {"context": context[c_first][by], "context_mark": c_mark[c_first][by], "context_n": c_total[by]}
        edges = np.arange(1, 1 << bits, dtype=np.uint64)
        cuts = {k: np.r_[0, np.searchsorted(v, edges << np.uint64(shift - bits)), len(v)].tolist() for k, v, shift in (("w", found["stem"], 64), ("p", stem[~some], 64), ("k", stem[some], 64), ("c", found["context"], 40))}
        full = np.flatnonzero(sum(np.diff(at) for at in cuts.values())).tolist()  # no row for an empty bucket, so there are never more rows than pairs
        columns = []
        for name, kind in _PACKED.items():
            at = cuts["c" if name.startswith("context") else "p" if name == "before" else "w" if name in ("stem", "word", "word_low", "plain", "known") else "k"]
            pack = (lambda v, kind=kind: _planes(v, kind)) if isinstance(kind, int) else (lambda v, kind=kind: v.astype(kind).tobytes())
            columns.append(pa.array([pack(found[name][at[k] : at[k + 1]]) for k in full], pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *columns], names=["bucket", *_PACKED])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for block in blocks(batches, text):
            h, stem, before, _, first = _codes(block)
            if not len(h):
                continue
            held.append((stem, h, before, np.repeat(block.rows.column(1).to_numpy().astype(np.uint8), np.diff(first))))
            size += len(h)
            if size >= HELD_TOKENS:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    return rows.select(text, "mark").mapInArrow(count, "bucket int, " + ", ".join(f"{c} binary" for c in _PACKED))


def _distinct(seen: np.ndarray) -> np.ndarray:
    """How many distinct words stand behind so many distinct values of ``CONTEXT_BITS``, by linear counting."""
    size = float(1 << CONTEXT_BITS)
    return -size * np.log1p(-np.minimum(seen, size - 1) / size)


def _grouped(columns: np.ndarray, group: np.ndarray, size: int) -> np.ndarray:
    return np.column_stack([np.bincount(group, c, size) for c in columns.T])


def _parts(counts: np.ndarray) -> np.ndarray:
    """From counts by mark from 1 on: for each class those of half 0, of half 1 and of both."""
    return np.column_stack([x for k in (0, 2) for x in (counts[:, k], counts[:, k + 1], counts[:, k] + counts[:, k + 1])])


WORD, STEM, PAIR, CONTEXT, WORD_SUM, STEM_SUM = range(6)
N_VALUES = 8  # all, then for each class half 0, half 1, both; of a stem also the sum over its words
_KEPT = "kind int, a long, b long, top float, " + ", ".join(f"v{k} float" for k in range(N_VALUES))


def model_counts(packed: DataFrame) -> DataFrame:
    """(kind, a, b, top, v0 ...): what the models need of words, stems, pairs and contexts, and the sums over all of them; ``top`` is the larger class's count.

    What both classes hold ``DISCOUNT`` times or less stays behind. It adds no mass of its own to a class, and its share of
    the backoff is the same in both, so no ratio changes; the sums count it.
    """

    def reduce(table: pa.Table) -> pa.Table:
        got = {name: _column(table.column(name).to_pylist(), kind) for name, kind in _PACKED.items()}
        stem, plain, known, before, high, mark, n, context, c_mark, c_n = (got[c] for c in ("stem", "plain", "known", "before", "known_before", "mark", "n", "context", "context_mark", "context_n"))
        word, low = (got["word"].astype(np.uint64) << np.uint64(16)) | got["word_low"], got["known_low"]
        rows = []

        def add(kind: int, a: np.ndarray, b: np.ndarray, values: np.ndarray, all_: np.ndarray | None = None, within: np.ndarray | None = None) -> None:
            v = np.zeros((len(a), N_VALUES))
            v[:, 1:7] = values
            v[:, 0], v[:, 7] = 0 if all_ is None else all_, 0 if within is None else within
            rows.append([np.full(len(a), kind, np.int32), a.view(np.int64), b.view(np.int64), np.maximum(values[:, 2], values[:, 5]).astype(np.float32), *v.T.astype(np.float32)])

        def frequent(parts: np.ndarray) -> np.ndarray:
            return np.maximum(parts[:, 2], parts[:, 5]) > DISCOUNT

        none = np.zeros(1, np.uint64)
        if len(word):
            words, one, of = np.unique(word, return_index=True, return_inverse=True)
            word_stem = stem[one]
            stems, home = np.unique(word_stem, return_inverse=True)
            known_of = np.repeat(of, known)
            # Every distinct word before, labelled or not.
            every, every_before = np.concatenate([np.repeat(of, plain), known_of]), np.concatenate([before, high])
            _, first = np.unique(mix64(every_before.astype(np.uint64)) + words[every], return_index=True)
            word_all = _distinct(np.bincount(every[first], minlength=len(words)))
            _, first = np.unique(mix64(every_before.astype(np.uint64)) + stems[home[every]], return_index=True)
            stem_all = _distinct(np.bincount(home[every[first]], minlength=len(stems)))
            full = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(16))
            pair, one, at = np.unique(mix64(full) + words[known_of], return_index=True, return_inverse=True)
            parts = _parts(np.bincount(4 * at + (mark - 1), n, 4 * len(pair)).reshape(-1, 4)) if len(pair) else np.zeros((0, 6))
            some = frequent(parts)
            add(PAIR, pair[some], full[one][some], parts[some])
            follows, of_pair = (parts > 0).astype(float), known_of[one]  # each pair is one distinct context of its word
            by_word = _grouped(follows, of_pair, len(words)) if len(pair) else np.zeros((len(words), 6))
            some = frequent(by_word)
            add(WORD, words[some], word_stem[some], by_word[some], word_all[some])
            _, first, at = np.unique(mix64(full[one]) + stems[home[of_pair]], return_index=True, return_inverse=True)
            follows = (_grouped(follows, at, len(first)) > 0).astype(float) if len(first) else follows
            by_stem = _grouped(follows, home[of_pair[first]], len(stems)) if len(first) else np.zeros((len(stems), 6))
            some = frequent(by_stem)
            add(STEM, stems[some], stems[some], by_stem[some], stem_all[some], np.bincount(home, word_all, len(stems))[some])
            add(WORD_SUM, none, none, by_word.sum(0)[None], word_all.sum())
            add(STEM_SUM, none, none, by_stem.sum(0)[None], stem_all.sum())
        if len(context):
            contexts, of = np.unique(context, return_inverse=True)
            parts = _parts(np.bincount(4 * of + (c_mark - 1), c_n, 4 * len(contexts)).reshape(-1, 4))
            some = frequent(parts)
            add(CONTEXT, contexts[some], contexts[some], parts[some])
        schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("top", pa.float32()), *((f"v{k}", pa.float32()) for k in range(N_VALUES))])
        return pa.table([pa.array(np.concatenate(x)) for x in zip(*rows)], schema=schema) if rows else schema.empty_table()

    return packed.groupBy("bucket").applyInArrow(reduce, _KEPT)


def broadcast_level(counts: DataFrame, most: int = MAX_ENTRIES) -> float:
    """``DISCOUNT``, or the least power of 2**(1/8) beyond it that at most ``most`` counts pass. At most 8 rows for each doubling of counts reach the driver."""
    level = F.floor(8 * F.log2("top")).cast("int")
    sizes = sorted(((r.level, r.n) for r in counts.where(F.col("kind") < WORD_SUM).groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    held = 0
    for at, n in sizes:
        held += n
        if held > most:
            return max(DISCOUNT, 2.0 ** ((at + 1) / 8))
    return DISCOUNT


PARTS = 3  # half 0, half 1, both
_IN_PART = [1 + 3 * k + part for part in range(PARTS) for k in (0, 1)]  # values of ``model_counts`` in the order of a model's


def smoothed(counts: DataFrame) -> tuple[DataFrame, list[float], list[bool]]:
    """(kind, a, top, m0 ...): of each word, stem, context and pair its smoothed numbers, of each part for both classes; those of a stem
    that is not known; and which parts have rows of both classes.

    Of a word and a stem these are its probability below a pair, of a pair what is left of its count, of a context what it leaves to its words.
    """
    taken = lambda j: F.greatest(F.col(f"v{j}").cast("double") - DISCOUNT, F.lit(0.0))
    sums = (F.sum(F.col(f"v{j}").cast("double")).alias(f"s{j}") for j in range(N_VALUES))
    rows = counts.where(F.col("kind").isin(WORD, STEM, WORD_SUM, STEM_SUM)).groupBy("kind").agg(*sums, *(F.sum(taken(j)).alias(f"t{j}") for j in _IN_PART)).collect()
    of = {r.kind: r for r in rows}
    total = lambda kind, name: float(of[kind][name]) if kind in of else 0.0
    ready = [all(total(WORD_SUM, f"s{j}") > 0 for j in _IN_PART[2 * part : 2 * part + 2]) for part in range(PARTS)]
    size = {(kind, j): max(total(kind, f"s{j}"), 1.0) for kind in (WORD_SUM, STEM_SUM) for j in _IN_PART}
    left = {j: (size[WORD_SUM, j] - total(WORD, f"t{j}")) / size[WORD_SUM, j] for j in _IN_PART}  # what words leave to stems
    share = {j: (size[STEM_SUM, j] - total(STEM, f"t{j}")) / size[STEM_SUM, j] / (total(STEM_SUM, "s0") + 1) for j in _IN_PART}  # and stems to the shared counts
    model = lambda values: [v.cast("float").alias(f"m{i}") for i, v in enumerate(values)]

    def entries(kind: int) -> DataFrame:
        return counts.where(F.col("kind") == kind)

    of_stem = [left[j] * (taken(j) / size[STEM_SUM, j] + share[j] * F.col("v0")) for j in _IN_PART]
    stems = entries(STEM).select("kind", "a", "top", *model(of_stem))
    home = entries(STEM).select(F.col("a").alias("b"), F.array(*of_stem).alias("of_stem"), F.col("v7").alias("whole"))  # a word's stem is at least as frequent, so it is there
    within = F.col("v0") / F.col("whole")  # a word's share of its stem, the same for both classes
    words = entries(WORD).join(home, "b").select("kind", "a", "top", *model([taken(j) / size[WORD_SUM, j] + F.col("of_stem")[i] * within for i, j in enumerate(_IN_PART)]))
    counted = entries(CONTEXT).select(F.col("a").alias("b"), F.col("top").alias("often"), *(F.greatest(F.col(f"v{j}").cast("double"), F.lit(1.0)).alias(f"n{j}") for j in _IN_PART))
    pairs = entries(PAIR).select("a", "b", "top", *(f"v{j}" for j in _IN_PART)).join(counted, "b")  # and so is a pair's context
    rest = pairs.groupBy("b").agg(*(F.sum(taken(j) / F.col(f"n{j}")).alias(f"r{j}") for j in _IN_PART))
    contexts = counted.select("b", "often").join(rest, "b", "left").select(F.lit(CONTEXT).alias("kind"), F.col("b").alias("a"), F.col("often").alias("top"), *model([1 - F.coalesce(f"r{j}", F.lit(0.0)) for j in _IN_PART]))
    pairs = pairs.select(F.lit(PAIR).alias("kind"), "a", "top", *model([taken(j) / F.col(f"n{j}") for j in _IN_PART]))
    return stems.unionByName(words).unionByName(contexts).unionByName(pairs), [left[j] * share[j] for j in _IN_PART], ready


KINDS = (WORD, STEM, CONTEXT, PAIR)


def _places(kind: np.ndarray | int, keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Where entries stand in a filter of so many 64-bit words, and their two bits there."""
    code = mix64(keys ^ mix64(np.atleast_1d(np.asarray(kind, np.uint64)) + np.uint64(1)))
    one = np.uint64(1)
    return code & np.uint64(size - 1), (one << (code >> np.uint64(52) & np.uint64(63))) | (one << (code >> np.uint64(58)))


def entry_filter(entries: DataFrame) -> np.ndarray:
    """A Bloom filter of the entries' kinds and hashes, of 32 bits an entry and ``FILTER_WORDS`` words at most; beyond that it lets more through, which costs time and no result."""
    size = min(FILTER_WORDS, max(64, 1 << int(entries.count() // 2).bit_length()))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, mask = _places(batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), size)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(mask.view(np.int64))], names=["at", "bits"])

    got = entries.select("kind", "a").mapInArrow(bits, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size, np.uint64)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


class Models:
    """Both classes' smoothed models of some parts (from ``first`` on): sorted arrays of the entries that are broadcast, and a filter of the others (none: there are no others)."""

    def __init__(self, kind: np.ndarray, a: np.ndarray, m: np.ndarray, unknown_stem: list[float], ready: list[bool], first: int = 0, others: np.ndarray | None = None):
        self.ready, self.first, self.others = np.array(ready), first, others
        self.keys, self.values = {}, {}
        for of, unknown in ((WORD, np.nan), (STEM, unknown_stem), (CONTEXT, 1.0), (PAIR, 0.0)):
            at = np.flatnonzero(kind == of)
            at = at[np.argsort(a[at])]
            self.keys[of] = a[at]
            self.values[of] = np.concatenate([m[at], np.broadcast_to(np.asarray(unknown, np.float32), (1, m.shape[1]))])

    def look(self, of: int, keys: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries' numbers for both classes, those of an unknown one where it is not there; and whether it may be among the others."""
        at = _find(self.keys[of], keys)
        other = np.zeros(len(keys), bool)
        if self.others is not None:
            place, mask = _places(of, keys, len(self.others))
            other = (at == len(self.keys[of])) & (self.others[place] & mask == mask)
        return self.values[of][at[:, None], self.columns(part)].astype(float), other

    def columns(self, part: np.ndarray) -> np.ndarray:
        return 2 * (part[:, None] - self.first) + np.arange(2)

    def ratios(self, block: Block, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """For the words of a block, each row by its part: the log-likelihood ratio (NaN where an entry may be among the others), which
        entries may be, by bits, the rows' starts, and the hashes of word, stem, word before and pair."""
        h, stem, before, pair, first = _codes(block)
        part = np.repeat(part, np.diff(first))
        found = [self.look(of, keys, part) for of, keys in zip(KINDS, (h, stem, before, pair))]
        asked = sum(other.astype(np.int32) << k for k, (_, other) in enumerate(found))
        asked = np.where(np.isnan(found[0][0][:, 0]), asked, asked & ~2)  # a stem is asked for an unknown word alone
        ratio = log_ratio(*(values for values, _ in found))
        poor = ~self.ready[part]
        ratio[poor], asked[poor] = 0, 0
        return np.where(asked > 0, np.nan, ratio), asked, first, [h, stem, before, pair]


def log_ratio(word: np.ndarray, stem: np.ndarray, context: np.ndarray, pair: np.ndarray) -> np.ndarray:
    p = np.log(pair + context * np.where(np.isnan(word), stem, word))
    return p[:, 1] - p[:, 0]


@dataclass
class Split:
    """Broadcast models, the entries that are not among them (None: all are), and a place for tables."""

    shared: Broadcast
    others: DataFrame | None
    work: Workspace

    @property
    def models(self) -> Models:
        return self.shared.value


@dataclass
class Trained:
    """The smoothed entries of all parts in a table, a stem's numbers that is not known, and the parts that have both classes."""

    entries: DataFrame
    unknown_stem: list[float]
    ready: list[bool]
    work: Workspace

    def broadcast(self, parts: range, most: int) -> Split:
        """The models of some parts with at most ``most`` entries, those of the largest counts, and the other entries."""
        level, names = broadcast_level(self.entries, most), [f"m{2 * part + k}" for part in parts for k in (0, 1)]
        often = F.col("top") > level
        got = self.entries.where(often).select("kind", "a", *names).toArrow()
        kind, a, m = got.column(0).to_numpy(), got.column(1).to_numpy().view(np.uint64), np.column_stack([got.column(name).to_numpy() for name in names])
        del got
        others = self.entries.where(~often).select("kind", "a", F.array(*names).alias("m")) if level > DISCOUNT else None
        unknown = self.unknown_stem[2 * parts.start : 2 * parts.stop]
        models = Models(kind, a, m, unknown, self.ready, parts.start, None if others is None else entry_filter(others))
        return Split(self.entries.sparkSession.sparkContext.broadcast(models), others, self.work)


_LATE = "late array<struct<pair: long, word: long, stem: long, before: long, asked: int, n: long>>"


def _with_others(rows: DataFrame, split: Split) -> DataFrame:
    """The rows of ``features`` with their late words: each distinct pair and part meets the entries that are not broadcast."""
    shared = split.shared
    rows = split.work.keep(rows.withColumn("uid", F.monotonically_increasing_id()))
    late = rows.select("uid", "part", F.inline("late"))
    kinds = rows.select("part", F.inline("late")).select("pair", "part", "word", "stem", "before", "asked").distinct()
    wanted = F.array(*(F.struct(F.lit(of).alias("kind"), F.col(c).alias("a"), (F.col("asked").bitwiseAND(F.lit(1 << k)) != 0).alias("ask")) for k, (of, c) in enumerate(zip(KINDS, ("word", "stem", "before", "pair")))))
    asked = kinds.select("pair", "part", F.inline(wanted)).where("ask").drop("ask")
    met = asked.join(split.others, ["kind", "a"]).groupBy("pair", "part").agg(*(F.max(F.when(F.col("kind") == of, F.col("m"))).alias(f"m{of}") for of in KINDS))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            part = batch.column("part").to_numpy().astype(np.int64)
            values = []
            for of, name in zip(KINDS, ("word", "stem", "before", "pair")):
                v, _ = models.look(of, batch.column(name).to_numpy().view(np.uint64), part)
                there = batch.column(f"m{of}")
                at = np.flatnonzero(there.is_valid().to_numpy(zero_copy_only=False))
                if len(at):
                    v[at] = there.drop_null().flatten().to_numpy().reshape(-1, models.values[of].shape[1])[np.arange(len(at))[:, None], models.columns(part[at])]
                values.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("pair"), batch.column("part"), pa.array(log_ratio(*values))], names=["pair", "part", "ratio"])

    ratios = kinds.join(met, ["pair", "part"], "left").mapInArrow(resolve, "pair long, part int, ratio double")
    sums = late.join(ratios, ["pair", "part"]).groupBy("uid").agg(F.sum(F.col("n") * F.col("ratio")).alias("more"), F.sum(F.when(F.col("ratio") > HOT, F.col("n")).otherwise(0)).alias("more_hot"), F.max("ratio").alias("high"))
    total, hot = (F.col(c) + F.coalesce(m, F.lit(0)) for c, m in (("total", "more"), ("hot", "more_hot")))
    return rows.drop("late").join(sums, "uid", "left").select("key", "size", total.alias("total"), hot.alias("hot"), F.greatest("top", "high").alias("top"))


def features(rows: DataFrame, split: Split) -> DataFrame:
    """(key, x0 ...) of every row (key, part, text): mean ratio, ratio over root length, log of the length, hot words (log and share), largest ratio.

    Words whose entries are broadcast are summed where the text is. Pairs of words that may have other entries are
    found by joins, each distinct pair once, and their ratios go back to the rows that hold them.
    """
    kind, shared, whole = rows.schema["key"].dataType.simpleString(), split.shared, split.others is None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for block in blocks(batches):
            part = block.rows.column(1).to_numpy().astype(np.int64)
            ratio, asked, first, codes = models.ratios(block, part)
            size, some, now = np.diff(first), np.diff(first) > 0, asked == 0
            sums = []
            for values in (np.where(now, ratio, 0.0), now & (ratio > HOT)):
                running = np.r_[0, np.cumsum(values)]
                sums.append(running[first[1:]] - running[first[:-1]])
            top = np.zeros(len(size))
            if some.any():
                top[some] = np.maximum.reduceat(np.where(now, ratio, -np.inf), first[:-1][some])
            out = [block.rows.column(0), block.rows.column(1), pa.array(size.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1].astype(np.int64)), pa.array(top)]
            names = ["key", "part", "size", "total", "hot", "top"]
            if not whole:
                at = np.flatnonzero(~now)
                row = np.repeat(np.arange(len(size)), size)[at]
                order = np.lexsort((codes[3][at], row))
                at, row = at[order], row[order]
                new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (codes[3][at[1:]] != codes[3][at[:-1]])]) if len(at) else at
                n, at, row = np.diff(np.r_[new, len(row)]), at[new], row[new]
                columns = [*(pa.array(codes[k][at].view(np.int64)) for k in (3, 0, 1, 2)), pa.array(asked[at], pa.int32()), pa.array(n.astype(np.int64))]
                ends = np.searchsorted(row, np.arange(len(size) + 1)).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, ["pair", "word", "stem", "before", "asked", "n"])))
                names.append("late")
            yield pa.RecordBatch.from_arrays(out, names=names)

    got = rows.select("key", "part", "text").mapInArrow(measure, f"key {kind}, part int, size long, total double, hot long, top double" + ("" if whole else ", " + _LATE))
    if not whole:
        got = _with_others(got, split)
    n = F.greatest("size", F.lit(1))
    values = F.col("total") / n, F.col("total") / F.sqrt(n), F.log1p("size"), F.log1p("hot"), F.col("hot") / n, F.col("top")
    return got.select("key", *(v.alias(f"x{k}") for k, v in enumerate(values)))


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(keys), np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, len(table))


class Logistic:
    """Ridge-penalised logistic regression by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.prior = (y.sum() + 0.5) / (len(y) + 5)
        self.weights = None
        if 0 < y.sum() < len(y):
            self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
            z = self._with_one(x)
            w = np.zeros(z.shape[1])
            for _ in range(50):
                p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
                step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w)), z.T @ (y - p) - 1e-2 * w)
                w = w + np.clip(step, -3, 3)
            self.weights = w

    def _with_one(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.column_stack([z, np.ones(len(x))])

    def column(self, names: list[str]) -> Column:
        """The probability as a column function of the numbers' columns."""
        if self.weights is None:
            return F.lit(float(self.prior))
        z = F.lit(float(self.weights[-1]))
        for name, mean, scale, weight in zip(names, self.mean.tolist(), self.scale.tolist(), self.weights.tolist()):
            z = z + (F.col(name) - mean) / scale * weight
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


def train_models(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> Trained:
    """The models of all training rows, in a table."""
    work = Workspace(docs.sparkSession)
    rows = marked(docs, labels, work, id_col, text)
    bits = max(6, 3 + int(docs.rdd.getNumPartitions() - 1).bit_length())  # so a bucket stays small as the input grows
    counted = work.keep(model_counts(packed_counts(rows, bits, text)))
    del rows
    work.free()
    entries, unknown_stem, ready = smoothed(counted)
    trained = Trained(work.keep(entries), unknown_stem, ready, work)
    work.drop(counted)
    del entries
    work.free()
    return trained


NAMES = [f"x{k}" for k in range(N_FEATURES)]


def train(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED, id_col: str = "doc_id", text: str = "text", most: int = SAMPLE_ENTRIES) -> tuple[Trained, Logistic]:
    """The models of all training rows; the classifier's sample, each row measured by the models of the other half, brings one row of numbers a sampled row to the driver."""
    trained = train_models(docs, labels, id_col, text)
    sample = labelled_sample(docs, labels, limit, id_col, text)
    rows = sample.select(F.col("toxic").alias("key"), (1 - F.col("half")).alias("part"), F.col(text).alias("text"))
    halves = trained.broadcast(range(PARTS - 1), most)
    got = features(rows, halves).toPandas()
    halves.shared.destroy()
    return trained, Logistic(got[NAMES].to_numpy(float), got.key.to_numpy(float))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text: str = "text", most: int = MAX_ENTRIES) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``; at most ``most`` entries of the models are broadcast."""
    trained, judge = train(docs, labels, MAX_LABELLED, id_col, text, min(most, SAMPLE_ENTRIES))
    split = trained.broadcast(range(PARTS - 1, PARTS), most)
    out = features(docs.select(F.col(id_col).alias("key"), F.lit(PARTS - 1).alias("part"), F.col(text).alias("text")), split)
    if split.others is None:
        trained.work.drop(trained.entries)
    out = out.select(F.col("key").alias(id_col), judge.column(NAMES).alias("score"))
    return out.select(id_col, F.coalesce(remainder(id_col) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
