"""Benchmark decontamination: a BM25 inverted index of the test items, searched by block-max WAND.

Document frequencies and the mean length are taken over all items, once, and every index uses them, so a score does not depend on what else is in an index. Items are sorted by length and cut into
blocks; for each term an index holds its impact on every item, its largest impact and, for each block, the largest within it. Every passage of every document (overlapping windows that
cover the whole text) is a query of its distinct terms. Impacts are divided by the item's own score, so one threshold serves all items. The maxima of large blocks bound many passages at once, a few megabytes at a time, and those
of small blocks bound what is left; a passage that no block can lift to the threshold is done. For the others WAND moves sorted cursors over the whole posting lists: the pivot is the first item that
the terms before it can lift to the threshold by their largest impacts; where its block cannot reach the threshold all cursors jump to the next block that can, else those before the pivot jump to it, and
only pivots that all reach are scored. What scores above is verified by alignment of the whole item at its passage: in one place the
document must hold, in order, enough words of the item's question (its first three quarters) and of its answer (the rest, three
words at least), each at most ``SLIP`` words off its place, so no single edit fails a part. An item of fewer than ``RUN`` words must be whole.
Items of up to 64, 256, 1,024, ... words have an index each, with windows of twice that many words, so a long item does not widen the passages of short ones and a passage does not depend on the items.

Items are dealt to shards of about ``SHARD_BYTES`` of text and ``SHARD`` items by a hash; no result depends on that. Spark tasks build the indexes; the driver passes one
pickled index at a time to a broadcast, and each shard has its own pass over the documents.

Defined cases: null, empty and blank texts match nothing; items without words are left out; repeated items are found
under each id, and of passages that match equally well the first counts; items of equal score are all found; an empty table on either side gives an empty result; long texts and long items are read whole; clashing column names do not matter,
because only id and text are read.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sourceloom.llm.text import Block, blocks, letters_only, word_hashes, words_block

K1, B = 1.2, 0.75
SHARD = 20_000
BLOCK_ITEMS, SMALL_BLOCK = 8, 2
THRESHOLD = 0.4
RUN = 4
SLIP = 3
OVERLAP = 0.6
SHARD_BYTES = 1 << 24
SHORTEST, WIDER = 64, 4  # words of the first class of items, and how many times as many each next one takes
BOUNDS = 1 << 20  # passages x blocks that are bounded at once
PAIRS = 1 << 22  # pairs of equal words that alignment looks at once
_BETWEEN = letters_only()


def _chain(j: np.ndarray) -> int:
    """The longest chain of pairs (i, j) that rises in both numbers; they come by i, then by falling j."""
    ends: list[int] = []
    for x in j.tolist():
        k = bisect_left(ends, x)
        ends[k : k + 1] = [x]
    return len(ends)


@dataclass(frozen=True)
class Statistics:
    """Of all items with words: how many there are, their mean length, and the terms, sorted, with the number of items that hold each."""

    n: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


def statistics_of(own: list[np.ndarray]) -> Statistics:
    own = [w for w in own if len(w)]
    terms, df = np.unique(np.concatenate([np.unique(w) for w in own] or [np.zeros(0, np.uint64)]), return_counts=True)
    return Statistics(len(own), sum(map(len, own)) / max(1, len(own)), terms, df)


def _class_of(size: int) -> int:
    bound = SHORTEST
    while bound < size:
        bound *= WIDER
    return bound


def indexes(ids: list, texts: list[str], known: Statistics | None = None) -> list[ItemIndex]:
    """An index for each class of lengths in use; without ``known`` statistics, by those of the items."""
    hashes, first = word_hashes(words_block(texts or [""]), between=_BETWEEN)
    own = [hashes[a:b] for a, b in zip(first.tolist(), first[1:].tolist())]
    known = known or statistics_of(own)
    bounds = [_class_of(len(w)) if len(w) else 0 for w in own]
    parts = [[k for k, x in enumerate(bounds) if x == bound] for bound in sorted({*bounds} - {0})]
    return [ItemIndex([ids[k] for k in p], [own[k] for k in p], known) for p in parts]


class ItemIndex:
    """Impacts of terms on items and on blocks of items, and the words that verification asks for."""

    def __init__(self, ids: list, own: list[np.ndarray], known: Statistics | None = None):
        order = sorted((k for k in range(len(own)) if len(own[k])), key=lambda k: (len(own[k]), k))
        self.ids, self.words = [ids[k] for k in order], [own[k] for k in order]
        known = known or statistics_of(own)
        n = len(order)
        self.n_blocks = -(-n // BLOCK_ITEMS)
        sizes = np.array([len(w) for w in self.words], float)
        self.window = 2 * _class_of(int(sizes.max(initial=1)))
        self.terms = np.unique(np.concatenate(self.words)) if n else np.zeros(0, np.uint64)
        # Postings in order of terms: item, impact.
        term, item, tf = [], [], []
        for k, w in enumerate(self.words):
            t, c = np.unique(w, return_counts=True)
            term.append(np.searchsorted(self.terms, t))
            item.append(np.full(len(t), k))
            tf.append(c)
        if n:
            term, item, tf = (np.concatenate(x) for x in (term, item, tf))
            df = known.df[np.searchsorted(known.terms, self.terms)]
            idf = np.log(1 + (known.n - df + 0.5) / (df + 0.5))
            impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[item] / known.mean))
            impact /= np.bincount(item, impact, n)[item]
            by = np.lexsort((item, term))
            self.item, self.impact = item[by].astype(np.int32), impact[by].astype(np.float32)
            self.start = np.searchsorted(term[by], np.arange(len(self.terms) + 1))
            # Block postings: the largest impact of a term within a block.
            key = term[by].astype(np.int64) * self.n_blocks + self.item // BLOCK_ITEMS
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            self.block, self.block_max = (key[cut] % self.n_blocks).astype(np.int32), np.maximum.reduceat(self.impact, cut)
            self.block_start = np.searchsorted(key[cut] // self.n_blocks, np.arange(len(self.terms) + 1))
            n_small = -(-n // SMALL_BLOCK)
            key = term[by].astype(np.int64) * n_small + self.item // SMALL_BLOCK
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            self.small, self.small_max = (key[cut] % n_small).astype(np.int32), np.maximum.reduceat(self.impact, cut)
            self.small_start = np.searchsorted(key[cut] // n_small, np.arange(len(self.terms) + 1))
        self.cursors: dict[int, tuple[float, list[int], list[float]]] = {}

    def candidates(self, found: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
        """(passage, item) at or above the threshold; ``found`` holds term numbers of the text's words, -1 for others. Passage q begins at word q * window / 2."""
        half = self.window // 2
        last = max(0, -(-len(found) // half) - 2)
        step = max(1, BOUNDS // self.n_blocks)
        least = threshold - 1e-5
        spans: dict[int, tuple[list[int], list[int]]] = {}
        for low in range(0, last + 1, step):
            high = min(low + step, last + 1)
            begin = low * half
            known = np.flatnonzero(found[begin : len(found) if high > last else (high + 1) * half] >= 0) + begin
            if not len(known):
                continue
            part = known // half
            query = np.concatenate([np.minimum(part, last), np.clip(part - 1, 0, last)])
            inside = (query >= low) & (query < high)
            key = np.unique((query[inside] - low) * len(self.terms) + np.tile(found[known], 2)[inside])
            query, term = np.divmod(key, len(self.terms))
            rows, at = _expand(self.block_start, term)
            bound = np.bincount(query[rows] * self.n_blocks + self.block[at], self.block_max[at], (high - low) * self.n_blocks)
            alive = bound >= least
            busy = alive.reshape(high - low, self.n_blocks).any(1)[query]
            query, term = query[busy], term[busy]
            rows, at = _expand(self.small_start, term)
            kept = alive[query[rows] * self.n_blocks + self.small[at] // (BLOCK_ITEMS // SMALL_BLOCK)]
            rows, at = rows[kept], at[kept]
            n_small = self.n_blocks * (BLOCK_ITEMS // SMALL_BLOCK)
            bound = np.bincount(query[rows] * n_small + self.small[at], self.small_max[at], 1)
            asked, blocks_ = np.divmod(np.flatnonzero(bound >= least), n_small)
            for q, a, b in zip(asked.tolist(), np.searchsorted(query, asked).tolist(), np.searchsorted(query, asked, "right").tolist()):
                spans.setdefault(q + low, (term[a:b].tolist(), []))
            for q, block in zip(asked.tolist(), blocks_.tolist()):
                spans[q + low][1].append(block)
            for q in sorted(spans):
                for item in self.wand(*spans[q], threshold):
                    yield q, item
            spans.clear()

    def wand(self, terms: list[int], alive: list[int], threshold: float) -> list[int]:
        """The items that a query of distinct terms scores at or above the threshold; ``alive``: the small blocks whose maxima reach it, in order."""
        least = threshold - 1e-5  # bounds are sums in another order than scores
        begin, lists = alive[0] * SMALL_BLOCK, []  # [current item, place, largest impact, items, impacts]
        for t in terms:
            if t not in self.cursors:
                a, b = self.start[t], self.start[t + 1]
                self.cursors[t] = float(self.impact[a:b].max()), self.item[a:b].tolist(), self.impact[a:b].tolist()
            most, items, impacts = self.cursors[t]
            at = bisect_left(items, begin)
            if at < len(items):
                lists.append([items[at], at, most, items, impacts])
        out, block = [], 0
        while lists:
            lists.sort(key=lambda x: x[0])
            total, k = 0.0, 0
            while k < len(lists) and total < least:
                total += lists[k][2]
                k += 1
            if total < least:
                break
            pivot = target = lists[k - 1][0]
            block = bisect_left(alive, pivot // SMALL_BLOCK, block)
            if block == len(alive):
                break
            if alive[block] * SMALL_BLOCK > pivot:
                target = alive[block] * SMALL_BLOCK
            elif lists[0][0] == pivot:
                if sum(x[4][x[1]] for x in lists if x[0] == pivot) >= threshold:
                    out.append(pivot)
                target = pivot + 1
            for x in lists:
                if x[0] >= target:
                    break
                x[1] = at = bisect_left(x[3], target, x[1])
                x[0] = x[3][at] if at < len(x[3]) else -1
            lists = [x for x in lists if x[0] >= 0]
        return out

    def verified(self, hashes: np.ndarray, hits: Iterator[tuple[int, int]], overlap: float) -> Iterator[tuple[int, float, float]]:
        """(item, question share, answer share) of hits that alignment finds in their passage and half a window around it."""
        half, place, near, order, ordered = self.window // 2, None, None, None, None
        for q, k in hits:
            if q != place:
                near = hashes[max(0, q - 1) * half : (q + 4) * half]
                place, order = q, np.argsort(near, kind="stable")
                ordered = near[order]
            question, answer = max(shares for shares in self._shares(k, near, order, ordered, overlap))
            if question:
                yield k, question, answer

    def _shares(self, k: int, near: np.ndarray, order: np.ndarray, ordered: np.ndarray, overlap: float) -> Iterator[tuple[float, float]]:
        """The shares of question and answer in each place that holds enough of both, and a pair of zeros."""
        yield 0.0, 0.0
        word = self.words[k]
        size = len(word)
        overlap = overlap if size >= RUN else 1.0
        tail = min(size, max(3, -(-size // 4)))
        head = max(size - tail, min(size, 3))
        low = np.searchsorted(ordered, word)
        n = np.searchsorted(ordered, word, "right") - low
        # How many words of the item stand at each place, a bounded number of pairs at a time; place is the position in the text less that in the item.
        at_place = np.zeros(len(near) + size + 2 * SLIP, np.int32)
        cuts = np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), size]):
            m = n[a:b]
            i = np.repeat(np.arange(a, b), m)
            j = order[np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(low[a:b], m)]
            at_place += np.bincount(j - i + size, minlength=len(at_place)).astype(np.int32)
        held = np.r_[0, np.cumsum(at_place)]
        band = held[2 * SLIP + 1 :] - held[: -2 * SLIP - 1]
        for place in (np.flatnonzero((band >= overlap * size) & (at_place[: len(band)] > 0)) - size).tolist():
            x, y = [], []
            for p in range(place, place + 2 * SLIP + 1):
                a, b = max(0, -p), min(size, len(near) - p)
                same = np.flatnonzero(near[a + p : b + p] == word[a:b]) + a if a < b else np.zeros(0, np.int64)
                x.append(same)
                y.append(same + p)
            x, y = np.concatenate(x), np.concatenate(y)
            if len(np.unique(x)) < overlap * size:
                continue
            by = np.lexsort((-y, x))
            x, y = x[by], y[by]
            question = _chain(y[x < head]) / head
            answer = _chain(y[x >= size - tail]) / tail
            if min(question, answer) >= overlap:
                yield question, answer
                if question == answer == 1:
                    return


def _expand(start: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each posting of each term of a list: the place in the list and the place of the posting."""
    n = start[term + 1] - start[term]
    rows = np.repeat(np.arange(len(term)), n)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[term], n)


def search(block: Block, shard: list[ItemIndex], threshold: float, overlap: float) -> Iterator[tuple[int, object, float, float]]:
    """(row, item id, question share, answer share) for a block; of an item's passages in a row the one with the largest shares."""
    hashes, first = word_hashes(block, between=_BETWEEN)
    best: dict[tuple[int, int, int], tuple[float, float, object]] = {}
    for number, index in enumerate(shard):
        at = np.minimum(np.searchsorted(index.terms, hashes), len(index.terms) - 1)
        found = np.where(index.terms[at] == hashes, at, -1)
        for row, (a, b) in enumerate(zip(first.tolist(), first[1:].tolist())):
            for k, q, r in index.verified(hashes[a:b], index.candidates(found[a:b], threshold), overlap):
                key = row, number, k
                if key not in best or best[key][:2] < (q, r):
                    best[key] = q, r, index.ids[k]
    for (row, *_), (q, r, item) in sorted(best.items(), key=lambda x: x[0]):
        yield row, item, q, r


def item_shards(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[bytes]:
    """Pickled indexes of the items, one for each shard, all by the statistics of the whole table."""
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("size")).first()
    shards = max(-(-size.n // SHARD), -(-size.size // SHARD_BYTES), 1)
    dealt = items.where(F.col(text).isNotNull()).select(F.col(item_id).alias("id"), F.col(text).alias("text"), F.pmod(F.xxhash64(item_id, text), F.lit(shards)).alias("shard"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            hashes, first = word_hashes(block, between=_BETWEEN)
            own = [np.unique(hashes[a:b]) for a, b in zip(first.tolist(), first[1:].tolist())]
            ends = pa.array(np.r_[0, np.cumsum([len(w) for w in own])], pa.int32())
            terms = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(own).view(np.int64)))
            yield pa.RecordBatch.from_arrays([block.rows.column(0), pa.array(np.diff(first), pa.int64()), terms], names=["shard", "size", "terms"])

    words = dealt.select("shard", "text").mapInArrow(count, "shard long, size long, terms array<long>").where("size > 0")
    total = words.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
    held = words.select("shard", F.explode("terms").alias("term"))
    df = held.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    own_df = held.distinct().join(df, "term")

    def build(table: pa.Table, counts: pa.Table) -> pa.Table:
        ids, texts = (table.column(name).to_pylist() for name in ("id", "text"))
        by = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] if ids[k] is not None else 0, texts[k]))
        terms, n = counts.column("term").to_numpy().view(np.uint64), counts.column("df").to_numpy()
        order = np.argsort(terms)
        known = Statistics(total.n, total.size / total.n, terms[order], n[order]) if total.n else None
        made = pickle.dumps(indexes([ids[k] for k in by], [texts[k] for k in by], known), protocol=5)
        return pa.table({"made": pa.array([made], pa.large_binary()).cast(pa.binary())})

    for r in dealt.groupBy("shard").cogroup(own_df.groupBy("shard")).applyInArrow(build, "made binary").toLocalIterator():
        yield bytes(r.made)


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, id_col: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, question_overlap, answer_overlap) of verified matches."""
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_id].dataType
    schema = f"{id_col} {kind}, {item_id} {item_kind.simpleString()}, question_overlap double, answer_overlap double"

    def one(made: bytes) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(made)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard = pickle.loads(shared.value)
            for block in blocks(batches, text):
                rows = list(search(block, shard, threshold, overlap))
                if rows:
                    row, item, q, a = zip(*rows)
                    cols = [block.rows.column(0).take(pa.array(row)), pa.array(item, to_arrow_type(item_kind)), pa.array(q), pa.array(a)]
                    yield pa.RecordBatch.from_arrays(cols, names=[id_col, item_id, "question_overlap", "answer_overlap"])

        return docs.select(id_col, text).mapInArrow(scan, schema)

    parts = [one(made) for made in item_shards(items, item_id, text)]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text holds no item."""
    out = docs
    for made in item_shards(items, text=text):
        shared = docs.sparkSession.sparkContext.broadcast(made)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            shard = pickle.loads(shared.value)
            for block in blocks(batches, text):
                bad = {row for row, *_ in search(block, shard, threshold, overlap)}
                yield block.rows.filter(pa.array([k not in bad for k in range(len(block))])) if bad else block.rows

        out = out.mapInArrow(scan, docs.schema)
    return out
