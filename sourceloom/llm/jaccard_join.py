"""N-gram Jaccard join by T-occurrence search (DivideSkip), and its near-duplicate components.

A document's set holds its distinct word shingles as 64-bit hashes. Two sets of sizes x and y link when their overlap reaches
``needed(x, y)``. The texts are read twice. The first reading finds the lists that hold many documents (``long_lists``).
The second deals every other posting, packed, to buckets by its hash, where the exact length of each inverted list is counted; what stands in
one document alone stops there, and the rest goes back to the block of documents that it came from. With ``least`` the
smallest overlap that any link of a set has, a set's lists are divided into its ``least - 1`` longest and the short rest; lists of one document
count as short. A set whose short lists are all its own links with nothing.

The other short lists are merged by pairs of documents. A pair whose merged count leaves too few long lists to reach the overlap is rejected;
for the others the long lists are probed by binary search. So that a group of near copies does not bring all its pairs, each document is
first compared with the smallest document of its lists, the one that shares most of them; then, in rounds, the lists that still hold several
components compare some members with all others, four times as many each round, until every pair of a list is compared or
lies in one component. No link between components is lost, and a list of n members in one component costs n comparisons.

Defined cases: null, empty and blank texts have an empty set and stand alone; fewer words than a shingle make one
shingle of the whole sequence; rows of equal texts are one class, named by the smallest id; an id may repeat, with the same text or
another, and each of its rows has a result; a null id is like any other and names a class only if no other id does; an empty table gives an
empty result; texts are read whole; only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from sourceloom.llm.text import Block, blocks, mix64, word_hashes
from sourceloom.operators.components import follow_pointers, star_components
from sourceloom.plans.durable import Workspace

WORDS = 5
NUMERATOR, DENOMINATOR = 3, 4  # a similarity of 0.75
HELD = 1 << 20  # words of a block of documents that is sorted at once
HELD_DOCS = 1 << 16
LONG_SHARE = 1024  # a list is long from this part of the documents on
LONG_LEAST = 32
MOST_LONG = 1 << 22  # bounds the number of long lists: each holds at least this part of all words
BUCKET_BYTES = 1 << 24  # of text, for each bucket of postings
MARK_WORDS = 1 << 20  # 64-bit words of the table that marks dropped rows


def needed(x: int, y: int) -> int:
    """The overlap at which sets of sizes x and y reach the similarity."""
    return -(-NUMERATOR * (x + y) // (NUMERATOR + DENOMINATOR))


def least_overlap(n):
    """The smallest overlap that a set of size n has with any set that links."""
    return -(-NUMERATOR * n // DENOMINATOR)


def shingle_codes(block: Block, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of a block's shingles and the row of each, by rows; repeated ones are still there."""
    hashes, first = word_hashes(block)
    codes = hashes[: max(len(hashes) - words + 1, 0)].copy()
    for k in range(1, words):
        codes = mix64(codes) + hashes[k : k + len(codes)]
    size = np.diff(first)
    row = np.repeat(np.arange(len(size)), size)[: len(codes)]
    whole = np.arange(len(codes)) + words <= first[1:][row]
    codes, row = mix64(codes[whole]), row[whole]
    few = np.flatnonzero((size > 0) & (size < words))
    if len(few):
        own = []
        for k in few.tolist():
            code = np.array([size[k]], np.uint64)
            for h in hashes[first[k] : first[k + 1]]:
                code = mix64(code) + h
            own.append(code)
        codes, row = np.concatenate([codes, mix64(np.concatenate(own))]), np.concatenate([row, few])
    return codes, row


def _sorted_sets(codes: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (code, row) pairs by code, then row."""
    order = np.argsort(codes)
    codes, row = codes[order], row[order]
    same = codes[1:] == codes[:-1]
    part = np.flatnonzero(np.r_[same, False] | np.r_[False, same])
    row[part] = row[part][np.lexsort((row[part], codes[part]))]
    new = np.ones(len(codes), bool)
    new[1:] = ~same | (row[1:] != row[:-1])
    return codes[new], row[new]


def _held(batches: Iterator[pa.RecordBatch], text: str, words: int) -> Iterator[tuple[list[pa.Array], np.ndarray, np.ndarray, int, int]]:
    """Blocks of documents: their first columns, the distinct (code, row) pairs, the number of rows and the bytes of text."""
    keys, codes, rows, size, count, n_bytes = [], [], [], 0, 0, 0
    for block in blocks(batches, text):
        for a in range(0, len(block), HELD_DOCS):
            some = block if len(block) <= HELD_DOCS else Block(block.rows.slice(a, HELD_DOCS), block.data[block.offsets[a] : block.offsets[min(a + HELD_DOCS, len(block))]], block.offsets[a : a + HELD_DOCS + 1] - block.offsets[a])
            if count and (size >= HELD or count + len(some) > HELD_DOCS):
                yield keys, *_sorted_sets(np.concatenate(codes), np.concatenate(rows)), count, n_bytes
                keys, codes, rows, size, count, n_bytes = [], [], [], 0, 0, 0
            c, r = shingle_codes(some, words)
            keys.append(some.rows.column(0))
            codes.append(c)
            rows.append(r + count)
            size, count, n_bytes = size + len(c), count + len(some), n_bytes + len(some.data)
    if count:
        yield keys, *_sorted_sets(np.concatenate(codes), np.concatenate(rows)), count, n_bytes


@dataclass
class LongLists:
    """The codes of long lists, sorted, with their lengths, and the number of buckets for the other postings (a power of two)."""

    codes: np.ndarray
    lengths: np.ndarray
    bits: int


def long_lists(docs: DataFrame, work: Workspace, text: str = "text", words: int = WORDS) -> LongLists:
    """Lists that hold a 1024th of the documents.

    A block of documents counts what stands in a 1024th of its own documents, twice at least. A list of a 512th of all documents is in that
    many of some block's, so it is never missed; a shorter one may be counted too low or be left out, which changes the order of
    lists, the same for all sets, and no link. A list that is taken holds a part of all words, so there are ``MOST_LONG`` at most, whatever the size of the corpus.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, codes, _, n_docs, n_bytes in _held(batches, text, words):
            at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
            n = np.diff(np.r_[at, len(codes)])
            many = n >= max(2, n_docs // LONG_SHARE)
            kind = np.r_[np.zeros(many.sum(), np.int32), [1, 2, 3]].astype(np.int32)
            cols = [kind, np.r_[codes[at[many]].view(np.int64), [0, 0, 0]], np.r_[n[many], [n_docs, len(codes), n_bytes]].astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "code", "n"])

    counted = work.keep(docs.select(text).mapInArrow(count, "kind int, code long, n long").groupBy("kind", "code").agg(F.sum("n").alias("n")))
    total = {r.kind: r.n for r in counted.where("kind > 0").collect()}
    least = max(LONG_LEAST, total.get(1, 0) // LONG_SHARE, total.get(2, 0) // MOST_LONG)
    found = counted.where((F.col("kind") == 0) & (F.col("n") >= least)).select("code", "n").toArrow()
    work.drop(counted)
    codes, n = found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy()
    order = np.argsort(codes)
    return LongLists(codes[order], n[order], min(18, max(8, int(total.get(3, 0) // BUCKET_BYTES).bit_length())))


def _pack(codes: np.ndarray) -> bytes:
    """Sorted codes with their upper bytes apart, where they hardly change and so compress."""
    return (codes & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (codes >> np.uint64(32)).astype("<u2").tobytes() + (codes >> np.uint64(48)).astype("<u2").tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    n = len(raw) // 8
    low, mid, high = np.frombuffer(raw, "<u4", n), np.frombuffer(raw, "<u2", n, 4 * n), np.frombuffer(raw, "<u2", n, 6 * n)
    return low.astype(np.uint64) | (mid.astype(np.uint64) << np.uint64(32)) | (high.astype(np.uint64) << np.uint64(48))


def _joined(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def divided(docs: DataFrame, lists: LongLists, key: str, text: str = "text", words: int = WORDS) -> DataFrame:
    """(uid, key, n, s1, s2, own, k, codes) for every row: a number of the row, the set's size and 128-bit signature, how many of its lists hold
    no other row, how many of ``codes`` are short; ``codes`` are its other lists, shortest first, null where the row can link with nothing."""
    key_type = docs.schema[key].dataType
    arrow_key = to_arrow_type(StructType.fromDDL(f"key {key_type.simpleString()}")[0].dataType)  # every field nullable
    shared = docs.sparkSession.sparkContext.broadcast(lists)
    packed = pa.schema([
        ("bucket", pa.int32()), ("blob", pa.int64()), ("codes", pa.binary()), ("rows", pa.binary()), ("lengths", pa.binary()),
        ("keys", pa.list_(arrow_key)), ("sums", pa.binary()), ("long_rank", pa.binary()), ("long_row", pa.binary()),
    ])
    ddl = f"bucket int, blob long, codes binary, rows binary, lengths binary, keys array<{key_type.simpleString()}>, sums binary, long_rank binary, long_row binary"

    def postings(bucket, blob: int, codes, rows, lengths) -> pa.RecordBatch:
        n = len(bucket)
        cols = [pa.array(bucket, pa.int32()), pa.array(np.full(n, blob)), *(pa.array(x, pa.binary()) for x in (codes, rows, lengths)), *(pa.nulls(n, packed.field(k).type) for k in range(5, 9))]
        return pa.RecordBatch.from_arrays(cols, schema=packed)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        edges = np.arange(1, 1 << known.bits, dtype=np.uint64) << np.uint64(64 - known.bits)
        place = TaskContext.get().partitionId() << 32  # with the place in the task it names the block of documents within this one shuffle
        for turn, (keys, codes, rows, n_docs, _) in enumerate(_held(batches, text, words)):
            blob = place + turn
            sizes = np.bincount(rows, minlength=n_docs)
            sums = np.zeros((2, n_docs), np.uint64)
            np.add.at(sums[0], rows, codes)
            np.add.at(sums[1], rows, mix64(codes + sizes[rows].astype(np.uint64)))
            low, high = np.searchsorted(codes, known.codes), np.searchsorted(codes, known.codes, "right")
            rank = np.repeat(np.arange(len(low)), high - low)
            at = np.arange(len(rank)) + np.repeat(low - (np.cumsum(high - low) - (high - low)), high - low)
            head = [
                pa.array([(turn + TaskContext.get().partitionId()) % (1 << known.bits)], pa.int32()), pa.array([blob]), *(pa.nulls(1, pa.binary()) for _ in range(3)),
                pa.ListArray.from_arrays(pa.array([0, n_docs], pa.int32()), pa.concat_arrays(keys).cast(arrow_key)),
                *(pa.array([x], pa.binary()) for x in (sizes.astype("<u8").tobytes() + sums.tobytes(), rank.astype("<u4").tobytes(), rows[at].astype("<u2").tobytes())),
            ]
            yield pa.RecordBatch.from_arrays(head, schema=packed)
            short = np.ones(len(codes), bool)
            short[at] = False
            codes, rows = codes[short], rows[short].astype("<u2")
            cuts = np.r_[0, np.searchsorted(codes, edges), len(codes)].tolist()
            full = [k for k in range(len(cuts) - 1) if cuts[k] < cuts[k + 1]]
            for a in range(0, len(full), 4096):
                ks = full[a : a + 4096]
                yield postings(ks, blob, [_pack(codes[cuts[k] : cuts[k + 1]]) for k in ks], [rows[cuts[k] : cuts[k + 1]].tobytes() for k in ks], [None] * len(ks))

    def measure(table: pa.Table) -> pa.Table:
        """A bucket's exact list lengths; what is left of its postings goes back under the number of its block."""
        table = table.combine_chunks()
        head = table.filter(pc.is_valid(table.column("keys")))
        body = table.filter(pc.is_null(table.column("keys")))
        own = [_unpack(x) for x in body.column("codes").to_pylist()]
        rows = [np.frombuffer(x, "<u2") for x in body.column("rows").to_pylist()]
        out, blob = [head], body.column("blob").to_pylist()
        if own:
            codes = np.concatenate(own)
            order = np.argsort(codes)
            codes = codes[order]
            at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            runs = np.diff(np.r_[at, len(codes)])
            length = np.empty(len(codes), "<u4")
            length[order] = np.repeat(runs, runs)
            first, found = 0, []
            for k, c in enumerate(own):
                n = length[first : first + len(c)]
                some = n > 1
                if some.any():
                    found.append((blob[k], _pack(c[some]), rows[k][some].tobytes(), n[some].tobytes()))
                first += len(c)
            if found:
                b, *values = zip(*found)
                cols = [pa.array([0] * len(b), pa.int32()), pa.array(b, pa.int64()), *(pa.array(x, pa.binary()) for x in values), *(pa.nulls(len(b), packed.field(k).type) for k in range(5, 9))]
                out.append(pa.Table.from_arrays(cols, schema=packed))
        return pa.concat_tables([t.cast(packed) for t in out])

    def divide(table: pa.Table) -> pa.Table:
        """A block's documents with the order of their lists."""
        known = shared.value
        table = table.combine_chunks()
        head = table.filter(pc.is_valid(table.column("keys")))
        body = table.filter(pc.is_null(table.column("keys")))
        raw = np.frombuffer(head.column("sums")[0].as_py(), np.uint64).reshape(3, -1)
        n, n_docs = raw[0].astype(np.int64), raw.shape[1]
        rank = np.frombuffer(head.column("long_rank")[0].as_py(), "<u4")
        codes = np.concatenate([*(_unpack(x) for x in body.column("codes").to_pylist()), known.codes[rank]])
        rows = np.concatenate([*(np.frombuffer(x, "<u2") for x in body.column("rows").to_pylist()), np.frombuffer(head.column("long_row")[0].as_py(), "<u2")])
        length = np.concatenate([*(np.frombuffer(x, "<u4").astype(np.int64) for x in body.column("lengths").to_pylist()), known.lengths[rank] + (1 << 40)])
        own = n - np.bincount(rows, minlength=n_docs)
        k = n - least_overlap(n) + 1 - own
        live = (n > 0) & (k > 0)
        # Of equal sets in the block one is enough.
        _, first = np.unique(raw[1] ^ mix64(raw[2]), return_index=True)
        once = np.zeros(n_docs, bool)
        once[first] = True
        live &= once
        some = live[rows]
        codes, rows, length = codes[some], rows[some], length[some]
        order = np.lexsort((codes, length, rows))
        offsets = np.r_[0, np.cumsum(np.bincount(rows, minlength=n_docs))].astype(np.int32)
        lists_ = pa.ListArray.from_arrays(pa.array(offsets), pa.array(codes[order].view(np.int64)), mask=pa.array(~live))
        blob = head.column("blob")[0].as_py()
        uid = ((blob >> 32) << 40) + ((blob & 0xFFFFFF) << 16) + np.arange(n_docs)
        keys = head.column("keys").combine_chunks()
        keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
        cols = [pa.array(uid), keys.flatten(), pa.array(n), pa.array(raw[1].view(np.int64)), pa.array(raw[2].view(np.int64)), pa.array(own), pa.array(np.where(live, k, 0)), lists_]
        return pa.Table.from_arrays(cols, names=["uid", "key", "n", "s1", "s2", "own", "k", "codes"])

    dealt = docs.select(key, text).mapInArrow(deal, ddl)
    back = dealt.groupBy("bucket").applyInArrow(measure, ddl)
    return back.groupBy("blob").applyInArrow(divide, f"uid long, key {key_type.simpleString()}, n long, s1 long, s2 long, own long, k long, codes array<long>")


def probe(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of set numbers whose sets reach the required overlap: short lists are merged, long ones probed where it can still be reached."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            columns = [batch.column(c) for c in ("xn", "xk", "x", "yn", "yk", "y")]
            for k in range(batch.num_rows):
                xn, xk, yn, yk = (columns[c][k].as_py() for c in (0, 1, 3, 4))
                x, y = (columns[c][k].values.to_numpy(zero_copy_only=False) for c in (2, 5))
                need = needed(xn, yn)
                merged = len(np.intersect1d(x[:xk], y[:yk], assume_unique=True))
                if merged + max(least_overlap(xn), least_overlap(yn)) - 1 < need:
                    keep.append(False)
                    continue
                x, y = (x, np.sort(y)) if len(x) <= len(y) else (y, np.sort(x))
                at = np.searchsorted(y, x)
                keep.append(bool(len(y)) and int((y[np.minimum(at, len(y) - 1)] == x).sum()) >= need)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda end, v: sets.select(F.col("node").alias(end), F.col("n").alias(f"{v}n"), F.col("k").alias(f"{v}k"), F.col("codes").alias(v))
    return pairs.join(side("b", "y"), "b").join(side("a", "x"), "a").select("a", "b", "xn", "xk", "x", "yn", "yk", "y").mapInArrow(check, "a long, b long")


def _most(n: str, pos: str) -> Column:
    """The largest set that can link with one of size n if their first common list stands at place ``pos`` of its order."""
    return F.floor((DENOMINATOR * F.col(n) - (NUMERATOR + DENOMINATOR) * F.col(pos)) / NUMERATOR)


def _fit(n: str, most: str, other_n: str, other_most: str) -> Column:
    """The sizes allow a link, and so do the places of the list, should it be the first common one; for a pair that links its first common list does."""
    return (DENOMINATOR * F.least(n, other_n) >= NUMERATOR * F.greatest(n, other_n)) & (F.col(other_n) <= F.col(most)) & (F.col(n) <= F.col(other_most))


def components(sets: DataFrame, work: Workspace) -> DataFrame:
    """(node, comp) of the sets that share a short list with another one; comp is the smallest linked number. ``sets``: (node, n, own, k, codes)."""
    lists = sets.select("node", "n", "own", F.posexplode(F.slice("codes", F.lit(1), F.col("k").cast("int"))).alias("pos", "code")).withColumn("pos", F.col("pos") + F.col("own"))
    lists = lists.select("code", "node", "n", _most("n", "pos").alias("most"))
    seen = lambda rows, *more: rows.groupBy("code").agg(F.count(F.lit(1)).alias("m"), F.min("n").alias("least_n"), F.max("most").alias("most_most"), *more)
    useful = (F.col("most") >= F.col("least_n")) & (F.col("n") <= F.col("most_most"))  # some other set of the list may be of a size that fits
    rows = lists.join(seen(lists).where("m > 1"), "code").where(useful).select(lists.columns)
    packed = F.min_by(F.shiftleft("n", 32) + F.col("most"), "node").alias("hub_is")
    hubs = rows.groupBy("code").agg(F.count(F.lit(1)).alias("m"), F.min("node").alias("hub"), packed).where("m > 1")
    work.free()
    postings = work.keep(rows.join(hubs, "code").select("code", "node", "n", "most", "hub", F.shiftright("hub_is", 32).alias("hub_n"), F.col("hub_is").bitwiseAND(F.lit(0xFFFFFFFF)).alias("hub_most")))
    # Each set against the smallest set of its lists that shares most of them with it.
    best = postings.where((F.col("node") != F.col("hub")) & _fit("n", "most", "hub_n", "hub_most")).groupBy("node", "hub").agg(F.count(F.lit(1)).alias("c")).groupBy("node").agg(F.max_by("hub", "c").alias("hub"))
    linked = probe(best.select(F.col("hub").alias("a"), F.col("node").alias("b")), sets)
    nodes = postings.select("node").distinct()
    labels = follow_pointers(nodes.join(linked.select(F.col("b").alias("node"), F.col("a").alias("up")), "node", "left").select("node", F.coalesce("up", "node").alias("comp")), work)
    left, turn, hubs = postings.select("code", "node", "n", "most"), 0, 4
    while True:
        live = left.join(labels, "node")
        ends = F.min("comp").alias("low"), F.max("comp").alias("high")
        live = live.join(seen(live, *ends).where("low <> high").select("code", "least_n", "most_most"), "code").where(useful).select("code", "node", "n", "most", "comp")
        mixed = live.groupBy("code").agg(F.count(F.lit(1)).alias("m"), *ends).where("low <> high").select("code", "m")
        # A number below one that a set has in every list of a round: the sets of the smallest ones are compared with all others.
        lot = F.shiftrightunsigned(F.xxhash64("node", F.lit(turn)), 11) / float(1 << 53)
        state = work.keep(live.join(mixed, "code").select("code", "node", "n", "most", "comp", (lot * F.col("m") < hubs).alias("hub")))
        if turn:
            work.drop(old)
        old = state
        if state.isEmpty():
            return labels
        x = state.where("hub").select("code", F.col("node").alias("a"), F.col("n").alias("an"), F.col("most").alias("am"), F.col("comp").alias("ac"))
        y = state.select("code", F.col("node").alias("b"), F.col("n").alias("bn"), F.col("most").alias("bm"), F.col("comp").alias("bc"), "hub")
        pairs = x.join(y, "code").where((F.col("ac") != F.col("bc")) & _fit("an", "am", "bn", "bm") & (~F.col("hub") | (F.col("a") < F.col("b")))).select("a", "b").distinct()
        found = probe(pairs, sets)
        comp = lambda end: labels.select(F.col("node").alias(end), F.col("comp").alias(f"{end}c"))
        stars = star_components(found.join(comp("a"), "a").join(comp("b"), "b"), "ac", "bc")
        names = stars.select(F.col("node").alias("comp"), F.col("component").alias("whole"))
        labels = work.keep(labels.join(names, "comp", "left").select("node", F.coalesce("whole", "comp").alias("comp")))
        left = state.where("not hub").select("code", "node", "n", "most")
        del live, mixed, pairs, found, stars, names
        work.free()
        turn, hubs = turn + 1, 4 * hubs


def linked_rows(docs: DataFrame, key: str, order: Column, text: str = "text", words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(key, n, s1, s2) of every row, and (s1, s2, best) of every class of equal non-empty sets: the smallest ``order`` of the class's component.

    ``order`` is made of the column ``key``.
    """
    work = Workspace(docs.sparkSession)
    rows = work.keep(divided(docs, long_lists(docs, work, text, words), key, text, words))
    work.free()
    full = rows.where("n > 0")
    classes = full.groupBy("s1", "s2").agg(F.min(order).alias("own"))
    reps = full.where("k > 0").groupBy("s1", "s2").agg(F.min("uid").alias("uid"))
    sets = work.keep(full.where("k > 0").select("uid", "n", "own", "k", "codes").join(reps.select("uid"), "uid", "left_semi").withColumnRenamed("uid", "node"))
    labels = components(sets, work)
    named = reps.join(labels.withColumnRenamed("node", "uid"), "uid").join(classes, ["s1", "s2"]).select("s1", "s2", "comp", "own")
    best = named.groupBy("comp").agg(F.min("own").alias("best"))
    found = work.keep(named.join(best, "comp").select("s1", "s2", "best"))
    work.drop(sets)
    del labels, named, best
    work.free()
    return rows.select("key", "n", "s1", "s2"), classes.join(found, ["s1", "s2"], "left").select("s1", "s2", F.coalesce("best", "own").alias("best"))


def _id_order(value: Column) -> Column:
    return F.struct(F.isnull(value).alias("last"), value.alias("id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``; component_id is the smallest id that links reach."""
    rows, classes = linked_rows(docs.select(id_col, text), id_col, _id_order(F.col("key")), text, words)
    full = rows.where("n > 0").join(classes, ["s1", "s2"], "left").select(F.col("key").alias(id_col), F.col("n").alias("n_shingles"), F.col("best.id").alias("component_id"))
    return full.unionByName(rows.where("n = 0").select(F.col("key").alias(id_col), F.col("n").alias("n_shingles"), F.col("key").alias("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns: of each component one row, that of the smallest id (a null id comes last); empty texts all stay.

    A row is known by its id and a 128-bit hash of id and text; of rows that agree in both, one stays. Dropped rows set a bit in a table of
    ``MARK_WORDS`` words, which is broadcast; rows whose bit is not set stay where they are, and only the others are joined.
    """
    # The row goes in one struct, so no column of the caller's meets a name of ours.
    packed = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    packed = packed.select("row", F.col("row").getField(id_col).alias("id"), F.col("row").getField(text).alias("text"))
    h1, h2 = F.xxhash64("id", "text"), F.xxhash64(F.lit(1), "text", "id")
    order = F.struct(F.isnull("key.id").alias("last"), F.col("key.id").alias("id"), F.col("key.h1").alias("h1"), F.col("key.h2").alias("h2"))
    rows, classes = linked_rows(packed.select(F.struct("id", h1.alias("h1"), h2.alias("h2")).alias("key"), "text"), "key", order)
    work = Workspace(docs.sparkSession)
    named = rows.where("n > 0").join(classes, ["s1", "s2"])
    chosen = (F.col("key.h1") == F.col("best.h1")) & (F.col("key.h2") == F.col("best.h2"))
    # (h1, h2, chosen): of a dropped row no copy stays; a chosen row that stands there more than once keeps one.
    fate = work.keep(named.select("key.h1", "key.h2", chosen.alias("chosen")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("chosen").alias("chosen")).where("not chosen or n > 1").drop("n"))
    word, bit = F.pmod("h1", F.lit(MARK_WORDS)).cast("int"), F.expr("shiftleft(1L, cast(pmod(h2, 64) as int))")
    marks = fate.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))  # at most MARK_WORDS rows
    near = packed.select("row", h1.alias("h1"), h2.alias("h2")).withColumn("word", word).join(F.broadcast(marks), "word", "left")
    maybe = F.coalesce(F.col("bits").bitwiseAND(bit) != 0, F.lit(False))
    clear, asked = near.where(~maybe).select("row"), near.where(maybe).select("row", "h1", "h2")
    other = asked.join(fate, ["h1", "h2"], "left_anti").select("row")
    again = asked.join(fate.where("chosen"), ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select("row")
    return clear.unionByName(other).unionByName(again).select("row.*")
