"""Exact dedup by a heavy-hitter split: the frequent digests' groups are settled where their rows lie, all others by ordinary shuffles.

Texts are equal when they are the same after each run of blanks, tabs and line ends became one blank; SHA-256 of that text stands for it. Whole texts are read once, and
what is counted, joined and shuffled is a narrow table of ids and digests in the shared folder.

Each task keeps a Misra-Gries summary of ``2 * HEAVY`` counters; counters of one digest are summed over the tasks. With N rows a sum falls short of the true count by at most
2 N / (2 HEAVY + 1), so the digests whose sum reaches N / HEAVY hold every digest of 2 N / HEAVY rows, and there are ``HEAVY`` of them at most, whatever the input:
that bound allows the broadcast. They are verified by an exact count (partial in each task), and their winners are broadcast. No other group holds more than 2 N / HEAVY rows,
and of those only groups of two or more are joined back.

Defined cases: null texts count as empty; null ids come last, so such a row stays only where its group has no id; of repeated rows of one id and text one stays; very long texts are hashed whole; an empty
table gives an empty result; only id and text are read, so other columns may have any name. Ill-formed UTF-8 is replaced by U+FFFD first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.plans.durable import Workspace

HEAVY = 1024  # digests that are settled by broadcast, at most


def text_digest(text: Column) -> Column:
    """SHA-256 of the text with its white space folded, as bytes."""
    known = F.make_valid_utf8(F.coalesce(text, F.lit("")))
    return F.unhex(F.sha2(F.regexp_replace(known, r"[\x20\x09-\x0D]+", " "), 256))


def _merged(held: pa.Table, counters: int) -> pa.Table:
    """Counters of one digest summed; of more than ``counters`` the largest ones, less the largest that goes, so no count falls by more than the rows that are cancelled."""
    held = held.group_by("digest").aggregate([("n", "sum")]).rename_columns(["digest", "n"])
    if len(held) <= counters:
        return held
    n = held.column("n").to_numpy()
    cut = int(np.partition(n, len(n) - counters - 1)[len(n) - counters - 1])
    held = held.filter(pc.greater(held.column("n"), cut))
    return held.set_column(1, "n", pc.subtract(held.column("n"), cut))


def misra_gries(rows: DataFrame, counters: int) -> DataFrame:
    """(digest, n) with a row for each task and counter; n falls short of the task's rows of the digest by at most 2 / (counters + 1) of all its rows."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = pa.table({"digest": pa.array([], pa.binary()), "n": pa.array([], pa.int64())}), 0
        for batch in batches:
            seen += batch.num_rows
            fresh = pa.table({"digest": batch.column(0).cast(pa.binary()), "n": pa.array(np.ones(batch.num_rows, np.int64))})
            held = _merged(pa.concat_tables([held, fresh]), counters)
        held = held.filter(pc.greater(held.column("n"), seen // (counters + 1)))
        yield from held.to_batches()

    return rows.select("digest").mapInArrow(summarise, "digest binary, n long")


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """(id, keep_id, group_size, kept, digest) for every row: of the rows of one text the one with the smallest id stays."""
    work = Workspace(docs.sparkSession)
    rows = work.keep(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text)).alias("digest"), F.monotonically_increasing_id().alias("row")))
    total = rows.count()
    # The first row of a group: ids before nulls, then the row's place.
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    group = (F.count(F.lit(1)).alias("size"), first.alias("first"))
    sums = misra_gries(rows, 2 * heavy).groupBy("digest").agg(F.sum("n").alias("n"))
    frequent = sums.where((F.col("n") >= max(2, -(-total // heavy)))).select("digest")
    winners = work.keep(rows.join(F.broadcast(frequent), "digest").groupBy("digest").agg(*group))
    settled = rows.join(F.broadcast(winners), "digest", "left")
    rest = settled.where("size is null").select("id", "digest", "row")
    groups = rest.groupBy("digest").agg(*group).where("size > 1")
    both = settled.where("size is not null").unionByName(rest.join(groups, "digest", "left"))
    alone = F.col("size").isNull()
    return both.select(
        F.col("id").alias(id_col), F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"), F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"), "digest",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", heavy: int = HEAVY) -> DataFrame:
    """The rows of ``docs``, all columns, that stay. Rows are found again by id and digest; where an id comes twice with one text, one of those rows stays."""
    groups = copy_groups(docs, id_col, text, heavy).select(F.col(id_col).alias("_id"), F.col("keep_id").alias("_keep"), F.col("kept").alias("_kept"), F.col("digest").alias("_digest"))
    mark = next(n for n in (f"_digest{k}" for k in range(len(docs.columns) + 1)) if n not in docs.columns)
    rows = docs.withColumn(mark, text_digest(F.col(text)))
    lost = groups.where(~F.col("_kept"))
    twin = F.col("_id").eqNullSafe(F.col("_keep"))
    left = rows.join(lost.where(~twin).select("_id", "_digest").distinct(), rows[id_col].eqNullSafe(F.col("_id")) & (rows[mark] == F.col("_digest")), "left_anti")
    twins = lost.where(twin).select("_digest").distinct()
    once, more = left.join(twins, left[mark] == twins["_digest"], "left_anti"), left.join(twins, left[mark] == twins["_digest"], "left_semi")
    return once.unionByName(more.dropDuplicates([mark])).select(*docs.columns)


def copies_digest(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``copy_groups`` with the digest in hexadecimal."""
    return copy_groups(docs, id_col, text).select(id_col, "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
