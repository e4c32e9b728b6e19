"""Merkle fixity audit of web records, with DataFrame functions only.

A record's hash covers its address and payload. Records lie in order of their ids; sixteen consecutive ids make a leaf, sixteen leaves a node, up to the
root. A node hashes, for each of its children in order, the child's number, the range of payload bytes that it covers within the node, and its
hash; so the order and the offsets of records are audited with their content. Two replicas' roots are compared; below a node that differs, and only there, the children are
compared, down to leaves and then records. Offsets in the result count payload bytes within an archive of consecutive leaves. Ids that are no whole numbers are dealt to leaves
by a hash, in as many leaves as an eighth of the records.

Defined cases: a null id is an id of its own; null addresses and payloads hash as such and differ from empty ones;
rows that repeat an id are one record, hashed as a multiset; empty tables have no root, and a record in one replica alone is reported as
missing from the other; only id, address and payload are read; payloads are hashed whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.plans.durable import Workspace

FANOUT_BITS = 4
ARCHIVE_BITS = 6  # leaves
_WHOLE = ("tinyint", "smallint", "int", "bigint")


def _leaf(first: DataFrame, second: DataFrame, id_col: str) -> Column:
    """The leaf of an id, the same for both replicas."""
    if all(dict(x.dtypes)[id_col] in _WHOLE for x in (first, second)):
        return F.coalesce(F.shiftright(F.col(id_col).cast("long"), FANOUT_BITS), F.lit(-1))
    bits = max(1, (max(first.count(), second.count()) >> 3).bit_length())
    return F.coalesce(F.shiftrightunsigned(F.xxhash64(F.col(id_col).cast("string")), 64 - bits), F.lit(-1))


def records(rows: DataFrame, leaf: Column, id_col: str = "page_id", address: str = "url", payload: str = "html") -> DataFrame:
    """(leaf, id, hash, bytes): one row an id."""
    mark = lambda c: F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.sha2(F.col(c), 256)))
    own = rows.select(leaf.alias("leaf"), F.col(id_col).alias("id"), F.sha2(F.concat_ws("|", mark(address), mark(payload)), 256).alias("h"), F.coalesce(F.octet_length(payload), F.lit(0)).cast("long").alias("bytes"))
    part = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)"))
    sums = own.groupBy("leaf", "id").agg(F.count(F.lit(1)).alias("n"), part(1).alias("s1"), part(16).alias("s2"), part(31).alias("s3"), part(46).alias("s4"), F.sum("bytes").alias("bytes"))
    return sums.select("leaf", "id", F.sha2(F.concat_ws("|", F.lit("record"), "n", "s1", "s2", "s3", "s4", "bytes"), 256).alias("hash"), "bytes")


def nodes_above(children: DataFrame, up: Column, name: Column) -> DataFrame:
    """(replica, key, hash, bytes): nodes over their ordered children; each child enters with its name, its range of bytes within the node and its hash."""
    group = F.array_sort(F.collect_list(F.struct(name.alias("name"), "hash", "bytes")))
    made = children.groupBy("replica", up.alias("key")).agg(group.alias("c"), F.sum("bytes").alias("bytes"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, c: Column) -> Column:
        end = s["at"] + c["bytes"]
        one = F.concat_ws(":", F.coalesce(c["name"].cast("string"), F.lit("null")), s["at"].cast("string"), end.cast("string"), c["hash"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    return made.select("replica", "key", F.sha2(F.array_join(F.aggregate("c", start, step, lambda s: s["out"]), "|"), 256).alias("hash"), "bytes")


def _differing(nodes: DataFrame, *keys: str) -> DataFrame:
    side = lambda k: F.max(F.when(F.col("replica") == k, F.col("hash"))).alias(f"hash_{k}")
    return nodes.groupBy(*keys).agg(side(0), side(1)).where(~F.col("hash_0").eqNullSafe(F.col("hash_1")))


def audit(first: DataFrame, second: DataFrame, id_col: str = "page_id", address: str = "url", payload: str = "html") -> DataFrame:
    """(id, archive, start, end, state) of records that differ; offsets are those of the first replica, state is ``changed``, ``missing`` or ``extra``."""
    work = Workspace(first.sparkSession)
    leaf = _leaf(first, second, id_col)
    sides = [records(x, leaf, id_col, address, payload).withColumn("replica", F.lit(k)) for k, x in enumerate((first, second))]
    both = work.keep(sides[0].unionByName(sides[1]))
    tree = [work.keep(nodes_above(both, F.col("leaf"), F.col("id")))]
    low, high = tree[0].agg(F.min("key"), F.max("key")).first()
    while low is not None and low != high and (low, high) != (-1, 0):
        tree.append(work.keep(nodes_above(tree[-1], F.shiftright("key", FANOUT_BITS), F.col("key"))))
        low, high = low >> FANOUT_BITS, high >> FANOUT_BITS
    bad = work.keep(_differing(tree[-1], "key").select("key"))
    for level in reversed(tree[:-1]):
        below = level.join(bad.select(F.col("key").alias("up")), F.shiftright("key", FANOUT_BITS) == F.col("up"), "left_semi")
        bad = work.keep(_differing(below, "key").select("key"))
    work.drop(*tree)
    found = work.keep(_differing(both.join(bad.select(F.col("key").alias("leaf")), "leaf", "left_semi"), "leaf", "id"))
    archive = F.shiftright("leaf", ARCHIVE_BITS)
    hit = found.select(archive.alias("archive")).distinct()
    order = Window.partitionBy("archive").orderBy("leaf", "id")
    placed = both.where("replica = 0").withColumn("archive", archive).join(hit, "archive", "left_semi").withColumn("end", F.sum("bytes").over(order)).select(F.col("leaf").alias("l"), F.col("id").alias("i"), (F.col("end") - F.col("bytes")).alias("start"), "end")
    state = F.when(F.col("hash_1").isNull(), "missing").when(F.col("hash_0").isNull(), "extra").otherwise("changed")
    rows = found.join(placed, (F.col("leaf") == F.col("l")) & F.col("id").eqNullSafe(F.col("i")), "left")
    return rows.select(F.col("id").alias(id_col), archive.alias("archive"), "start", "end", state.alias("state"))
