"""Connected components of edge tables of any size, by rounds of random contraction or of alternating stars, and pointers that are followed by doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.plans.durable import Workspace


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour of a node to the smallest of the node and its neighbours; an edge may come twice.

    Nothing above the join asks for its partitioning, so Spark can split the rows of a node with very many neighbours.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Join every smaller neighbour of a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def star_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node id that it reaches.

    Self loops, repeated edges and edges with a null end carry nothing and are left out. Each round works on at most as
    many rows as there are edges and is written to the shared folder, so a lost executor re-reads one round; the round before is
    removed. The edge set shrinks to stars in O(log^2 n) rounds, whatever the diameter, and the loop ends when a round changes nothing.
    Only a count and a checksum per round reach the driver.
    """
    work = Workspace(edges.sparkSession)
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    state, before = work.keep(ends.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()), None
    while True:
        row = state.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (row.n, row.h) == before or not row.n:
            break
        before, old = (row.n, row.h), state
        state = work.keep(_small_star(_large_star(old)))
        work.drop(old)
    hubs = state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(hubs)


def smallest_reached(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """For each of the numbers below ``size`` the smallest one that the edges lead to: roots hang on their smallest neighbours, which at least halves those with a neighbour in each turn."""
    root = np.arange(size)
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = np.maximum(a[apart], b[apart]), np.minimum(a[apart], b[apart])
        np.minimum.at(root, a, b)
        while True:
            above = root[root]
            if np.array_equal(above, root):
                break
            root = above
    return root


def _stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    a, b = (np.concatenate([x.column(k).to_numpy() for x in batches]) for k in (0, 1))
    ids, codes = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = smallest_reached(codes[: len(a)], codes[len(a) :], len(ids))
    leaf = root != np.arange(len(ids))
    return pa.record_batch({"a": pa.array(ids[leaf]), "b": pa.array(ids[root[leaf]])})


def _thinned(edges: DataFrame, packet: int) -> DataFrame:
    """Fewer edges (a, b), of numbers, that connect the same: each task replaces packets of what it holds by stars, without a shuffle."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kept = [], 0, 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= max(2 * kept, packet):
                held = [_stars(held)]
                size = kept = held[0].num_rows
                if kept >= packet:
                    yield held[0]
                    held, size, kept = [], 0, 0
        if held:
            yield _stars(held)

    return edges.mapInArrow(thin, "a long, b long")


def contracted_components(edges: DataFrame, packet: int = 1 << 20) -> DataFrame:
    """(node, component) for every node on an edge (a, b); component is the smallest node that it reaches.

    Nodes become numbers by a hash, which is drawn anew while two nodes share one. In each round every node joins the one of its neighbourhood that a new hash of numbers puts first; that hash
    is one to one for a round, so its values name the nodes of the next round. At least a quarter of the nodes is expected to go in each, and far more next to nodes of many neighbours. One task
    finishes what fits a packet, and the rounds' maps are then composed from the last one back. The edges are read twice, for their names and for their numbers.
    """
    work = Workspace(edges.sparkSession)
    ends = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    seed = 0
    while True:
        key = lambda c: F.xxhash64(F.lit(seed), c)  # noqa: B023, E731
        names = work.keep(ends.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", key("node").alias("v")))
        if names.groupBy("v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
        work.drop(names)
        seed += 1
    labels = linked_numbers(ends.select(key("a").alias("a"), key("b").alias("b")), packet, work)
    found = work.keep(names.join(labels, "v").select("node", "k", "root"))
    work.drop(names, labels)
    least = found.groupBy("k", "root").agg(F.min("node").alias("component"))
    return found.join(least, ["k", "root"]).select("node", "component")


def linked_numbers(edges: DataFrame, packet: int, work: Workspace) -> DataFrame:
    """(v, k, root) for every number on an edge (a, b) between two different ones: (k, root) names its component; a table of the workspace. Each round aggregates and joins numbers only."""
    state = work.keep(_thinned(edges, packet))
    maps = []
    while state.count() > packet:
        order = lambda c: F.xxhash64(F.lit(len(maps)), c)
        both = state.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(state.select(F.col("b").alias("v"), F.col("a").alias("w")))
        to = work.keep(both.groupBy("v").agg(F.min(order("w")).alias("m")).select("v", F.least("m", order("v")).alias("m")))
        moved = state.join(to.toDF("a", "ma"), "a").join(to.toDF("b", "mb"), "b").where("ma <> mb").select(F.col("ma").alias("a"), F.col("mb").alias("b"))
        old, state = state, work.keep(_thinned(moved, packet))
        work.drop(old)
        maps.append(to)
    rest = state.groupBy(F.lit(0).alias("all")).applyInArrow(lambda t: pa.Table.from_batches([_stars(t.select(["a", "b"]).to_batches())]), "a long, b long")
    hubs = rest.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct()
    labels = rest.select(F.col("a").alias("v"), F.col("b").alias("root")).unionByName(hubs).select("v", F.lit(len(maps)).alias("k"), "root")
    labels = work.keep(labels)
    for k in reversed(range(len(maps))):
        above = labels.select(F.col("v").alias("m"), "k", "root")
        old, labels = labels, work.keep(maps[k].join(above, "m", "left").select("v", F.coalesce("k", F.lit(k + 1)).alias("k"), F.coalesce("root", "m").alias("root")))
        work.drop(old)
    work.drop(state, *maps)
    return labels


def follow_pointers(pointers: DataFrame, work: Workspace) -> DataFrame:
    """(node, comp) with every pointer of (node, comp) followed to its end, a node that points at itself; a table of the workspace.

    Every ``comp`` is a node of the table, and pointers run in no other circle. Each round doubles the steps and replaces the table of the round before.
    """
    state = work.keep(pointers)
    while True:
        up = state.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        old, state = state, work.keep(state.join(up, "comp").select("node", F.col("next").alias("comp"), (F.col("next") != F.col("comp")).alias("moved")))
        moved = not state.where("moved").isEmpty()
        work.drop(old)
        state = work.drops_with(state.select("node", "comp"), state)
        if not moved:
            return state
