"""Minimum spanning forests of edge tables and their merge trees: every level of detail from one build.

Edges are put into a strict order (weight, ord, source, target). Spark deals them to tasks, each task keeps the forest of what it holds (an edge that is the last on a circle of
any part of the edges is in no minimum forest), and what no single task may hold is parted into its components, of which those that are still too large are contracted in rounds. ``PACKET`` bounds the edges that a task works on at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.operators.components import contracted_components, follow_pointers, linked_numbers, smallest_reached
from sourceloom.plans.durable import Workspace
from sourceloom.plans.ranking import numbered

PACKET = 1 << 20  # edges that meet in a task
ORDER = ("weight", "ord", "source", "target")
FOREST = "repo string, source string, target string, weight double, ord long, part string"
SHARES = 8  # tasks among which a packet of small parts is dealt


def _codes(table: pa.Table, by: tuple[str, ...], ends: tuple[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 for the ends of edges within the keys ``by``."""
    n = len(table)
    coded = lambda columns: pa.chunked_array([x for c in columns for x in table.column(c).chunks]).combine_chunks().dictionary_encode("encode")
    key, kinds = np.zeros(n, np.int64), 1
    for c in by:
        found = coded([c])
        key, kinds = _compact(key * len(found.dictionary) + found.indices.to_numpy(), kinds * len(found.dictionary))
    found = coded(ends)
    codes, _ = _compact(found.indices.to_numpy().astype(np.int64) * kinds + np.tile(key, 2), len(found.dictionary) * kinds)
    return codes[:n], codes[n:]


def _compact(codes: np.ndarray, size: int) -> tuple[np.ndarray, int]:
    """The codes, below ``size``, numbered from 0 without gaps, and how many there are."""
    if size > 16 * len(codes):
        ids, codes = np.unique(codes, return_inverse=True)
        return codes, len(ids)
    there = np.zeros(size, bool)
    there[codes] = True
    return (np.cumsum(there) - 1)[codes], int(there.sum())


def _united(a: np.ndarray, b: np.ndarray, first: np.ndarray | None = None) -> tuple[np.ndarray, list[int], list[int]]:
    """Which edges, taken in order, unite two sets, and for those the root that goes and the root that stays: the one of smaller ``first``, else of smaller number."""
    root = list(range(int(max(a.max(), b.max())) + 1)) if len(a) else []
    rank = root[:] if first is None else first.tolist()
    kept, gone, stays = np.zeros(len(a), bool), [], []
    for k, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            if rank[x] < rank[y]:
                x, y = y, x
            root[x] = y
            kept[k] = True
            gone.append(x)
            stays.append(y)
    return kept, gone, stays


def _forest(table: pa.Table, a: str, b: str) -> pa.Table:
    """The minimum spanning forest of the edges. The lightest third is put in order and walked first; of the others only those that it leaves between two of its trees are."""
    ends = _codes(table, ("repo",), (a, b))
    weight = table.column("weight").to_numpy()
    kept, rest = [], np.arange(len(table))
    light = weight <= np.partition(weight, len(weight) // 3)[len(weight) // 3] if len(weight) else np.zeros(0, bool)
    for chosen in (light, ~light):
        at = rest[chosen[rest]]
        if not len(at):
            continue
        at = at[pc.sort_indices(table.take(pa.array(at)), sort_keys=[(c, "ascending") for c in ORDER]).to_numpy()]
        unites, gone, stays = _united(ends[0][at], ends[1][at])
        kept.append(at[unites])
        root = np.arange(max(x.max() for x in ends) + 1)
        root[gone] = stays
        while not np.array_equal(root, root[root]):
            root = root[root]
        ends = root[ends[0]], root[ends[1]]
        rest = np.flatnonzero(ends[0] != ends[1])
    return table.take(pa.array(np.concatenate(kept))) if kept else table.slice(0, 0)


def _tasks(rows: DataFrame, bins: int) -> int:
    """How many tasks share the bins: work in Python counts by rows, so small shuffles are not put together."""
    return max(1, min(bins, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def in_bins(rows: DataFrame, by: list[str], bins: int, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` over the rows of each of so many bins of the keys ``by``."""
    return rows.withColumn("bin", F.pmod(F.xxhash64(*by), F.lit(max(bins, 1)))).repartition(_tasks(rows, bins), "bin").groupBy("bin").applyInArrow(run, schema)


def local_forests(edges: DataFrame, packet: int = PACKET, ends: tuple[str, str] = ("source", "target")) -> DataFrame:
    """The edges without those that close a circle among lighter edges of their task; a task holds a forest and a packet of further edges at a time, and passes a forest of more than a packet on."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, forest = [], 0, 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= max(2 * forest, packet):
                kept = _forest(pa.Table.from_batches(held), *ends)
                held, size, forest = kept.to_batches(), len(kept), len(kept)
                if forest >= packet:
                    yield from held
                    held, size, forest = [], 0, 0
        if held:
            yield from _forest(pa.Table.from_batches(held), *ends).to_batches()

    return edges.mapInArrow(thin, edges.schema)


def number(end: str) -> Column:
    """The number of a node by which ``edge_parts`` names it. Two nodes that share one only make their components one part."""
    return F.xxhash64("repo", end)


def edge_parts(edges: DataFrame, packet: int = PACKET) -> tuple[DataFrame, DataFrame] | None:
    """The repositories (repo) of more than a packet of edges (repo, source, target), and (v, part, n) for the numbers of their nodes: which part, of how many numbers, a node lies in; no edge leads out of a part. None where all repositories fit."""
    work = Workspace(edges.sparkSession)
    large = work.keep(edges.groupBy("repo").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > packet).select("repo"))
    if large.isEmpty():
        return None
    numbers = edges.join(large, "repo", "left_semi").select(number("source").alias("a"), number("target").alias("b")).where("a <> b")
    labels = linked_numbers(numbers, packet, work)
    sizes = labels.groupBy("k", "root").agg(F.count(F.lit(1)).alias("n"))
    return large, work.keep(labels.join(sizes, ["k", "root"]).select("v", F.concat_ws(":", "k", "root").alias("part"), "n"))


def with_parts(rows: DataFrame, end: str, parts: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """``rows`` (repo, end, ...) with the ``part`` of the end and the part's size ``part_n``: '' and 0 where the repository fits a packet."""
    if parts is None:
        return rows.withColumn("part", F.lit("")).withColumn("part_n", F.lit(0).cast("long"))
    large, labels = parts
    marked = rows.join(large.withColumn("_wide", F.lit(True)), "repo", "left").withColumn("_v", F.when(F.col("_wide"), number(end)))
    # A node without edges is a part of its own.
    named = marked.join(labels.withColumnRenamed("v", "_v"), "_v", "left").withColumn("part", F.when(F.col("_wide"), F.coalesce("part", F.col("_v").cast("string"))).otherwise(""))
    return named.select(*rows.columns, "part", F.coalesce("n", F.lit(0).cast("long")).alias("part_n"))


def minimum_spanning_forest(weighted: DataFrame, packet: int = PACKET) -> DataFrame:
    """The edges (repo, source, target, weight, ord) of the minimum spanning forest under the strict order (weight, ord, source, target)."""
    return spanning_parts(weighted, packet).drop("part")


def spanning_parts(weighted: DataFrame, packet: int = PACKET) -> DataFrame:
    """The minimum spanning forest with the ``part`` of each edge, as ``edge_parts`` names it ('' in repositories of a packet at most).

    Edges that come with parts and their sizes are dealt to tasks by them, a part to one task unless it has more nodes than a packet; others are first thinned out where they are, without a shuffle, and then parted. What tasks leave of
    a repository or part that fits a packet is finished by one task (many share a task). Parts of more than a packet are dealt
    out anew, by their sources, while that thins them by half, and otherwise contracted: every node takes its lightest edge, the chosen edges unite nodes, edges within one go, and of parallel
    edges the lightest stays, so the number of nodes at least halves.
    """
    work = Workspace(weighted.sparkSession)
    columns = ["repo", "source", "target", "weight", "ord"]
    rows = weighted.where("source <> target").withColumn("ord", F.col("ord").cast("long"))
    if "part" in rows.columns:
        share = F.when(F.col("part_n") > packet, F.pmod(F.xxhash64("source"), F.ceil(F.col("part_n") / packet))).otherwise(0)
        live = work.keep(local_forests(rows.repartition(_tasks(rows, 1 << 30), "repo", "part", share).select(*columns, "part"), packet))
    else:
        thin = work.keep(local_forests(rows.select(columns), packet))
        live = with_parts(thin, "source", edge_parts(thin, packet)).drop("part_n")
    live = live.withColumn("a", F.col("source")).withColumn("b", F.col("target"))
    key = ["repo", "part"]
    done = []
    while True:
        sizes = work.keep(live.groupBy(*key).agg(F.count(F.lit(1)).alias("n")))
        row = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
        fits = live if row.most <= packet else live.join(sizes.where(F.col("n") > packet), key, "left_anti")
        bins = -(-row.total * SHARES // packet)
        done.append(in_bins(fits, key, bins, lambda t: _forest(t, "a", "b").select([*columns, "part"]), FOREST))
        if row.most <= packet:
            break
        large = work.keep(live.join(sizes.where(F.col("n") > packet), key))
        share = F.pmod(F.xxhash64("a"), F.ceil(F.col("n") / packet))
        dealt = work.keep(local_forests(large.repartition(2 * -(-row.total // packet), *key, share).drop("n"), packet, ("a", "b")))
        if 2 * dealt.count() > large.count():
            chosen, contracted = _contracted(dealt, work)
            done.append(chosen)
            work.drop(dealt)
            dealt = contracted
        work.drop(large)
        live = dealt
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _contracted(live: DataFrame, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """The lightest edge of every component, and the edges between what those unite."""
    edge = F.struct(*ORDER).alias("edge")
    ends = live.select("repo", "part", "a", "b", edge)  # names are unique in a repository, whatever the part
    sides = ends.select("repo", F.explode(F.array(F.struct(F.col("a").alias("c"), F.col("b").alias("to")), F.struct(F.col("b").alias("c"), F.col("a").alias("to")))).alias("x"), "edge", "part").select("repo", "x.*", "edge", "part")
    best = work.keep(sides.groupBy("repo", "c").agg(F.min(F.struct("edge", "to", "part")).alias("m")).select("repo", "c", "m.*"))
    # In a strict order two components may choose each other's edge, and longer circles cannot be: of such two the smaller stays.
    node = lambda c: F.struct("repo", F.col(c).alias("id"))
    to = best.select(node("c").alias("c"), node("to").alias("p"))
    back = to.select(F.col("c").alias("p"), F.col("p").alias("pp"))
    pointers = to.join(back, "p").select(F.col("c").alias("node"), F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("comp"))
    names = follow_pointers(pointers, work)
    rows = live
    for side in ("a", "b"):
        rows = rows.join(names.select(F.col("node.repo").alias("repo"), F.col("node.id").alias(side), F.col("comp.id").alias(f"{side}_to")), ["repo", side]).drop(side).withColumnRenamed(f"{side}_to", side)
    rows = rows.where("a <> b").groupBy("repo", "part", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(edge).alias("edge"))
    contracted = work.keep(rows.select("repo", "edge.source", "edge.target", "edge.weight", "edge.ord", "part", "a", "b"))
    work.drop(names)
    chosen = best.select("repo", "edge", "part").distinct().select("repo", "edge.source", "edge.target", "edge.weight", "edge.ord", "part")
    return chosen, contracted


LABELS = "repo string, id string, cluster_id string"


def _named(table: pa.Table, ends: tuple[str, str]) -> tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """Numbers for the two ends of edges, in the order of the names, and the numbers' names and repositories."""
    names = pa.chunked_array([x for end in ends for x in table.column(end).chunks], pa.string()).combine_chunks()
    repos = pa.chunked_array([*table.column("repo").chunks, *table.column("repo").chunks], pa.string()).combine_chunks()
    a, b = _codes(table, ("repo",), ends)
    both = np.concatenate([a, b])
    at = np.zeros(int(both.max()) + 1, np.int64)
    at[both] = np.arange(len(both))
    sorting = pc.sort_indices(names.take(pa.array(at))).to_numpy()
    place = np.empty(len(at), np.int64)
    place[sorting] = np.arange(len(at))
    at = pa.array(at[sorting])
    return place[a], place[b], names.take(at), repos.take(at)


def _labels(table: pa.Table) -> pa.Table:
    """The smallest name of each set that the edges unite, for all their ends."""
    a, b, names, repos = _named(table, ("source", "target"))
    root = smallest_reached(a, b, len(names))
    return pa.table({"repo": repos, "id": names, "cluster_id": names.take(pa.array(root))})


def _local_stars(edges: DataFrame, packet: int) -> DataFrame:
    """Fewer edges (repo, source, target) that connect the same: each task replaces packets of what it holds by stars, without a shuffle."""

    def stars(held: list[pa.RecordBatch]) -> pa.Table:
        labels = _labels(pa.Table.from_batches(held)).rename_columns(["repo", "source", "target"])
        return labels.filter(pc.not_equal(labels.column("source"), labels.column("target")))

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kept = [], 0, 0
        for batch in batches:
            if batch.num_rows:
                held.append(pa.RecordBatch.from_arrays(batch.columns, names=batch.schema.names))  # a column without nulls says so in its type, and stars do not
                size += batch.num_rows
            if size >= max(2 * kept, packet):
                held = stars(held).to_batches()
                size = kept = sum(x.num_rows for x in held)
                if kept >= packet:
                    yield from held
                    held, size, kept = [], 0, 0
        if held:
            yield from stars(held).to_batches()

    return edges.mapInArrow(thin, "repo string, source string, target string")


def component_labels(edges: DataFrame, packet: int = PACKET) -> DataFrame:
    """(repo, id, cluster_id) for every end of the edges (repo, source, target): the smallest id of its component.

    Repositories of at most a packet of edges are thinned to stars where they are and labelled by tasks. All others become numbers as they are read and are labelled by rounds of contraction; only their names are
    shuffled as texts, once each. The edges are read once to count them and once or twice more.
    """
    work = Workspace(edges.sparkSession)
    live = edges.where("source <> target").select("repo", "source", "target")
    sizes = work.keep(live.groupBy("repo").agg(F.count(F.lit(1)).alias("n")))
    fit = F.col("n") <= packet
    row = sizes.agg(F.coalesce(F.sum(F.when(fit, F.col("n"))), F.lit(0)).alias("total"), F.count(F.when(~fit, True)).alias("wide")).first()
    wide = F.broadcast(sizes.where(~fit).select("repo"))  # one a packet at most; a shuffle by repository would send each of them to one task
    out = []
    if row.total or not row.wide:
        fits = _local_stars(live.join(wide, "repo", "left_anti") if row.wide else live, packet)
        out.append(fits.groupBy(F.pmod(F.xxhash64("repo"), F.lit(max(1, -(-row.total // packet)))).alias("bin")).applyInArrow(_labels, LABELS))
    if row.wide:
        end = lambda c: F.struct("repo", F.col(c).alias("id"))
        found = contracted_components(live.join(wide, "repo", "left_semi").select(end("source").alias("a"), end("target").alias("b")), packet)
        out.append(found.select("node.repo", "node.id", F.col("component.id").alias("cluster_id")))
    return reduce(DataFrame.unionByName, out)


TREE = "repo string, id string, up string, height long, part string"


def _tree(table: pa.Table) -> pa.Table:
    """The merges of whole subproblems, each of consecutive edges in the order of its repository from place ``low`` on."""
    table = table.sort_by([(c, "ascending") for c in ("repo", "low", *ORDER)])
    n = len(table)
    a, b = _codes(table, ("repo", "low"), ("a", "b"))
    size = int(max(a.max(), b.max())) + 1
    at, first = np.zeros(size, np.int64), np.zeros(size, np.int64)
    at[a], at[b] = np.arange(n), np.arange(n) + n
    first[a], first[b] = table.column("a_rank").to_numpy(), table.column("b_rank").to_numpy()
    order = np.empty(size, np.int64)
    names = pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks]).take(pa.array(at))
    order[pc.sort_indices(pa.table({"first": first, "name": names}), sort_keys=[("first", "ascending"), ("name", "ascending")]).to_numpy()] = np.arange(size)
    kept, gone, stays = _united(a, b, order)
    low = table.column("low").to_numpy()
    begin = np.maximum.accumulate(np.where(np.r_[True, (low[1:] != low[:-1]) | (pc.not_equal(table.column("repo")[1:], table.column("repo")[:-1]).to_numpy(zero_copy_only=False) if n > 1 else np.zeros(0, bool))], np.arange(n), 0))
    place = table.column("place").fill_null(-1).to_numpy()
    height = np.where(place < 0, low + np.arange(n) - begin, place)
    return pa.table({"repo": table.column("repo").filter(pa.array(kept)), "id": names.take(pa.array(gone, pa.int64())), "up": names.take(pa.array(stays, pa.int64())), "height": pa.array(height[kept], pa.int64()), "part": table.column("part").filter(pa.array(kept))})


def merge_tree(forest: DataFrame, packet: int = PACKET) -> DataFrame:
    """(repo, id, up, height, part): the merge tree of a spanning forest, one row for each node but one of every component.

    When the edge at place ``height`` of its repository's order unites two clusters, the representative of one goes and points ``up`` to the other's, which is the one of
    the smaller hash; so a cluster has one representative at every level, whatever else is merged, heights rise along the pointers, and by the hash their number grows with the logarithm of the nodes.
    Repositories of more than a packet of edges are numbered by a distributed sort and merged by components, each in a task; components of more than a packet are halved in rounds: the components of the lower half of the places are the nodes of the upper half, all halves of a
    round at once. ``part`` names the rows that a task merged together, whole components of a packet at most ('' for a whole repository), and is null elsewhere.
    """
    work = Workspace(forest.sparkSession)
    rank = lambda c: F.xxhash64("repo", c)
    named = "part" in forest.columns
    ends = (F.col("source").alias("a"), F.col("target").alias("b"), rank("source").alias("a_rank"), rank("target").alias("b_rank"))
    rows = work.keep(forest.select("repo", *ORDER, *ends, *(["part"] if named else [])))
    if named:
        sizes = work.keep(rows.groupBy("repo").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > packet))
        whole = rows.join(sizes, "repo", "left").withColumn("part", F.when(F.col("_n").isNotNull(), F.col("part")).otherwise("")).drop("_n")
    else:
        whole = work.keep(with_parts(rows, "source", edge_parts(rows, packet)).drop("part_n"))
    whole = whole.withColumn("low", F.lit(0).cast("long"))
    bins = max(1, -(-rows.count() * SHARES // packet))
    ready = whole.where("part = ''").withColumn("place", F.lit(None).cast("long"))
    wide = whole.where("part <> ''")
    if not wide.isEmpty():
        placed = work.keep(numbered(wide, ["repo"], [F.col(c) for c in ORDER], "place"))
        sizes = work.keep(placed.groupBy("repo", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > packet).select("repo", "part"))
        if sizes.isEmpty():
            return _merged(ready.unionByName(placed.select(ready.columns)), bins)
        ready = ready.unionByName(placed.join(sizes, ["repo", "part"], "left_anti").select(ready.columns))
        state = work.keep(placed.join(sizes, ["repo", "part"], "left_semi").withColumn("part", F.lit(None).cast("string")).select(ready.columns))
        spans = state.groupBy("repo").agg((F.max("place") + 1).alias("high"))
        width = spans.agg(F.coalesce(F.max("high"), F.lit(0)).alias("most")).first().most
        state = state.join(spans, "repo")
        while width > packet:
            width = -(-width // 2)
            mid = F.expr("low + (high - low + 1) div 2")
            end = lambda c: F.struct("repo", "low", F.col(f"{c}_rank").alias("rank"), F.col(c).alias("id"))
            found = contracted_components(state.where(F.col("place") < mid).select(end("a").alias("a"), end("b").alias("b")), packet)
            upper = state.where(F.col("place") >= mid).withColumn("new_low", mid)
            for side in ("a", "b"):
                names = found.select(F.col("node.repo").alias("repo"), F.col("node.low").alias("low"), F.col("node.id").alias(side), F.col("component.id").alias("_id"), F.col("component.rank").alias("_rank"))
                upper = upper.join(names, ["repo", "low", side], "left").withColumn(side, F.coalesce("_id", side)).withColumn(f"{side}_rank", F.coalesce("_rank", f"{side}_rank")).drop("_id", "_rank")
            lower = state.where(F.col("place") < mid).withColumn("high", mid)
            state = work.keep(lower.unionByName(upper.withColumn("low", F.col("new_low")).drop("new_low")))
        ready = ready.unionByName(state.select(ready.columns))
    return _merged(ready, bins)


def _merged(ready: DataFrame, bins: int) -> DataFrame:
    return in_bins(ready, ["repo", "part", "low"], bins, _tree, TREE)


def part_cuts(budgets: DataFrame, levels: list[float], tree: DataFrame, packet: int = PACKET) -> DataFrame:
    """(repo, level, id, cluster_id) of the nodes in the tree's parts, from ``budgets`` (repo, ks): after the first ``ks[j]`` merges of level ``levels[j]``. A task follows the pointers of whole parts, so no level is shuffled."""

    def cut(table: pa.Table) -> pa.Table:
        a, b, names, repos = _named(table, ("id", "up"))
        own, out = np.arange(len(names)), []
        up, height, ks = own.copy(), np.zeros(len(names), np.int64), np.zeros((len(names), len(levels)), np.int64)
        up[a], height[a] = b, table.column("height").to_numpy()
        ks[a] = table.column("ks").combine_chunks().flatten().to_numpy().reshape(-1, len(levels))
        for j, level in enumerate(levels):
            at = np.where(height < ks[:, j], up, own)
            while True:
                above = at[at]
                if np.array_equal(above, at):
                    break
                at = above
            least = own.copy()
            np.minimum.at(least, at, own)
            out.append(pa.table({"repo": repos, "level": pa.array(np.full(len(own), float(level))), "id": names, "cluster_id": names.take(pa.array(least[at]))}))
        return pa.concat_tables(out)

    rows = tree.where("part is not null").join(budgets, "repo").select("repo", "part", "id", "up", "height", "ks")
    bins = max(1, -(-rows.count() * len(levels) * SHARES // packet))
    return in_bins(rows, ["repo", "part"], bins, cut, "repo string, level double, id string, cluster_id string")


def level_cuts(budgets: DataFrame, tree: DataFrame) -> DataFrame:
    """(repo, level, id, cluster_id) from ``budgets`` (repo, level, id, k): the clusters after the first k merges of each level, named by their smallest id.

    For every level a node's pointer holds while its height is below k; doubling the pointers of all levels together finds the representatives, three doublings a table, until none moves.
    """
    work = Workspace(tree.sparkSession)
    start = budgets.join(tree, ["repo", "id"], "left").select("repo", "level", "id", F.when(F.col("height") < F.col("k"), F.col("up")).otherwise(F.col("id")).alias("up"))
    state, moved = work.keep(start), True
    while moved:
        rows = state.select("*", F.col("up").alias("was"))
        for _ in range(3):
            step = rows.select("repo", "level", F.col("id").alias("up"), F.col("up").alias("next"))
            rows = rows.join(step, ["repo", "level", "up"]).select("repo", "level", "id", F.col("next").alias("up"), F.col("up").alias("was"))
        old, state = state, work.keep(rows)
        moved = not state.where("up <> was").isEmpty()
        work.drop(old)
        state = work.drops_with(state.drop("was"), state)
    least = state.groupBy("repo", "level", "up").agg(F.min("id").alias("cluster_id"))
    return state.join(least, ["repo", "level", "up"]).select("repo", "level", "id", "cluster_id")
