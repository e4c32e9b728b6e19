"""Measures of a call graph. ``nodes`` has (repo, id, ...), ``edges`` (repo, source, target); null flags count as false."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.plans.durable import Workspace

MAIN = "::MAIN::0"
FOLD = 16


def project_subgraph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without library nodes and library edges."""
    inner = lambda df: df.where(~F.coalesce(F.col("is_library"), F.lit(False)))
    return inner(nodes), inner(edges)


def _calls(edges: DataFrame) -> DataFrame:
    return edges.where((F.col("source") != MAIN) & (F.col("target") != MAIN))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, id, degree): calls in and out, without those of the entry node."""
    ends = _calls(edges).select("repo", F.explode(F.array("source", "target")).alias("id"))
    found = ends.groupBy("repo", "id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("repo", "id").join(found, ["repo", "id"], "left").fillna(0, ["degree"])


def in_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, id, in_degree)."""
    found = _calls(edges).groupBy("repo", F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    return nodes.select("repo", "id").join(found, ["repo", "id"], "left").fillna(0, ["in_degree"])


def _anchors(calls: DataFrame, ids: DataFrame, entries: DataFrame, work: Workspace) -> tuple[DataFrame, list[DataFrame]]:
    """(repo, id, up, steps, settled), and the tables that it reads: the first node at or above each one that is an entry or has not exactly one caller, and how many calls lead down from it.

    A node with one caller is one step deeper than that caller, whatever else there is, so trees and paths of such nodes hang on their anchors. Pointers are doubled until they are settled, which
    means that they point to an anchor; a table holds only the rows that were not settled before. What is not settled after as many steps as there are nodes lies on or below a circle that nothing enters.
    """
    known = calls.join(ids.withColumnRenamed("id", "source"), ["repo", "source"], "left_semi")
    caller = known.groupBy("repo", F.col("target").alias("id")).agg(F.min("source").alias("caller"), F.max("source").alias("other")).where("caller = other").drop("other")
    alone = ids.join(caller, ["repo", "id"], "left").join(entries.withColumn("entry", F.lit(True)), ["repo", "id"], "left")
    hangs = F.col("caller").isNotNull() & F.col("entry").isNull()
    tables = [work.keep(alone.select("repo", "id", F.when(hangs, F.col("caller")).otherwise(F.col("id")).alias("up"), F.when(hangs, 1).otherwise(0).cast("long").alias("steps"), (~hangs).alias("settled")))]
    state = lambda: reduce(DataFrame.unionByName, [*(t.where("settled") for t in tables[:-1]), tables[-1]])
    total, reach = None, 1
    while not tables[-1].where("not settled").isEmpty():
        total = ids.count() if total is None else total
        if reach > total:
            break
        above = state().select("repo", F.col("id").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), "settled")
        rows = tables[-1].where("not settled").drop("settled").join(above, ["repo", "up"])
        tables.append(work.keep(rows.select("repo", "id", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), "settled")))
        reach *= 2
    return state(), tables


def bfs_depth(nodes: DataFrame, edges: DataFrame, kept: bool = False) -> DataFrame:
    """(repo, id, depth, max_depth): steps from the entry points; what they do not reach gets one more than the repo's depth (at least 2).

    Nodes with one caller are contracted to their anchors first, and the calls between anchors weigh the steps that they stand for, so a chain costs the logarithm of its length. Then each round
    relaxes the calls of the anchors that the last one brought nearer; a round is one table, and the tables are folded every ``FOLD`` of them. The walk ends when a round brings none nearer.
    ``kept``: the edges are a table already and are not written again. They are read as they are: repeated calls change nothing, and ends that are no node meet none.
    """
    work = Workspace(nodes.sparkSession)
    ids = work.keep(nodes.where(F.col("id") != MAIN).select("repo", "id").distinct())
    if not kept:
        edges = work.keep(edges.select("repo", "source", "target"))
    calls = _calls(edges).select("repo", "source", "target").where("source <> target")
    entries = work.keep(edges.where(F.col("source") == MAIN).select("repo", F.col("target").alias("id")).distinct().join(ids, ["repo", "id"], "left_semi"))
    state, tables = _anchors(calls, ids, entries, work)
    below = state.where("settled").select("repo", F.col("id").alias("source"), F.col("up").alias("anchor"), "steps")
    joints = state.where("settled and id = up").select("repo", F.col("id").alias("target")).join(entries.withColumnRenamed("id", "target"), ["repo", "target"], "left_anti")
    links = calls.join(joints, ["repo", "target"], "left_semi").join(below, ["repo", "source"]).select("repo", "anchor", "target", (F.col("steps") + 1).alias("weight"))
    links = work.keep(links)
    layers = [work.keep(entries.select("repo", "id", F.lit(0).cast("long").alias("depth")))]
    nearest = lambda: reduce(DataFrame.unionByName, layers).groupBy("repo", "id").agg(F.min("depth").alias("depth"))
    while not layers[-1].isEmpty():
        front = layers[-1].select("repo", F.col("id").alias("anchor"), "depth")
        reached = front.join(links, ["repo", "anchor"]).groupBy("repo", F.col("target").alias("id")).agg(F.min(F.col("depth") + F.col("weight")).alias("depth"))
        known = nearest().select("repo", "id", F.col("depth").alias("was"))
        fresh = work.keep(reached.join(known, ["repo", "id"], "left").where("was is null or depth < was").select("repo", "id", "depth"))
        if len(layers) == FOLD:
            old, layers = layers, [work.keep(nearest())]
            work.drop(*old)
        layers.append(fresh)
    at = nearest().select("repo", F.col("id").alias("up"), F.col("depth").alias("base"))
    found = work.keep(state.join(at, ["repo", "up"], "left").select("repo", "id", (F.col("base") + F.col("steps")).cast("int").alias("depth")))
    work.drop(*layers, links, *tables, entries, *([] if kept else [edges]), ids)
    deepest = found.groupBy("repo").agg(F.greatest(F.lit(1), F.max("depth")).alias("max_depth"))
    return found.join(deepest, "repo").select("repo", "id", F.coalesce("depth", F.col("max_depth") + 1).alias("depth"), "max_depth")


def importance(nodes: DataFrame, edges: DataFrame, kept: bool = False) -> DataFrame:
    """(repo, id, score): 0.4 for closeness to entry points and 0.6 for calls received, each relative to the repo; MAIN has 0. ``kept``: nodes and edges are tables already."""
    work = Workspace(nodes.sparkSession)
    if not kept:
        nodes, edges = work.keep(nodes.select("repo", "id")), work.keep(edges.select("repo", "source", "target"))
    depth, calls = bfs_depth(nodes, edges, kept=True), in_degrees(nodes, edges)
    has_entry = edges.where(F.col("source") == MAIN).select("repo").distinct().withColumn("has_entry", F.lit(True))
    both = work.keep(calls.where(F.col("id") != MAIN).join(depth, ["repo", "id"]).join(has_entry, "repo", "left"))
    most = both.groupBy("repo").agg(F.greatest(F.lit(1), F.max("in_degree")).alias("most"))
    near = 0.4 * (1 - F.least("depth", F.col("max_depth") + 1) / (F.col("max_depth") + 1))
    score = F.when(F.col("has_entry"), near).otherwise(F.lit(0.0)) + 0.6 * (F.col("in_degree") / F.col("most"))
    main = nodes.where(F.col("id") == MAIN).select("repo", "id", F.lit(0.0).alias("score"))
    return both.join(most, "repo").select("repo", "id", score.alias("score")).unionByName(main)


def connected_nodes(view_nodes: DataFrame, view_edges: DataFrame) -> DataFrame:
    """The nodes that an edge of the view touches."""
    ends = view_edges.select("repo", F.explode(F.array("source", "target")).alias("id"))
    return view_nodes.join(ends, ["repo", "id"], "left_semi")


def visible_edges(edges: DataFrame, visible: DataFrame) -> DataFrame:
    """The edges whose both ends are visible."""
    ends = visible.select("repo", "id")
    first = edges.join(ends.withColumnRenamed("id", "source"), ["repo", "source"], "left_semi")
    return first.join(ends.withColumnRenamed("id", "target"), ["repo", "target"], "left_semi").select(*edges.columns)


def auto_level(nodes: DataFrame, limit: int = 500) -> DataFrame:
    """(repo, n, level): the detail level for the graph's size, null to keep the level."""
    out = nodes.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("level", F.when(F.col("n") >= limit, F.greatest(F.lit(0.1), F.least(F.lit(0.9), F.lit(float(limit)) / F.col("n")))))
