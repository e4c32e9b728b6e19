"""Contraction and roll-ups of graphs by cluster, file, folder and language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.operators.measures import MAIN


def structural_groups(nodes: DataFrame, mode: str) -> DataFrame:
    """(repo, id, cluster_id): by ``class`` or ``file``, a node without one stands alone."""
    key = {"class": F.when(F.col("class_name").isNotNull(), F.concat_ws("::", F.coalesce("file", F.lit("")), "class_name")), "file": F.col("file")}.get(mode)
    return nodes.select("repo", "id", F.coalesce(key, "id").alias("cluster_id") if key is not None else F.col("id").alias("cluster_id"))


def cluster_labels(assignment: DataFrame, nodes: DataFrame, scores: DataFrame) -> DataFrame:
    """(repo, cluster_id, label, n): the most important member's name and how many others there are; ties by id."""
    rows = assignment.join(nodes.select("repo", "id", "name"), ["repo", "id"]).join(scores.select("repo", "id", "score"), ["repo", "id"], "left")
    return labelled(rows).select("repo", "cluster_id", "label", "n")


def labelled(members: DataFrame, *more: Column) -> DataFrame:
    """(repo, cluster_id, n, ..., label) of members (repo, id, cluster_id, name, score): as in ``cluster_labels``, with further aggregates."""
    best = F.min(F.struct((-F.coalesce("score", F.lit(0.0))).alias("s"), "id", "name")).alias("best")
    out = members.groupBy("repo", "cluster_id").agg(best, F.count(F.lit(1)).alias("n"), *more)
    others = F.when(F.col("n") > 1, F.concat(F.lit(" +"), (F.col("n") - 1).cast("string"))).otherwise("")
    return out.withColumn("label", F.concat("best.name", others)).drop("best")


def language_breakdown(assignment: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, cluster_id, lang, n, fraction) for clusters of more than one member."""
    rows = assignment.join(nodes.select("repo", "id", F.coalesce("language", F.lit("unknown")).alias("lang")), ["repo", "id"])
    by_lang = rows.groupBy("repo", "cluster_id", "lang").agg(F.count(F.lit(1)).alias("n"))
    total = by_lang.groupBy("repo", "cluster_id").agg(F.sum("n").alias("total")).where("total > 1")
    return by_lang.join(total, ["repo", "cluster_id"]).select("repo", "cluster_id", "lang", "n", (F.col("n") / F.col("total")).alias("fraction"))


def rendered_ids(assignment: DataFrame, expanded: DataFrame) -> DataFrame:
    """(repo, id, rendered): the node itself where its cluster is expanded, else the cluster."""
    open_ = expanded.select("repo", "cluster_id").distinct().withColumn("open", F.lit(True))
    rows = assignment.join(open_, ["repo", "cluster_id"], "left")
    return rows.select("repo", "id", F.when(F.col("open"), F.col("id")).otherwise(F.col("cluster_id")).alias("rendered"))


def quotient_edges(edges: DataFrame, rendered: DataFrame) -> DataFrame:
    """(repo, source, target, calls): edges between what is rendered, once each, with how many they stand for."""
    rows = edges.where((F.col("source") != MAIN) & (F.col("target") != MAIN))
    for end in ("source", "target"):
        to = rendered.select("repo", F.col("id").alias(end), F.col("rendered").alias(f"{end}_r"))
        rows = rows.join(to, ["repo", end])
    rows = rows.where("source_r <> target_r").groupBy("repo", "source_r", "target_r").agg(F.count(F.lit(1)).alias("calls"))
    return rows.select("repo", F.col("source_r").alias("source"), F.col("target_r").alias("target"), "calls")


def folder_ancestors(files: DataFrame) -> DataFrame:
    """(repo, file, folder, depth): every folder above a file; runs of separators part the segments."""
    parts = F.filter(F.split("file", r"[/\\]+"), lambda s: s != "")
    rows = files.select("repo", "file", parts.alias("p")).where("size(p) > 1")
    deep = rows.select("repo", "file", "p", F.explode(F.sequence(F.lit(1), F.size("p") - 1)).alias("depth"))
    return deep.select("repo", "file", F.array_join(F.slice("p", 1, F.col("depth")), "/").alias("folder"), "depth")


def folder_rollup(files: DataFrame) -> DataFrame:
    """(repo, folder, depth, n_files): files at any depth under each folder."""
    return folder_ancestors(files).groupBy("repo", "folder", "depth").agg(F.countDistinct("file").alias("n_files"))
