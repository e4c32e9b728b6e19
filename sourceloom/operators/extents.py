"""Extents of groups of placed nodes: centroids, circles and nested boxes. ``positions``: (repo, id, x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a file's circle adds to its farthest node and its least radius; a file's box as a share of its radius; the padding of each folder level.
PAD, LEAST, BOX, MARGIN = 28.0, 30.0, 0.92, 40.0


def centroids(assignment: DataFrame, positions: DataFrame) -> DataFrame:
    """(repo, cluster_id, x, y): the mean of the members whose place is known."""
    placed = positions.where("x is not null and y is not null").select("repo", "id", "x", "y")
    return assignment.join(placed, ["repo", "id"]).groupBy("repo", "cluster_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def bounding_circles(points: DataFrame, key: str, pad: float = PAD, least: float = LEAST) -> DataFrame:
    """(repo, key, cx, cy, r): circles around the mean of each group's points (x, y and, optionally, own radius ``r``)."""
    own = F.col("r") if "r" in points.columns else F.lit(0.0)
    rows = points.where("x is not null and y is not null").select("repo", key, "x", "y", own.alias("own"))
    middle = rows.groupBy("repo", key).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    far = rows.join(middle, ["repo", key]).groupBy("repo", key, "cx", "cy").agg(F.max(F.hypot(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")) + F.col("own")).alias("far"))
    return far.select("repo", key, "cx", "cy", F.greatest(F.col("far") + pad, F.lit(least)).alias("r"))


def folder_extents(circles: DataFrame, margin: float = MARGIN) -> DataFrame:
    """(repo, folder, min_x, min_y, max_x, max_y): boxes around the files and folders below each folder, padded at each level.

    ``circles``: (repo, file, cx, cy, r). A box grows by ``margin`` for each level between it and a file, so one aggregation over a file's ancestors gives what
    a walk from the leaves would.
    """
    parts = F.filter(F.split("file", r"[/\\]+"), lambda s: s != "")
    rows = circles.select("repo", "cx", "cy", (F.col("r") * BOX).alias("h"), F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))).alias("p")).where("size(p) > 0")
    up = rows.select("*", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k")).withColumn("m", margin * (F.size("p") - F.col("k") + 1))
    return up.groupBy("repo", F.array_join(F.slice("p", F.lit(1), F.col("k")), "/").alias("folder")).agg(
        F.min(F.col("cx") - F.col("h") - F.col("m")).alias("min_x"), F.min(F.col("cy") - F.col("h") - F.col("m")).alias("min_y"),
        F.max(F.col("cx") + F.col("h") + F.col("m")).alias("max_x"), F.max(F.col("cy") + F.col("h") + F.col("m")).alias("max_y"),
    )
