"""Files, classes and folders of code graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import common_prefix, language_of

#: Fixed value: the extensions of scanned files that are shown without nodes.
SHOWN_EMPTY = r"\.(?:py|js|ts)$"


def _flag(nodes: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in nodes.columns else F.lit(False)


def project_members(nodes: DataFrame) -> DataFrame:
    """Nodes that are no library, cluster or stand-in of a whole project, with a file."""
    skipped = _flag(nodes, "is_library") | _flag(nodes, "is_cluster") | _flag(nodes, "is_synthetic")
    return nodes.where(~skipped & F.col("file").isNotNull() & (F.col("file") != ""))


def files_rollup(nodes: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """(repo, file, n, language): nodes of each file, its language from its first node or else its extension; of ``files`` (repo, file) also those without nodes."""
    rows = project_members(nodes).groupBy("repo", "file").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("language").isNotNull(), F.struct("id", "language")))["language"].alias("first"))
    if files is not None:
        empty = files.where(F.col("file").rlike(SHOWN_EMPTY)).select("repo", "file").distinct().join(rows, ["repo", "file"], "left_anti")
        rows = rows.unionByName(empty.withColumn("n", F.lit(0).cast("long")).withColumn("first", F.lit(None).cast("string")))
    return rows.select("repo", "file", "n", F.coalesce("first", language_of(F.col("file"))).alias("language"))


def classes_rollup(nodes: DataFrame) -> DataFrame:
    """(repo, class_key, file, class_name, class_extends, class_implements, members): classes with the fields of their first member; members by id."""
    rows = nodes.where(~(_flag(nodes, "is_library") | _flag(nodes, "is_cluster") | _flag(nodes, "is_synthetic")) & F.col("class_name").isNotNull())
    extra = [F.col(c) if c in nodes.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("class_extends", "string"), ("class_implements", "array<string>"))]
    rows = rows.select("repo", "id", F.coalesce("file", F.lit("")).alias("file"), "class_name", *extra)
    out = rows.groupBy("repo", "file", "class_name").agg(
        F.min_by(F.struct("class_extends", "class_implements"), "id").alias("first"), F.array_sort(F.collect_set("id")).alias("members")
    )
    return out.select("repo", F.concat_ws("::", "file", "class_name").alias("class_key"), "file", "class_name", "first.class_extends", "first.class_implements", "members")


def _folders(files: DataFrame) -> DataFrame:
    """(repo, file, p): the parts of each file's folder; runs of separators part them, and empty parts are left out."""
    parts = F.filter(F.split("file", r"[/\\]+"), lambda s: s != "")
    return files.select("repo", "file", parts.alias("p")).select("repo", "file", F.slice("p", F.lit(1), F.greatest(F.size("p") - 1, F.lit(0))).alias("p"))


def folder_tree(files: DataFrame) -> DataFrame:
    """(repo, folder, depth, parent, n_direct): folders of files and what lies between them and the common part of all, which has depth 0 where files lie there.

    Depth counts parts below the common one; the parent is null where it is not in the tree.
    """
    rows = _folders(files.select("repo", "file").distinct())
    ends = rows.groupBy("repo").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    common = ends.select("repo", F.size(common_prefix(F.col("low"), F.col("high"))).alias("common"))
    rows = rows.join(common, "repo").withColumn("size", F.size("p"))
    path = lambda k: F.array_join(F.slice("p", F.lit(1), k), "/")
    above = rows.select("repo", "common", "p", F.explode(F.sequence(F.col("common") + F.when(F.col("size") > F.col("common"), 1).otherwise(0), F.col("size"))).alias("k"), "size")
    tree = above.select("repo", path(F.col("k")).alias("folder"), (F.col("k") - F.col("common")).alias("depth"), F.when(F.col("k") > F.col("common"), path(F.col("k") - 1)).alias("up"), (F.col("k") == F.col("size")).cast("long").alias("direct"))
    tree = tree.groupBy("repo", "folder", "depth", "up").agg(F.sum("direct").alias("n_direct"))
    inside = tree.select("repo", F.col("folder").alias("up"), F.lit(True).alias("there"))
    return tree.join(inside, ["repo", "up"], "left").select("repo", "folder", "depth", F.when(F.col("there"), F.col("up")).alias("parent"), "n_direct")


def folder_nodes(nodes: DataFrame) -> DataFrame:
    """(repo, folder, n): nodes at any depth under each folder, by one aggregation over the ancestors of files."""
    per_file = project_members(nodes).groupBy("repo", "file").agg(F.count(F.lit(1)).alias("n"))
    parts = per_file.join(_folders(per_file).select("repo", "file", "p"), ["repo", "file"])
    rows = parts.where("size(p) > 0").select("repo", "n", "p", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("k"))
    return rows.select("repo", F.array_join(F.slice("p", F.lit(1), F.col("k")), "/").alias("folder"), "n").groupBy("repo", "folder").agg(F.sum("n").alias("n"))


def sibling_folders(tree: DataFrame) -> DataFrame:
    """(repo, a, b): pairs of folders of one parent, each once; as many as the pairs that the feature shows."""
    side = lambda name: tree.where("parent is not null").select("repo", "parent", F.col("folder").alias(name))
    return side("a").join(side("b"), ["repo", "parent"]).where("a < b").select("repo", "a", "b")
