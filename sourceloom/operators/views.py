"""Filters over the rows of a view: search, toggles, folders, time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import path_dirname
from sourceloom.operators.measures import connected_nodes


def _flag(view: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in view.columns else F.lit(False)


def matches(label: Column, query: str) -> Column:
    """The label holds the query, in any case; an empty query matches all."""
    return F.lower(label).contains(query.lower())


def inside_folder(file: Column, folder: str) -> Column:
    """The file lies in the folder or below it."""
    own = path_dirname(file)
    return (own == folder) | own.startswith(f"{folder}/") | own.startswith(f"{folder}\\")


def files_inside(files: DataFrame, folders: DataFrame) -> DataFrame:
    """(repo, file) of the files that lie in or below any of the folders (repo, folder), tables of any size: each file meets its own folders by equality."""
    own = path_dirname(F.col("file"))
    place = F.sequence(F.lit(1), F.length(own))
    above = F.transform(F.filter(place, lambda i: F.substr(own, i, F.lit(1)).isin("/", "\\")), lambda i: F.substr(own, F.lit(1), i - 1))
    rows = files.select("repo", "file").where("file is not null").distinct().select("repo", "file", F.explode(F.array_union(above, F.array(own))).alias("folder"))
    return rows.join(folders.select("repo", "folder"), ["repo", "folder"], "left_semi").select("repo", "file").distinct()


def visible_nodes(
    view: DataFrame, edges: DataFrame, query: str = "", libraries: bool = True, existing_only: bool = False, orphans: bool = True,
    only_folder: str | None = None, hidden_folders: tuple[str, ...] = (), seen: DataFrame | None = None, shown: DataFrame | None = None, hidden: DataFrame | None = None,
) -> DataFrame:
    """The nodes of a view that the filters let pass; library nodes meet the search, their toggle and the time only. ``seen`` (repo, id): what a snapshot holds.

    ``shown`` and ``hidden`` (repo, folder) are tables of the folders to which the view is limited, and of those left out.
    """
    library = _flag(view, "is_library")
    cluster = _flag(view, "is_cluster") | _flag(view, "is_synthetic")
    keep = matches(F.col("label"), query) if query else F.lit(True)
    if not libraries:
        keep = keep & ~library
    if existing_only:
        there = F.coalesce((F.col("file") != "") & (F.col("line") > 0), F.lit(False))
        keep = keep & (library | cluster | there)
    placed = ~library & ~cluster & F.coalesce(F.col("file") != "", F.lit(False))
    if only_folder is not None:
        keep = keep & (~placed | inside_folder(F.col("file"), only_folder))
    for folder in hidden_folders:
        keep = keep & (~placed | ~inside_folder(F.col("file"), folder))
    out = view.where(keep)
    for folders, inside in ((shown, True), (hidden, False)):
        if folders is not None:
            found = files_inside(out.where(placed), folders).withColumn("_inside", F.lit(True))
            out = out.join(found, ["repo", "file"], "left").where(~placed | (F.col("_inside").isNotNull() if inside else F.col("_inside").isNull())).select(view.columns)
    if not orphans:
        out = out.where(_flag(out, "is_library")).unionByName(connected_nodes(out.where(~_flag(out, "is_library")), edges))
    if seen is not None:
        out = out.join(seen.select("repo", "id"), ["repo", "id"], "left_semi").select(view.columns)
    return out


def ego_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with an end among ``ids`` (repo, id)."""
    ends = ids.select("repo", "id").distinct()
    sides = [edges.join(ends.withColumnRenamed("id", end), ["repo", end], "left_semi").select(edges.columns) for end in ("source", "target")]
    return sides[0].unionByName(sides[1]).distinct()


def languages(nodes: DataFrame) -> DataFrame:
    """(language): those in use, in order."""
    return nodes.where("language is not null").select("language").distinct().orderBy("language")
