"""Version-control changes and time: parsed texts, attribution to functions, order of appearance and snapshots."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourceloom.operators.hierarchy import _flag
from sourceloom.operators.measures import MAIN
from sourceloom.plans.durable import Workspace
from sourceloom.plans.ranking import numbered


#: The formats of the version-control tool's outputs, a hunk header and the header line of a blame entry.
_HUNK = r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
_BLAME = re.compile(r"([0-9a-f]{40}) (\d+) (\d+)(?: (\d+))?[\r\x85\u2028\u2029]?\Z", re.ASCII)
_AUTHOR_TIME = re.compile(r"author-time (-?\d+)", re.ASCII)


def _lines(texts: DataFrame, by: str = r"\n") -> DataFrame:
    """The texts' lines with their place; a text is one file's or one repository's output, and is split within its row."""
    return texts.select(*(c for c in texts.columns if c != "text"), F.posexplode(F.split("text", by)).alias("pos", "line"))


def _under(root: Column, rest: Column) -> Column:
    return F.regexp_replace(F.concat(F.regexp_replace(root, r"[/\\]+$", ""), F.lit("/"), rest), r"\\", "/")


def parse_status(texts: DataFrame) -> DataFrame:
    """(repo, file, unstaged, staged) from (repo, root, text): NUL-separated short statuses; the last entry of a file counts.

    Entries without two status letters and a blank, such as the old path of a rename, are left out.
    """
    rows = _lines(texts, "\x00").where((F.length("line") >= 4) & F.col("line").rlike("^[A-Z? ][A-Z? ] "))
    x, y = F.substring("line", 1, 1), F.substring("line", 2, 1)
    unstaged = F.when((x == "?") & (y == "?"), "added").when(y == "M", "modified").when(y == "D", "deleted").when((x == "A") & (y == " "), "added")
    staged = F.when(x == "A", "added").when(x == "D", "deleted").when(~x.isin(" ", "?"), "modified")
    rows = rows.select("repo", _under(F.col("root"), F.expr("substring(line, 4)")).alias("file"), "pos", unstaged.alias("unstaged"), staged.alias("staged"))
    return rows.groupBy("repo", "file").agg(F.max_by(F.struct("unstaged", "staged"), "pos").alias("s")).select("repo", "file", "s.unstaged", "s.staged")


def parse_diff(texts: DataFrame) -> DataFrame:
    """(repo, staged, file, start, end, is_new) from (repo, root, staged, text): the new sides of the hunks of a diff without context.

    White space that ends a path goes: the tool puts a tab behind a path that holds a blank, and a carriage return may stand before the line end. A missing count is 1; a hunk of no new lines covers its start; a hunk that replaces no line is new; hunks before the first file are left out.
    Lines are carried within one text, which is one command's output.
    """
    rows = _lines(texts.withColumn("doc", F.monotonically_increasing_id())).where(F.col("line").startswith("+++ b/") | F.col("line").startswith("@@"))
    file = F.when(F.col("line").startswith("+++ b/"), _under(F.col("root"), F.regexp_replace(F.expr("substring(line, 7)"), r"\s+$", "")))
    carried = F.last(file, ignorenulls=True).over(Window.partitionBy("repo", "staged", "doc").orderBy("pos"))
    hunks = rows.withColumn("file", carried).where(F.col("line").startswith("@@") & F.col("file").isNotNull() & F.col("line").rlike(_HUNK))
    group = lambda k: F.regexp_extract("line", _HUNK, k)
    count = lambda k: F.when(group(k) == "", F.lit(1)).otherwise(group(k).try_cast("int"))
    start = group(3).try_cast("int")
    return hunks.select("repo", "staged", "file", start.alias("start"), F.when(count(4) > 0, start + count(4) - 1).otherwise(start).alias("end"), (count(2) == 0).alias("is_new"))


def _blame_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of whole texts: (text, line, sha, author_time), the last one of each line of a text."""
    for batch in batches:
        rows = []
        for k in range(batch.num_rows):
            repo, file, text = (batch.column(c)[k].as_py() for c in range(3))
            times: dict[str, int] = {}
            entries: list[list] = []
            for line in (text or "").split("\n"):
                if found := _BLAME.match(line):
                    n = int(found[3])
                    entries.append([found[1], n if n < 1 << 31 else None, None])
                elif entries and (found := _AUTHOR_TIME.match(line)):
                    time = int(found[1])
                    if -(1 << 63) <= time < 1 << 63:
                        entries[-1][2] = time if entries[-1][2] is None else max(time, entries[-1][2])
            last: dict[int | None, tuple[str, int]] = {}
            for sha, n, time in entries:
                if time is not None:
                    times[sha] = time
                if sha in times:
                    last[n] = sha, times[sha]
            rows += [(repo, file, n, *x) for n, x in last.items()]
            if len(rows) >= 1 << 16:
                yield _blamed(rows)
                rows = []
        if rows:
            yield _blamed(rows)


def _blamed(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["repo", "file", "line", "sha", "author_time"])


def parse_blame(texts: DataFrame) -> DataFrame:
    """(repo, file, line, sha, author_time) from (repo, file, text), one text a file: a commit's time stands at its first entry and holds for its later ones. Lines without a known time are left out.

    A text is read within its row, so nothing is shuffled and a task holds the entries of one batch of texts.
    """
    return texts.select("repo", "file", "text").mapInArrow(_blame_entries, "repo string, file string, line int, sha string, author_time long")


def node_ranges(nodes: DataFrame) -> DataFrame:
    """(repo, id, file, start, end): a function lasts until the line before the next one of its file; the last has no end."""
    order = Window.partitionBy("repo", "file").orderBy("line", "id")
    return nodes.where("file is not null and file <> ''").select("repo", "id", "file", F.col("line").alias("start"), (F.lead("line").over(order) - 1).alias("end"))


def _met(ranges: DataFrame, hunks: DataFrame) -> DataFrame:
    """(repo, id, staged, status) of the ranges that hunks of a side meet, both sides in one window over a file's lines."""
    h = hunks.where("start is not null and end >= start and staged is not null").select("repo", "file", F.col("start").alias("at"), F.lit(1).alias("kind"), F.col("end").alias("he"), F.coalesce("is_new", F.lit(False)).alias("is_new"), "staged")
    placed = ranges.where("start is not null").select("repo", "file", "id", "start", "end")
    starts = placed.select("repo", "file", F.col("start").alias("at"), F.lit(0).alias("kind"), "id", "end")
    asks = placed.select("repo", "file", F.least("start", "end").alias("at"), F.lit(2).alias("kind"), "id", "start")
    points = h.unionByName(starts, allowMissingColumns=True).unionByName(asks, allowMissingColumns=True)
    before = Window.partitionBy("repo", "file").orderBy("at", "kind", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The range that a hunk begins in: the last one at or before its first line.
    columns = [F.last(F.when(F.col("kind") == 0, F.struct("id", "end")), ignorenulls=True).over(before).alias("r")]
    sides = [(staged, new) for staged in (False, True) for new in (False, True)]
    far = {x: f"far{k}" for k, x in enumerate(sides)}
    # A hunk that begins at or before a range holds its first line if the farthest one does.
    columns += [F.max(F.when((F.col("staged") == staged) & (F.col("is_new") | (not new)), F.col("he"))).over(before).alias(far[staged, new]) for staged, new in sides]
    seen = points.select("repo", "kind", "at", "id", "start", "staged", *columns, F.col("file").isNotNull().alias("filed"))
    hit = lambda id, staged, new: F.struct(id.alias("id"), staged.alias("staged"), new.alias("new"))
    begun = F.when((F.col("kind") == 1) & (F.col("at") <= F.coalesce("r.end", F.lit(2147483647))) & F.col("r").isNotNull(), hit(F.col("r.id"), F.col("staged"), F.lit(False)))
    holds = lambda staged, new: F.coalesce(F.col(far[staged, new]) >= F.col("start"), F.lit(False))
    within = [F.when((F.col("kind") == 2) & F.col("filed") & holds(staged, False), hit(F.col("id"), F.lit(staged), holds(staged, True))) for staged in (False, True)]
    both = seen.select("repo", F.explode(F.array_compact(F.array(begun, *within))).alias("x")).select("repo", "x.*")
    return both.groupBy("repo", "id", "staged").agg(F.when(F.max("new"), "added").otherwise("modified").alias("status"))


def _kept(ranges: DataFrame) -> DataFrame:
    """Ranges that several joins read, made once."""
    return Workspace(ranges.sparkSession).keep(ranges.select("repo", "id", "file", "start", "end"))


def hunk_status(ranges: DataFrame, hunks: DataFrame) -> DataFrame:
    """(repo, id, status): ``added`` where a new hunk holds the first line, ``modified`` where any hunk overlaps, else null.

    A window over a file's lines carries the farthest end of the hunks so far to each range, and the last range so far to each hunk; so no file joins its ranges with its hunks, and the lines of a hunk
    cost nothing. Of ranges that start on one line all but the last are empty and take hunks that hold the line and begin before it.
    """
    ranges = _kept(ranges)
    found = _met(ranges, hunks.withColumn("staged", F.lit(False)))
    return ranges.select("repo", "id").join(found.drop("staged"), ["repo", "id"], "left")


def attribute_changes(nodes: DataFrame, status: DataFrame, hunks: DataFrame) -> DataFrame:
    """(repo, id, unstaged, staged) of nodes with a file: a file that is added or deleted as a whole gives its status, others by their hunks; a file without status gives none."""
    ranges = _kept(node_ranges(nodes))
    side = lambda staged, name: F.max(F.when(F.col("staged") == staged, F.col("status"))).alias(name)
    found = _met(ranges, hunks).groupBy("repo", "id").agg(side(False, "hu"), side(True, "hs"))
    rows = ranges.select("repo", "id", "file").join(status.select("repo", "file", F.col("unstaged").alias("fu"), F.col("staged").alias("fs"), F.lit(True).alias("known")), ["repo", "file"], "left")
    rows = rows.join(found, ["repo", "id"], "left")
    whole = F.col("fu").isin("added", "deleted")
    pick = lambda a, b: F.when(F.col("known"), F.when(F.coalesce(whole, F.lit(False)), F.col(a)).otherwise(F.col(b)))
    return rows.select("repo", "id", pick("fu", "hu").alias("unstaged"), pick("fs", "hs").alias("staged"))


def introduction_times(nodes: DataFrame, blame: DataFrame) -> DataFrame:
    """(repo, id, ts): the time of the commit that a node's first line comes from; nodes without one are left out."""
    placed = nodes.where("file is not null and file <> '' and line > 0").select("repo", "id", F.regexp_replace("file", r"\\", "/").alias("file"), "line")
    return placed.join(blame.select("repo", "file", "line", F.col("author_time").alias("ts")), ["repo", "file", "line"]).select("repo", "id", "ts")


def timeline_order(times: DataFrame) -> DataFrame:
    """(repo, id, idx): functions from 0 by time, missing ones last, ties by id."""
    return numbered(times.select("repo", "id", "ts"), ["repo"], [F.col("ts").asc_nulls_last(), F.col("id")], "idx").select("repo", "id", "idx")


def library_appearance(order: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, id, appear_at): when the first function that calls a library function is there; never: no row."""
    rows = edges.select("repo", F.col("source").alias("id"), "target").join(order, ["repo", "id"])
    return rows.groupBy("repo", F.col("target").alias("id")).agg((F.min("idx") + 1).alias("appear_at"))


def snapshot(nodes: DataFrame, edges: DataFrame, order: DataFrame, libraries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges that are there after k functions: ordered ones below k, libraries that have appeared, and what has no place in the order."""
    rows = nodes.join(order.select("repo", "id", "idx"), ["repo", "id"], "left").join(libraries.select("repo", "id", "appear_at"), ["repo", "id"], "left")
    always = (F.col("id") == MAIN) | _flag(nodes, "is_cluster") | _flag(nodes, "is_synthetic")
    seen = F.when(always, True).when(_flag(nodes, "is_library"), F.coalesce(F.col("appear_at") <= k, F.lit(False))).otherwise(F.coalesce(F.col("idx") < k, F.lit(True)))
    there = rows.where(seen).select(nodes.columns)
    ends = there.select("repo", "id")
    kept = edges.join(ends.withColumnRenamed("id", "source"), ["repo", "source"], "left_semi").join(ends.withColumnRenamed("id", "target"), ["repo", "target"], "left_semi")
    return there, kept.select(edges.columns)


def growth(order: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, k, n_edges): how many edges between ordered functions are there after k of them, for each k at which some appear."""
    idx = lambda end: order.select("repo", F.col("id").alias(end), F.col("idx").alias(f"{end}_idx"))
    rows = edges.join(idx("source"), ["repo", "source"]).join(idx("target"), ["repo", "target"])
    born = rows.groupBy("repo", (F.greatest("source_idx", "target_idx") + 1).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    ranked = numbered(born, ["repo"], [F.col("k")], "place")
    part = F.floor(F.col("place") / 4096)
    blocks = ranked.groupBy("repo", part.alias("part")).agg(F.sum("n").alias("s"))
    before = blocks.select("repo", "part", (F.sum("s").over(Window.partitionBy("repo").orderBy("part")) - F.col("s")).alias("before"))
    own = F.sum("n").over(Window.partitionBy("repo", "part").orderBy("k"))
    return ranked.withColumn("part", part).withColumn("own", own).join(before, ["repo", "part"]).select("repo", "k", (F.col("own") + F.col("before")).alias("n_edges"))
