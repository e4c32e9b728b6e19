"""Feeds of edits with Structured Streaming; each function takes a stream or, where time allows, a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourceloom.functions import language_of


def change_feed(saves: DataFrame, file: str = "file") -> DataFrame:
    """Saved files with ``route``: ``analysis`` for source files, which also change the status, else ``status``."""
    return saves.withColumn("route", F.when(language_of(F.col(file)).isNotNull(), "analysis").otherwise("status"))


def debounce(events: DataFrame, key: str, gap: str = "1 second", ts: str = "ts", late: str = "1 minute") -> DataFrame:
    """(key, fire_at, n): one firing a run of events, a gap after the last; an event exactly one gap later still belongs to the run.

    On a stream a run fires once the watermark has passed it.
    """
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    runs = rows.groupBy(key, F.session_window(ts, gap).alias("run")).agg(F.count(F.lit(1)).alias("n"))
    return runs.select(key, F.col("run.end").alias("fire_at"), "n")


def latest_status(updates: DataFrame, ts: str = "ts") -> DataFrame:
    """(repo, id, status, ts): the last status of each node; nodes without an update keep theirs. On a stream, in update mode."""
    newest = updates.groupBy("repo", "id").agg(F.max_by("status", ts).alias("status"), F.max(ts).alias(ts))
    return newest.select("repo", "id", "status", ts)


def stream_edges(edges: DataFrame, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Edges once each, repeats within the watermark dropped; a table's are all distinct."""
    keys = ["repo", "source", "target"]
    return edges.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys) if edges.isStreaming else edges.groupBy(*keys).agg(F.min(ts).alias(ts))


def first_seen(events: DataFrame, ts: str = "ts") -> DataFrame:
    """(repo, id, ts): when each id first came. On a stream, in update mode."""
    return events.groupBy("repo", "id").agg(F.min(ts).alias(ts))


def replace_facts(facts: DataFrame, changed: DataFrame, fresh: DataFrame) -> DataFrame:
    """The fact table with the facts of changed files (repo, file) replaced by fresh ones; a changed file without facts has none left."""
    return facts.join(changed.select("repo", "file").distinct(), ["repo", "file"], "left_anti").select(facts.columns).unionByName(fresh.select(facts.columns))


def on_change(extract: Callable[[DataFrame], DataFrame], read: Callable[[], DataFrame], write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: of each batch of saved files (repo, file, text, ts) the last version is extracted, and its facts replace the stored ones.

    ``read`` gives the stored facts and ``write`` stores the new ones, to another place than ``read`` is reading.
    """

    def apply(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("repo", "file").agg(F.max_by("text", "ts").alias("text"))
        write(replace_facts(read(), last, extract(last)))

    return apply
