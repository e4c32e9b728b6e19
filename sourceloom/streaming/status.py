"""The change status of every function as a stream: each update of a file replaces what the one before said about it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATUS = "repo string, file string, id string, status string, ts timestamp"


class FileStatuses(StatefulProcessor):
    """Of one file: the time of its newest update, and the status of each id in it. A timer clears a file that has had no update for ``keep_ms`` of event time."""

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "micros long")
        self.held = handle.getMapState("held", "id string", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        newest, fresh = self.at.get()[0] if self.at.exists() else None, {}
        began = newest
        for part in rows:
            for micros, i, status in zip((part["ts"].astype("datetime64[us]").astype("int64")).tolist(), part["id"].tolist(), part["status"].tolist()):
                if newest is None or micros > newest:
                    newest, fresh = micros, {}
                if micros == newest and i is not None and status is not None:
                    fresh[i] = max(status, fresh.get(i, status))
        if newest is None:
            return
        old = {k[0]: v[0] for k, v in self.held.iterator()}
        if newest == began:
            fresh = {i: max(s, old.get(i, s)) for i, s in fresh.items()}
        out = {i: s for i, s in fresh.items() if old.get(i) != s or newest != began}
        if newest != began:
            for i in old.keys() - fresh.keys():
                self.held.removeKey((i,))
                out[i] = None
            self.at.update((newest,))
            if self.keep_ms is not None:
                for timer in list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(newest // 1000 + self.keep_ms)
        for i, s in fresh.items():
            if old.get(i) != s:
                self.held.updateValue((i,), (s,))
        if out:
            yield pd.DataFrame({"repo": key[0], "file": key[1], "id": list(out), "status": list(out.values()), "ts": pd.to_datetime([newest] * len(out), unit="us")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.at.clear()
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_file_statuses(updates: DataFrame, late: str = "1 hour", keep_ms: int | None = None) -> DataFrame:
    """(repo, file, id, status, ts), in update mode, from a stream of the same columns: rows of one file and time are one update.

    An update sets the status of its ids and takes it from the file's other ids (a row with a null status); an older one that comes late changes nothing; files without an update keep what they have. A row without id or status stands for
    an update that may be empty. Of two statuses of an id in one update the larger counts. State is a map for each file, in RocksDB, which the session must name as its state store.
    """
    rows = updates.select("repo", "file", "id", "status", "ts").withWatermark("ts", late)
    mode = "EventTime" if keep_ms is not None else "None"
    return rows.groupBy("repo", "file").transformWithStateInPandas(FileStatuses(keep_ms), STATUS, "Update", mode)


def file_statuses(updates: DataFrame) -> DataFrame:
    """(repo, file, id, status, ts) that hold after all updates of a table: those of each file's newest one."""
    newest = updates.groupBy("repo", "file").agg(F.max("ts").alias("ts"))
    held = updates.join(newest, ["repo", "file", "ts"]).where("id is not null and status is not null")
    return held.groupBy("repo", "file", "id").agg(F.max("status").alias("status"), F.max("ts").alias("ts"))


def statuses_of(emitted: DataFrame) -> DataFrame:
    """What the rows that a stream has emitted amount to: of each id the last one, if that has a status."""
    last = emitted.groupBy("repo", "file", "id").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", F.col("status").isNotNull(), "status")).alias("m"))
    return last.select("repo", "file", "id", "m.status", "m.ts").where("status is not null")
