"""Data sources of files: a reader of source trees whose tasks list folders, and a writer of documents that appear when all of them are written."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from sourceloom.plans.durable import Workspace

#: Folders that a scan leaves out, by language, and extensions by language.
SKIPPED = ("node_modules", "out", "dist")
SKIPPED_PYTHON = ("__pycache__",)
EXTENSIONS = (("python", r"\.py$"), ("typescript", r"(?<!\.d)\.tsx?$"), ("javascript", r"\.(?:js|jsx|mjs|cjs)$"))

BATCH_BYTES = 1 << 22
STAGED = 1 << 12  # files that a task moves or reads at once


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address, or the local one of a plain path, and the path within it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _kept_folder(name: str) -> bool:
    return not name.startswith(".") and name not in SKIPPED


def _language(path: str) -> str | None:
    """The language of a file below the root that a scan takes."""
    *folders, name = path.split("/")
    language = next((k for k, pattern in EXTENSIONS if re.search(pattern, name)), None)
    return None if language == "python" and any(f in SKIPPED_PYTHON for f in folders) else language


@dataclass
class Folder(InputPartition):
    """A folder below the root, with all folders below it or by itself."""

    path: str
    deep: bool


class CorpusReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.repo = options["path"], options.get("repo", "")
        self.most = int(options.get("folders", "1024"))

    def _listed(self, store: fs.FileSystem, path: str) -> list[fs.FileInfo]:
        return sorted(store.get_file_info(fs.FileSelector(path)), key=lambda x: x.path)

    def partitions(self) -> Sequence[InputPartition]:
        """The tree is opened level by level until there are ``folders`` folders or 16 times as many names have been seen; tasks list what lies below the others, so the driver lists no more names than that and one folder's."""
        store, top = store_of(self.root)
        opened, front, seen = [], [top.rstrip("/")], 0
        while front and len(opened) + len(front) < self.most and seen < 16 * self.most:
            below, level = [], iter(front)
            for folder in level:
                found = self._listed(store, folder)
                seen += len(found)
                opened.append(folder)
                below += [x.path for x in found if x.type == fs.FileType.Directory and _kept_folder(x.base_name)]
                if seen >= 16 * self.most:
                    break
            front = [*level, *below]
        return [*(Folder(f, False) for f in opened), *(Folder(f, True) for f in front)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        store, top = store_of(self.root)
        base = len(top.rstrip("/")) + 1
        rows, size, folders = [], 0, [partition.path]
        while folders:
            folder = folders.pop()
            try:
                found = self._listed(store, folder)
            except OSError as e:
                rows.append((self.repo, folder[base:], None, None, f"folder: {type(e).__name__}"))
                continue
            for info in found:
                path = info.path[base:]
                if info.type == fs.FileType.Directory:
                    folders += [info.path] * (partition.deep and _kept_folder(info.base_name))
                elif language := _language(path):
                    text, reason = None, None
                    try:
                        with store.open_input_stream(info.path) as stream:
                            raw = stream.read()
                        text = raw.decode("utf-8", "ignore")
                        reason = None if len(text.encode()) == len(raw) else "bytes that are no UTF-8"
                    except OSError as e:
                        reason = f"file: {type(e).__name__}"
                    rows.append((self.repo, path, language, text, reason))
                    size += len(text or "")
                    if size >= BATCH_BYTES:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["repo", "path", "language", "text", "reason"])


class CorpusSource(DataSource):
    """``spark.read.format("source_corpus").option("repo", ...).load(root)``: (repo, path, language, text, reason) of the files that a scan takes.

    A file or folder that cannot be read is a row without text and with the reason; bytes that are no UTF-8 are left out, and the reason says so.
    """

    @classmethod
    def name(cls) -> str:
        return "source_corpus"

    def schema(self) -> str:
        return "repo string, path string, language string, text string, reason string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return CorpusReader(self.options)


@dataclass
class Staged(WriterCommitMessage):
    folders: list[str]


def _staging(top: str, job: str) -> str:
    return f"{top}/_staging-{job}"


def _clear(store: fs.FileSystem, top: str, job: str) -> None:
    if store.get_file_info(_staging(top, job)).type != fs.FileType.NotFound:
        store.delete_dir(_staging(top, job))


def _place(store: fs.FileSystem, staged: str, top: str) -> int:
    """Move the files below a staged folder to their places below the top, over what is there. What another attempt has moved is passed over."""
    made, moved = set(), 0
    for info in store.get_file_info(fs.FileSelector(staged, recursive=True)):
        if info.type == fs.FileType.File:
            place = f"{top}/{info.path[len(staged) + 1 :]}"
            if place.rpartition("/")[0] not in made:
                store.create_dir(place.rpartition("/")[0], recursive=True)
                made.add(place.rpartition("/")[0])
            try:
                store.move(info.path, place)
                moved += 1
            except FileNotFoundError:
                if store.get_file_info(place).type != fs.FileType.File:
                    raise
    return moved


def publish(spark: SparkSession, root: str, job: str) -> None:
    """Tasks move what the writer of ``job`` has left staged to its place, a staged folder at a time."""
    store, top = store_of(root.rstrip("/"))
    with store.open_input_stream(f"{_staging(top, job)}/_written") as stream:
        staged = stream.read().decode().split()

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of(root.rstrip("/"))
        for batch in batches:
            yield pa.record_batch({"n": pa.array([_place(store, f"{_staging(top, job)}/{name}", top) for name in batch.column(0).to_pylist()], pa.int64())})

    try:
        if staged:
            spark.range(0, len(staged), 1, len(staged)).select(F.element_at(F.lit(staged), (F.col("id") + 1).cast("int")).alias("name")).mapInArrow(move, "n long").agg(F.sum("n")).collect()
    finally:
        _clear(store, top, job)


def read_documents(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(file, text) of the files of one folder whose names end so, as ``write_documents`` leaves them; hidden ones are left out. A task lists the folder, and the names are dealt out to tasks that read ``STAGED`` files each."""

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            store, top = store_of(root.rstrip("/"))
            found = [x.base_name for x in store.get_file_info(fs.FileSelector(top)) if x.type == fs.FileType.File and x.base_name.endswith(suffix) and x.base_name[0] not in "._"]
            for k in range(0, len(found), STAGED):
                yield pa.record_batch({"file": pa.array(found[k : k + STAGED], pa.string())})

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = store_of(root.rstrip("/"))
        for batch in batches:
            rows, size = [], 0
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{top}/{name}") as stream:
                    rows.append((name, stream.read().decode("utf-8", "replace")))
                size += len(rows[-1][1])
                if size >= BATCH_BYTES:
                    yield _documents(rows)
                    rows, size = [], 0
            if rows:
                yield _documents(rows)

    listed = Workspace(spark).keep(spark.range(0, 1, 1, 1).mapInArrow(names, "file string"))
    tasks = max(spark.sparkContext.defaultParallelism, -(-listed.count() // STAGED))
    return listed.repartition(tasks).mapInArrow(texts, "file string, text string")


def _documents(rows: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["file", "text"])


class DocumentWriter(DataSourceWriter):
    """Tasks write below staging folders of their own, of ``STAGED`` files at most. The commit moves what the successful ones wrote to its place, over what is there, and removes the rest; where the
    option ``job`` names the staging folder, it only lists what they wrote, for ``publish``."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.root, self.overwrite, self.held = options["path"].rstrip("/"), overwrite, "job" in options
        self.job = options.get("job") or uuid.uuid4().hex

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, top = store_of(self.root)
        context = TaskContext.get()
        own, made, folders = f"{context.partitionId()}-{context.taskAttemptId()}", set(), []
        for k, row in enumerate(rows):
            if row.file.startswith("/") or ".." in row.file.split("/"):
                raise ValueError(f"not a place below the folder: {row.file}")
            if k % STAGED == 0:
                folders.append(f"{own}-{k // STAGED}")
            path = f"{_staging(top, self.job)}/{folders[-1]}/{row.file}"
            if path.rpartition("/")[0] not in made:
                store.create_dir(path.rpartition("/")[0], recursive=True)
                made.add(path.rpartition("/")[0])
            with store.open_output_stream(path) as out:
                out.write((row.text or "").encode())
        return Staged(folders)

    def commit(self, messages: list[Staged | None]) -> None:
        store, top = store_of(self.root)
        store.create_dir(_staging(top, self.job), recursive=True)
        if self.overwrite:
            for info in store.get_file_info(fs.FileSelector(top)):
                if info.base_name != _staging(top, self.job).rpartition("/")[2]:
                    (store.delete_dir if info.type == fs.FileType.Directory else store.delete_file)(info.path)
        staged = [name for message in messages if message is not None for name in message.folders]
        if self.held:
            with store.open_output_stream(f"{_staging(top, self.job)}/_written") as out:
                out.write("\n".join(staged).encode())
            return
        for name in staged:
            _place(store, f"{_staging(top, self.job)}/{name}", top)
        _clear(store, top, self.job)

    def abort(self, messages: list[Staged | None]) -> None:
        _clear(*store_of(self.root), self.job)


class DocumentFiles(DataSource):
    """``df.write.format("document_files").mode("append").save(folder)`` of rows (file, text): one file a document, relative paths allowed. ``append`` replaces documents of the same name, ``overwrite`` all."""

    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return "file string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return DocumentWriter(self.options, overwrite)
