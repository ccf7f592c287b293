"""A directory of source files: listed level by level over the cluster, or as a Spark data source (format "source_tree"),
in a batch or as a stream.

Spark's own file readers hide names that begin with _ or ., so the walk is ours. Symbolic links aren't followed; unreadable
files and folders are left out; skipped folders are pruned. The folder must be one that all machines see.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from siltworks.operators.graph import written

SCHEMA = "path string, size long, raw binary"
#: Folders that one task lists.
FOLDERS_A_TASK = 64


def _pruned(name: str, skip: frozenset[str]) -> bool:
    return name in skip or name.endswith(".egg-info")


class _Slice(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.max_size = int(options.get("maxFileSize", 200 * 1024))
        self.skip = frozenset(filter(None, options.get("skipDirs", "").split(",")))
        self.files_a_task = int(options.get("filesPerTask", 256))

    def partitions(self) -> list[InputPartition]:
        found = []
        for at, folders, names in os.walk(self.root, followlinks=False):
            folders[:] = sorted(d for d in folders if not _pruned(d, self.skip))
            found += [os.path.join(at, n) for n in sorted(names) if not os.path.islink(os.path.join(at, n))]
        return [_Slice(found[i : i + self.files_a_task]) for i in range(0, len(found), self.files_a_task)] or [_Slice([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.paths:
            if (row := _row(self.root, path, self.max_size)) is not None:
                yield row


def _row(root: str, path: str, max_size: int) -> tuple | None:
    """path from root on, size and content of a file; the content of larger ones is null, an unreadable file none."""
    try:
        size = os.path.getsize(path)
        raw = None
        if size <= max_size:  # larger ones are reported, not read
            with open(path, "rb") as f:
                raw = f.read()
    except OSError:
        return None
    return os.path.relpath(path, root).replace(os.sep, "/"), size, raw


class TreeStream(DataSourceStreamReader):
    """Files in the order of (time of change in nanoseconds, path). A micro-batch holds those that came behind the last offset.

    Offsets come from a walk by the stream's planner, which keeps nothing but the files of the batch. A file whose time of
    change lies before the last offset (a copy that keeps times, a clock set back) is not seen.
    """

    def __init__(self, options: dict):
        self.reader = TreeReader(options)

    def initialOffset(self) -> dict:
        return {"time": 0, "path": ""}

    def _between(self, low: tuple, high: tuple | None) -> Iterator[tuple]:
        for at, folders, names in os.walk(self.reader.root, followlinks=False):
            folders[:] = [d for d in folders if not _pruned(d, self.reader.skip)]
            for path in (os.path.join(at, n) for n in names):
                try:
                    told = os.lstat(path)
                except OSError:
                    continue
                key = (told.st_mtime_ns, path)
                if not os.path.islink(path) and low < key and (high is None or key <= high):
                    yield key

    def latestOffset(self) -> dict:
        time, path = max(self._between((0, ""), None), default=(0, ""))
        return {"time": time, "path": path}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found = [path for _, path in sorted(self._between((start["time"], start["path"]), (end["time"], end["path"])))]
        size = self.reader.files_a_task
        return [_Slice(found[i : i + size]) for i in range(0, len(found), size)] or [_Slice([])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        pass


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TreeStream(self.options)


def _level(folders: DataFrame, root: str, skip: frozenset[str]) -> DataFrame:
    """path, is_folder, by folder of this level: what lies in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[str, bool]] = []
            for folder in batch.column("path").to_pylist():
                try:
                    entries = list(os.scandir(os.path.join(root, folder)))
                except OSError:
                    continue
                for e in entries:
                    if e.is_symlink():
                        continue
                    is_folder = e.is_dir(follow_symlinks=False)
                    if not (is_folder and _pruned(e.name, skip)) and (is_folder or e.is_file(follow_symlinks=False)):
                        found.append((f"{folder}/{e.name}" if folder else e.name, is_folder))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([d for _, d in found], pa.bool_())], names=["path", "is_folder"])

    return folders.mapInArrow(run, "path string, is_folder boolean")


def list_tree(spark: SparkSession, root: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """path of every regular file below root, from root on.

    The folders found on one level are dealt over the cluster and listed there for the next; the driver learns how many
    there are. One job a level.
    """
    level = spark.createDataFrame([("",)], "path string")
    files, n = None, 1
    while n:
        dealt = level.repartition(max(1, -(-n // FOLDERS_A_TASK)))
        found = written(_level(dealt, root, frozenset(skip)))
        here = found.where("not is_folder").select("path")
        files = here if files is None else files.unionByName(here)
        level = found.where("is_folder").select("path")
        n = level.count()
    return files


def read_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """path, size, raw of every regular file under root; raw is null for files over maxFileSize.

    options: maxFileSize, skipDirs (comma-separated), filesPerTask.
    """
    most, size = int(options.get("maxFileSize", 200 * 1024)), int(options.get("filesPerTask", 256))
    paths = written(list_tree(spark, root, tuple(filter(None, options.get("skipDirs", "").split(",")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path in batch.column("path").to_pylist():
                row = _row(root, os.path.join(root, path), most)
                if row is None:
                    continue
                rows.append(row)
                held += len(row[2] or b"")
                if held > 4 << 20:
                    yield _files(rows)
                    rows, held = [], 0
            yield _files(rows)

    return paths.repartition(max(1, -(-paths.count() // size)), F.xxhash64("path")).mapInArrow(run, SCHEMA)


def _files(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.binary()))], names=["path", "size", "raw"])


def stream_tree(spark: SparkSession, root: str, **options) -> DataFrame:
    """A stream of path, size, raw: files that came or changed since the last micro-batch (new content is a new row)."""
    spark.dataSource.register(SourceTree)
    return spark.readStream.format("source_tree").options(**{k: str(v) for k, v in options.items()}).load(root)
