"""Folders whose files are replaced in place, as a stream: ``latest/<station>.zip``.

Spark's file source takes a path once and never looks at it again, so a station's second
snapshot would be lost.  Here an offset is the folder's listing: the modification time and
length of every file.  A micro-batch holds the files whose entry differs between its two
offsets, i.e. those that are new or were replaced since; a file that was gone is new again.
The offsets are in the query's checkpoint, so a restart repeats none.

An offset takes about sixty bytes a file, which is right for one file a station and wrong for
a history of archives (``archives.stream_archives``).

What a replaced file held before is gone: of two replacements between two polls only the
second is seen.  A file that is replaced again between listing and reading is left to the next
micro-batch, whose listing has the newer entry; so no content comes twice, and none is read
half of one snapshot and half of the next.  The same holds for a micro-batch that is run again.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

FORMAT = "replaced_files"
SCHEMA = "path string, modified timestamp, content binary"
_ARROW = pa.schema(
    [("path", pa.string()), ("modified", pa.timestamp("us", tz="UTC")), ("content", pa.binary())]
)


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


@dataclass
class Files(InputPartition):
    """Some files of the folder, each with the entry it was listed with."""

    entries: list[tuple[str, str]]


def _entry(info: fs.FileInfo) -> str:
    return f"{info.mtime_ns} {info.size}"


class ReplacedFilesReader(DataSourceStreamReader):
    def __init__(self, folder: str, suffix: str, files_per_task: int):
        self.folder, self.suffix, self.files_per_task = folder, suffix, files_per_task

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, folder = open_store(self.folder)
        infos = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return {
            info.base_name: _entry(info)
            for info in sorted(infos, key=lambda i: i.base_name)
            if info.is_file and info.base_name.endswith(self.suffix) and not info.base_name.startswith((".", "_"))
        }

    def partitions(self, start: dict, end: dict) -> Sequence[Files]:
        changed = [(name, entry) for name, entry in sorted(end.items()) if start.get(name) != entry]
        n = self.files_per_task
        return [Files(changed[k : k + n]) for k in range(0, len(changed), n)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(self.folder)
        for name, entry in partition.entries:
            path = f"{folder}/{name}"
            try:
                with store.open_input_stream(path) as stream:
                    content = stream.read()
            except FileNotFoundError:
                continue
            if _entry(store.get_file_info(path)) == entry:
                modified = int(entry.split()[0]) // 1000
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{self.folder}/{name}"], _ARROW.types[0]),
                        pa.array([modified], _ARROW.types[1]),
                        pa.array([content], _ARROW.types[2]),
                    ],
                    schema=_ARROW,
                )


class ReplacedFiles(DataSource):
    """Options: ``path``, ``suffix`` (.zip) and ``files_per_task`` (64)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ReplacedFilesReader:
        options = self.options
        return ReplacedFilesReader(
            options["path"].rstrip("/"), options.get("suffix", ".zip"), int(options.get("files_per_task", "64"))
        )


def stream_replaced(
    spark: SparkSession, folder: str, *, suffix: str = ".zip", files_per_task: int = 64
) -> DataFrame:
    """(path, modified, content) of every file of ``folder``, again whenever it is replaced.

    No folder, and a folder without such files, give no rows until there are some.  Names that
    begin with a dot or an underscore, as unfinished files do, are passed over.
    """
    spark.dataSource.register(ReplacedFiles)
    reader = spark.readStream.format(FORMAT).option("path", folder).option("suffix", suffix)
    return reader.option("files_per_task", str(files_per_task)).load()


def stream_latest(spark: SparkSession, root: str, *, files_per_task: int = 64) -> DataFrame:
    """The newest archive of every station, ``latest/<station>.zip``, whenever it is replaced."""
    return stream_replaced(spark, f"{root}/latest", files_per_task=files_per_task)


def put_files(files: DataFrame, root: str) -> None:
    """Write (path, content) below ``root``, each file whole or not at all, old ones replaced.

    A file is written under a name that no reader takes and then moved.  Rows of one path must
    not differ; a null content leaves the path as it is.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        store, base = open_store(root)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                folder, _, name = f"{base}/{path}".rpartition("/")
                store.create_dir(folder, recursive=True)
                unfinished = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(unfinished) as stream:
                    stream.write(content)
                store.move(unfinished, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["files"])

    rows = files.select("path", "content").where("path is not null and content is not null")
    rows.mapInArrow(put, "files long").groupBy().sum("files").collect()
