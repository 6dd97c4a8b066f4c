"""Snapshot archives: zip files, each holding JSON status documents.

Layout below the root: ``<yyyy-MM-dd>/<station>/<HH:mm:ss>.zip`` for history and
``latest/<station>.zip`` for the newest snapshot of every station.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator, Sequence
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuspulse import schemas
from statuspulse.functions import time
from statuspulse.params import OUTLET_CODES

# fixed value: archive path, date and station
ARCHIVE_PATH = r"(\d{4}-\d{2}-\d{2})/([^/]+)/([^/]+)\.zip$"
LATEST_PATH = r"/latest/([^/]+)\.zip$"

# fixed values: why an archive went to quarantine
BAD_ARCHIVE = "bad archive"
BAD_JSON = "bad json"
MISSING_FIELD = "missing field"
BAD_TIME = "bad time"

_ARCHIVE_OPTIONS = {
    "recursiveFileLookup": "true",
    # no checksummed local file system, see read_archives
    "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem",
    "fs.file.impl.disable.cache": "true",
}

_UNPACKED = "path string, payloads array<string>, error string"


def read_archives(
    spark: SparkSession, root: str, *, days: Sequence[date] | None = None, glob: str = "*.zip"
) -> DataFrame:
    """Archives below ``root`` as (path, content); with ``days``, of those date folders only.

    No days, and days without a folder, mean no rows.

    Minute-sized files are the cost here, not their bytes.  Only the named folders are
    listed, many of them in parallel; read them once and compact them
    (``plans.refresh.compact_archives``).

    The colons in the file names are no legal part of the checksum files that the checksummed
    local file system looks for, so local folders are read without it; other stores ignore
    these two options.
    """
    options = {**_ARCHIVE_OPTIONS, "pathGlobFilter": glob}
    folders = [root] if days is None else _existing(spark, [f"{root}/{day.isoformat()}" for day in days])
    if not folders:
        return spark.createDataFrame([], schemas.ARCHIVE_FILES)
    return spark.read.format("binaryFile").options(**options).load(folders).select("path", "content")


def _existing(spark: SparkSession, folders: list[str]) -> list[str]:
    """Those of a look-back's folders that are there."""
    conf = spark._jsc.hadoopConfiguration()
    paths = [spark._jvm.org.apache.hadoop.fs.Path(folder) for folder in folders]
    return [f for f, p in zip(folders, paths, strict=True) if p.getFileSystem(conf).exists(p)]


def archive_days(spark: SparkSession, root: str) -> list[date]:
    """The date folders below ``root``, oldest first; one listing, no archive is opened."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in store.listStatus(path)] if store.exists(path) else []
    return sorted(date.fromisoformat(n) for n in names if re.fullmatch(r"\d{4}-\d{2}-\d{2}", n))


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """The newest archive of every station, ``latest/<station>.zip``, as it is now.

    Nothing else below the root is listed or opened.  ``latest.stream_latest`` is the same as a
    stream, which opens only what was replaced since the last poll.
    """
    folders = _existing(spark, [f"{root}/latest"])
    if not folders:
        return spark.createDataFrame([], schemas.ARCHIVE_FILES)
    options = {**_ARCHIVE_OPTIONS, "pathGlobFilter": "*.zip"}
    return spark.read.format("binaryFile").options(**options).load(folders).select("path", "content")


def stream_archives(
    spark: SparkSession, root: str, *, glob: str = "*.zip", files_per_trigger: int | None = None
) -> DataFrame:
    """The same as a stream: each archive once, as it appears."""
    options = {**_ARCHIVE_OPTIONS, "pathGlobFilter": glob}
    if files_per_trigger:
        options["maxFilesPerTrigger"] = str(files_per_trigger)
    reader = spark.readStream.format("binaryFile").schema(schemas.BINARY_FILES)
    return reader.options(**options).load(root).select("path", "content")


def with_path_parts(archives: DataFrame) -> DataFrame:
    """Directory date and station, from the path alone."""
    return archives.withColumns(
        {
            "dir_date": F.regexp_extract("path", ARCHIVE_PATH, 1).try_cast("date"),
            "station": F.coalesce(
                F.nullif(F.regexp_extract("path", ARCHIVE_PATH, 2), F.lit("")),
                F.regexp_extract("path", LATEST_PATH, 1),
            ),
        }
    )


def _unpack_one(content: bytes) -> tuple[list[str], str | None]:
    """Texts of the archive's files, up to the first that cannot be read."""
    payloads: list[str] = []
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for entry in archive.infolist():
                if not entry.is_dir():
                    payloads.append(archive.read(entry).decode("utf-8"))
    except (zipfile.BadZipFile, zlib.error, UnicodeDecodeError, EOFError, OSError,
            RuntimeError, NotImplementedError):
        return payloads, BAD_ARCHIVE
    return payloads, None


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        done = [_unpack_one(content) for content in batch["content"]]
        yield pd.DataFrame(
            {
                "path": batch["path"],
                "payloads": [payloads for payloads, _ in done],
                "error": [error for _, error in done],
            }
        )


def parse_archives(
    archives: DataFrame,
    *,
    outlets: Sequence[str] | None = tuple(OUTLET_CODES),
    keep_later: bool = False,
) -> DataFrame:
    """One row per archive: its usable documents, why reading stopped, and what was dropped.

    Only the unzipping runs in Python; all of it is per row - no shuffle.  A document is one
    element of ``summaries`` of one element of a file's outer array, in this order; an empty
    array counts as one bad document.  The first bad one ends its archive, unless
    ``keep_later`` keeps the good ones after it.  ``dropped`` lists every document that is not
    kept: its file, poll and summary (from 0) and, if it is bad itself, the reason.
    ``outlets`` are the outlets every document must have; ``None`` takes those it has, at least
    one.
    """
    texts = archives.select("path", "content").mapInPandas(_unpack, _UNPACKED)

    def elements(array: Column) -> Column:
        """The elements, or one NULL for none."""
        return F.when(F.size(array) > 0, array).otherwise(F.array(F.get(array, F.lit(0))))

    def documents(payload: Column, file: Column) -> Column:
        # a bare object would be read as an array of one
        root = F.from_json(payload, schemas.SNAPSHOT_DOCUMENT)
        unreadable = root.isNull() | ~F.ltrim(payload).startswith("[")

        def of_poll(node: Column, poll: Column) -> Column:
            return F.transform(
                elements(node["summaries"]),
                lambda summary, place: F.struct(
                    unreadable.alias("unreadable"),
                    file.alias("file"),
                    poll.alias("poll"),
                    place.alias("summary"),
                    summary["device_id"].alias("device_id"),
                    node["time"].alias("time"),
                    summary["port_status"].alias("ports"),
                ),
            )

        return F.flatten(F.transform(elements(root), of_poll))

    def checked(doc: Column) -> Column:
        ports, ts = doc["ports"], time.parse_gmt(doc["time"])
        if outlets is None:
            kept = ports
            absent = F.size(ports) < 1
        else:
            wanted = F.array(*(F.lit(o) for o in outlets))
            kept = F.map_filter(ports, lambda name, _: F.array_contains(wanted, name))
            absent = F.size(kept) < len(outlets)
        absent = absent | F.exists(F.map_values(kept), lambda node: node.isNull())
        missing = doc["device_id"].isNull() | doc["time"].isNull() | F.coalesce(absent, F.lit(True))
        return F.struct(
            doc["file"].alias("file"),
            doc["poll"].alias("poll"),
            doc["summary"].alias("summary"),
            doc["device_id"].alias("device_id"),
            ts.alias("ts"),
            F.transform_values(kept, lambda _, node: node["status"]).alias("ports"),
            F.when(doc["unreadable"], BAD_JSON)
            .when(missing, MISSING_FIELD)
            .when(ts.isNull(), BAD_TIME)
            .alias("error"),
        )

    docs = texts.withColumn("docs", F.flatten(F.transform("payloads", documents))).withColumn(
        "docs", F.transform("docs", checked)
    )
    bad = F.array_position(F.transform("docs", lambda d: d["error"].isNotNull()), F.lit(True))

    def kept(doc: Column, place: Column) -> Column:
        good = doc["error"].isNull()
        return good if keep_later else good & ((F.col("_bad") == 0) | (place < F.col("_bad")))

    lost = F.filter("docs", lambda d, i: ~kept(d, i))
    return docs.withColumn("_bad", bad).select(
        "path",
        F.filter("docs", kept).alias("docs"),
        F.coalesce(F.get("docs", (F.col("_bad") - 1).cast("int"))["error"], "error").alias("error"),
        F.transform(
            lost, lambda d: F.struct(d["file"], d["poll"], d["summary"], d["error"])
        ).alias("dropped"),
    )


def archive_readings(parsed: DataFrame, *, site: Column | None = None) -> DataFrame:
    """Outlet readings of the usable documents; an absent status stays NULL."""
    return (
        parsed.select("path", F.explode("docs").alias("_doc"))
        .select("path", "_doc.device_id", "_doc.ts", F.explode("_doc.ports").alias("outlet_id", "status"))
        .withColumn("site_id", F.lit(0) if site is None else site)
    )


def outcomes(parsed: DataFrame) -> DataFrame:
    """Every archive with the documents kept and dropped and, if there was one, the first error."""
    return parsed.select(
        "path",
        "error",
        F.size("docs").alias("documents_kept"),
        F.size("dropped").alias("documents_dropped"),
    )


def dropped_documents(parsed: DataFrame) -> DataFrame:
    """Every document that was not kept, with its place and, if it is bad itself, the reason."""
    return parsed.select("path", F.explode("dropped").alias("_d")).select("path", "_d.*")


def quarantine(parsed: DataFrame) -> DataFrame:
    """Archives that were cut short, with the reason."""
    return outcomes(parsed).where(F.col("error").isNotNull())


def latest_archives(archives: DataFrame) -> DataFrame:
    """Newest archive per station by path.

    Paths alone are reduced and shuffled; contents are taken from the chosen files.
    """
    dated = with_path_parts(archives.select("path"))
    newest = dated.groupBy("station").agg(F.max_by("path", F.struct("dir_date", "path")).alias("path"))
    return archives.join(newest.select("path"), "path", "left_semi").select("path", "content")


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        contents = []
        for name, payload in zip(batch["entry"], batch["payload"], strict=True):
            buffer = io.BytesIO()
            with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr(name, payload)
            contents.append(buffer.getvalue())
        yield pd.DataFrame({"path": batch["path"], "content": contents})


def pack_archives(documents: DataFrame) -> DataFrame:
    """(path, entry, payload) to (path, content): the collector's side of the format."""
    return documents.select("path", "entry", "payload").mapInPandas(_pack, schemas.ARCHIVE_FILES)
