"""Sources and the restartable sink shared by the streams."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from statuspulse.sources.tables import append_records


def stream_files(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    *,
    glob: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """Parquet files of a folder as a stream, oldest first."""
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(files_per_trigger))
    return reader.parquet(path)


def with_event_time(rows: DataFrame, delay: str, *, ts: str = "ts") -> DataFrame:
    """GMT ``timestamp_ntz`` to ``timestamp``, which watermarks need, and the watermark."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def write_batches(
    stream: DataFrame,
    path: str,
    *,
    mode: str,
    poll: str | None = None,
    each: Callable[[DataFrame, int], None] | None = None,
) -> StreamingQuery:
    """Write every micro-batch to ``path/rows/batch=N``, with the checkpoint next to it.

    A batch that is run again after a failure overwrites its own folder, so the table holds
    each batch once.  ``each`` gets the rows read back from that folder: the stateful part
    of the plan runs once, whatever is made of its rows.  Without ``poll`` the query takes
    what is there and stops.
    """

    def write(rows: DataFrame, batch: int) -> None:
        append_records(rows, f"{path}/rows", batch=batch)
        if each:
            stored = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows/batch={batch}")
            each(stored, batch)

    trigger = {"processingTime": poll} if poll else {"availableNow": True}
    return (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(**trigger)
        .start()
    )


def run_available(stream: DataFrame, path: str, *, mode: str) -> DataFrame:
    """Run a stream over everything available now and return the written rows."""
    write_batches(stream, path, mode=mode).awaitTermination()
    return stream.sparkSession.read.parquet(f"{path}/rows")


def newest_version(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows written in update mode, reduced to the last version of every key."""
    fields = [c for c in rows.columns if c not in {*keys, "batch"}]
    newest = F.max_by(F.struct(*fields), F.col("batch")).alias("_r")
    return rows.groupBy(*keys).agg(newest).select(*keys, "_r.*")
