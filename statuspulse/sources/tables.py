"""Tables as files: replace-all, per-day and per-schedule replacement, keyed records, reads.

Result tables are parquet folders.  Replacement is by whole folder or by partition, which
Spark commits at the end of the job, so a job that lost executors leaves the old rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def replace_table(df: DataFrame, path: str) -> None:
    """Delete every row, insert these."""
    df.write.mode("overwrite").parquet(path)


def clear_table(spark: SparkSession, path: str) -> None:
    """Delete every row, keep the schema."""
    schema = spark.read.parquet(path).schema
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def _partitioned(df: DataFrame, column: str, sort: Sequence[str]) -> DataFrameWriter:
    # AQE splits a hot partition value over several tasks and files; the writer has to sort by
    # the partition column anyway, so a longer sort key costs little and lets readers of one
    # site skip row groups
    spread = df.hint("rebalance", column).sortWithinPartitions(column, *sort)
    return spread.write.mode("overwrite").partitionBy(column)


def write_days(
    df: DataFrame, path: str, *, date: str = "slot_date", sort: Sequence[str] = ()
) -> None:
    """Replace the days present in ``df``, keep all others: running a day twice is harmless."""
    _partitioned(df, date, sort).option("partitionOverwriteMode", "dynamic").parquet(path)


def replace_days(
    df: DataFrame, path: str, *, date: str = "slot_date", sort: Sequence[str] = ()
) -> None:
    """Replace the whole table, partitioned by day."""
    _partitioned(df, date, sort).option("partitionOverwriteMode", "static").parquet(path)


def replace_schedule(df: DataFrame, path: str, *, schedule: str) -> None:
    """Replace the rows of one schedule, even by none; other schedules keep theirs."""
    named = df.withColumn("schedule", F.lit(schedule))
    named.write.mode("overwrite").parquet(f"{path}/of={schedule}")


def read_schedules(spark: SparkSession, path: str, *, schedule: str | None = None) -> DataFrame:
    """All schedules, or the folder of one."""
    rows = spark.read.parquet(path)
    return (rows if schedule is None else rows.where(F.col("of") == schedule)).drop("of")


def append_records(df: DataFrame, path: str, *, batch: int) -> None:
    """Write a batch of keyed records; the same batch number again replaces itself."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def latest_records(
    spark: SparkSession, path: str, *, keys: Sequence[str], order: str
) -> DataFrame:
    """One record per key, last write wins: the read side of an upsert."""
    rows = spark.read.parquet(path)
    fields = [c for c in rows.columns if c not in {*keys, "batch"}]
    newest = F.max_by(F.struct(*fields), F.struct(F.col(order), F.col("batch")))
    return rows.groupBy(*keys).agg(newest.alias("_r")).select(*keys, "_r.*")


def write_state(df: DataFrame, path: str, *, batch: int) -> None:
    """What the next micro-batch needs of this one.

    Two folders take turns: a batch reads the other's and overwrites its own, so it can be
    run again, and the state does not grow with the number of batches.
    """
    df.write.mode("overwrite").parquet(f"{path}/turn={batch % 2}")


def read_state(
    spark: SparkSession, path: str, schema: StructType | str, *, batch: int
) -> DataFrame:
    """What the batch before this one left; nothing for the first."""
    if batch == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/turn={(batch - 1) % 2}")


def read_records(
    table: DataFrame,
    *,
    where: Column | None = None,
    order_by: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Filtered, ordered, limited read; no limit unless asked for."""
    rows = table if where is None else table.where(where)
    rows = rows.orderBy(*order_by) if order_by else rows
    return rows if limit is None else rows.limit(limit)


def read_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The table, or no rows where it does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def write_libsvm(vectors: DataFrame, path: str) -> None:
    """Training rows (label, features) as libsvm text, for exchange with other tools."""
    vectors.select("label", "features").write.mode("overwrite").format("libsvm").save(path)


def read_libsvm(spark: SparkSession, path: str, *, features: int = 3) -> DataFrame:
    return spark.read.format("libsvm").option("numFeatures", str(features)).load(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a declared schema: no inference pass."""
    return spark.read.schema(schema).json(path)
