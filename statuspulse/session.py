"""Session helpers: a tuned local session, and the shared folder for written tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "statuspulse", **conf: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the caller brings their own."""
    partitions = "8" if cpus == "*" else str(cpus)
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shared_folder: str | None = None


def use_shared_folder(path: str) -> None:
    """The folder to use in sessions that do not name one in ``spark.checkpoint.dir``."""
    global _shared_folder
    _shared_folder = path


def has_shared_folder(spark: SparkSession) -> bool:
    return bool(spark.conf.get("spark.checkpoint.dir", None) or _shared_folder)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which every executor must see."""
    base = spark.conf.get("spark.checkpoint.dir", None) or _shared_folder
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    For a small result of a large scan that several branches use: the scan runs once, a lost
    executor does not repeat it, and the size on disk lets Spark choose how to join.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
