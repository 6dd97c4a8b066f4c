"""What the operators share: scratch tables, and column names that cannot clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statuspulse.session import shared_path

#: The words of a text: runs without ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


class Scratch:
    """Tables an operator writes to the folder all executors share, and reads again.

    Writing cuts the lineage: a lost executor repeats only what came after the last table.
    ``drop`` removes a table that no later step reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = shared_path(spark, name)
        self.tables = 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.tables += 1
        path = f"{self.root}/{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        for file in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(file)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str, of: str = "") -> Column:
    """The column of exactly this name, dots and all; ``of`` is the alias of its frame."""
    quoted = "`" + name.replace("`", "``") + "`"
    return F.col(f"{of}.{quoted}" if of else quoted)
