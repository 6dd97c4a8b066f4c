"""A table that micro-batches append to and that stays cheap to read: a log of sorted runs.

Batch N is run N of level 0.  When the last batch of an interval of ``fanout ** level`` batches
has been written, what lies in the interval is merged into one run of that level, so a read opens
at most ``fanout - 1`` runs a level and a row is rewritten once a level.  The place of a run follows
from batch numbers alone: a batch that is run again after a failure writes and merges the same
folders again, and there is no list of files that could be lost.

A run counts once it has the marker that Spark writes last.  Readers take the greatest runs and
leave out those inside another, so a crash between two steps leaves the old runs or the new one,
never both.  Merged runs stay until the next interval of their level has been merged: a reader
that began before has that many batches to finish.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Written with every row: the batch it came with.
BATCH = "batch"

Run = tuple[int, int]  # level, number within the level


def span(run: Run, fanout: int) -> range:
    """The batches of a run."""
    width = fanout ** run[0]
    return range(run[1] * width, (run[1] + 1) * width)


def cover(runs: Iterable[Run], fanout: int) -> list[Run]:
    """The runs that a read needs: none inside another, by batch."""
    taken: set[Run] = set()
    for level, number in sorted(runs, reverse=True):
        above = ((up, number // fanout ** (up - level)) for up in range(level + 1, 64))
        if not any(run in taken for run in above):
            taken.add((level, number))
    return sorted(taken, key=lambda run: span(run, fanout).start)


@dataclass(frozen=True)
class RunTable:
    """Rows below ``root``, which every executor must see.

    With ``keys`` a merge keeps the record of every key that has the greatest ``order`` (and of
    these the latest batch), as ``latest`` does.  With ``reduce`` a merge keeps what that makes of
    the rows (sums, say), whose columns keep their types.  Without either every row stays.  All batches have
    the same columns; a batch number that comes again replaces that batch, if none came after it.

    ``append`` is right for consecutive batches.  Where numbers are left out, or a batch must not be
    merged before something else is written, ``write`` it and ``settle`` later.
    """

    spark: SparkSession
    root: str
    keys: Sequence[str] = ()
    order: str | None = None
    fanout: int = 8
    reduce: Callable[[DataFrame], DataFrame] | None = None

    def _path(self, run: Run) -> str:
        return f"{self.root}/level={run[0]}/run={run[1]}"

    def _folder(self, pattern: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{pattern}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def runs(self) -> list[Run]:
        """All runs that are written to the end, also those that a greater one replaces."""
        pattern, files = self._folder("level=*/run=*/_SUCCESS")
        found = [status.getPath().getParent() for status in files.globStatus(pattern) or ()]
        return [(_number(path.getParent()), _number(path)) for path in found]

    def _rows(self, runs: Sequence[Run], schema: StructType | None = None) -> DataFrame:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(*map(self._path, runs))

    def read(self, schema: StructType | str | None = None) -> DataFrame:
        """Every row kept so far, with its batch; without any batch no rows of ``schema``."""
        runs = cover(self.runs(), self.fanout)
        if runs:
            return self._rows(runs)
        if schema is None:
            raise FileNotFoundError(f"no batch in {self.root}")
        return self.spark.createDataFrame([], schema).withColumn(BATCH, F.lit(None).cast("long"))

    def latest(self, schema: StructType | str | None = None) -> DataFrame:
        """One record per key: the last written wins."""
        return self._newest(self.read(schema)).drop(BATCH)

    def _newest(self, rows: DataFrame) -> DataFrame:
        fields = [c for c in rows.columns if c not in self.keys]
        rank = F.struct(*([F.col(self.order)] if self.order else []), F.col(BATCH))
        newest = F.max_by(F.struct(*fields), rank).alias("_newest")
        return rows.groupBy(*self.keys).agg(newest).select(*self.keys, "_newest.*").select(rows.columns)

    def write(self, rows: DataFrame, batch: int) -> None:
        """Write a batch and merge nothing."""
        stamped = rows.withColumn(BATCH, F.lit(batch).cast("long"))
        stamped.write.mode("overwrite").parquet(self._path((0, batch)))

    def of(self, batch: int) -> DataFrame:
        """The rows of a batch that is not merged yet."""
        return self._rows([(0, batch)]).drop(BATCH)

    def settle(self, batch: int) -> None:
        """Merge all intervals that end with ``batch`` or before it and are not merged yet."""
        level = 1
        while self.fanout**level <= batch + 1:
            ended = (batch + 1) // self.fanout**level
            below = [run for run in cover(self.runs(), self.fanout) if run[0] < level]
            for number in sorted({n // self.fanout ** (level - low) for low, n in below}):
                if number < ended:
                    self.merge((level, number))
            level += 1

    def append(self, rows: DataFrame, batch: int) -> None:
        """Write a batch, then merge the intervals that end with it."""
        self.write(rows, batch)
        level = 1
        while (batch + 1) % self.fanout**level == 0:
            self.merge((level, batch // self.fanout**level))
            level += 1

    def merge(self, run: Run) -> None:
        """One run out of what lies in its interval; then the runs inside the one before are removed."""
        inside = [r for r in self.runs() if r[0] < run[0] and _within(r, run, self.fanout)]
        if inside:
            rows = self._rows(cover(inside, self.fanout))
            if self.keys:
                rows = self._newest(rows).sortWithinPartitions(*self.keys)
            elif self.reduce:
                rows = self.reduce(rows).select(*(F.col(c).cast(kind).alias(c) for c, kind in rows.dtypes))
            else:
                rows = rows.hint("rebalance")
            rows.write.mode("overwrite").parquet(self._path(run))
        known = self.runs()
        before = max((r for r in known if r[0] == run[0] and r[1] < run[1]), default=None)
        for old in known if before else ():
            if old[0] < run[0] and _within(old, before, self.fanout):
                self._remove(old)

    def _remove(self, run: Run) -> None:
        # the marker goes first, so that a run half removed is no run
        for part in ("/_SUCCESS", ""):
            path, files = self._folder(f"level={run[0]}/run={run[1]}{part}")
            files.delete(path, True)


def _number(path) -> int:
    return int(path.getName().split("=")[1])


def _within(run: Run, other: Run, fanout: int) -> bool:
    return run[1] // fanout ** (other[0] - run[0]) == other[1]
