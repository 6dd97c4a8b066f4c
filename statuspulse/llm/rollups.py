"""Token counts kept up to date by deltas.

A batch of changes names documents to insert, delete or revise.  Only their texts are counted.
Joined with the counts on record, a batch becomes signed rows: what it adds is positive, what
it takes back negative.  Their sums by source, language and tokenizer version are the batch's
delta, and the totals are the sum of all deltas: nothing is ever recounted.

Two logs of merged runs (``sources.runs``) hold the counts, of which a merge keeps each document's
last, and the deltas, which a merge sums.  A batch writes its counts, then its delta, which commits
it, then a mark in ``commits``, and only then the logs are merged.  Counts without a delta are not
read and are written again, and a committed batch is not applied again, so a batch that failed
midway, or is sent twice, leaves the totals right.  Batches are applied in order; numbers may be
left out.  A read opens a bounded number of folders after any number of batches; only the listing
of the marks grows with them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuspulse.sources.runs import BATCH, RunTable

KEYS = ("source", "lang", "version")
MEASURES = ("documents", "tokens", "characters")
COUNTS = "doc_id long, source string, lang string, version string, tokens long, characters long, present boolean"
DELTAS = "source string, lang string, version string, documents long, tokens long, characters long"


@lru_cache(maxsize=4)
def tokenizer(vocabulary: str, pattern: str):
    """A byte-pair encoder from a file of ranks."""
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary).read_bytes().splitlines())}
    return tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, text_column: str, vocabulary: str, pattern: str) -> DataFrame:
    """``docs`` with ``tokens`` and ``characters`` in place of the text; a null text has none."""
    others = [c for c in docs.columns if c != text_column]
    schema = docs.select(*others).schema.add("tokens", "long").add("characters", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary, pattern).encode_ordinary
        for batch in batches:
            tokens, characters = [], []
            for scalar in batch.column(batch.num_columns - 1):
                text = scalar.as_py() or ""
                tokens.append(len(encode(text)))
                characters.append(len(text))
            columns = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(tokens, pa.int64()), pa.array(characters, pa.int64())], schema.names
            )

    return docs.select(*others, F.col(text_column).cast("string").alias(text_column)).mapInArrow(run, schema)


@dataclass(frozen=True)
class Rollup:
    """The folder of a rollup; every executor must see it."""

    spark: SparkSession
    root: str

    @property
    def counts(self) -> RunTable:
        return RunTable(self.spark, f"{self.root}/counts", keys=("doc_id",))

    @property
    def deltas(self) -> RunTable:
        return RunTable(self.spark, f"{self.root}/deltas", reduce=_summed)

    def _marks(self, pattern: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/commits/{pattern}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> set[int]:
        """Batches whose delta is written; those of merged runs are known by their marks."""
        pattern, files = self._marks("*")
        marked = {int(f.getPath().getName()) for f in files.globStatus(pattern) or ()}
        return marked | {number for level, number in self.deltas.runs() if level == 0}

    def _settle(self, done: set[int]) -> None:
        """Marks of ``done``, then the merges that are due."""
        for level, number in self.deltas.runs():
            if level == 0 and number in done:
                path, files = self._marks(str(number))
                files.create(path, True).close()
        last = max(done)
        self.counts.settle(last)
        self.deltas.settle(last)

    def state(self) -> DataFrame:
        """The documents on record: the latest row of each, if it is present."""
        last = max(self.committed(), default=-1)
        rows = self.counts.read(COUNTS).where(F.col(BATCH) <= last)
        latest = F.max_by(F.struct(*_names(COUNTS)[1:]), BATCH).alias("_latest")
        return rows.groupBy("doc_id").agg(latest).select("doc_id", "_latest.*").where("present").drop("present")

    def totals(self) -> DataFrame:
        """source, lang, version, documents, tokens, characters; groups that came to nothing are left out."""
        summed = _summed(self.deltas.read(DELTAS)).drop(BATCH)
        return summed.where("documents <> 0 OR tokens <> 0 OR characters <> 0")

    def apply(self, batch: int, changes: DataFrame, version: str, vocabulary: str, pattern: str) -> bool:
        """Commit a batch; False if it is committed already.

        ``changes`` has op ('insert', 'delete' or 'revise'), doc_id, text, source and lang.  An
        insert or revision of a document on record replaces its count, one of an unknown
        document adds it, a deletion of an unknown one does nothing.  Of several changes of a
        document in a batch a revision wins over an insert and that over a deletion, then more
        characters, more tokens, the greater source and language; rows without an id or with
        another op are ignored.
        """
        if batch < 0:
            raise ValueError("batches are numbered from 0")
        done = self.committed()
        if done:
            self._settle(done)  # a batch may have been lost after its commit
        if batch in done:
            return False
        if done and batch < max(done):
            raise ValueError(f"batch {batch} comes after batch {max(done)}")
        wanted = changes.where("doc_id IS NOT NULL AND op IN ('insert', 'delete', 'revise')").select(
            F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("lang").cast("string"), "op",
            F.when(F.col("op") != "delete", F.col("text").cast("string")).alias("text"),
        )
        counted = count_tokens(wanted, "text", vocabulary, pattern).withColumn("version", F.lit(version))
        counted = counted.withColumn("present", F.col("op") != "delete")
        order = F.row_number().over(
            Window.partitionBy("doc_id").orderBy(F.desc("op"), F.desc("characters"), F.desc("tokens"), F.desc("source"), F.desc("lang"))
        )
        fresh = counted.withColumn("nth", order).where("nth = 1").select(*_names(COUNTS))
        self.counts.write(fresh, batch)
        after = self.counts.of(batch)
        # what it takes back: the counts on record of the documents it touches
        back = self.state().join(after.select("doc_id"), "doc_id", "left_semi")
        signed = _signed(after.where("present"), 1).unionByName(_signed(back, -1))
        delta = signed.groupBy(*KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES))
        self.deltas.write(delta.coalesce(1), batch)
        self._settle(done | {batch})
        return True


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(*(F.sum(m).alias(m) for m in MEASURES), F.max(BATCH).alias(BATCH))


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _signed(rows: DataFrame, sign: int) -> DataFrame:
    return rows.select(
        *KEYS,
        F.lit(sign).cast("long").alias("documents"),
        (F.col("tokens") * sign).alias("tokens"),
        (F.col("characters") * sign).alias("characters"),
    )
