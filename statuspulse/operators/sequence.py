"""Bounded look-back over very long sequences.

A window partitioned by site alone puts one site's whole history into one task.  Every
operator here that looks back needs a bounded number of earlier rows, so the history is
cut into time chunks and each chunk is given the last ``k`` rows that precede it.  Window
functions then run per (key, chunk): a hot key spreads over its chunks, and the result
equals that of the window over the whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

IS_HALO = "is_halo"


def with_halo(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    order: Sequence[str],
    k: int,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """``df`` plus, per (keys, chunk), copies of the ``k`` rows before it, flagged ``is_halo``.

    ``chunk`` must not decrease along ``order`` within a key, and (keys, order) must be
    unique.  The tails are limited before they are shuffled, so what moves between chunks is
    ``k`` rows per chunk; the window that links the chunks of one key sees one row a chunk.

    ``carry`` names the columns the look-back needs; the others are NULL in a halo row.  Name
    them when ``df`` is read from files, so that the tails read less.  Leave it out when
    ``df`` comes from a shuffle: with equal columns Spark reuses that shuffle for the tails.
    """
    wanted = df.columns if carry is None else carry
    payload = [*order, *(c for c in wanted if c not in {*keys, chunk, *order})]
    if k == 1 and len(order) == 1:
        carried = _last_before(df, keys, chunk, payload)
    else:
        carried = _tail_before(df, keys, chunk, payload, order, k)

    def column(name: str, kind: str) -> Column:
        if name in payload:
            return F.col(f"_row.{name}").alias(name)
        if name in {*keys, chunk}:
            return F.col(name)
        return F.lit(None).cast(kind).alias(name)

    halo = carried.select(
        *(column(name, kind) for name, kind in df.dtypes), F.lit(True).alias(IS_HALO)
    )
    return df.withColumn(IS_HALO, F.lit(False)).unionByName(halo)


def _last_before(
    df: DataFrame, keys: Sequence[str], chunk: str, payload: Sequence[str]
) -> DataFrame:
    """The one row before each chunk, from a plain aggregate: nothing is sorted but chunks."""
    at, *rest = payload
    last = df.groupBy(*keys, chunk).agg(
        F.max(at).alias(at), *(F.max_by(c, at).alias(c) for c in rest)
    )
    chunks = Window.partitionBy(*keys).orderBy(chunk)
    return last.select(*keys, chunk, F.lag(F.struct(*payload)).over(chunks).alias("_row")).where(
        F.col("_row").isNotNull()
    )


def _tail_before(
    df: DataFrame,
    keys: Sequence[str],
    chunk: str,
    payload: Sequence[str],
    order: Sequence[str],
    k: int,
) -> DataFrame:
    """The last k rows before each chunk, from the tails of the chunks before it."""
    newest_first = Window.partitionBy(*keys, chunk).orderBy(*(F.col(c).desc() for c in order))
    tails = (
        df.withColumn("_rank", F.row_number().over(newest_first))
        .where(F.col("_rank") <= k)
        .groupBy(*keys, chunk)
        .agg(F.sort_array(F.collect_list(F.struct(*payload))).alias("_tail"))
    )
    # each earlier chunk holds at least one row: the last k chunks hold the last k rows
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(-k, -1)
    before = F.flatten(F.collect_list("_tail").over(earlier))
    last_k = F.slice("_before", F.greatest(F.size("_before") - (k - 1), F.lit(1)), k)
    return tails.select(*keys, chunk, before.alias("_before")).select(
        *keys, chunk, F.explode(last_k).alias("_row")
    )
