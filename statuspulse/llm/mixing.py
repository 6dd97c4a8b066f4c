"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same number of expected copies, target / size of the source.
Their prefix sum within the source is that number times a rank; one random offset per source is
added, and a document is emitted once per integer the sum crosses.  Ranks run by size, then by
a digest of the id, so that what is taken of long and of short documents is in proportion and
the words taken come within about one document of the target.

The rank of a document is a sum of three counts, none of which needs a source in one task: the
documents of smaller sizes (counted per source and size), those of its size with smaller digest
prefixes (counted per bucket), and its place in its bucket.  The number of prefix digits follows
the fullest size, the ranks do not depend on it.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statuspulse.llm.common import Scratch, column, free_name

WORD = r"[^\x20\x09-\x0D]+"
#: Documents of a bucket, about.
BUCKET = 50_000


def targets(rows: DataFrame, weights: tuple, share: float, most: float) -> DataFrame:
    """(source, source_size, target): one row per source of ``rows`` (source, size).

    Sources by code point, null last, weigh ``weights`` in turn.  ``share`` times the whole size
    is dealt by weight; a target stops at ``most`` times its source's size and the excess goes
    to the others by weight, until none is above: target = min(most * size, level * weight).
    The window runs over one row per source.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.get(F.array(*(F.lit(w) for w in weights)), turn)
    weighed = sizes.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * share
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    levelled = weighed.withColumn("own_level", level)
    above = F.col("cap") / F.col("weight") < F.col("own_level")
    level = F.max(F.when(~above, F.col("own_level"))).over(everything)
    return levelled.select(
        "source",
        "source_size",
        F.coalesce(F.least("cap", level * F.col("weight")), F.col("cap")).alias("target"),
    )


def mix(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
    weights: tuple = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken; a row per row of ``docs``.

    size counts words; a null text has none, a null source is a source of its own, and a null
    id is ranked like an empty one.  Rows that agree in id, source and size may swap copies.
    No row has more than ``most`` (rounded up) copies.  A source without words has target 0.
    Other columns are ignored.  Equal tables give equal results.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    size = F.coalesce(F.regexp_count(docs[text_column].cast("string"), F.lit(WORD)), F.lit(0))
    rows = scratch.keep(
        docs.select(
            docs[id_column].alias("doc_id"), docs[source_column].alias("source"), size.cast("long").alias("size")
        )
    )
    aims = scratch.keep(targets(rows, weights, share, most))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    counted = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    fullest = counted.agg(F.max("n")).first()[0] or 0
    digits = max(0, math.ceil(math.log(fullest / BUCKET, 16))) if fullest else 0
    placed = rows.withColumn("digest", digest).withColumn("bucket", F.substring("digest", 1, digits))
    smaller = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = counted.withColumn("below", F.coalesce(F.sum("n").over(smaller), F.lit(0))).drop("n")
    earlier = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    by_bucket = (
        placed.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("ahead", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    )
    nth = F.row_number().over(Window.partitionBy("source", "size", "bucket").orderBy("digest", "doc_id")) - 1
    ranked = placed.withColumn("nth", nth)
    for part, keys in ((by_bucket, ("source", "size", "bucket")), (by_size, ("source", "size")), (aims, ("source",))):
        part = part.select(*(F.col(k).alias(f"{k}_") for k in keys), *(c for c in part.columns if c not in keys))
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys))
        ranked = ranked.join(part, same).drop(*(f"{k}_" for k in keys))
    rank = F.col("below") + F.col("ahead") + F.col("nth")
    # 20 bits of a digest: exact in a double beside any rank
    name = F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    offset = F.conv(F.substring(F.md5(name.cast("binary")), 1, 5), 16, 10).cast("double") / float(1 << 20)
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    crossed = F.floor(offset + each * (rank + 1)) - F.floor(offset + each * rank)
    copies = F.least(crossed, F.ceil(F.lit(most))).cast("long")
    return ranked.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def emit(docs: DataFrame, **columns) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` says (0 to ``most`` times).

    Rows are matched with their copies by id, source, size and, for rows that agree in these,
    by order; the columns are those of ``docs``, whatever they are called.
    """
    names = {"id_column": "doc_id", "text_column": "text", "source_column": "source"}
    names |= {k: v for k, v in columns.items() if k in names}
    chosen = mix(docs, **columns).where("copies > 0")
    keys = ("doc_id", "source", "size")
    chosen = chosen.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("copies"))))
    chosen = chosen.select(*(F.col(k).alias(f"mix_{k}") for k in (*keys, "nth", "copies")))
    mine = {k: free_name(docs, f"row_{k}") for k in (*keys, "nth")}
    size = F.coalesce(F.regexp_count(docs[names["text_column"]].cast("string"), F.lit(WORD)), F.lit(0))
    rows = docs.withColumns(
        {
            mine["doc_id"]: docs[names["id_column"]],
            mine["source"]: docs[names["source_column"]],
            mine["size"]: size.cast("long"),
        }
    )
    own = Window.partitionBy(*(mine[k] for k in keys)).orderBy(mine["doc_id"])
    rows = rows.withColumn(mine["nth"], F.row_number().over(own)).alias("rows")
    chosen = chosen.alias("chosen")
    same = reduce(
        lambda a, b: a & b,
        (F.col(f"rows.{mine[k]}").eqNullSafe(F.col(f"chosen.mix_{k}")) for k in (*keys, "nth")),
    )
    out = rows.join(chosen, same)
    times = F.explode(F.sequence(F.lit(1), F.col("chosen.mix_copies").cast("int")))
    return out.select(*(column(c, "rows") for c in docs.columns), times.alias(free_name(docs, "copy"))).drop(
        free_name(docs, "copy")
    )
