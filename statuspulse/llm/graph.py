"""Connected components of a distributed edge list."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuspulse.llm.common import Scratch


def local_stars(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes of a few edges, roots left out."""
    nodes, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = at[: len(left)], at[len(left) :]
    root = np.arange(len(nodes))
    while True:
        least = np.minimum(root[a], root[b])
        fresh = root.copy()
        np.minimum.at(fresh, root[a], least)
        np.minimum.at(fresh, root[b], least)
        fresh = fresh[fresh]
        if (fresh == root).all():
            break
        root = fresh
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _print(edges: DataFrame) -> tuple:
    """Two equal edge sets have equal prints."""
    digest = F.xxhash64("u", "v")
    return tuple(
        edges.agg(F.count(F.lit(1)), F.bit_xor(digest), F.sum(F.shiftright(digest, 20))).first()
    )


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node that has an edge and is not its component's least node.

    ``edges`` has two columns of one orderable type.  Alternating large-star and small-star
    rounds, each written to the shared folder: every node hands its least neighbour to its
    greater (then to its smaller) neighbours, until the edges are stars around the least
    nodes.  The least neighbour is a hash aggregate, combined before the shuffle, so a node
    with very many edges is no hot group; the joins are plain equality joins that adaptive
    execution may split.  Edges with a null or equal ends are ignored.
    """
    a, b = edges.columns
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    current = scratch.keep(edges.distinct())
    seen = _print(current)
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        after = scratch.keep(
            small.where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = _print(after)
        scratch.drop(current)
        current = after
        if now == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
