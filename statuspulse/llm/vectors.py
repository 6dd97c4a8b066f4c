"""Embedding near-duplicates by a forest of random-projection trees.

Every tree splits the vectors of a label again and again along a random direction.  A split
has two thresholds, quantiles below and above the median, and the vectors between them go to
both sides (spill overlap), so that near vectors are rarely parted; many trees make up for
those that are.  Nodes are split until they hold at most ``leaf`` vectors; inside a leaf all
vectors are compared in double precision.  The quantiles of all nodes of a level are one
grouped aggregate, combined before the shuffle, so the forest is built over all rows and no
node is ever gathered before it is small.

Vectors of one direction are one point with a count.  Before the forest, points very near one
another are drawn together into cells: a pivot and what lies within a quarter of the linking
angle of it, so all members of a cell are linked and are counted without a comparison.  The
forest holds the pivots.  Two cells whose pivots are near enough, whatever the members, are
linked as a whole; where the members decide, they are compared in blocks.  So a cluster of very
many near-equal vectors is a few points of the forest, and loses no link.

A pair that several leaves share counts in the first of them, which both members know from the
list of their leaves: pairs are counted where they are found and never shuffled.  A leaf hands
on one edge per member, to the least member it is linked with there.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuspulse.llm.common import Scratch
from statuspulse.llm.graph import components, local_stars

#: Entries of a block of similarities.
BLOCK = 1 << 20

#: What angles may be wrong by (radians); pairs nearer to a bound are compared by their cosine.
DOUBT = 1e-6

#: A split must leave this share of a node beyond each threshold's nominal one.
SLACK = 0.02


def _directions(dims: int, trees: int, levels: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, trees * levels))


def unit_vectors(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of length one, in double precision, from lists of ``dims`` finite numbers."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    values = values / np.abs(values).max(axis=1, keepdims=True)
    return values / np.sqrt((values * values).sum(axis=1, keepdims=True))


def _projections(trees: int, levels: int, seed: int):
    def run(batches):
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for dims in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dims))
                where = unit_vectors(part.column(1), int(dims)) @ _directions(int(dims), trees, levels, seed)
                key = part.column(0)
                for tree in range(trees):
                    own = where[:, tree * levels : (tree + 1) * levels]
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0),
                            part.column(2),
                            pa.array(np.full(len(key), dims, np.int32)),
                            pa.array(np.full(len(key), tree, np.int32)),
                            pa.ListArray.from_arrays(
                                pa.array(np.arange(0, len(key) * levels + 1, levels, dtype=np.int32)),
                                pa.array(own.ravel()),
                            ),
                        ],
                        ["key", "label", "dims", "tree", "along"],
                    )

    return run


NODE = ("label", "dims", "tree", "node")


def forest(points: DataFrame, trees: int, leaf: int, overlap: float, seed: int, scratch: Scratch) -> DataFrame:
    """(key, label, dims, leaf, size): the leaves of each point (key, vector, label).

    A node where so many projections tie that its halves would not shrink is a leaf, whatever
    its size; ``near_duplicates`` compares large leaves in blocks.
    """
    fullest = points.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    shrink = math.log(1 / (0.5 + overlap))
    levels = max(1, math.ceil(math.log(max(1.0, fullest / leaf)) / shrink) + 3)
    kind = points.schema["label"].dataType.simpleString()
    active = points.select("key", "vector", "label").mapInArrow(
        _projections(trees, levels, seed), f"key long, label {kind}, dims int, tree int, along array<double>"
    )
    active = scratch.keep(active.withColumn("node", F.lit(1).cast("long")))
    marks = [0.5 - overlap - SLACK, 0.5 - overlap, 0.5 + overlap, 0.5 + overlap + SLACK]
    done: list[DataFrame] = []
    for level in range(levels + 1):
        at = F.get("along", F.lit(level))
        nodes = scratch.keep(
            active.groupBy(*NODE).agg(
                F.count(F.lit(1)).alias("size"),
                F.percentile_approx(at, marks, 1000).alias("at"),
            ).select(
                *NODE, "size", F.slice("at", 2, 2).alias("cut"),
                ((F.col("at")[0] < F.col("at")[1]) & (F.col("at")[2] < F.col("at")[3])).alias("parts"),
            )
        )
        counted = active.join(nodes, list(NODE))
        small = (F.col("size") <= leaf) | ~F.col("parts")
        if level == levels:
            small = F.lit(True)
        done.append(counted.where(small).select("key", *NODE, "size"))
        if not nodes.where(~small).take(1):
            break
        sides = F.array_compact(
            F.array(
                F.when(at <= F.col("cut")[1], F.col("node") * 2),
                F.when(at >= F.col("cut")[0], F.col("node") * 2 + 1),
            )
        )
        active = scratch.keep(
            counted.where(~small).select("key", "label", "dims", "tree", "along", F.explode(sides).alias("node"))
        )
    leaves = done[0]
    for part in done[1:]:
        leaves = leaves.unionByName(part)
    return scratch.keep(leaves.select("key", "label", "dims", F.xxhash64("tree", "node").alias("leaf"), "size"))


def _codes(bits: int, seed: int):
    """Rows (key, vector, ...) with the sides of ``bits`` random planes their vectors lie on."""

    def run(batches):
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for dims in np.unique(sizes):
                part = batch.filter(pa.array(sizes == dims))
                side = unit_vectors(part.column(1), int(dims)) @ _directions(int(dims), 1, bits, seed) > 0
                code = side @ (np.int64(1) << np.arange(bits))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.full(len(code), dims, np.int32)), pa.array(code)],
                    [*part.schema.names, "dims", "code"],
                )

    return run


def _pivots(widest: float):
    """Cells that lie near one another to (key, cell, reach), for those drawn into another."""

    def run(table: pa.Table) -> pa.Table:
        order = np.lexsort((table.column("key").to_numpy(), -table.column("n").to_numpy()))
        table = table.take(pa.array(order))
        key, radius = table.column("key").to_numpy(), table.column("radius").to_numpy()
        unit = unit_vectors(table.column("vector").combine_chunks(), table.column("dims")[0].as_py())
        reach = np.arccos(np.clip(unit @ unit.T, -1.0, 1.0)) + DOUBT + radius[None, :]
        np.fill_diagonal(reach, np.inf)
        fits = reach <= widest
        free = np.ones(len(key), bool)
        cell = np.arange(len(key))
        for i in np.flatnonzero(fits.any(axis=1)):
            mine = np.flatnonzero(fits[i] & free)
            if free[i] and len(mine):
                cell[mine] = i
                free[mine] = free[i] = False
        moved = np.flatnonzero(cell != np.arange(len(key)))
        return pa.Table.from_arrays(
            [pa.array(key[moved]), pa.array(key[cell[moved]]), pa.array(reach[cell[moved], moved])],
            names=["key", "cell", "reach"],
        )

    return run


def contract(points: DataFrame, widest: float, leaf: int, seed: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Cells (key, label, vector, n, radius, points) of points (key, label, vector, n), and (key, cell).

    ``radius`` bounds the angle of every member to the cell's vector and is at most ``widest``.
    A round deals cells by the sides of random planes, and within these by a hash, into groups
    of about ``leaf``; so a cluster shrinks by up to ``leaf`` times a round, however large it is.
    Rounds go on while they draw in one cell of a thousand.
    """
    state = points.select("key", "label", "vector", "n").withColumn("radius", F.lit(0.0))
    cells = state.withColumn("points", F.lit(1).cast("long"))
    of = points.select("key", F.col("key").alias("cell"))
    kind = points.schema["label"].dataType.simpleString()
    shape = f"key long, vector array<double>, label {kind}, n long, radius double, dims int, code long"
    spot = ["label", "dims", "code"]
    turn = 0
    while True:
        total, fullest = cells.groupBy("label").count().agg(F.sum("count"), F.max("count")).first()
        if not total:
            return cells, of
        bits = max(1, min(40, math.ceil(math.log2(max(2.0, fullest / leaf)))))
        coded = scratch.keep(
            cells.select("key", "vector", "label", "n", "radius").mapInArrow(_codes(bits, seed + 1 + turn), shape)
        )
        sizes = coded.groupBy(*spot).agg(F.ceil(F.count(F.lit(1)) / leaf).alias("groups"))
        dealt = coded.join(sizes, spot).withColumn(
            "group", F.pmod(F.xxhash64("key", F.lit(turn)), F.col("groups"))
        )
        # dealt anew, as the join leaves all of a code in one task
        groups = dealt.repartition(*spot, "group").groupBy(*spot, "group")
        moved = scratch.keep(groups.applyInArrow(_pivots(widest), "key long, cell long, reach double"))
        scratch.drop(coded)
        drawn = moved.count()
        if not drawn:
            return cells, of
        into = moved.select(F.col("key").alias("cell"), F.col("cell").alias("into"))
        of = scratch.keep(of.join(into, "cell", "left").select("key", F.coalesce("into", "cell").alias("cell")))
        merged = (
            cells.join(moved, "key", "left").groupBy(F.coalesce("cell", "key").alias("key"))
            .agg(F.sum("n").alias("n"), F.max(F.coalesce("reach", "radius")).alias("radius"), F.sum("points").alias("points"))
        )
        cells = scratch.keep(cells.select("key", "label", "vector").join(merged, "key"))
        if drawn * 1000 < total:
            return cells, of
        turn += 1


def _across(least: float):
    """Members of two cells (sides 0 and 1) to (key, links, a, b), for those with a link across."""

    def run(table: pa.Table) -> pa.Table:
        key, count = table.column("key").to_numpy(), table.column("n").to_numpy()
        side = table.column("side").to_numpy()
        lists = table.column("vector").combine_chunks()
        unit = unit_vectors(lists, len(lists[0]))
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        near = unit[left] @ unit[right].T >= least
        links = np.zeros(len(key), np.int64)
        links[left], links[right] = near @ count[right], count[left] @ near
        some = np.flatnonzero(links)
        ends = [pa.array(np.full(len(some), table.column(c)[0].as_py(), np.int64)) for c in ("a", "b")]
        return pa.Table.from_arrays([pa.array(key[some]), pa.array(links[some]), *ends], names=["key", "links", "a", "b"])

    return run


def _members_compared(pairs: DataFrame, members: DataFrame, least: float, leaf: int) -> DataFrame:
    """(key, links, a, b): links between members (cell, points, key, vector, n) of cells a and b.

    The members of a cell are cut into blocks; a task compares a block of one cell with one of the other.
    """
    blocks = F.ceil(F.col("points") / leaf).cast("int")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cell")).distinct()
    held = members.join(wanted, "cell", "left_semi").withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
    many = held.groupBy("cell").agg(F.first(blocks).alias("blocks"))
    work = pairs
    for end, at in (("a", "i"), ("b", "j")):
        ways = many.select(F.col("cell").alias(end), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias(at))
        work = work.join(ways, end)
    sides = [
        work.join(held.select(F.col("cell").alias(end), F.col("block").alias(at), "key", "vector", "n"), [end, at])
        .select("a", "b", "i", "j", "key", "vector", "n", F.lit(side).alias("side"))
        for side, (end, at) in enumerate((("a", "i"), ("b", "j")))
    ]
    return sides[0].unionByName(sides[1]).groupBy("a", "b", "i", "j").applyInArrow(
        _across(least), "key long, links long, a long, b long"
    )


def _compare(least: float):
    """Rows of one leaf, or of two blocks of one too large, to (key, links, root, other).

    ``other`` is a cell of which only the members can tell whether they are linked with those of
    ``key``; such rows bring no links.
    """
    angle = math.acos(least)

    def run(table: pa.Table) -> pa.Table:
        key = table.column("key").to_numpy()
        order = np.argsort(key, kind="stable")
        table, key = table.take(pa.array(order)), key[order]
        count = table.column("n").to_numpy()
        block = table.column("block").to_numpy()
        crossing = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        here = table.column("leaf")[0].as_py()
        lists = table.column("leaves").combine_chunks()
        owner = np.repeat(np.arange(len(key)), lists.value_lengths().to_numpy())
        held = lists.flatten().to_numpy()
        earlier = held < here
        codes, code = np.unique(held[earlier], return_inverse=True)
        holds = np.sort(owner[earlier] * len(codes) + code)
        first = np.searchsorted(owner[earlier], np.arange(len(key) + 1))
        vectors = unit_vectors(table.column("vector").combine_chunks(), table.column("dims")[0].as_py())
        radius = table.column("radius").to_numpy()
        widest = min(math.pi, angle + 2 * radius.max() + DOUBT) if radius.any() else 0.0
        floor = math.cos(widest) - 1e-12 if widest else least
        links = np.zeros(len(key), np.int64)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        doubt: list[np.ndarray] = []
        step = max(1, BLOCK // max(1, len(key)))
        for at in range(0, len(key), step):
            cosine = vectors[at : at + step] @ vectors[at:].T
            i, j = np.nonzero(cosine >= floor)
            cosine, i, j = cosine[i, j], i + at, j + at
            wide = radius[i] + radius[j]
            apart = np.arccos(np.clip(cosine, -1.0, 1.0))
            sure = np.where(wide > 0, apart + wide <= angle - DOUBT, cosine >= least)
            pairs = (i < j) & (sure | ((wide > 0) & (apart - wide <= angle + DOUBT)))
            if crossing:
                pairs &= block[i] != block[j]
            i, j, sure = i[pairs], j[pairs], sure[pairs]
            if not len(i):
                continue
            # of the left member's earlier leaves, does the right one hold any
            many = (first[1:] - first[:-1])[i]
            pair = np.repeat(np.arange(len(i)), many)
            nth = np.repeat(first[:-1][i] - (np.cumsum(many) - many), many) + np.arange(len(pair))
            wanted = j[pair] * len(codes) + code[nth]
            place = np.minimum(np.searchsorted(holds, wanted), max(0, len(holds) - 1))
            shared = np.zeros(len(i), bool)
            if len(holds):
                shared[pair[holds[place] == wanted]] = True
            doubt.append(np.stack([i, j])[:, ~shared & ~sure])
            fresh = ~shared & sure
            np.add.at(links, i[fresh], count[j[fresh]])
            np.add.at(links, j[fresh], count[i[fresh]])
            a, b = np.concatenate([a, i[sure]]), np.concatenate([b, j[sure]])
            if len(a) > 4 * BLOCK:
                a, b = local_stars(a, b)
        root = np.arange(len(key))
        node, top = local_stars(a, b)
        root[node] = top
        some = np.flatnonzero((links > 0) | (root != np.arange(len(key))))
        first, second = np.concatenate(doubt, axis=1) if doubt else np.zeros((2, 0), np.int64)
        other = np.concatenate([np.zeros(len(some), np.int64), key[second]])
        sure = np.arange(len(other)) < len(some)
        return pa.Table.from_arrays(
            [
                pa.array(np.concatenate([key[some], key[first]])),
                pa.array(np.concatenate([links[some], np.zeros(len(first), np.int64)])),
                pa.array(np.concatenate([key[root[some]], key[first]])),
                pa.array(other, mask=sure),
            ],
            names=["key", "links", "root", "other"],
        )

    return run


def _comparable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def near_duplicates(
    rows: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    least: float = 0.93,
    trees: int = 10,
    leaf: int = 512,
    overlap: float = 0.1,
    seed: int = 17,
) -> DataFrame:
    """vec_id, n_links, component_id, kept; a row per row of ``rows``.

    Vectors of one label (and one length) are linked if their cosine is ``least`` or more.
    Null labels, and vectors that are null, empty, zero or hold nulls or non-finite numbers,
    have no links.  ``component_id`` is the least id reachable; a null id names a component only if
    it has no other, and is not ``kept`` then.  The forest may miss links, and counts none that
    are not.  Repeated rows are linked with one another.  ``rows`` may have other columns.
    """
    scratch = Scratch(rows.sparkSession, "vectors")
    given = rows.select(
        rows[id_column].alias("vec_id"), rows[label_column].alias("label"), rows[vector_column].alias("vector")
    )
    sound = F.col("label").isNotNull() & _comparable(F.col("vector"))
    # vectors of one direction are one point; -0.0 is 0.0
    doubles = F.transform("vector", lambda x: x.cast("double"))
    top = F.greatest(F.array_max(doubles), -F.array_min(doubles))
    # the one-element array binds the greatest component, which is then computed once a vector
    vector = F.transform(F.array(top), lambda most: F.transform(doubles, lambda x: x / most + F.lit(0.0)))[0]
    sane = scratch.keep(given.where(sound).withColumn("vector", vector))
    points = sane.groupBy("label", "vector").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    points = scratch.keep(points.withColumn("key", F.monotonically_increasing_id()))
    cells, of = contract(points, math.acos(least) / 4, leaf, seed, scratch)
    leaves = forest(cells, trees, leaf, overlap, seed, scratch)
    lists = leaves.groupBy("key").agg(F.collect_set("leaf").alias("leaves"))
    held = cells.select("key", "vector", "n", "radius").join(lists, "key")
    # a leaf that could not be split to size is compared in pairs of blocks
    blocks = F.ceil(F.col("size") / leaf).cast("int")
    block = F.pmod(F.xxhash64("key"), blocks).cast("int")
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = (
        leaves.withColumn("blocks", blocks).withColumn("block", block)
        .withColumn("other", F.explode(others))
        .withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
        .join(held, "key")
    )
    groups = dealt.groupBy("label", "dims", "leaf", "low", "high")
    found = scratch.keep(groups.applyInArrow(_compare(least), "key long, links long, root long, other long"))
    pairs = found.where("other is not null").select(F.col("key").alias("a"), F.col("other").alias("b"))
    sizes = cells.select(F.col("key").alias("cell"), F.col("n").alias("held"), "points")
    members = points.select("key", "vector", "n").join(of, "key").join(sizes, "cell")
    across = scratch.keep(_members_compared(pairs, members, least, leaf))
    edges = found.where("key != root").select("key", "root").union(across.select("a", "b").distinct())
    stars = components(edges, scratch).select(F.col("node").alias("cell"), "root")
    whole = found.groupBy(F.col("key").alias("cell")).agg(F.sum("links").alias("whole"))
    single = across.groupBy("key").agg(F.sum("links").alias("single"))
    links = F.coalesce("whole", F.lit(0)) + F.coalesce("single", F.lit(0)) + F.col("held") - 1
    rooted = (
        points.select("key", "label", "vector", "least").join(of, "key").join(sizes, "cell")
        .join(whole, "cell", "left").join(single, "key", "left").join(stars, "cell", "left")
        .select("label", "vector", "least", links.alias("n_links"), F.coalesce("root", "cell").alias("root"))
    )
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(names, "root").select("label", "vector", "n_links", "component_id")
    linked = sane.join(named, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    alone = given.where(~F.coalesce(sound, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return linked.unionByName(alone).withColumn("kept", kept)
