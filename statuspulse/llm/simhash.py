"""SimHash near-duplicates by anchor-point covering.

A fingerprint has 64 bits.  Two blocks of 23 of them are each covered by the perfect Golay
code of radius 3: every 23-bit block lies within 3 bits of exactly one codeword.  A pair of
codewords is an anchor.  A fingerprint's home is the anchor within the covering radius of
both blocks; it is replicated to every anchor whose blocks are, in sum, at most ``max_bits``
farther than that.  If two fingerprints differ in at most ``max_bits`` bits, each is among the
visitors of the other's home, so comparing homes with visitors per anchor finds every link.
The 2**24 anchors keep groups small; equal fingerprints are one point, however many
documents share them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuspulse.llm import kernel
from statuspulse.llm.common import Scratch, column, free_name
from statuspulse.llm.graph import components, local_stars

#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY = 0b101011100011
LENGTH, RADIUS, CHECKS = 23, 3, 11
LOW_BITS = 12
#: Pairs compared at a time inside a task.
PAIRS = 2_000_000
#: Rows of an output batch.
BATCH = 200_000


def _syndromes(words: np.ndarray) -> np.ndarray:
    rest = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GOLAY << (bit - CHECKS)), rest)
    return rest


@lru_cache
def _cosets(extra: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By bits beyond the covering radius: patterns sorted by syndrome, and each syndrome's range."""
    out = []
    for more in range(extra + 1):
        weights = range(RADIUS + 1) if more == 0 else [RADIUS + more]
        places = [p for weight in weights for p in combinations(range(LENGTH), weight)]
        patterns = np.sort(np.array([sum(1 << bit for bit in p) for p in places], np.int64))
        syndrome = _syndromes(patterns)
        order = np.argsort(syndrome, kind="stable")
        counts = np.bincount(syndrome, minlength=1 << CHECKS)
        out.append((patterns[order], np.cumsum(counts) - counts, counts))
    return out


@lru_cache
def _syndrome_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of the low and of the high bits of a block; a syndrome is linear, so theirs are combined by xor."""
    low = np.arange(1 << LOW_BITS)
    high = np.arange(1 << (LENGTH - LOW_BITS)) << LOW_BITS
    return _syndromes(low), _syndromes(high)


def _expand(rows: np.ndarray, blocks: np.ndarray, coset) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword) for all patterns of each block's coset."""
    patterns, first, counts = coset
    low, high = _syndrome_tables()
    syndrome = low[blocks & (1 << LOW_BITS) - 1] ^ high[blocks >> LOW_BITS]
    many = counts[syndrome]
    owner = np.repeat(np.arange(len(rows)), many)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    return owner, blocks[owner] ^ patterns[first[syndrome][owner] + nth]


def anchors_of(prints: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(anchor, index of the fingerprint, whether it is its home), a few at a time."""
    mask = (1 << LENGTH) - 1
    low = (prints & np.uint64(mask)).astype(np.int64)
    high = (prints >> np.uint64(LENGTH) & np.uint64(mask)).astype(np.int64)
    cosets = _cosets(max_bits)
    rows = np.arange(len(prints))
    for a in range(max_bits + 1):
        owner, code = _expand(rows, low, cosets[a])
        for b in range(max_bits + 1 - a):
            again, other = _expand(owner, high[owner], cosets[b])
            yield code[again] << LENGTH | other, owner[again], a == b == 0


def fingerprint(text: Column, shingle: int) -> Column:
    """As a long: a bit is 1 if set in over half of the XXH64 of the word shingles.

    A-Z are lowered; shingles are ``shingle`` words joined by a space, repeats included; fewer
    words are one shingle; no word (or a null text) gives 0.
    """

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        prints = np.zeros(len(texts), np.uint64)
        for row, data, offsets in kernel.chunks(texts):
            starts, ends, bounds = kernel.words(data, offsets)
            joined, begin = kernel.joined_words(data, starts, ends)
            finish = begin + (ends - starts)
            counts = np.diff(bounds)
            many = np.maximum(counts - shingle + 1, np.minimum(counts, 1))
            owner = np.repeat(np.arange(len(counts)), many)
            first = bounds[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            last = np.minimum(first + shingle, bounds[1:][owner]) - 1
            hashes = kernel.xxh64(joined, begin[first], finish[last])
            cuts = np.concatenate([[0], np.cumsum(many)])
            prints[row : row + len(counts)] = kernel.majority_bits(hashes, cuts)
        kernel.give_back()
        return pa.array(prints.view(np.int64))

    return of(text.cast("string"))


def _near(prints: np.ndarray, home: np.ndarray, bounds: np.ndarray, max_bits: int):
    """Linked (left, right) fingerprints of whole anchor groups, given by their bounds."""
    sizes = np.diff(bounds)
    homes = np.add.reduceat(home.astype(np.int64), bounds[:-1]) if len(sizes) else sizes
    work = sizes * homes
    useful = np.flatnonzero((homes > 0) & (sizes > 1))
    found = []
    small = useful[work[useful] <= PAIRS]
    cut = 0
    total = np.cumsum(work[small])
    while cut < len(small):
        base = total[cut - 1] if cut else 0
        end = max(cut + 1, int(np.searchsorted(total, base + PAIRS, side="right")))
        groups = small[cut:end]
        cut = end
        # home rows of these groups, each against its whole group
        rows = np.repeat(bounds[:-1][groups], sizes[groups])
        rows += np.arange(len(rows)) - np.repeat(np.cumsum(sizes[groups]) - sizes[groups], sizes[groups])
        group = np.repeat(groups, sizes[groups])
        is_home = home[rows]
        left, of = rows[is_home], group[is_home]
        many = sizes[of]
        a = np.repeat(left, many)
        b = np.repeat(bounds[:-1][of], many) + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
        a, b = prints[a], prints[b]
        near = (np.bitwise_count(a ^ b) <= max_bits) & (a != b)
        found.append((a[near], b[near]))
    for g in useful[work[useful] > PAIRS]:
        found.append(_near_many(prints[bounds[g] : bounds[g + 1]], max_bits))
    left = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.uint64)
    right = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.uint64)
    return left, right


def _near_many(prints: np.ndarray, max_bits: int):
    """Links in one large group without comparing all pairs, a part of the keys at a time.

    Two points are at most 2r bits apart exactly if some point is within r bits of both, so
    those that share such a point are chained; an odd distance is checked on what is chained
    by comparing each block of a sorted order, which a group this large does not need for
    the even distances.
    """
    prints = np.unique(prints)
    if max_bits != 2:
        left, right = [], []
        step = max(1, PAIRS // len(prints))
        for at in range(0, len(prints), step):
            near = np.bitwise_count(prints[at : at + step, None] ^ prints[None, :]) <= max_bits
            i, j = np.nonzero(near)
            left.append(prints[at + i])
            right.append(prints[j])
            a, b = local_stars(np.concatenate(left), np.concatenate(right))
            left, right = [a], [b]
        return left[0], right[0]
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    parts = -(-len(prints) * len(flips) // (4 * PAIRS))
    left, right = [], []
    for part in range(parts):
        keys, owners = [], []
        for flip in flips:
            key = prints ^ flip
            own = kernel.mix(key) % np.uint64(parts) == part
            keys.append(key[own])
            owners.append(prints[own])
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order][1:] == key[order][:-1])
        left.append(owner[order][same])
        right.append(owner[order][same + 1])
        a, b = local_stars(np.concatenate(left), np.concatenate(right))
        left, right = [a], [b]
    return left[0], right[0]


def _edges(points: DataFrame, max_bits: int) -> DataFrame:
    """Star edges (a, b) between linked fingerprints, from the distinct ``fp`` of ``points``."""

    @kernel.giving_back
    def replicate(batches):
        for batch in batches:
            every = batch.column(0).to_numpy().view(np.uint64)
            step = 20_000
            for at in range(0, len(every), step):
                prints = every[at : at + step]
                for anchor, row, home in anchors_of(prints, max_bits):
                    for k in range(0, len(anchor), BATCH):
                        part = slice(k, k + BATCH)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(anchor[part]),
                                pa.array(prints[row[part]].view(np.int64)),
                                pa.array(np.full(len(anchor[part]), home)),
                            ],
                            ["anchor", "fp", "home"],
                        )

    @kernel.giving_back
    def compare(batches):
        kept = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)]

        def links(anchor, prints, home):
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1, [len(anchor)]])
            left, right = _near(prints, home, bounds, max_bits)
            a, b = local_stars(left.view(np.int64), right.view(np.int64))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            fresh = [
                batch.column(0).to_numpy(),
                batch.column(1).to_numpy().view(np.uint64),
                batch.column(2).to_numpy(zero_copy_only=False),
            ]
            kept = [np.concatenate(x) for x in zip(kept, fresh, strict=True)]
            whole = int(np.searchsorted(kept[0], kept[0][-1])) if len(kept[0]) else 0
            if whole:  # the last anchor may go on in the next batch
                yield links(*(x[:whole] for x in kept))
                kept = [x[whole:] for x in kept]
        if len(kept[0]):
            yield links(*kept)

    replicas = points.select("fp").mapInArrow(replicate, "anchor long, fp long, home boolean")
    dealt = replicas.repartition("anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 3,
    max_bits: int = 2,
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, kept; a row per row of ``docs``.

    component_id is the least id reachable over fingerprints ``max_bits`` or fewer bits apart;
    ``kept`` marks that document.  Null and empty texts have fingerprint zero and are linked
    like others; a null id never is a component's name unless the component has no other.
    Columns besides the two named are ignored.  An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows, named = _grouped(docs, id_column, text_column, shingle, max_bits, scratch)
    return rows.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def _grouped(docs, id_column, text_column, shingle, max_bits, scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, fp) by row; and per fp its component's root fp and least id."""
    prints = fingerprint(docs[text_column], shingle)
    rows = scratch.keep(docs.select(docs[id_column].alias("doc_id"), prints.alias("fp")))
    points = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    stars = components(_edges(points, max_bits), scratch)
    rooted = points.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    names = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows, scratch.keep(rooted.join(names, "root").select("fp", "root", "component_id"))


def representatives(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    shingle: int = 3,
    max_bits: int = 2,
) -> DataFrame:
    """One row of each group of near copies: one with the least id (any, where all are null).

    The columns are those of ``docs``.  Rows are found by fingerprint and id; only where a group
    has several rows of its least id is one of them chosen.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows, named = _grouped(docs, id_column, text_column, shingle, max_bits, scratch)
    chosen = rows.join(named, "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    many = Window.partitionBy("root")
    chosen = scratch.keep(
        chosen.groupBy("root", "fp").agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
        .withColumn("several", F.sum("n").over(many) > 1)
    )
    name = {k: free_name(docs, f"simhash_{k}") for k in ("fp", "fp2", "id", "root", "several")}
    given = docs.withColumn(name["fp"], fingerprint(docs[text_column], shingle))
    keys = chosen.select(
        F.col("fp").alias(name["fp2"]), F.col("doc_id").alias(name["id"]), F.col("root").alias(name["root"]),
        F.col("several").alias(name["several"]),
    )
    same = (given[name["fp"]] == keys[name["fp2"]]) & docs[id_column].eqNullSafe(keys[name["id"]])
    found = given.join(keys, same)
    single = found.where(~F.col(name["several"]))
    several = found.where(name["several"]).dropDuplicates([name["root"]])
    columns = [column(c) for c in docs.columns]
    return single.select(*columns).unionByName(several.select(*columns))
