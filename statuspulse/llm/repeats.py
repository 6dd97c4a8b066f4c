"""Windows of text that also stand in an earlier document: the exchange two operators share.

A window is a fixed number of consecutive symbols (bytes or words) of one document.  Each is
assigned to an anchor inside it (``kernel.anchors``); equal windows have equal anchors.  The
windows of one anchor occurrence are a *segment*.  Documents are dealt into blocks by id; the
steps, each a grouped Arrow function, are

1. ``_summaries``: a block lists its distinct segments as (anchor hash, segment hash),
2. ``_verdicts``: per range of anchor hashes, which segments share their anchor with another
   document's; identical segments collapse to the one in the first block,
3. ``_contents``: blocks send the symbols of the distinct segments that share an anchor,
4. ``_matches``: per range of anchor hashes, a matcher finds each segment's windows that stand
   in a segment of a smaller id (the part that differs between the operators),
5. ``_finish``: blocks mark what is covered and derive the results.

Text is shuffled once, by block, and that exchange serves steps 1, 3 and 5.  No group grows
with a popular passage: a block lists a segment once however many documents share it, and an
anchor with more than ``heavy`` distinct segments in some block (the rim of a popular passage,
with other words after it in each document) is listed by single windows instead, which are
dealt by their own hashes.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from statuspulse.llm import kernel
from statuspulse.llm.common import column, partitions

#: Bytes of text of a block, about; one block is in memory at a time.
BLOCK_BYTES = 8 << 20
#: Symbols a matcher is given at a time, whole anchors though.
SHARD = 1 << 20
_COLD, _COVERED, _FIRST, _SENT, _WINDOWS = range(5)

PACK = "bucket int, block int, kind int, keys binary, values binary, docs binary, sizes binary, symbols binary"
_NAMES = ["bucket", "block", "kind", "keys", "values", "docs", "sizes", "symbols"]

#: symbols and per-row bounds of (bytes, offsets); what else ``finish`` needs comes third
Reader = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, object]]
#: for segments (symbols, bounds, ids): bit j of a mask is set if window j stands in a smaller id
Matcher = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Unit:
    window: int
    gram: int
    reader: Reader
    #: the symbols of a row range as sent to the matcher (bytes are sent, their hashes are not)
    content: Callable[[np.ndarray, np.ndarray, object], np.ndarray]
    width: type
    matcher: Matcher
    #: (row ids, bytes, offsets, covered symbols, bounds, what the reader returned) to arrays
    finish: Callable
    schema: str
    #: distinct segments of one anchor that a block lists before it switches to windows
    heavy: int = 64


def block_of(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``doc_id``, in two steps of a square root."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    rows = [bounds[k : k + step] for k in range(0, len(bounds), step)]

    def below(values, x):
        return F.size(F.filter(values, lambda b: b <= x))

    heads = F.array(*(F.lit(r[0]) for r in rows))
    parts = F.array(*(F.array(*(F.lit(b) for b in r)) for r in rows))

    def found(x):
        row = below(heads, x)
        return F.when(row == 0, 0).otherwise((row - 1) * step + below(F.get(parts, row - 1), x))

    return F.transform(F.array(doc_id), found)[0].cast("int")


def blocked(
    docs: DataFrame, id_column: str, text_column: str, block_bytes: int, carried: list[str]
) -> tuple[DataFrame, int]:
    """(doc_id, text, rest, block) dealt by block, and the number of blocks.

    Blocks are ranges of ids that hold about as many bytes each: ids count once for each quarter
    of the mean size their row has, or begins.  Rows without an id may be in any block.
    """
    rows = docs.select(
        docs[id_column].cast("long").alias("doc_id"),
        docs[text_column].cast("string").alias("text"),
        F.struct(F.lit(0).alias("none"), *(column(c).alias(f"c{k}") for k, c in enumerate(carried))).alias("rest"),
    )
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    with_id = F.when(F.col("doc_id").isNotNull(), size)
    total, ours, least = rows.agg(F.sum(size), F.sum(with_id), F.count("doc_id")).first()
    n = max(partitions(docs.sparkSession), math.ceil((total or 0) / block_bytes))
    bounds: list[int] = []
    if least:
        shares = [k / n for k in range(1, n)]
        quarter = max(1.0, ours / least / 4)
        times = F.greatest(F.lit(1), F.ceil(size / F.lit(quarter))).cast("int")
        weighed = rows.where("doc_id IS NOT NULL").select(F.explode(F.array_repeat("doc_id", times)).alias("doc_id"))
        found = weighed.agg(F.percentile_approx("doc_id", shares, max(10_000, 20 * n))).first()[0] if shares else []
        bounds = sorted(set(found))
    anywhere = F.pmod(F.xxhash64("text"), F.lit(n)).cast("int")
    block = F.when(F.col("doc_id").isNull(), anywhere).otherwise(block_of(F.col("doc_id"), bounds))
    return rows.withColumn("block", block).repartition(n, "block"), n


@dataclass
class _Block:
    """A block's anchor occurrences, grouped into distinct segments ("entries")."""

    ids: np.ndarray  # by row
    valid: np.ndarray  # rows with an id
    row: np.ndarray  # by occurrence, as are the next four
    begin: np.ndarray
    end: np.ndarray
    chunk: np.ndarray
    entry: np.ndarray
    anchor: np.ndarray  # by entry, as are the rest
    segment: np.ndarray
    first: np.ndarray  # the occurrence with the least id
    least: np.ndarray
    several: np.ndarray  # more than one id


def _spread(hashes: np.ndarray) -> np.ndarray:
    """48 even bits; the chosen hashes are least ones, hence uneven."""
    return kernel.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(16)


def _order(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """Order by the 48-bit ``major``, then ``minor``: one sort on as much as fits in 64 bits."""
    key = major << np.uint64(16) | minor >> np.uint64(48)
    order = np.argsort(key, kind="stable")
    key, sub = key[order], minor[order]
    odd = np.flatnonzero((key[1:] == key[:-1]) & (sub[1:] != sub[:-1]))
    if len(odd):
        lone = np.isin(key, key[odd])
        part = order[lone]
        order[lone] = part[np.lexsort((minor[part], major[part]))]
    return order


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a new combination of sorted keys begins."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    fresh = np.ones(len(keys[0]), bool)
    fresh[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(fresh)


def _scan(table: pa.Table, unit: Unit) -> _Block:
    ids = table.column("doc_id").combine_chunks()
    valid = ids.is_valid().to_numpy(zero_copy_only=False)
    ids = ids.fill_null(0).to_numpy()
    found = []
    for k, (row, data, offsets) in enumerate(kernel.chunks(table.column("text"))):
        symbols, bounds, _ = unit.reader(data, offsets)
        rows, _, begin, end, hashes, prefix = kernel.anchors(symbols, bounds, unit.window, unit.gram)
        segment = kernel.range_hash(prefix, begin, end + unit.window - 1)
        segment = kernel.mix(segment + (end - begin).astype(np.uint64))
        keep = valid[rows + row]
        parts = (rows + row, begin, end, np.full(len(rows), k), _spread(hashes), segment)
        found.append([x[keep] for x in parts])
    if found:
        row, begin, end, chunk, anchor, segment = (np.concatenate(x) for x in zip(*found, strict=True))
    else:
        row = begin = end = chunk = np.zeros(0, np.int64)
        anchor = segment = np.zeros(0, np.uint64)
    order = _order(anchor, segment)
    a, s, d = anchor[order], segment[order], ids[row[order]]
    cuts = _starts(a, s)
    number = np.zeros(len(order), np.int64)
    number[cuts] = 1
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(number) - 1
    least = np.minimum.reduceat(d, cuts) if len(cuts) else d
    most = np.maximum.reduceat(d, cuts) if len(cuts) else d
    is_least = np.flatnonzero(d == np.repeat(least, np.diff(np.append(cuts, len(d)))))
    first = np.empty(len(cuts), np.int64)
    first[entry[order[is_least]][::-1]] = order[is_least][::-1]
    return _Block(ids, valid, row, begin, end, chunk, entry, a[cuts], s[cuts], first, least, most > least)


def _listed(block: _Block, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a block lists: anchors, segments, whether several documents share the anchor,
    whether it is a heavy anchor; and the listed place of each entry."""
    cuts = _starts(block.anchor)
    many = np.diff(np.append(cuts, len(block.anchor)))
    heavy = np.repeat(many > most, many)
    group = np.repeat(np.arange(len(cuts)), many)
    high = np.maximum.reduceat(block.least, cuts) if len(cuts) else block.least
    low = np.minimum.reduceat(block.least, cuts) if len(cuts) else block.least
    several = (np.logical_or.reduceat(block.several, cuts) if len(cuts) else block.several) | (high > low)
    keep = ~heavy
    keep[cuts] = True
    place = np.cumsum(keep) - 1
    kept = np.flatnonzero(keep)
    segment = np.where(heavy, np.uint64(0), block.segment)
    return block.anchor[kept], segment[kept], several[group[kept]], heavy[kept], place


def _buckets(keys: np.ndarray, n: int) -> np.ndarray:
    """Even ranges of 48-bit keys."""
    return (keys >> np.uint64(16)) * np.uint64(n) >> np.uint64(32)


def _planes(keys: np.ndarray) -> bytes:
    """48-bit keys byte by byte, most significant first: sorted ones compress well."""
    return keys.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(6, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 2:] = planes.T
    return out.view(">u8").ravel().astype(np.uint64)


def _packs(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    kinds = [pa.int32()] * 3 + [pa.binary()] * 5
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=_NAMES)


def _cells(keys: np.ndarray, n: int) -> list[tuple[int, slice]]:
    """(bucket, range) of sorted keys."""
    bucket = _buckets(keys, n)
    cuts = np.append(_starts(bucket), len(keys))
    return [(int(bucket[a]), slice(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _summaries(unit: Unit, n: int):
    @kernel.giving_back
    def run(table: pa.Table) -> pa.Table:
        number = table.column("block")[0].as_py()
        anchor, segment, several, heavy, _ = _listed(_scan(table, unit), unit.heavy)
        mark = several.astype(np.uint8) | heavy.astype(np.uint8) << 1
        return _packs(
            [
                (b, number, 0, _planes(anchor[s]), segment[s].tobytes(), mark[s].tobytes(), b"", b"")
                for b, s in _cells(anchor, n)
            ]
        )

    return run


def _verdicts(table: pa.Table) -> pa.Table:
    block = table.column("block").to_numpy()
    anchors = [_unplanes(x.as_py()) for x in table.column("keys")]
    sizes = [len(x) for x in anchors]
    anchor = np.concatenate(anchors)
    segment = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table.column("values")])
    mark = np.concatenate([np.frombuffer(x.as_py(), np.uint8) for x in table.column("docs")])
    owner = np.repeat(block, sizes)
    order = _order(anchor, segment)
    a, s, o, m = anchor[order], segment[order], owner[order], mark[order]
    cuts = _starts(a)
    many = np.diff(np.append(cuts, len(a)))
    marked = np.bitwise_or.reduceat(m, cuts)
    hot = (np.minimum.reduceat(o, cuts) < np.maximum.reduceat(o, cuts)) | (marked > 0)
    heavy = marked >= 2
    pairs = _starts(a, s)
    lone = np.diff(np.append(np.searchsorted(pairs, cuts), len(pairs))) == 1
    per_pair = np.diff(np.append(pairs, len(a)))
    ahead = np.repeat(np.minimum.reduceat(o, pairs), per_pair)
    verdict = np.where(ahead < o, _COVERED, np.where(np.repeat(lone, many), _FIRST, _SENT))
    verdict = np.where(np.repeat(heavy, many), _WINDOWS, verdict)
    verdict = np.where(np.repeat(hot, many), verdict, _COLD).astype(np.uint8)
    out = np.empty(len(order), np.uint8)
    out[order] = verdict
    ends = np.cumsum(sizes)
    return _packs(
        [
            (b, k, 0, b"", out[e - z : e].tobytes(), b"", b"", b"")
            for b, k, z, e in zip(table.column("bucket").to_pylist(), block.tolist(), sizes, ends, strict=True)
        ]
    )


def _verdict_of(block: _Block, replies: pa.Table, unit: Unit) -> np.ndarray:
    """By entry."""
    place = _listed(block, unit.heavy)[4]
    rows = replies.filter(pa.compute.equal(replies.column("kind"), 0)).sort_by("bucket")
    listed = np.frombuffer(b"".join(x.as_py() for x in rows.column("values")), np.uint8)
    return listed[place] if len(place) else listed


@dataclass
class _Windows:
    """The single windows of a block's heavy anchors; keys are distinct and sorted."""

    start: np.ndarray  # by occurrence, as is the rest up to key
    row: np.ndarray
    chunk: np.ndarray
    of: np.ndarray
    key: np.ndarray  # by distinct window
    first: np.ndarray
    least: np.ndarray


def _windows(block: _Block, table: pa.Table, verdict: np.ndarray, unit: Unit) -> _Windows:
    runs = np.flatnonzero(verdict[block.entry] == _WINDOWS)
    many = (block.end - block.begin)[runs]
    run = np.repeat(runs, many)
    start = block.begin[run] + np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many)
    key = np.zeros(len(run), np.uint64)
    if len(run):
        chunk = block.chunk[run]
        for k, (_, data, offsets) in enumerate(kernel.chunks(table.column("text"))):
            own = np.flatnonzero(chunk == k)
            if len(own):
                prefix = kernel.prefix_hash(unit.reader(data, offsets)[0])
                key[own] = kernel.range_hash(prefix, start[own], start[own] + unit.window)
    ids = block.ids[block.row[run]]
    order = np.lexsort((ids, key))
    cuts = _starts(key[order])
    number = np.zeros(len(order), np.int64)
    number[cuts] = 1
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(number) - 1
    first = order[cuts]
    return _Windows(start, block.row[run], block.chunk[run], of, key[first], first, ids[first])


def _contents(unit: Unit, n: int):
    @kernel.giving_back
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return _packs([])
        number = table.column("block")[0].as_py()
        block = _scan(table, unit)
        verdict = _verdict_of(block, replies, unit)
        entries = np.flatnonzero(verdict == _SENT)
        at = block.first[entries]
        single = _windows(block, table, verdict, unit)
        groups = [
            (1, block.anchor[entries], entries, block.least[entries], block.chunk[at], block.begin[at],
             block.end[at] + unit.window - 1),
            (2, single.key >> np.uint64(16), np.arange(len(single.key)), single.least,
             single.chunk[single.first], single.start[single.first], single.start[single.first] + unit.window),
        ]
        parts: list[dict[int, np.ndarray]] = [{}, {}]
        for k, (_, data, offsets) in enumerate(kernel.chunks(table.column("text"))):
            symbols, _, extra = unit.reader(data, offsets)
            raw = unit.content(symbols, data, extra)
            for part, (_, _, _, _, chunk, begin, end) in zip(parts, groups, strict=True):
                own = np.flatnonzero(chunk == k)
                if len(own):
                    size = (end - begin)[own]
                    flat = np.repeat(begin[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    part[k] = raw[flat]
        rows = []
        for part, (kind, keys, index, ids, chunk, begin, end) in zip(parts, groups, strict=True):
            if not len(keys):
                continue
            size = end - begin
            # the gathered symbols stand by chunk, then by key
            by_chunk = np.argsort(chunk, kind="stable")
            place = np.empty(len(keys), np.int64)
            place[by_chunk] = np.cumsum(size[by_chunk]) - size[by_chunk]
            gathered = np.concatenate([part[k] for k in sorted(part)])
            for b, s in _cells(keys, n):
                flat = np.repeat(place[s] - (np.cumsum(size[s]) - size[s]), size[s]) + np.arange(size[s].sum())
                rows.append(
                    (b, number, kind, _planes(keys[s]), index[s].astype(np.uint32).tobytes(),
                     ids[s].astype(np.int64).tobytes(), size[s].astype(np.uint16).tobytes(), gathered[flat].tobytes())
                )
        return _packs(rows)

    return run


def _shards(keys: np.ndarray, sizes: np.ndarray) -> list[slice]:
    """Ranges of about ``SHARD`` symbols that do not divide a key."""
    cuts = np.append(_starts(keys), len(keys))
    ends = np.concatenate([[0], np.cumsum(sizes)])[cuts]
    out, at = [], 0
    while at < len(cuts) - 1:
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + SHARD, side="right")) - 1)
        out.append(slice(cuts[at], cuts[end]))
        at = end
    return out


def _matches(unit: Unit):
    @kernel.giving_back
    def run(table: pa.Table) -> pa.Table:
        def joined(name, kind):
            return np.frombuffer(b"".join(x.as_py() for x in table.column(name)), kind)

        keys = np.concatenate([_unplanes(x.as_py()) for x in table.column("keys")])
        counts = [len(x.as_py()) // 4 for x in table.column("values")]
        sizes = joined("sizes", np.uint16).astype(np.int64)
        symbols, ids = joined("symbols", unit.width), joined("docs", np.int64)
        place = np.cumsum(sizes) - sizes
        masks = np.zeros(len(keys), np.uint64)
        order = np.argsort(keys, kind="stable")
        for part in _shards(keys[order], sizes[order]):
            own = order[part]
            bounds = np.concatenate([[0], np.cumsum(sizes[own])])
            flat = np.repeat(place[own] - bounds[:-1], sizes[own]) + np.arange(bounds[-1])
            masks[own] = unit.matcher(symbols[flat], bounds, ids[own])
        ends = np.cumsum(counts)
        return _packs(
            [
                (b, k, kind, b"", index, b"", b"", masks[e - c : e].astype(np.uint64).tobytes())
                for b, k, kind, index, c, e in zip(
                    *(table.column(x).to_pylist() for x in ("bucket", "block", "kind", "values")), counts, ends, strict=True
                )
            ]
        )

    return run


def _covered(block: _Block, single: _Windows, verdict: np.ndarray, replies: pa.Table, unit: Unit):
    """(chunk, first symbol, end) of covered stretches."""
    masks = [np.zeros(len(verdict), np.uint64), np.zeros(len(single.key), np.uint64)]
    for kind, mask in zip((1, 2), masks, strict=True):
        rows = replies.filter(pa.compute.equal(replies.column("kind"), kind))
        for index, bits in zip(rows.column("values"), rows.column("symbols"), strict=True):
            mask[np.frombuffer(index.as_py(), np.uint32)] = np.frombuffer(bits.as_py(), np.uint64)
    said = verdict[block.entry]
    later = block.ids[block.row] > block.least[block.entry]
    whole = (said == _COVERED) | (later & ((said == _FIRST) | (said == _SENT)))
    out = [(block.chunk[whole], block.begin[whole], block.end[whole] + unit.window - 1)]
    some = np.flatnonzero(~whole & (said == _SENT) & (masks[0][block.entry] > 0))
    bits = masks[0][block.entry[some]]
    for j in range(unit.window - unit.gram + 1):
        hit = some[(bits >> np.uint64(j) & np.uint64(1)).astype(bool)]
        out.append((block.chunk[hit], block.begin[hit] + j, block.begin[hit] + j + unit.window))
    hit = (block.ids[single.row] > single.least[single.of]) | (masks[1][single.of] > 0)
    out.append((single.chunk[hit], single.start[hit], single.start[hit] + unit.window))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _finish(unit: Unit):
    @kernel.giving_back
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        block = _scan(table, unit)
        if replies.num_rows:
            verdict = _verdict_of(block, replies, unit)
            chunk, begin, end = _covered(block, _windows(block, table, verdict, unit), verdict, replies, unit)
        else:
            chunk = begin = end = np.zeros(0, np.int64)
        order = np.argsort(chunk, kind="stable")
        cuts = np.searchsorted(chunk[order], np.arange(int(chunk.max(initial=0)) + 2))
        out = []
        ids, rest = (table.column(c).combine_chunks() for c in ("doc_id", "rest"))
        for k, (row, data, offsets) in enumerate(kernel.chunks(table.column("text"))):
            symbols, bounds, extra = unit.reader(data, offsets)
            own = order[cuts[k] : cuts[k + 1]] if k + 1 < len(cuts) else order[:0]
            level = np.bincount(begin[own], minlength=len(symbols) + 1)
            level -= np.bincount(end[own], minlength=len(symbols) + 1)
            gone = np.cumsum(level[:-1]) > 0
            rows = len(offsets) - 1
            out.append(
                pa.Table.from_pydict(
                    {"doc_id": ids.slice(row, rows), "rest": rest.slice(row, rows)} | unit.finish(data, offsets, gone, bounds, extra)
                )
            )
        return pa.concat_tables(out)

    return run


def mark(
    docs: DataFrame,
    id_column: str,
    text_column: str,
    unit: Unit,
    block_bytes: int = BLOCK_BYTES,
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """A row per row of ``docs``: doc_id, rest and what ``unit.finish`` derives from the covered symbols.

    ``rest`` is a struct of the ``carried`` columns, c0, c1 and so on.  A row with a null id
    neither covers nor is covered.
    """
    dealt, n = blocked(docs, id_column, text_column, block_bytes, list(carried))
    schema = StructType().add("doc_id", "long").add("rest", dealt.schema["rest"].dataType)
    for field in StructType.fromDDL(unit.schema):
        schema.add(field)
    by_block = dealt.groupBy("block")
    summaries = by_block.applyInArrow(_summaries(unit, n), PACK)
    verdicts = summaries.groupBy("bucket").applyInArrow(_verdicts, PACK)
    contents = by_block.cogroup(verdicts.groupBy("block")).applyInArrow(_contents(unit, n), PACK)
    masks = contents.groupBy("bucket").applyInArrow(_matches(unit), PACK)
    replies = verdicts.unionByName(masks)
    done = by_block.cogroup(replies.groupBy("block"))
    return done.applyInArrow(_finish(unit), schema)
