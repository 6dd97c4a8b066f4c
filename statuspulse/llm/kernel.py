"""Vectorised text kernels for code that runs inside a task: words, rolling hashes, anchors.

Everything works on the UTF-8 bytes of an Arrow batch as numpy arrays, many documents at a
time and a few megabytes at a time, so memory does not depend on a batch's row count.
Hashes are polynomials modulo 2**64 over randomised symbols.  ``repeats`` takes stretches with
equal hashes as equal; the suffix sort verifies the symbols.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import lru_cache, wraps
from inspect import isgeneratorfunction, signature

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time.
CHUNK_BYTES = 1 << 20
#: An odd multiplier (so that its powers have inverses) for polynomial hashes.
BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1

# space, and the control characters from tab to carriage return
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache
def _byte_symbols() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int, base: int = BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    size = 1 << max(16, (n - 1).bit_length())
    return _powers(size, base & _MASK)[:n]


def inverse_powers(n: int) -> np.ndarray:
    return powers(n, pow(BASE, -1, 1 << 64))


def prefix_hash(symbols: np.ndarray) -> np.ndarray:
    """p[i] = sum over j < i of symbols[j] * BASE**j; its differences give any range's hash."""
    out = np.empty(len(symbols) + 1, np.uint64)
    out[0] = 0
    np.cumsum(symbols * powers(len(symbols)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of symbols[start:end], the same wherever that sequence stands."""
    return mix((prefix[end] - prefix[start]) * inverse_powers(len(prefix))[start])


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _byte_symbols()[data]


def give_back() -> None:
    """Hand memory that is free back to the system.

    A Python worker serves one task after another and else keeps what it needed at its worst,
    beside workers that by then need as much for another operator.
    """
    _powers.cache_clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library: what is free stays with the worker
        pass


def giving_back(run: Callable) -> Callable:
    """``run``, a task's generator or function of one or two tables, handing memory back when it is done."""

    @wraps(run)
    def each(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    @wraps(run)
    def one(table):
        try:
            return run(table)
        finally:
            give_back()

    @wraps(run)
    def two(table, other):
        try:
            return run(table, other)
        finally:
            give_back()

    if isgeneratorfunction(run):
        return each
    return one if len(signature(run).parameters) == 1 else two


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the row offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if pa.types.is_string(column.type) else column.cast(pa.large_string()).fill_null("")
    wide = pa.types.is_large_string(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), bounds - bounds[0]
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows, cut at about ``most`` bytes."""
    data, offsets = utf8(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(rows, max(end, row + 1))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and each row's range in those arrays.

    A word is a run of bytes that are no ASCII white space; it never crosses a row's end.
    """
    inside = np.zeros(len(data) + 2, bool)
    np.logical_not(_IS_SPACE[data], out=inside[1:-1])
    begins = inside[1:-1] & ~inside[:-2]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begins[edges] = inside[1:-1][edges]
    ends = inside[1:-1] & ~inside[2:]
    ends[edges - 1] = inside[1:-1][edges - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hash(prefix_hash(byte_symbols(data)), starts, ends)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def anchors(symbols: np.ndarray, bounds: np.ndarray, window: int, gram: int):
    """Content-defined anchors such that equal windows have the same anchor.

    Of each window of ``window`` symbols, the gram of ``gram`` symbols with the least hash is
    the anchor (the first of equals).  Consecutive windows with one anchor are a run.  Returns
    per run: row, anchor position, first window start, end of window starts, anchor hash.
    Windows lie in one row; a row with fewer symbols than a window has none.  The prefix hash
    of the symbols comes last.
    """
    none = np.zeros(0, np.int64)
    prefix = prefix_hash(symbols)
    if len(symbols) < window:
        return none, none, none, none, np.zeros(0, np.uint64), prefix
    n = len(symbols)
    scaled = (prefix[gram:] - prefix[:-gram]) * inverse_powers(n + 1)[: n - gram + 1]
    grams = mix(scaled)
    packed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    least = (sliding_min(packed, window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # windows by their start; those that cross a row's end are not windows
    legal = np.ones(len(least), bool)
    for shift_from, shift_to in zip(bounds[1:-1] - window + 1, bounds[1:-1], strict=True):
        legal[max(0, shift_from) : shift_to] = False
    starts = np.flatnonzero(legal)
    if not len(starts):
        return none, none, none, none, np.zeros(0, np.uint64), prefix
    at = least[starts]
    fresh = np.empty(len(starts), bool)
    fresh[0] = True
    fresh[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(fresh)
    begin = starts[first]
    last = np.append(first[1:], len(starts)) - 1
    end = starts[last] + 1
    row = np.searchsorted(bounds, begin, side="right") - 1
    return row, at[first], begin, end, grams[at[first]], prefix


_P1, _P2, _P3, _P4, _P5 = (  # fixed values of XXH64
    np.uint64(0x9E3779B185EBCA87),
    np.uint64(0xC2B2AE3D27D4EB4F),
    np.uint64(0x165667B19E3779F9),
    np.uint64(0x85EBCA77C2B2AE63),
    np.uint64(0x27D4EB2F165667C5),
)


def _rotl(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[start:end] for many ranges at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(padded) - 7,), (1,))
    size = (ends - starts).astype(np.uint64)
    at, left = starts.astype(np.int64), (ends - starts).astype(np.int64)
    one = np.uint64(seed)
    out = np.full(len(starts), one + _P5, np.uint64)
    long = np.flatnonzero(left >= 32)
    if len(long):
        with np.errstate(over="ignore"):
            v = [np.full(len(long), x, np.uint64) for x in (one + _P1 + _P2, one + _P2, one, one - _P1)]
        todo = np.arange(len(long))
        while len(todo):
            rows = long[todo]
            for k in range(4):
                v[k][todo] = _round(v[k][todo], lanes[at[rows] + 8 * k])
            at[rows] += 32
            left[rows] -= 32
            todo = todo[left[rows] >= 32]
        acc = _rotl(v[0], 1) + _rotl(v[1], 7) + _rotl(v[2], 12) + _rotl(v[3], 18)
        for lane in v:
            acc = (acc ^ _round(np.zeros_like(lane), lane)) * _P1 + _P4
        out[long] = acc
    out += size
    for _ in range(3):
        rows = np.flatnonzero(left >= 8)
        if not len(rows):
            break
        x = out[rows] ^ _round(np.zeros(len(rows), np.uint64), lanes[at[rows]])
        out[rows] = _rotl(x, 27) * _P1 + _P4
        at[rows] += 8
        left[rows] -= 8
    rows = np.flatnonzero(left >= 4)
    x = out[rows] ^ ((lanes[at[rows]] & np.uint64(0xFFFFFFFF)) * _P1)
    out[rows] = _rotl(x, 23) * _P2 + _P3
    at[rows] += 4
    left[rows] -= 4
    for _ in range(3):
        rows = np.flatnonzero(left >= 1)
        if not len(rows):
            break
        x = out[rows] ^ (padded[at[rows]].astype(np.uint64) * _P5)
        out[rows] = _rotl(x, 11) * _P1
        at[rows] += 1
        left[rows] -= 1
    out ^= out >> np.uint64(33)
    out *= _P2
    out ^= out >> np.uint64(29)
    out *= _P3
    out ^= out >> np.uint64(32)
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def joined_words(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """The words, with A-Z lowered, each followed by one space, and where each begins in that."""
    sizes = ends - starts
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    # a word's end may be the start of the next row's first word
    level = np.zeros(len(data) + 1, np.int32)
    level[starts] += 1
    level[ends] -= 1
    inside = np.cumsum(level[:-1]).astype(bool)
    out = np.full(int(begin[-1]), 0x20, np.uint8)
    slot = np.ones(len(out), bool)
    slot[begin[1:] - 1] = False
    out[slot] = _LOWER[data[inside]] if lower else data[inside]
    return out, begin[:-1]


_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()


def majority_bits(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per range of ``hashes``, a word whose bit is 1 if set in over half of them; 0 for none.

    Eight one-byte counters are added at a time, for at most 255 hashes, then widened.
    """
    counts = np.diff(bounds)
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    pieces = -(-counts[full] // 255)
    owner = np.repeat(np.arange(len(full)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = bounds[:-1][full][owner] + nth * 255
    first = np.cumsum(pieces) - pieces
    octets = hashes.view(np.uint8).reshape(-1, 8)
    half = counts[full]
    for k in range(8):
        added = np.add.reduceat(_SPREAD[octets[:, k]], cuts).view(np.uint8).reshape(-1, 8)
        sums = np.add.reduceat(added.astype(np.int64), first, axis=0)
        bits = np.packbits(2 * sums > half[:, None], axis=1, bitorder="little").ravel()
        out[full] |= bits.astype(np.uint64) << np.uint64(8 * k)
    return out
