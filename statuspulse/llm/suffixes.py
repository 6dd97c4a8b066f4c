"""Byte-level substring deduplication by a hash-compared suffix sort.

The exchange of ``repeats`` brings together the distinct stretches of text that may share a
window.  Their suffixes are sorted here: the first sixteen bytes put them in order at once, and
suffixes that agree so far are mergesorted, where two suffixes are compared by binary search
for their common extension over prefix polynomial hashes.  Neighbours in the sorted order that
agree over a whole window are compared byte by byte, so a hash collision cannot remove text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from statuspulse.llm import kernel, repeats

#: Bytes that the first order looks at.
HEAD = 16


class _Suffixes:
    """Comparison of the first ``window`` bytes of suffixes, by hashes."""

    def __init__(self, content: np.ndarray, window: int):
        self.content, self.window = content, window
        self.prefix = kernel.prefix_hash(kernel.byte_symbols(content))
        self.inverse = kernel.inverse_powers(len(content) + 1)
        padded = np.concatenate([content, np.zeros(8, np.uint8)])
        self.lanes = np.lib.stride_tricks.as_strided(padded[:8].view(">u8"), (len(content) + 1,), (1,))

    def _hash(self, start: np.ndarray, size) -> np.ndarray:
        return (self.prefix[start + size] - self.prefix[start]) * self.inverse[start]

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self._hash(a, self.window) == self._hash(b, self.window)

    def less(self, a: np.ndarray, b: np.ndarray, or_equal: bool) -> np.ndarray:
        """a before b; the common extension is found in logarithmic steps."""
        out = self.equal(a, b)
        rest = np.flatnonzero(~out)
        out = out & or_equal
        x, y = a[rest], b[rest]
        same = np.zeros(len(rest), np.int64)
        step = 1 << (self.window.bit_length() - 1)
        while step:
            longer = same + step
            fits = np.flatnonzero(longer < self.window)
            agree = self._hash(x[fits], longer[fits]) == self._hash(y[fits], longer[fits])
            same[fits[agree]] += step
            step >>= 1
        out[rest] = self.content[x + same] < self.content[y + same]
        return out

    def same_bytes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.ones(len(a), bool)
        for at in [*range(0, self.window - 7, 8), self.window - 8]:
            out &= self.lanes[a + at] == self.lanes[b + at]
        return out

    def mergesort(self, starts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """``starts`` with each range between ``bounds`` sorted; all ranges are merged together."""
        out = starts.copy()
        sizes = np.diff(bounds)
        width = 1
        while True:
            wide = sizes > width
            if not wide.any():
                return out
            rows = np.flatnonzero(np.repeat(wide, sizes))
            low = np.repeat(bounds[:-1], sizes)[rows]
            high = np.repeat(bounds[1:], sizes)[rows]
            nth = rows - low
            pair = low + nth // (2 * width) * (2 * width)
            middle = np.minimum(pair + width, high)
            end = np.minimum(pair + 2 * width, high)
            second = rows >= middle
            # rank of each suffix in the run it is merged with
            left, right = np.where(second, pair, middle), np.where(second, middle, end)
            begin = left.copy()
            own = out[rows]
            todo = np.flatnonzero(left < right)
            while len(todo):
                probe = (left[todo] + right[todo]) // 2
                other = out[probe]
                before = np.empty(len(todo), bool)
                from_second = second[todo]
                for side, or_equal in ((True, True), (False, False)):
                    part = np.flatnonzero(from_second == side)
                    before[part] = self.less(other[part], own[todo[part]], or_equal)
                left[todo[before]] = probe[before] + 1
                right[todo[~before]] = probe[~before]
                todo = todo[left[todo] < right[todo]]
            merged = out.copy()
            merged[pair + (rows - np.where(second, middle, pair)) + (left - begin)] = own
            out = merged
            width *= 2


def sort_suffixes(content: np.ndarray, starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of ``starts`` in the order of their windows, and whether each equals the one before."""
    suffixes = _Suffixes(content, window)
    head = min(HEAD, window)
    second = suffixes.lanes[starts + head - 8].astype(np.uint64)
    first = suffixes.lanes[starts].astype(np.uint64)
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
    cuts = np.append(np.flatnonzero(fresh), len(order))
    sizes = np.diff(cuts)
    tied = np.repeat(sizes > 1, sizes)
    place = np.empty(len(content) + 1, np.int64)
    place[starts] = np.arange(len(starts))
    ranges = np.concatenate([[0], np.cumsum(sizes[sizes > 1])])
    order[tied] = place[suffixes.mergesort(starts[order[tied]], ranges)]
    same = np.zeros(len(order), bool)
    near = starts[order]
    same[1:] = suffixes.equal(near[1:], near[:-1])
    at = np.flatnonzero(same)
    same[at] = suffixes.same_bytes(near[at], near[at - 1])
    return order, same


def _matcher(window: int):
    def match(content: np.ndarray, bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
        many = np.diff(bounds) - window + 1
        owner = np.repeat(np.arange(len(many)), many)
        first = np.cumsum(many) - many
        nth = np.arange(len(owner)) - first[owner]
        starts = bounds[:-1][owner] + nth
        order, same = sort_suffixes(content, starts, window)
        cuts = np.flatnonzero(~same)
        own = ids[owner[order]]
        least = np.repeat(np.minimum.reduceat(own, cuts), np.diff(np.append(cuts, len(own))))
        hit = np.empty(len(order), np.uint64)
        hit[order] = least < own
        return np.add.reduceat(hit << nth.astype(np.uint64), first)

    return match


def _finish(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray, bounds, extra) -> dict:
    total = np.concatenate([[0], np.cumsum(gone)])
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(gone))]
    begins[inner] = gone[inner]
    spans = np.concatenate([[0], np.cumsum(begins)])
    left = data[~gone].tobytes()
    removed = np.diff(total[offsets])
    sizes = np.diff(offsets)
    ends = np.concatenate([[0], np.cumsum(sizes - removed)])
    return {
        "n_bytes": pa.array(sizes),
        "n_removed": pa.array(removed),
        "n_spans": pa.array(np.diff(spans[offsets])),
        "kept": pa.array([left[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()),
    }


def _bytes(data: np.ndarray, offsets: np.ndarray):
    return kernel.byte_symbols(data), offsets, None


def remove_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = 50,
    heavy: int = 64,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes); a row per row of ``docs``.

    Removes every byte covered by a string of ``length`` bytes that also starts in a row with a
    smaller id, judged on the input.  Null texts are empty; rows with one id do not affect one
    another; a row without an id is left as it is and affects none; other columns are ignored.
    ``heavy`` only decides how popular passages travel, not the result.
    """
    unit = repeats.Unit(
        window=length,
        gram=max(1, length // 2 - 1),
        reader=_bytes,
        content=lambda symbols, data, extra: data,
        width=np.uint8,
        matcher=_matcher(length),
        finish=_finish,
        schema="n_bytes long, n_removed long, n_spans long, kept binary",
        heavy=heavy,
    )
    if length < HEAD:
        raise ValueError(f"length must be at least {HEAD}")
    return repeats.mark(docs, id_column, text_column, unit).drop("rest")
