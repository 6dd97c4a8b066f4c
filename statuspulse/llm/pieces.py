"""SentencePiece encoding and decoding with N-best segmentations.

The pieces of a model file span a lattice over a text.  A forward Viterbi pass gives every
position the best score of reaching it; these scores are exact heuristics for a backward A*
search from the end, which therefore pops complete segmentations in the order of their scores.
No piece crosses the start of a run of spaces, a line break or the end of a Latin word, so a
text's lattice is a chain of small ones: a worker searches each distinct one once (and keeps it
in a bounded memory), and
the N best of a text are the N cheapest ways to depart from the best in its parts.

A byte-pair model ranks its pieces and does not weigh them; by Zipf's law a piece of rank r
scores -log(1 + r).  Characters without a piece become byte pieces, which cost more than any
piece.  Scores are integers (millionths), so that sums and ties are exact; of equal
segmentations the one whose ids are less comes first.
"""

from __future__ import annotations

import gc
import heapq
import math
import re
import struct
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuspulse.llm import kernel

SPACE = "▁"
#: Cuts of a text; a model is read with the first that no piece of it crosses.
CUTS = (
    re.compile(rf"\n|{SPACE}*[A-Za-z\u00c0-\u024f]+(?!\w)|{SPACE}*[^{SPACE}\n]+|{SPACE}+"),
    re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+"),
)
#: Longer parts are searched in arrays, which take few bytes per position, with the same results.
LONG = 400
#: Parts a task remembers: two generations of about so many bytes.
REMEMBERED_BYTES = 32 << 20
#: What a part takes up there: text, ids and score of at most ``TOGETHER`` characters, most of them far less.
ENTRY_BYTES = 450
#: Parts up to this length are remembered and searched together, so many at a time.
TOGETHER, AT_ONCE = 64, 8192
#: Texts that are cut before their parts are looked up.
TEXTS = 256
#: Characters whose edges are in a table.
FREQUENT = 63
#: Pieces that are decoded at once.
DECODED = 1 << 18
EDIT_TYPE = pa.struct([("at", pa.int32()), ("instead_of", pa.int32()), ("ids", pa.list_(pa.int32()))])
N_BEST_TYPE = pa.list_(pa.struct([("score", pa.int64()), ("changed", pa.int32()), ("edits", pa.list_(EDIT_TYPE))]))
_NONE = -(1 << 60)


class Pieces:
    """The lattice of one model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.raw: list[bytes] = []
        self.score: dict[str, tuple[int, int]] = {}
        self.byte: dict[int, int] = {}
        size = model.get_piece_size()
        self.byte_score = -round(2e6 * math.log(1 + size))
        for k in range(size):
            piece = model.id_to_piece(k)
            self.raw.append(b"")
            if model.is_byte(k):
                self.byte[int(piece[3:5], 16)] = k
                self.raw[k] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(k) or model.is_unknown(k)):
                given = -model.get_score(k)
                rank = given if given < size else len(piece)  # pieces without a rank: runs of spaces
                self.score[piece] = (k, -round(1e6 * math.log(1 + rank)))
                self.raw[k] = piece.replace(SPACE, " ").encode()
        if len(self.byte) != 256:
            raise ValueError("the model must have all byte pieces")
        whole = [cut for cut in CUTS if all(cut.findall(p) == [p] for p in self.score)]
        if not whole:
            raise ValueError("pieces cross the spaces between words")
        self.cut = whole[0]
        self.known_best = lru_cache(maxsize=4096)(self.best)
        #: beginnings of pieces; those that are no piece have no value
        self.begin: dict[str, tuple[int, int] | None] = {
            p[:n]: None for p in self.score for n in range(1, len(p))
        } | self.score
        self.raw_bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_size = np.array([len(r) for r in self.raw], np.int64)
        self.raw_start = np.cumsum(self.raw_size) - self.raw_size
        # the beginnings as arrays: a node per beginning, and edges in the order of (node, next character)
        node = {"": 0} | {p: k for k, p in enumerate(self.begin, 1)}
        edges = sorted((node[p[:-1]] << 21 | ord(p[-1]), node[p]) for p in self.begin)
        self.edge_key, self.edge_to = np.array(edges, np.int64).T.copy()
        # a table of the edges by node for the characters that most of them have, 0 where there is none
        points = Counter(p[-1] for p in self.begin)
        self.column_of = np.zeros(0x110000, np.int8)
        for k, (point, _) in enumerate(points.most_common(FREQUENT), 1):
            self.column_of[ord(point)] = k
        at, point = self.edge_key >> 21, self.column_of[self.edge_key & 0x1FFFFF]
        self.edge_table = np.zeros((len(node), 1 + FREQUENT), np.int32)
        self.edge_table[at[point > 0], point[point > 0]] = self.edge_to[point > 0]
        values = [(-1, _NONE), *((-1, _NONE) if v is None else v for v in self.begin.values())]
        self.node_piece, self.node_score = np.array(values, np.int64).T.copy()

    def lattice(self, text: str) -> tuple[list[list[tuple]], list[int]]:
        """Into each position, (from, ids, score); and the best score of reaching each."""
        size = len(text)
        into: list[list[tuple]] = [[] for _ in range(size + 1)]
        reach: list = [0] + [None] * size
        begin = self.begin
        for at in range(size):
            here = reach[at]
            alone = True
            for end in range(at + 1, size + 1):
                part = text[at:end]
                if part not in begin:
                    break
                found = begin[part]
                if found:
                    piece, score = found
                    into[end].append((at, (piece,), score))
                    score += here
                    if reach[end] is None or score > reach[end]:
                        reach[end] = score
                    if end == at + 1:
                        alone = False
            if alone:
                raw = text[at].replace(SPACE, " ").encode()
                score = self.byte_score * len(raw)
                into[at + 1].append((at, tuple([self.byte[b] for b in raw]), score))
                if reach[at + 1] is None or score + here > reach[at + 1]:
                    reach[at + 1] = score + here
        return into, reach

    def first(self, text: str) -> tuple[tuple[int, ...], int, float]:
        """Ids and score of the best segmentation, and how much less the next one scores.

        The next one has an edge that the best has not: the least loss over such edges, from the
        scores of reaching either end of them.  Equally good ones are left to the search.
        """
        size = len(text)
        if size > LONG:
            both = self.best_of_long(text, 2)
            return both[0][1], both[0][0], both[0][0] - both[1][0] if len(both) > 1 else math.inf
        reach: list = [-math.inf] * (size + 1)
        came: list = [None] * (size + 1)
        equal = [False] * (size + 1)
        edges = []
        look = self.begin.get
        reach[0] = 0
        for at in range(size):
            here = reach[at]
            end = at + 1
            found = look(text[at], 0)
            longer = found != 0
            if not found:
                raw = text[at].replace(SPACE, " ").encode()
                found = tuple([self.byte[b] for b in raw]), self.byte_score * len(raw)
            while True:
                if found:
                    piece, score = found
                    edges.append((at, end, score))
                    score += here
                    if score > reach[end]:
                        reach[end] = score
                        came[end] = at, piece
                        equal[end] = False
                    elif score == reach[end]:
                        equal[end] = True
                if not longer or end == size:
                    break
                end += 1
                found = look(text[at:end], 0)
                if found == 0:
                    break
        total = reach[size]
        ids: list[int] = []
        at = size
        while at:
            if equal[at]:
                both = self.best(text, 2)
                return both[0][1], both[0][0], both[0][0] - both[1][0]
            at, piece = came[at]
            if piece.__class__ is int:
                ids.append(piece)
            else:
                ids += piece[::-1]
        rest: list = [-math.inf] * size + [0]
        loss = math.inf
        for start, end, score in reversed(edges):
            score += rest[end]
            if score > rest[start]:
                rest[start] = score
            score = total - score - reach[start]
            if 0 < score < loss:
                loss = score
        return tuple(ids[::-1]), total, loss

    def onward(self, node: np.ndarray, point: np.ndarray) -> np.ndarray:
        """The nodes that characters lead to from nodes; 0 where no piece goes on."""
        column = self.column_of[point]
        to = self.edge_table[node, column]
        rare = np.flatnonzero(column == 0)
        if len(rare):
            key = node[rare].astype(np.int64) << 21 | point[rare]
            place = np.minimum(np.searchsorted(self.edge_key, key), len(self.edge_key) - 1)
            to[rare] = np.where(self.edge_key[place] == key, self.edge_to[place], 0)
        return to

    def first_of_many(self, parts: list[str]) -> list[tuple[bytes, int, float]]:
        """``first`` of many short parts at once, the ids packed: positions in turn, parts side by side."""
        lengths = np.array([len(p) for p in parts])
        order = np.argsort(-lengths, kind="stable")
        lengths, order = lengths[order], order.tolist()
        many, longest = len(parts), int(lengths[0])
        column = np.arange(many)
        points = np.frombuffer("".join([parts[k] for k in order]).encode("utf-32-le"), np.uint32)
        text = np.zeros((longest, many), np.int64)
        begins = np.cumsum(lengths) - lengths
        text[np.arange(len(points)) - np.repeat(begins, lengths), np.repeat(column, lengths)] = points
        as_long = [many - int(np.searchsorted(lengths[::-1], k)) for k in range(longest + 1)]
        reach = np.full((longest + 1, many), _NONE)
        reach[0] = 0
        came, piece = (np.zeros((longest + 1, many), np.int64) for _ in range(2))
        tied = np.zeros((longest + 1, many), bool)
        edges = []
        for at in range(longest):
            rows, node = column[: as_long[at + 1]], np.zeros(as_long[at + 1], np.int32)
            for end in range(at + 1, longest + 1):
                rows = rows[: np.searchsorted(rows, as_long[end])]
                if not len(rows):
                    break
                point = text[end - 1, rows]
                node = self.onward(node[: len(rows)], point)
                longer = node > 0
                score = self.node_score[node]
                ids = self.node_piece[node]
                if end == at + 1:  # a character without a piece stands as its bytes
                    alone = score == _NONE
                    raw = np.where(point == ord(SPACE), ord(" "), point)
                    sizes = 1 + (raw >= 0x80) + (raw >= 0x800) + (raw >= 0x10000)
                    score = np.where(alone, self.byte_score * sizes, score)
                    ids = np.where(alone, -1 - raw, ids)
                there = score > _NONE
                own, score, ids = rows[there], score[there], ids[there]
                edges.append((at, end, own, score))
                total = reach[at, own] + score
                old = reach[end, own]
                better = total > old
                tied[end, own] = ~better & (tied[end, own] | (total == old))
                chosen = own[better]
                reach[end, chosen], came[end, chosen], piece[end, chosen] = total[better], at, ids[better]
                rows, node = rows[longer], node[longer]
        whole = reach[lengths, column]
        rest = np.full((longest + 1, many), _NONE)
        rest[lengths, column] = 0
        loss = np.full(many, -_NONE)
        for at, end, own, score in reversed(edges):
            onward = score + rest[end, own]
            rest[at, own] = np.maximum(rest[at, own], onward)
            less = whole[own] - onward - reach[at, own]
            loss[own] = np.minimum(loss[own], np.where(less > 0, less, -_NONE))
        at, back, unclear = lengths, [], np.zeros(many, bool)
        count = np.zeros(many, np.int64)
        while at.any():
            unclear |= tied[at, column]
            back.append(piece[at, column])
            count += at > 0
            at = came[at, column]
        ids = np.ascontiguousarray(np.array(back[::-1], np.int32).T)
        in_bytes = ((ids < 0) & (np.arange(len(back)) >= len(back) - count[:, None])).any(axis=1)
        special = (unclear | in_bytes).tolist()
        packed, width = ids.tobytes(), 4 * len(back)
        begin = (width * (column + 1) - 4 * count).tolist()
        found: list = [None] * many
        for row, (k, a, score, lost) in enumerate(zip(order, begin, whole.tolist(), loss.tolist())):
            found[k] = packed[a : width * (row + 1)], score, lost if lost < -_NONE else math.inf
            if special[row]:
                found[k] = self._special(parts[k], found[k], unclear[row])
        return found

    def _special(self, part: str, found: tuple[bytes, int, float], unclear: bool) -> tuple[bytes, int, float]:
        """Of equal segmentations the one searched for; characters without a piece as byte pieces."""
        if unclear:
            best, score, loss = self.first(part)
            return struct.pack(f"{len(best)}i", *best), score, loss
        best = [x for i in memoryview(found[0]).cast("i") for x in ([i] if i >= 0 else [self.byte[b] for b in chr(-1 - i).encode()])]
        return struct.pack(f"{len(best)}i", *best), *found[1:]

    def best(self, text: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """The ``n`` best (score, ids) of a part, best first."""
        if not text:
            return [(0, ())]
        if len(text) > LONG:
            return self.best_of_long(text, n)
        into, reach = self.lattice(text)
        push, pop = heapq.heappush, heapq.heappop
        found: list[tuple[int, tuple[int, ...]]] = []
        seen = [0] * (len(text) + 1)
        # (cost estimate, -position, first id, place of what follows at its position, position,
        # score from here on, ids from here on as a chain).  Of equal estimates later positions
        # come first, so what is on from a position comes in the order of (score, ids), and only
        # the first n of it matter.
        agenda: list[tuple] = [(-reach[-1], -len(text), 0, 0, len(text), 0, None)]
        while agenda and len(found) < n:
            _, _, _, _, at, so_far, chain = pop(agenda)
            nth = seen[at]
            if nth >= n:
                continue
            seen[at] = nth + 1
            if at == 0:
                ids: list[int] = []
                while chain:
                    ids += chain[0]
                    chain = chain[1]
                found.append((so_far, tuple(ids)))
                continue
            for start, piece, score in into[at]:
                score += so_far
                push(agenda, (-score - reach[start], -start, piece[0], nth, start, score, (piece, chain)))
        return found

    def edges(self, text: str, at: int) -> Iterator[tuple[int, tuple[int, ...], int]]:
        """(length, ids, score) of what may stand at a position."""
        found = self.begin.get(text[at])
        if found:
            yield 1, found[:1], found[1]
        else:
            raw = text[at].replace(SPACE, " ").encode()
            yield 1, tuple([self.byte[b] for b in raw]), self.byte_score * len(raw)
        for end in range(at + 2, len(text) + 1):
            found = self.begin.get(text[at:end], 0)
            if found == 0:
                break
            if found:
                yield end - at, found[:1], found[1]

    def best_of_long(self, text: str, n: int) -> list[tuple[int, tuple[int, ...]]]:
        """``best`` from the end to the start, with the ``n`` best ways on from every position.

        What starts at a position differs in its first id, and equal scores after it are in order
        already, so (score, first id, place after it) is the order of (score, ids).
        """
        size = len(text)
        score = array("q", bytes(8 * n * (size + 1)))
        length = array("i", [0]) * (n * size)
        place = array("i", [0]) * (n * size)
        many = array("i", [0]) * size + array("i", [1])
        for at in range(size - 1, -1, -1):
            options = []
            for step, ids, of_piece in self.edges(text, at):
                after = (at + step) * n
                options += [(-of_piece - score[after + k], ids[0], k, step) for k in range(many[at + step])]
            options.sort()
            del options[n:]
            many[at] = len(options)
            for k, (cost, _, nth, step) in enumerate(options, at * n):
                score[k], place[k], length[k] = -cost, nth, step
        found = []
        for k in range(many[0]):
            at, nth = 0, k
            out = array("i")
            while at < size:
                cell = at * n + nth
                out.extend(next(ids for step, ids, _ in self.edges(text, at) if step == length[cell]))
                at, nth = at + length[cell], place[cell]
            found.append((score[k], tuple(out)))
        return found

    def parts_of(self, text: str) -> list[str]:
        """The parts of a text as the model sees it: a space in front, spaces as ``SPACE``."""
        if not text:
            return []
        return self.cut.findall(SPACE + text.replace(" ", SPACE))

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """What these pieces stand for, end to end; so many at a time that the positions stay few."""
        some = (ids[k : k + DECODED] for k in range(0, len(ids), DECODED))
        return b"".join([self.raw_bytes[_joined(self.raw_start[x], self.raw_size[x])].tobytes() for x in some])

    def decode(self, ids) -> str:
        raw = b"".join([self.raw[k] for k in ids])
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def _joined(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of runs of these starts and sizes, run after run."""
    end = np.cumsum(size)
    return np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)


@lru_cache(maxsize=1)
def load(model_file: str) -> Pieces:
    return Pieces(model_file)


class _Parts(dict):
    """Part to (packed ids of the best segmentation, its score, cost of the next, part).

    Of what was not asked for while ``REMEMBERED_BYTES`` more were learnt, nothing is kept.
    """

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        self.old: dict[str, tuple] = {}
        self.size = 0

    def learn(self, parts: set[str]) -> None:
        """Search all of these that are not known, side by side."""
        if self.size > REMEMBERED_BYTES:
            self.old = dict(self)
            self.clear()
            self.size = 0
        old, unseen = self.old, []
        for part in parts.difference(self):
            value = old.get(part)
            if value is not None:
                self[part] = value
            elif len(part) <= TOGETHER:
                unseen.append(part)
        before = len(self)
        unseen.sort(key=len)  # those of like length together
        for k in range(0, len(unseen), AT_ONCE):
            some = unseen[k : k + AT_ONCE]
            for part, found in zip(some, self.pieces.first_of_many(some)):
                self[part] = (*found, part)
        self.size += ENTRY_BYTES * (len(self) - before)

    def __missing__(self, part: str):
        ids, score, loss = self.pieces.first(part)
        value = (struct.pack(f"{len(ids)}i", *ids), score, loss, part)
        if len(part) <= TOGETHER:
            self[part] = value
            self.size += ENTRY_BYTES
        return value


def segmentations(parts: list[tuple], n: int, pieces: Pieces) -> list[tuple[int, list[tuple[int, tuple, tuple]]]]:
    """The ``n`` cheapest segmentations of a text: cost above the best, and (part, its ids, its ids in the best)
    for each part that is cut otherwise.  Of equal costs the one whose ids are less comes first.
    """
    costs = np.array([p[2] for p in parts], np.float64)
    return _cheapest(costs, lambda k: parts[k][3], n, pieces)


def _cheapest(
    costs: np.ndarray, part_at: Callable[[int], str], n: int, pieces: Pieces
) -> list[tuple[int, list[tuple[int, tuple, tuple]]]]:
    """``segmentations`` of parts whose second choices have these costs (exact: all are far below 2 ** 53).

    At most n - 1 parts matter, those whose second choice costs least; of these the further
    choices are searched.
    """
    few = max(0, min(n - 1, len(costs)))
    last = np.partition(costs, few - 1)[few - 1] if few else -1
    options: dict[str, list[tuple[int, tuple[int, ...]]]] = {}
    near = []
    for k in np.flatnonzero((costs <= last) & (costs < math.inf)).tolist():
        part = part_at(k)
        if part not in options:
            options[part] = (pieces.known_best if len(part) <= LONG else pieces.best)(part, n)
        found = options[part]
        # of parts with one cost, the earlier one makes less ids less, and greater ids greater
        more = found[1][1] > found[0][1]
        near.append((costs[k], more, -k if more else k, k))
    combined: list[tuple] = [(0, (), [])]
    for k in sorted([x[3] for x in heapq.nsmallest(n - 1, near)]):
        found = options[part_at(k)]
        best, ids = found[0]
        combined = heapq.nsmallest(
            n,
            (
                (cost + best - score, before + (other,), changes + [(k, other, ids)] if choice else changes)
                for cost, before, changes in combined
                for choice, (score, other) in enumerate(found)
            ),
            key=lambda x: x[:2],
        )
    return [(cost, changes) for cost, _, changes in combined]


def _edit(start: int, new: tuple[int, ...], old: tuple[int, ...]) -> dict:
    """How ``old`` ids, which begin at ``start``, become the ``new`` ones, without what both begin or end with."""
    most = min(len(new), len(old))
    head = 0
    while head < most and new[head] == old[head]:
        head += 1
    tail = 0
    while tail < most - head and new[-1 - tail] == old[-1 - tail]:
        tail += 1
    return {"at": start + head, "instead_of": len(old) - tail - head, "ids": new[head : len(new) - tail]}


def segmented(part: pa.RecordBatch, known: _Parts, n_best: int) -> pa.RecordBatch:
    """The columns of ``encode`` for ids and texts; each different part of these is looked up once."""
    pieces = known.pieces
    columns = [[], [], [], []]
    texts = [text or "" for text in part.column(1).to_pylist()]
    cut = [pieces.parts_of(text) for text in texts]
    different = set().union(*cut)
    known.learn(different)
    place = dict(zip(different, range(len(different))))
    found = [known[p] for p in different]
    packed = [p[0] for p in found]
    sizes = np.array([len(p) for p in packed], np.int64) // 4
    begins = np.cumsum(sizes) - sizes
    all_ids = np.frombuffer(b"".join(packed), np.int32)
    scores = np.array([p[1] for p in found], np.int64)
    costs = np.array([p[2] for p in found], np.float64)
    for text, own in zip(texts, cut):
        at = np.fromiter(map(place.__getitem__, own), np.int64, len(own))
        size = sizes[at]
        ids = all_ids[_joined(begins[at], size)]
        score = int(scores[at].sum())
        again = pieces.bytes_of(ids)
        best = _cheapest(costs[at], own.__getitem__, n_best, pieces)
        columns[0].append(ids)
        columns[1].append(score)
        starts = np.cumsum(size) - size
        columns[2].append(
            [
                {
                    "score": score - cost,
                    "changed": len(changes),
                    "edits": [_edit(int(starts[k]), new, old) for k, new, old in changes],
                }
                for cost, changes in best
            ]
        )
        columns[3].append(again == ((" " + text).encode() if text else b""))
    ends = np.cumsum([0, *(len(x) for x in columns[0])]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            part.column(0),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(columns[0]))),
            pa.array(columns[1], pa.int64()),
            pa.array(columns[2], N_BEST_TYPE),
            pa.array(columns[3], pa.bool_()),
        ],
        ["doc_id", "pieces", "score", "n_best", "round_trip"],
    )


def encode(
    docs: DataFrame, model_file: str, id_column: str = "doc_id", text_column: str = "text", n_best: int = 4
) -> DataFrame:
    """doc_id, pieces, score, n_best (struct of score, changed and edits), round_trip; a row per row.

    ``pieces`` are the ids of the best segmentation and ``score`` its score; ``n_best`` has, for the up
    to ``n_best`` best segmentations, the score, how many parts are cut otherwise than in the best,
    and the edits that make its ids of ``pieces`` (``alternatives`` applies them): from position
    ``at`` on, ``ids`` stand instead of ``instead_of`` ids.  ``round_trip``: decoding gives back the text.  Null and empty texts have no pieces, score 0
    and one segmentation.  ``model_file`` must exist on every executor.
    """
    kind = docs.schema[id_column].dataType

    @kernel.giving_back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        collecting, known = gc.isenabled(), _Parts(load(model_file))
        gc.disable()  # what is remembered holds no cycles, and scanning it again and again is slow
        try:
            for batch in batches:
                # a few texts at a time bound the memory, whatever their lengths
                lengths = pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_pylist()
                at = 0
                while at < batch.num_rows:
                    size, end = 0, at
                    while end < min(at + TEXTS, batch.num_rows) and size < 1 << 20:
                        size += lengths[end]
                        end += 1
                    yield segmented(batch.slice(at, end - at), known, n_best)
                    at = end
        finally:
            del known
            load.cache_clear()
            if collecting:
                gc.enable()

    rows = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return rows.mapInArrow(
        run,
        f"doc_id {kind.simpleString()}, pieces array<int>, score long, "
        "n_best array<struct<score:long,changed:int,edits:array<struct<at:int,instead_of:int,ids:array<int>>>>>, "
        "round_trip boolean",
    )


def alternatives(pieces: Column, n_best: Column) -> Column:
    """The ids of each of the N best segmentations, from the columns of ``encode``."""

    def edited(edits: Column) -> Column:
        # the last edit first, so that the positions of the others hold
        return F.aggregate(
            F.reverse(edits),
            pieces,
            lambda ids, e: F.concat(
                F.slice(ids, F.lit(1), e["at"]),
                e["ids"],
                F.slice(ids, e["at"] + e["instead_of"] + 1, F.size(ids)),
            ),
        )

    return F.transform(n_best, lambda x: edited(x["edits"]))


def decode(rows: DataFrame, model_file: str, id_column: str = "doc_id", pieces_column: str = "pieces") -> DataFrame:
    """doc_id and text from ids; null ids decode to an empty text."""
    kind = rows.schema[id_column].dataType.simpleString()

    def run(batches):
        pieces = load(model_file)
        for batch in batches:
            texts = [pieces.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    given = rows.select(F.col(id_column).alias("doc_id"), F.col(pieces_column).cast("array<int>").alias("pieces"))
    return given.mapInArrow(run, f"doc_id {kind}, text string")
