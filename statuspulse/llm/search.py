"""Ranked lexical search: branch and bound over tries of documents.

A document is reduced to the terms that some item asks for, with how often it holds them.  Its
terms in order of frequency, the most frequent first, are a path; documents that begin with the
same terms share nodes (a frequent-pattern tree whose leaves are short runs of documents).  Every
node knows, for each term, the greatest count below it, and the least length figure m.  These give
a bound on any score below the node.  An item's search goes down depth first, the child of the
greatest bound first, and leaves out what cannot reach its k best.

A task builds tries of a few thousand documents each, so that memory is bounded, and carries an
item's k best from one to the next; what tasks found is merged by windows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from statuspulse.llm.common import Scratch

#: Texts of items searched together: their terms and what was found of them is held by every task.
BLOCK_BYTES = 256 << 10
#: Documents of a trie, at most; and of a leaf.
TRIE, LEAF = 4096, 32
#: Documents times terms of a trie, at most.
TRIE_CELLS = 16 << 20
#: Shares in which the tasks' findings for an item are merged before they meet.
MERGE = 64

# ASCII letters in lower case, digits and bytes of other code points; all else separates terms
_TERM_BYTES = bytes(
    b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in bytes(range(256)).lower()
)


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text: runs of ASCII letters, digits and other code points from 0x80 on."""
    return text.translate(_TERM_BYTES).split()


@dataclass
class Asked:
    """Items as their terms: those of item k are ``terms[starts[k]:starts[k + 1]]``, each ``times`` over."""

    starts: np.ndarray
    terms: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes], number: dict[bytes, int]) -> Asked:
        counts = [Counter(number[t] for t in terms_of(text)) for text in texts]
        flat = [pair for c in counts for pair in c.items()]
        pairs = np.array(flat, np.int64).reshape(-1, 2)
        return cls(np.cumsum([0, *map(len, counts)]), pairs[:, 0].copy(), pairs[:, 1].copy())

    def places(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the terms of the given items (each has one), and where each item's begin among them."""
        sizes = self.starts[items + 1] - self.starts[items]
        begin = np.cumsum(sizes) - sizes
        return np.repeat(self.starts[items] - begin, sizes) + np.arange(sizes.sum()), begin

    def scores(self, items: np.ndarray, per_term: np.ndarray) -> np.ndarray:
        """Scores of the items in each row of ``per_term`` (what a term adds, by row and term)."""
        places, begin = self.places(items)
        return np.add.reduceat(per_term[:, self.terms[places]] * self.times[places], begin, axis=1)


def added(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score; more for a greater tf and for a smaller m."""
    return weights * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class Trie:
    """The trie of some documents given as rows: ``bounds`` of their entries, and terms and counts of these.

    Terms are numbered in order of frequency and ascend within a document.  ``order`` has the
    documents along the trie; a node is a run ``low[k]:high[k]`` of it, and its children come later.
    """

    def __init__(self, bounds: np.ndarray, terms: np.ndarray, tf: np.ndarray, m: np.ndarray, n_terms: int):
        size = len(bounds) - 1
        paths = [terms[bounds[k] : bounds[k + 1]] for k in range(size)]
        keys = [path.astype(">u4").tobytes() for path in paths]
        self.order = np.array(sorted(range(size), key=keys.__getitem__), np.int64)
        shared = np.array([_shared(paths[a], paths[b]) for a, b in zip(self.order, self.order[1:])], np.int64)
        self.low, self.high, self.children = self._nodes(size, shared)
        lengths = np.diff(bounds)[self.order]
        self.bounds = np.cumsum(np.concatenate([[0], lengths]))
        cells = np.repeat(bounds[self.order] - self.bounds[:-1], lengths) + np.arange(self.bounds[-1])
        self.terms, self.tf, self.m = terms[cells], tf[cells].astype(np.int64), m[self.order]
        nodes = len(self.low)
        self.most = np.zeros((nodes, n_terms), np.int32)
        self.least_m = np.empty(nodes, np.int64)
        for node in range(nodes - 1, -1, -1):
            below = self.children[node]
            if below:
                self.most[node] = self.most[below].max(axis=0)
                self.least_m[node] = self.least_m[below].min()
            else:
                a, b = self.bounds[self.low[node]], self.bounds[self.high[node]]
                np.maximum.at(self.most[node], self.terms[a:b], self.tf[a:b])
                self.least_m[node] = self.m[self.low[node] : self.high[node]].min()

    @staticmethod
    def _nodes(size: int, shared: np.ndarray) -> tuple[list[int], list[int], list[list[int]]]:
        """A run splits where its documents part, at the first term not shared by all; neighbouring
        children of few documents are one leaf."""
        low, high, children = [0], [size], [[]]
        todo = [0]
        while todo:
            node = todo.pop()
            a, b = low[node], high[node]
            if b - a <= LEAF:
                continue
            inside = shared[a : b - 1]
            cuts = [*(np.flatnonzero(inside == inside.min()) + a + 1).tolist(), b]
            start = end = a
            runs = []
            for cut in cuts:
                if cut - start > LEAF and end > start:
                    runs.append((start, end))
                    start = end
                end = cut
            runs.append((start, end))
            for run in runs:
                children[node].append(len(low))
                todo.append(len(low))
                low.append(run[0])
                high.append(run[1])
                children.append([])
        return low, high, children

    def leaf(self, node: int, n_terms: int) -> np.ndarray:
        """Counts by document and term."""
        a, b = self.low[node], self.high[node]
        tf = np.zeros((b - a, n_terms), np.int64)
        at = slice(self.bounds[a], self.bounds[b])
        tf[np.repeat(np.arange(b - a), np.diff(self.bounds[a : b + 1])), self.terms[at]] = self.tf[at]
        return tf


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many terms two paths begin with."""
    size = min(len(a), len(b))
    differ = np.flatnonzero(a[:size] != b[:size])
    return int(differ[0]) if len(differ) else size


class Best:
    """The k best (score, id) of each item; of equal scores the least ids, null last."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.found: list[list[tuple]] = [[] for _ in range(items)]
        #: a score below this does not matter; nor does 0
        self.needed = np.ones(items, np.int64)

    def offer(self, item: int, scores: list[int], ids: list) -> None:
        found = self.found[item]
        found += [(-score, id_ is None, id_) for score, id_ in zip(scores, ids)]
        found.sort(key=_by_score_and_id)
        del found[self.k :]
        if len(found) == self.k:
            self.needed[item] = max(1, -found[-1][0])


def _by_score_and_id(row: tuple) -> tuple:
    return row[:2] if row[1] else row


def search(trie: Trie, asked: Asked, weights: np.ndarray, ids: list, best: Best) -> None:
    """Put what the trie's documents score into ``best``; every item prunes by its own k-th score."""
    n_terms = len(weights)
    items = np.flatnonzero(np.diff(asked.starts))
    if not len(items):
        return
    todo = [(0, items, np.full(len(items), np.iinfo(np.int64).max))]
    while todo:
        node, items, bounds = todo.pop()
        items = items[bounds >= best.needed[items]]
        if not len(items):
            continue
        below = trie.children[node]
        if below:
            most, least = trie.most[below].astype(np.int64), trie.least_m[below]
            bounds = asked.scores(items, added(weights, most, least[:, None]))
            for k in np.argsort(bounds.sum(axis=1), kind="stable"):  # the last is taken first
                todo.append((below[k], items, bounds[k]))
            continue
        a, b = trie.low[node], trie.high[node]
        scores = asked.scores(items, added(weights, trie.leaf(node, n_terms), trie.m[a:b, None]))
        enough = scores >= best.needed[items]
        for place in np.flatnonzero(enough.any(axis=0)):
            rows = np.flatnonzero(enough[:, place])
            best.offer(items[place], scores[rows, place].tolist(), [ids[r] for r in trie.order[a + rows]])


def restricted(docs: DataFrame, vocabulary: list[bytes], id_column: str, text_column: str) -> DataFrame:
    """doc_id, n (terms with repeats), terms (numbers in ``vocabulary``) and tfs, of documents with a term."""
    kind = docs.schema[id_column].dataType
    types = [to_arrow_type(kind), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {term: k for k, term in enumerate(vocabulary)}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows, ns, terms, tfs = [], [], [], []
                for k, text in enumerate(part.column(1)):
                    found = terms_of(text.as_py() or b"")
                    if not found:
                        continue
                    counts = Counter(map(number.get, found))
                    counts.pop(None, None)
                    rows.append(k)
                    ns.append(len(found))
                    terms.append(list(counts))
                    tfs.append(list(counts.values()))
                columns = [part.column(0).take(pa.array(rows, pa.int64())), ns, terms, tfs]
                yield pa.RecordBatch.from_arrays(
                    [columns[0], *(pa.array(c, t) for c, t in zip(columns[1:], types[1:]))],
                    ["doc_id", "n", "terms", "tfs"],
                )

    rows = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind.simpleString()}, n long, terms array<int>, tfs array<int>")


def _search_block(vectors: DataFrame, rows: list[Row], vocabulary: list[bytes], k: int, item_type) -> DataFrame:
    """item (its number), item_id, score, doc_id: the k best of each task."""
    totals = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    n_docs, length = totals[0], totals[1] or 1
    held = dict(vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect())
    df = np.array([held.get(t, 0) for t in range(len(vocabulary))], np.int64)
    # most frequent first; of equally frequent ones the first of the vocabulary
    place = np.empty(len(df), np.int64)
    place[np.argsort(-df, kind="stable")] = np.arange(len(df))
    weights = np.zeros(len(df), np.int64)
    weights[place] = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()]
    number = {term: int(place[t]) for t, term in enumerate(vocabulary)}
    asked = Asked.of([bytes(row["text"]) for row in rows], number)
    item_ids = [row["item_id"] for row in rows]
    doc_type = vectors.schema["doc_id"].dataType
    types = [pa.int32(), to_arrow_type(item_type), pa.int64(), to_arrow_type(doc_type)]
    most_docs = max(LEAF, min(TRIE, TRIE_CELLS // max(1, len(df))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(item_ids), k)
        for batch in batches:
            for at in range(0, batch.num_rows, most_docs):
                part = batch.slice(at, most_docs)
                lists = part.column(2)
                lengths = np.diff(lists.offsets.to_numpy())
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                terms = place[lists.flatten().to_numpy()]
                tf = part.column(3).flatten().to_numpy()
                along = np.lexsort((terms, np.repeat(np.arange(len(lengths)), lengths)))
                m = [25 + 75 * n * n_docs // length for n in part.column(1).to_pylist()]
                trie = Trie(bounds, terms[along], tf[along], np.array(m, np.int64), len(weights))
                search(trie, asked, weights, part.column(0).to_pylist(), best)
        out = [(i, item_ids[i], -row[0], row[2]) for i, found in enumerate(best.found) for row in found]
        columns = list(zip(*out)) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types)], ["item", "item_id", "score", "doc_id"]
        )

    return vectors.mapInArrow(
        run, f"item int, item_id {item_type.simpleString()}, score long, doc_id {doc_type.simpleString()}"
    )


def rank(
    items: DataFrame,
    docs: DataFrame,
    k: int = 10,
    item_id: str = "item_id",
    item_text: str = "text",
    doc_id: str = "doc_id",
    doc_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents that score highest for each item.

    A document scores the sum, over an item's terms with repeats, of w * ((10**9 * tf) div
    (1000 * tf + 8 * m)), where w = floor(1000 * ln((2N + 2) / (2 df + 1))) and m = 25 + (75 * n *
    N) div L.  Equal scores rank by ascending id, a null id last; scores of 0 are left out, so an
    item without terms (a null or empty text) has no rows and may have fewer than ``k``.  Every row
    of ``docs`` is a document, repeated ones too.  Items that agree in id and text are one; an id
    with several texts is ranked for each.  Whole texts are read; other columns are ignored.

    Items are taken in blocks of about ``block_bytes``, over which the documents are read again.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "search")
    item_type = items.schema[item_id].dataType
    text = items[item_text].cast("string").cast("binary")
    asked = scratch.keep(items.select(items[item_id].alias("item_id"), text.alias("text")).dropna(subset="text").distinct())
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    ranked = None
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        vocabulary = sorted({t for row in rows for t in terms_of(bytes(row["text"]))})
        vectors = scratch.keep(restricted(docs, vocabulary, doc_id, doc_text))
        found = _search_block(vectors, rows, vocabulary, k, item_type)
        by_score = [F.desc("score"), F.asc_nulls_last("doc_id")]
        found = found.withColumn("share", F.pmod(F.spark_partition_id(), F.lit(MERGE)))
        for keys in (("item", "share"), ("item",)):
            place = F.row_number().over(Window.partitionBy(*keys).orderBy(*by_score))
            found = found.withColumn("rank", place).where(F.col("rank") <= k)
        found = scratch.keep(found.select("item_id", "rank", "doc_id", "score"))
        scratch.drop(vectors)
        ranked = found if ranked is None else ranked.unionByName(found)
    return ranked
