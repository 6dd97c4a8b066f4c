"""Toxicity by a counterfactually regularised classifier.

Features are words and word beginnings of four to six bytes, as hashes: present or not, and
present twice or not.  The ones that tell labels apart are chosen by a grouped count over the sample; a logistic
regression on them is fitted to the labels and, for sentences that mention an identity group,
to a second aim: that swapping the term for another of its kind leaves the score alone.  What
a mention itself seems to say about the label is thereby unlearned, and neutral mentions are
not flagged.

The sample is bounded by ``sample`` rows per label, chosen by a hash of the id; the model by
``features`` numbers.  Scoring reads every whole text once and shuffles nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuspulse.llm import kernel
from statuspulse.llm.common import Scratch

#: Lengths of the word beginnings that are features.
HEADS = (4, 5, 6)
#: Terms of a row may replace one another (fixed values; a parameter of the operator).
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("black", "white", "asian", "latino"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("immigrants", "citizens", "refugees", "natives"),
)
#: Turns a feature's hash into that of its being there twice.
TWICE = np.uint64(0xA5A5A5A5A5A5A5A5)
_TRIM = np.zeros(256, bool)
_TRIM[np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def token_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of the lower-cased words without outer ASCII punctuation."""
    starts, ends, bounds = kernel.words(data, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    # the next and last byte that is no punctuation, within the word
    solid = np.flatnonzero(~_TRIM[data])
    after = np.searchsorted(solid, starts)
    before = np.searchsorted(solid, ends) - 1
    keep = before >= after
    row, after, before = row[keep], after[keep], before[keep]
    starts, ends = solid[after], solid[before] + 1
    prefix = kernel.prefix_hash(kernel.byte_symbols(_LOWER[data]))
    rows, hashes = [row], [kernel.range_hash(prefix, starts, ends)]
    for size in HEADS:
        long = ends - starts >= size
        rows.append(row[long])
        hashes.append(kernel.mix(kernel.range_hash(prefix, starts[long], starts[long] + size) ^ np.uint64(size)))
    return np.concatenate(rows), np.concatenate(hashes)


def present_features(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature): what a row has at all, and as another feature what it has twice or more."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    second = ~fresh
    second[1:] &= fresh[:-1]
    twice = value[second] ^ TWICE
    row, value = np.concatenate([row[fresh], row[second]]), np.concatenate([value[fresh], twice])
    order = np.argsort(row, kind="stable")
    return row[order], value[order]


def features_of(texts: list[str]) -> list[np.ndarray]:
    """The distinct feature hashes of each text."""
    out = []
    for _, data, offsets in kernel.chunks(pa.array(texts, pa.string())):
        row, value = present_features(*token_features(data, offsets))
        out += np.split(value, np.searchsorted(row, np.arange(1, len(offsets) - 1)))
    return out


def _swapper(groups):
    kind = {term: group for group in groups for term in group}
    pattern = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(kind, key=len, reverse=True))) + r")\b", re.I)
    return kind, pattern


def swaps(text: str, groups=IDENTITY_TERMS) -> list[tuple[str, str]]:
    """(sentence, sentence with all its terms replaced by the next of their kind)."""
    kind, pattern = _swapper(groups)

    def other(match):
        group = kind[match[0].lower()]
        return group[(group.index(match[0].lower()) + 1) % len(group)]

    return [(s, pattern.sub(other, s)) for s in re.split(r"(?<=[.!?])\s+|\n", text) if pattern.search(s)]


@dataclass(frozen=True)
class Model:
    vocabulary: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def logits(self, row: np.ndarray, value: np.ndarray, rows: int) -> np.ndarray:
        """Of ``rows`` texts, from their (row, feature) occurrences."""
        out = np.full(rows, self.bias)
        if len(self.vocabulary):
            # a table of hash beginnings leaves few occurrences to sort and look up
            likely = np.zeros(1 << 20, bool)
            head = (self.vocabulary >> np.uint64(44)).astype(np.int64)
            likely[head] = likely[head ^ int(TWICE >> np.uint64(44))] = True
            maybe = likely[(value >> np.uint64(44)).astype(np.int64)]
            row, value = present_features(row[maybe], value[maybe])
            at = np.minimum(np.searchsorted(self.vocabulary, value), len(self.vocabulary) - 1)
            known = self.vocabulary[at] == value
            out += np.bincount(row[known], self.weights[at[known]], minlength=rows)
        return out


def fit(
    examples: list[tuple[np.ndarray, float, float]],
    pairs: list[tuple[np.ndarray, np.ndarray]],
    size: int,
    ridge: float = 0.3,
    fairness: float = 10.0,
    steps: int = 300,
) -> tuple[np.ndarray, float]:
    """Weights and bias: logistic loss, ridge, and the squared change of score over ``pairs``.

    An example is (present features, label, importance); a pair the features only one of a
    sentence and its swapped form has.  Accelerated gradient steps over flat index arrays.
    """
    flat = np.concatenate([e[0] for e in examples] or [np.zeros(0, int)]).astype(np.int64)
    owner = np.repeat(np.arange(len(examples)), [len(e[0]) for e in examples])
    label = np.array([e[1] for e in examples])
    importance = np.array([e[2] for e in examples])
    plus = np.concatenate([p[0] for p in pairs] or [np.zeros(0, int)]).astype(np.int64)
    minus = np.concatenate([p[1] for p in pairs] or [np.zeros(0, int)]).astype(np.int64)
    of_plus = np.repeat(np.arange(len(pairs)), [len(p[0]) for p in pairs])
    of_minus = np.repeat(np.arange(len(pairs)), [len(p[1]) for p in pairs])
    weights, bias, speed, turn = np.zeros(size), 0.0, np.zeros(size), 0.0
    total = importance.sum()
    # per-feature step sizes bound the curvature: the rows a feature shares, times their size
    density = np.bincount(owner, minlength=len(examples))[owner] * importance[owner]
    curve = np.bincount(flat, density, minlength=size) / 4 + ridge
    if pairs:
        many = np.bincount(of_plus, minlength=len(pairs)) + np.bincount(of_minus, minlength=len(pairs))
        curve += fairness * np.bincount(plus, many[of_plus], minlength=size)
        curve += fairness * np.bincount(minus, many[of_minus], minlength=size)
    for k in range(steps):
        ahead, above = weights + speed, bias + turn
        logits = above + np.bincount(owner, ahead[flat], minlength=len(examples))
        error = importance * (1 / (1 + np.exp(-np.clip(logits, -40, 40))) - label)
        slope = np.bincount(flat, error[owner], minlength=size) + ridge * ahead
        if pairs:
            change = np.bincount(of_plus, ahead[plus], minlength=len(pairs))
            change -= np.bincount(of_minus, ahead[minus], minlength=len(pairs))
            slope += fairness * np.bincount(plus, change[of_plus], minlength=size)
            slope -= fairness * np.bincount(minus, change[of_minus], minlength=size)
        momentum = k / (k + 3)
        fresh, base = ahead - slope / curve, above - error.sum() / total
        speed, turn = momentum * (fresh - weights), momentum * (base - bias)
        weights, bias = fresh, base
    return weights, float(bias)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; a null id counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
    sample: int = 8_000,
    features: int = 4_096,
    evidence: float = 12.0,
    identity_terms=IDENTITY_TERMS,
    fairness: float = 10.0,
) -> Model:
    """A model from the labelled rows that are not held out, at most ``sample`` of each label.

    A feature needs a likelihood-ratio statistic of ``evidence``; the ``features`` strongest
    stay.  With one label only, or none, every score is the same.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    marks = (
        labels.select(F.col(id_column).alias("doc_id"), F.col(label_column).cast("int").alias("label"))
        .where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
        .where(~held_out(F.col("doc_id")))
    )
    marks = scratch.keep(marks)
    total = {r.label: r["count"] for r in marks.groupBy("label").count().collect()}
    if len(total) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), {0: -4.0, 1: 4.0}.get(next(iter(total), -1), 0.0))
    chosen = [
        marks.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)
    ]
    chosen = scratch.keep(chosen[0].unionByName(chosen[1]).coalesce(1))
    # at most 2 * sample rows of two numbers
    rows = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"))
    rows = scratch.keep(rows.join(F.broadcast(chosen), "doc_id").repartition("doc_id"))

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy()
            for row, data, offsets in kernel.chunks(batch.column(0)):
                at, value = present_features(*token_features(data, offsets))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(label[row + at])], ["feature", "label"]
                )

    got = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(got) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    counted = rows.select("text", "label").mapInArrow(present, "feature long, label int").groupBy("feature").agg(
        F.sum("label").cast("double").alias("bad"), F.count(F.lit(1)).cast("double").alias("n")
    )

    def term(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    everything = float(got[0] + got[1])
    bad, n = F.col("bad"), F.col("n")
    g2 = 2 * sum(
        term(a, b * c / everything)
        for a, b, c in (
            (bad, n, got[1]), (n - bad, n, got[0]),
            (got[1] - bad, everything - n, got[1]), (got[0] - (n - bad), everything - n, got[0]),
        )
    )
    best = counted.withColumn("g2", g2).where(F.col("g2") >= evidence).orderBy(F.desc("g2"), "feature")
    vocabulary = np.sort(
        np.array([r.feature for r in best.limit(features).select("feature").collect()], np.int64).view(np.uint64)
    )
    if not len(vocabulary):
        return Model(vocabulary, np.zeros(0), float(np.log(total[1] / total[0])))

    def indexed(batches):
        _, pattern = _swapper(identity_terms)

        def known(hashes):
            at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
            return at[vocabulary[at] == hashes].tolist()

        for batch in batches:
            texts = batch.column(0).fill_null("").to_pylist()
            found = [known(x) for x in features_of(texts)]
            changes = []
            for text in texts:
                sentences = swaps(text, identity_terms) if pattern.search(text) else []
                before, after = (features_of([s[k] for s in sentences]) for k in (0, 1))
                changes.append([[sorted(set(known(a)) - set(known(b))), sorted(set(known(b)) - set(known(a)))]
                                for a, b in zip(before, after, strict=True)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(found, pa.list_(pa.int32())),
                    batch.column(1),
                    pa.array(changes, pa.list_(pa.list_(pa.list_(pa.int32())))),
                ],
                ["found", "label", "swaps"],
            )

    # bounded by the sample and the vocabulary
    learned = rows.select("text", "label").mapInArrow(
        indexed, "found array<int>, label int, swaps array<array<array<int>>>"
    )
    learned = sorted((tuple(r.found), r.label, r.swaps) for r in learned.collect())
    share = {k: total[k] / got[k] for k in (0, 1)}
    mean = (share[0] * got[0] + share[1] * got[1]) / (got[0] + got[1])
    examples = [(np.array(f, int), float(y), share[y] / mean) for f, y, _ in learned]
    pairs = [(np.array(a, int), np.array(b, int)) for _, _, s in learned for a, b in s if a or b]
    weights, bias = fit(examples, pairs, len(vocabulary), fairness=fairness)
    return Model(vocabulary, weights, bias)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and score (0 to 1), a row per row; a null text scores like an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            logits = np.zeros(batch.num_rows)
            for row, data, offsets in kernel.chunks(batch.column(1)):
                rows = len(offsets) - 1
                logits[row : row + rows] = model.logits(*token_features(data, offsets), rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(logits, -40, 40))))], ["doc_id", "score"]
            )

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(docs[id_column].alias("doc_id"), docs[text_column].cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, score double")


def classify(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", **training
) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.7 on); a row per row of ``docs``.

    Only ids and labels of ``labels`` and texts of ``docs`` are read; several labels of an id count as
    the highest, null ones not at all.
    """
    model = train(docs, labels, id_column, text_column, **training)
    scored = score(docs, model, id_column, text_column)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
