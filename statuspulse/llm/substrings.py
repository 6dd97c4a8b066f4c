"""Word-level substring deduplication by suffix automata of reference shards.

The exchange of ``repeats`` deals the distinct stretches of text that may share a window into
shards by a hash of their anchors.  A shard's stretches are its reference: a generalised suffix
automaton is built from them, every state with the least id of a document it stands in, and the
stretches are streamed through it.  The matching statistics say, at each word, how long the
longest match that ends there is; where it reaches the threshold, the state of that length
tells whether a smaller id has it, and the union of such windows is the maximal span removed.
A shard goes to the task that streams what can match it, instead of to every executor, as the
references of a corpus grow with it and have no bound that would allow a broadcast.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuspulse.llm import kernel, repeats
from statuspulse.llm.common import free_name


class Automaton:
    """Suffix automaton of several word sequences, added in the order of their ids."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        self.least: list[int | None] = [None]

    def _clone(self, state: int, parent: int, word: int) -> int:
        """A copy of ``state`` for the shorter sequences that reach it from ``parent``."""
        step, link = self.step, self.link
        copy = len(step)
        step.append(dict(step[state]))
        link.append(link[state])
        self.size.append(self.size[parent] + 1)
        self.least.append(self.least[state])
        link[state] = copy
        while parent >= 0 and step[parent].get(word) == state:
            step[parent][word] = copy
            parent = link[parent]
        return copy

    def add(self, words: list[int], number: int) -> None:
        step, link, size, least = self.step, self.link, self.size, self.least
        last = 0
        for word in words:
            known = step[last].get(word)
            if known is not None:
                if size[known] != size[last] + 1:
                    known = self._clone(known, last, word)
                last = known
                continue
            fresh = len(step)
            step.append({})
            size.append(size[last] + 1)
            link.append(0)
            least.append(number)
            parent = last
            while parent >= 0 and word not in step[parent]:
                step[parent][word] = fresh
                parent = link[parent]
            if parent >= 0:
                other = step[parent][word]
                link[fresh] = other if size[other] == size[parent] + 1 else self._clone(other, parent, word)
            last = fresh

    def matches(self, words: list[int], length: int, number: int) -> int:
        """Bit j is set if words[j:j+length] also stand in a sequence of a smaller number.

        Sequences were added by ascending number, so a state's first visitor has the least.
        """
        step, link, size, least = self.step, self.link, self.size, self.least
        state, matched, out = 0, 0, 0
        for at, word in enumerate(words):
            while state and word not in step[state]:
                state = link[state]
                matched = size[state]
            after = step[state].get(word)
            if after is None:
                matched = 0
                continue
            state, matched = after, matched + 1
            while size[link[state]] >= length:
                state = link[state]
                matched = size[state]
            if matched >= length and least[state] < number:
                out |= 1 << (at + 1 - length)
        return out


def _matcher(length: int):
    def match(words: np.ndarray, bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
        masks = np.zeros(len(ids), np.uint64)
        order = np.argsort(ids, kind="stable")
        sequences = [words[bounds[k] : bounds[k + 1]].tolist() for k in order]
        numbers = ids[order].tolist()
        automaton = Automaton()
        for sequence, number in zip(sequences, numbers, strict=True):
            automaton.add(sequence, number)
        for k, sequence, number in zip(order, sequences, numbers, strict=True):
            masks[k] = automaton.matches(sequence, length, number)
        return masks

    return match


def _words(data: np.ndarray, offsets: np.ndarray):
    starts, ends, bounds = kernel.words(data, offsets)
    return kernel.word_hashes(data, starts, ends), bounds, (starts, ends)


def _finish(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray, bounds: np.ndarray, extra) -> dict:
    starts, ends = extra
    total = np.concatenate([[0], np.cumsum(gone)])
    joined, begin = kernel.joined_words(data, starts[~gone], ends[~gone], lower=False)
    text = joined.tobytes()
    begin = np.append(begin, len(joined))
    removed = np.diff(total[bounds])
    cuts = begin[bounds - total[bounds]]
    kept = [text[a : max(a, b - 1)] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return {
        "n_words": pa.array(np.diff(bounds)),
        "n_removed": pa.array(removed),
        "kept": pa.array(kept, pa.binary()).cast(pa.string()),
    }


def _finish_text(data: np.ndarray, offsets: np.ndarray, gone: np.ndarray, bounds: np.ndarray, extra) -> dict:
    """What is left of the text itself.  A removed run of words takes the space after it along, and
    the one before it at the end of the text."""
    starts, ends = extra
    total = np.concatenate([[0], np.cumsum(gone)])
    first = np.zeros(len(starts), bool)
    first[bounds[:-1][np.diff(bounds) > 0]] = True
    last = np.append(first[1:], True)[: len(starts)]
    kept_at = np.where(gone, -1, np.arange(len(starts)))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    last_kept = np.full(len(bounds) - 1, -1, np.int64)
    np.maximum.at(last_kept, owner, kept_at)
    at_end = np.arange(len(starts)) > last_kept[owner]
    begin = np.where(at_end & ~first, np.concatenate([[0], ends[:-1]])[: len(starts)], starts)
    stop = np.where(at_end | last, ends, np.append(starts[1:], 0)[: len(starts)])
    cut = np.zeros(len(data) + 1, np.int32)
    np.add.at(cut, begin[gone], 1)
    np.add.at(cut, stop[gone], -1)
    left = np.cumsum(cut[:-1]) == 0
    ends_left = np.concatenate([[0], np.cumsum(left)])[offsets]
    kept = data[left].tobytes()
    return {
        "n_words": pa.array(np.diff(bounds)),
        "n_removed": pa.array(np.diff(total[bounds])),
        "kept": pa.array([kept[a:b] for a, b in zip(ends_left[:-1], ends_left[1:])], pa.binary()).cast(pa.string()),
    }


def remove_repeats(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = 13,
    heavy: int = 64,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept (what is left, joined by spaces); a row per row of ``docs``.

    Removes every word covered by ``length`` consecutive words that also start in a row with a
    smaller id, judged on the input.  Null texts have no words; rows with one id do not affect
    one another; a row without an id is left as it is and affects none; other columns are
    ignored.  ``heavy`` only decides how popular passages travel, not the result.
    """
    return repeats.mark(docs, id_column, text_column, _unit(length, heavy)).drop("rest")


def cleaned(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length: int = 13,
    heavy: int = 64,
) -> DataFrame:
    """``docs`` without the words that ``remove_repeats`` removes; all else as it was.

    A text nothing is removed of stays as it is, null too; of others the removed runs of words are
    cut, with the space after them (before them at the end of the text), and line breaks, tabs and
    repeated spaces elsewhere stay.
    """
    others = tuple(c for c in docs.columns if c != text_column)
    empty = free_name(docs, "no_text")
    marked = docs.withColumn(empty, docs[text_column].isNull())
    unit = replace(_unit(length, heavy), finish=_finish_text)
    done = repeats.mark(marked, id_column, text_column, unit, carried=(*others, empty))
    place = {c: F.col(f"rest.c{k}") for k, c in enumerate((*others, empty))}
    text = F.when(~place[empty], F.col("kept"))
    return done.select(*((text if c == text_column else place[c]).alias(c) for c in docs.columns))


def _unit(length: int, heavy: int) -> repeats.Unit:
    return repeats.Unit(
        window=length,
        gram=length // 2 + 1,
        reader=_words,
        content=lambda symbols, data, extra: symbols,
        width=np.uint64,
        matcher=_matcher(length),
        finish=_finish,
        schema="n_words long, n_removed long, kept string",
        heavy=heavy,
    )
