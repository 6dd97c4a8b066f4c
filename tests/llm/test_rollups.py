"""Delta-maintained token counts against a recount from scratch."""

import random

import public_tokenizers
import pytest

from statuspulse.llm import rollups
from statuspulse.session import shared_path
from statuspulse.sources.runs import RunTable, cover

FILES = {"v1": public_tokenizers.path("byte_bpe_50k.tiktoken"), "v2": public_tokenizers.path("byte_bpe_multi_50k.tiktoken")}
SCHEMA = "op string, doc_id long, text string, source string, lang string, version string"


def recount(state):
    out = {}
    for text, source, lang, version in state.values():
        encoder = rollups.tokenizer(FILES[version], public_tokenizers.PATTERN)
        key = (str(source), str(lang), version)
        d, t, c = out.get(key, (0, 0, 0))
        out[key] = d + 1, t + len(encoder.encode_ordinary(text or "")), c + len(text or "")
    return out


def totals(rollup):
    return {(str(r.source), str(r.lang), r.version): (r.documents, r.tokens, r.characters) for r in rollup.totals().collect()}


@pytest.fixture
def rollup(spark):
    return rollups.Rollup(spark, shared_path(spark, "rollup"))


def apply(rollup, batch, changes, version="v1"):
    df = rollup.spark.createDataFrame([(*c, "x") for c in changes], SCHEMA)
    return rollup.apply(batch, df, version, FILES[version], public_tokenizers.PATTERN)


def test_batches(rollup):
    rng = random.Random(0)
    state = {}
    for batch in range(1, 5):
        version = "v1" if batch < 3 else "v2"
        changes = []
        for i in rng.sample(range(30), 18):
            op = rng.choice(["insert", "revise", "delete"])
            text = rng.choice([None, "", "héllo wörld " * rng.randrange(1, 50), f"number {i}", " \n\t"])
            row = (text, rng.choice(["a", "b", None]), rng.choice(["en", "fr"]), version)
            changes.append((op, i, *row[:3]))
            if op == "delete":
                state.pop(i, None)
            else:
                state[i] = row
        changes += [("insert", None, "lost", "a", "en"), ("other", 3, "ignored", "a", "en")]
        assert apply(rollup, batch, changes, version)
        assert totals(rollup) == recount(state)
        assert not apply(rollup, batch, changes, version)  # sent twice
        assert totals(rollup) == recount(state)
    with pytest.raises(ValueError):
        apply(rollup, 0, [], "v1")


def test_batch_that_failed_midway(rollup):
    apply(rollup, 1, [("insert", 1, "one two", "a", "en"), ("insert", 2, "three", "a", "en")])
    before = totals(rollup)
    # counts are written, the delta is not
    rollup.counts.write(rollup.counts.of(1).limit(1), 2)
    assert totals(rollup) == before and rollup.state().count() == 2
    assert apply(rollup, 2, [("delete", 1, None, None, None), ("revise", 2, "three four", "b", "en")])
    assert totals(rollup) == recount({2: ("three four", "b", "en", "v1")})


def test_several_changes_of_a_document(rollup):
    apply(rollup, 1, [("delete", 1, None, "a", "en"), ("insert", 1, "x", "a", "en"), ("revise", 1, "x y z", "a", "en"), ("insert", 2, "b", "a", "en"), ("insert", 2, "b", "a", "en")])
    assert totals(rollup) == recount({1: ("x y z", "a", "en", "v1"), 2: ("b", "a", "en", "v1")})


def test_logs_are_merged_and_batches_stay_known(rollup, monkeypatch):
    """Twenty batches, some numbers left out, one lost between its commit and the merges."""
    monkeypatch.setattr(RunTable, "fanout", 2)
    monkeypatch.setattr(RunTable.__init__, "__defaults__", tuple(2 if d == 8 else d for d in RunTable.__init__.__defaults__))
    rng, state = random.Random(1), {}
    numbers = [n for n in range(20) if n % 5]
    for batch in numbers:
        changes = []
        for i in rng.sample(range(6), 3):
            op = rng.choice(["insert", "revise", "delete"])
            row = ("word " * rng.randrange(1, 9), rng.choice("ab"), "en", "v1")
            changes.append((op, i, *row[:3]))
            if op == "delete":
                state.pop(i, None)
            else:
                state[i] = row
        if batch == 11:
            with monkeypatch.context() as lost, pytest.raises(ZeroDivisionError):
                lost.setattr(RunTable, "settle", lambda *_: 1 // (_[1] != 11))
                apply(rollup, batch, changes)
        else:
            assert apply(rollup, batch, changes)
        assert totals(rollup) == recount(state)
        assert rollup.state().count() == len(state)
    assert rollup.committed() == set(numbers)
    assert not any(apply(rollup, batch, [("insert", 1, "again", "a", "en")]) for batch in (1, 11, 19))
    assert totals(rollup) == recount(state)
    for log in (rollup.counts, rollup.deltas):
        assert len(cover(log.runs(), 2)) <= 2
        assert len(log.runs()) < len(numbers)


def test_empty(rollup):
    assert totals(rollup) == {}
    assert apply(rollup, 1, []) and totals(rollup) == {}


def test_very_long_texts_and_other_columns(rollup):
    long = "a word, " * 300_000
    rows = [("insert", 1, long, "a", "en", "x", 1), ("insert", 2, "", "a", "en", "y", 2), ("insert", 3, None, "a", "en", "y", 3)]
    df = rollup.spark.createDataFrame(rows, SCHEMA + ", tokens int")
    assert rollup.apply(0, df, "v1", FILES["v1"], public_tokenizers.PATTERN)
    state = {1: (long, "a", "en", "v1"), 2: ("", "a", "en", "v1"), 3: (None, "a", "en", "v1")}
    assert totals(rollup) == recount(state)
