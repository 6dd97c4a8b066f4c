"""Fill-in-the-middle against a direct cut of the list of tokens."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuspulse.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def direct(id_, text, rate=50, spm_rate=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if id_ is None else id_}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return id_, len(units), "plain", None, None, text, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(units[s]) for s in (slice(0, a), slice(a, b), slice(b, None)))
    if h[3] % 100 < spm_rate:
        return id_, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return id_, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def corpus():
    rng = random.Random(11)
    pieces = ["a", "word", "é", "日本語", "\U0001f600", "<", "<P", ">", "P>", "\x00", "\x1f", "\u00a0", "\x85"]
    spaces = [" ", "  ", "\t", "\n", "\r\n", "\x0b\x0c"]
    rows = []
    for k in range(300):
        parts = [rng.choice(pieces) + rng.choice(["", rng.choice(spaces)]) for _ in range(rng.choice([1, 3, 20, 200]))]
        rows.append((k, rng.choice(["", " ", "\n"]) + "".join(parts)))
    rows += [(1000 + k, t) for k, t in enumerate([None, "", " ", "\n\t ", "one", " <P> ", "a<S>b", "x <M>", "a " * 40_000, "z" * 90_000])]
    rows += [(None, "no id here"), (None, "no id here"), (None, None), rows[0], rows[0], rows[5], (-3, "minus three words")]
    return rows


@pytest.mark.parametrize("rate", [50, 100])
def test_against_direct_cuts(spark, rate):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in rows], "doc_id long, text string, form string, n int")
    found = fim.transform(docs, rate=rate)
    found = found.withColumn("restored", fim.restore(F.col("output"), F.col("form")))
    expected = [direct(i, t, rate) for i, t in rows]
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, expected))


def test_text_ids_and_an_empty_table(spark):
    docs = spark.createDataFrame([("k-1", "a b c d e f")], "name string, body string")
    row = fim.transform(docs, "name", "body", rate=100).first()
    assert tuple(row) == direct("k-1", "a b c d e f", 100)[:6]
    assert fim.transform(docs.limit(0), "name", "body").collect() == []


def test_skip_list_reaches_every_rank():
    rng = random.Random(3)
    for size in [0, 1, 2, 5, 30, 700]:
        sizes = np.array([rng.randrange(1, 9) for _ in range(size)], np.int64)
        ranks = fim.SkipList(sizes)
        assert [ranks.code_points(r) for r in range(size + 1)] == [0, *np.cumsum(sizes).tolist()]
        assert all((units > 0).all() and units.sum() == size + 1 for _, units, _ in ranks.lanes)
    assert len(fim.SkipList(np.ones(5000, np.int64)).lanes) > 3
