"""SimHash near-duplicates against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from statuspulse.llm import simhash
from statuspulse.llm.graph import components, local_stars
from statuspulse.llm.common import Scratch

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def print_of(text):
    words = [w.translate(LOWER) for w in WORDS.findall((text or "").encode())]
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute(rows, bits=2):
    prints = {i: print_of(t) for i, t in rows if i is not None}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (f"{p:016x}", find(i)) for i, p in prints.items()}


def test_documents(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice(["a", "Bé", "cc", "d" * 40, "E"]) + str(rng.randrange(40)) for _ in range(150)) for _ in range(12)]
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "One"), (5, "one"), (6, "two Words"), (7, "x" * 5000)]
    for i in range(120):
        words = rng.choice(base).split()
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = "new"
        rows.append((100 + i, " ".join(words)))
    rows.append((100, rows[8][1]))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    want = brute(dict(rows).items())
    for r in got:
        if r.doc_id != 100:
            assert (r.fingerprint, r.component_id) == want[r.doc_id], r
    assert sum(not r.kept for r in got) > 40


def test_empty_and_null_ids(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    got = simhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (5, "a b c"), (None, "zz")], schema))
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got.collect()) == [
        ("5", "5", True), ("None", "5", False), ("None", "None", False),
    ]


@pytest.mark.parametrize("bits", [0, 1, 2, 3])
def test_covering_finds_every_link(bits):
    rng = np.random.default_rng(bits)
    points = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    flipped = points.copy()
    for _ in range(bits):
        flipped ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    home, visits = {}, {}
    for anchor, row, is_home in simhash.anchors_of(points, bits):
        if is_home:
            home.update(zip(row.tolist(), anchor.tolist(), strict=True))
    for anchor, row, _ in simhash.anchors_of(flipped, bits):
        for a, r in zip(anchor.tolist(), row.tolist(), strict=True):
            visits.setdefault(r, set()).add(a)
    assert all(home[i] in visits[i] for i in range(300))


@pytest.mark.parametrize("bits", [1, 2])
def test_large_group_equals_all_pairs(bits):
    rng = np.random.default_rng(7)
    prints = np.unique(np.bitwise_xor.reduce(np.uint64(1) << rng.integers(0, 24, (400, 3), dtype=np.uint64), axis=1))
    a, b = simhash._near_many(prints, bits)
    near = np.argwhere(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= bits)
    want = local_stars(prints[near[:, 0]], prints[near[:, 1]])
    got = local_stars(a, b)
    assert dict(zip(*map(np.ndarray.tolist, got))) == dict(zip(*map(np.ndarray.tolist, want)))


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)]
    edges += [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(7, 7), (None, 3)]
    df = spark.createDataFrame(edges, "x long, y long")
    got = {r.node: r.root for r in components(df, Scratch(spark, "t")).collect()}
    a, b = local_stars(*np.array([e for e in edges if e[0] is not None]).T)
    assert got == dict(zip(a.tolist(), b.tolist()))
