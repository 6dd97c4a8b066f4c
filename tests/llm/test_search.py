"""Ranked search against scores of all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from statuspulse.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m.group().lower(), text or ""))


def direct(items, docs, k=10):
    counted = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n_docs, total = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in set(items):
        asked = Counter(terms(text))
        scored = []
        for id_, c, n in counted:
            m = 100 - 75 + 75 * n * n_docs // total
            score = 0
            for t, times in asked.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += times * w * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, id_ is None, id_))
        scored.sort(key=lambda r: r[:2] if r[1] else r)
        out += [(item, r, row[2], -row[0]) for r, row in enumerate(scored[:k], 1)]
    return out


def corpus(seed, size):
    rng = random.Random(seed)
    words = ["The", "the", "of", "x1", "é", "É", "日本", "a_b", "zz-top", *(f"w{k}" for k in range(60))]
    weights = [30, 30, 20, 9, 5, 5, 3, 3, 3, *(1 + 60 // (k + 1) for k in range(60))]
    docs = [(k, rng.choice([" ", "\n", ", "]).join(rng.choices(words, weights, k=rng.choice([1, 4, 30, 200])))) for k in range(size)]
    copy = docs[0][1]
    docs += [(size + k, copy) for k in range(200)] + [(None, copy), (None, copy), (7, copy), docs[3], docs[3]]
    docs += [(-1, None), (-2, ""), (-3, " ,;\x00"), (-4, "w5 " * 30_000)]
    items = [(k, " ".join(rng.choices(words, weights, k=rng.choice([1, 2, 10, 40])))) for k in range(40)]
    items += [(100, None), (101, ""), (102, "?!"), (103, "absent"), (104, copy), (104, copy), (None, "w5 w5 w7"), (5, "x1")]
    return items, docs


@pytest.mark.parametrize("limits", [(search.TRIE, search.BLOCK_BYTES), (70, 1500)])
def test_against_all_scores(spark, monkeypatch, limits):
    monkeypatch.setattr(search, "TRIE", limits[0])
    items, docs = corpus(13, 600)
    asked = spark.createDataFrame([(*r, 0) for r in items], "item_id int, text string, score int")
    table = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, rank string").repartition(5)
    found = search.rank(asked, table, block_bytes=limits[1])
    assert sorted(map(repr, (tuple(r) for r in found.collect()))) == sorted(map(repr, direct(items, docs)))


def test_other_types_and_empty_tables(spark):
    items, docs = corpus(5, 40)
    items = [(str(i), t) for i, t in items]
    docs = [(f"d{i}", t) for i, t in docs]
    asked = spark.createDataFrame(items, "name string, body string")
    table = spark.createDataFrame(docs, "url string, content string")
    found = search.rank(asked, table, 3, "name", "body", "url", "content")
    assert sorted(tuple(r) for r in found.collect()) == sorted(direct(items, docs, 3))
    assert search.rank(asked.limit(0), table, 3, "name", "body", "url", "content").collect() == []
    assert search.rank(asked, table.limit(0), 3, "name", "body", "url", "content").collect() == []


def test_trie_shares_paths_and_prunes(monkeypatch):
    rng = np.random.default_rng(1)
    rows = [np.flatnonzero(rng.random(50) < 1 / (1 + np.arange(50)) ** 0.5) for _ in range(1500)]
    bounds = np.cumsum([0, *map(len, rows)])
    terms_ = np.concatenate(rows)
    tf = rng.integers(1, 4, len(terms_))
    m = rng.integers(25, 200, 1500)
    trie = search.Trie(bounds, terms_, tf, m, 50)
    leaves = [n for n, below in enumerate(trie.children) if not below]
    assert sorted(r for n in leaves for r in range(trie.low[n], trie.high[n])) == list(range(1500))
    assert all(trie.high[n] - trie.low[n] <= search.LEAF for n in leaves)
    for node, below in enumerate(trie.children):  # a node's figures bound those of all below it
        for child in below:
            assert (trie.most[child] <= trie.most[node]).all() and trie.least_m[child] >= trie.least_m[node]
    visited = []
    whole = search.Trie.leaf
    monkeypatch.setattr(search.Trie, "leaf", lambda self, node, n: visited.append(node) or whole(self, node, n))
    asked = search.Asked.of([b"t45 t49"], {f"t{k}".encode(): k for k in range(50)})
    best = search.Best(1, 10)
    search.search(trie, asked, np.arange(50) * 100, list(range(1500)), best)
    assert len(best.found[0]) == 10 and len(visited) < len(leaves)
