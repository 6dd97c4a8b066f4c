"""Substring deduplication, by words and by bytes, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from statuspulse.llm import repeats, substrings, suffixes

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def covered(rows, window):
    """rows: (id, sequence); by row, whether each symbol is covered."""
    least = {}
    for i, s in rows:
        if i is not None:
            for k in range(len(s) - window + 1):
                least[s[k : k + window]] = min(i, least.get(s[k : k + window], i))
    out = []
    for i, s in rows:
        gone = [False] * len(s)
        for k in range(len(s) - window + 1):
            if i is not None and least[s[k : k + window]] < i:
                gone[k : k + window] = [True] * window
        out.append(gone)
    return out


def by_words(rows, length=13):
    split = [(i, tuple(WORDS.findall((t or "").encode()))) for i, t in rows]
    return sorted(
        (str(i), len(s), sum(g), b" ".join(w for w, x in zip(s, g) if not x).decode())
        for (i, s), g in zip(split, covered(split, length))
    )


def by_bytes(rows, length=50):
    raw = [(i, (t or "").encode()) for i, t in rows]
    return sorted(
        (str(i), len(s), sum(g), sum(x and not y for x, y in zip(g, [False, *g])),
         hashlib.sha256(bytes(c for c, x in zip(s, g) if not x)).hexdigest())
        for (i, s), g in zip(raw, covered(raw, length))
    )


def planted(seed, docs=220):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéü") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [prose(rng.randrange(10, 60)) for _ in range(8)]
    popular = prose(20)
    rows = [(0, None), (1, ""), (2, "one two"), (None, " ".join(passages[0])), (3, "\n \t"), (4, "z" * 400), (5, "z" * 130)]
    for k in range(docs):
        words = prose(rng.randrange(0, 40))
        for _ in range(rng.randrange(3)):
            words += rng.choice(passages)[rng.randrange(5) :] + prose(rng.randrange(10))
        if k % 2:
            words += popular + prose(rng.randrange(12))
        rows.append((10 + k * 7919 % 1009, rng.choice([" ", "  ", "\n"]).join(words)))
    rows += [(3000 + k, rows[20][1]) for k in range(5)] + [rows[30], rows[31]]
    rows.append((4000, " ".join(prose(6000) + passages[1])))
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(t, i, 7, "x") for i, t in rows], "text string, doc_id long, block int, kept string")


@pytest.mark.parametrize("heavy", [64, 3])
def test_words(spark, heavy):
    rows = planted(heavy)
    got = substrings.remove_repeats(frame(spark, rows), heavy=heavy).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == by_words(rows)
    assert sum(r.n_removed for r in got) > 1000


@pytest.mark.parametrize("heavy", [64, 3])
def test_bytes(spark, heavy):
    rows = planted(heavy + 1)
    got = suffixes.remove_repeats(frame(spark, rows), heavy=heavy).collect()
    assert sorted(
        (str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got
    ) == by_bytes(rows)
    assert sum(r.n_removed for r in got) > 5000


def test_other_lengths(spark):
    rows = planted(11, docs=60)
    got = substrings.remove_repeats(frame(spark, rows), length=4).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == by_words(rows, 4)
    got = suffixes.remove_repeats(frame(spark, rows), length=21).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in got) == [x[:3] for x in by_bytes(rows, 21)]


def test_empty_table(spark):
    empty = frame(spark, []).limit(0)
    assert substrings.remove_repeats(empty).collect() == []
    assert suffixes.remove_repeats(empty).collect() == []


def test_suffix_order():
    rng = np.random.default_rng(2)
    content = rng.integers(97, 99, 3000).astype(np.uint8)
    content[500:900] = content[100:500]
    content[2000:2300] = 97
    starts = np.arange(len(content) - 40)
    order, same = suffixes.sort_suffixes(content, starts, 40)
    text = content.tobytes()
    windows = [text[k : k + 40] for k in starts[order]]
    assert windows == sorted(windows)
    assert same.tolist() == [False] + [a == b for a, b in zip(windows, windows[1:])]


def test_collisions_are_verified(monkeypatch):
    """With hashes that always agree, only equal bytes count as equal."""
    content = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz" * 3 + b"abcdefghijklmnopqrstuvwx!!", np.uint8)
    monkeypatch.setattr(suffixes._Suffixes, "equal", lambda self, a, b: np.ones(len(a), bool))
    order, same = suffixes.sort_suffixes(content, np.arange(len(content) - 26), 26)
    text = content.tobytes()
    for k in range(1, len(order)):
        a, b = order[k - 1], order[k]
        if same[k]:
            assert text[a : a + 26] == text[b : b + 26]


def test_automaton_against_search():
    rng = random.Random(5)
    sequences = [[rng.randrange(3) for _ in range(rng.randrange(4, 30))] for _ in range(40)]
    automaton = substrings.Automaton()
    for k, s in enumerate(sequences):
        automaton.add(s, k)
    for k, s in enumerate(sequences):
        mask = automaton.matches(s, 5, k)
        for j in range(len(s) - 4):
            earlier = any(s[j : j + 5] == t[i : i + 5] for t in sequences[:k] for i in range(len(t) - 4))
            assert bool(mask >> j & 1) == earlier


def test_blocks_hold_even_bytes(spark):
    """Neither long documents with neighbouring ids nor rows without an id fill one block."""
    rows = [(k, "a" * (20_000 if k < 50 else 100)) for k in range(1000)]
    rows += [(None, f"{k} " + "b" * 5000) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt, n = repeats.blocked(docs, "doc_id", "text", 60_000, [])
    sizes = [r[1] for r in dealt.selectExpr("block", "octet_length(text) AS size").groupBy("block").sum("size").collect()]
    assert sum(sizes) == sum(len(t) for _, t in rows)
    assert max(sizes) <= 3 * 60_000


def left_of(text, gone):
    """The text without the words flagged: cut with the space after, or at the end of the text before."""
    words = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    out, at, k = "", 0, 0
    while k < len(words):
        if not gone[k]:
            k += 1
            continue
        end = k
        while end < len(words) and gone[end]:
            end += 1
        if end < len(words):
            out, at = out + text[at : words[k].start()], words[end].start()
        else:
            out, at = out + text[at : words[k - 1].end() if k else words[k].start()], words[-1].end()
        k = end
    return out + text[at:]


def test_cleaned_keeps_layout(spark):
    rng = random.Random(21)
    passage = [f"p{k}" for k in range(30)]
    space = lambda: rng.choice([" ", "  ", "\n", "\t", " \r\n", "\x0b"])
    rows = []
    for k in range(60):
        own = [f"é{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 20))]
        cut = rng.randrange(len(own) + 1)
        shared = passage[rng.randrange(10) : rng.randrange(15, 30)] if k % 3 else []
        words = own[:cut] + shared + own[cut:] + (passage if k % 7 == 0 else [])
        rows.append((k, rng.choice(["", "\n "]) + "".join(w + space() for w in words)))
    rows += [(100, None), (101, ""), (102, " \n"), (103, "a\tb\n\nc"), (104, " ".join(passage)), (105, "\n" + "\n".join(passage) + "\n")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, no_text string")
    found = substrings.cleaned(docs)
    assert found.columns == docs.columns
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i, ws in sorted(words.items()):
        for k in range(len(ws) - 12):
            first.setdefault(tuple(ws[k : k + 13]), i)
    want = {}
    for i, t in rows:
        gone = [False] * len(words[i])
        for k in range(len(gone) - 12):
            if first[tuple(words[i][k : k + 13])] < i:
                gone[k : k + 13] = [True] * 13
        want[i] = t if t is None else left_of(t, gone)
    assert {r.doc_id: r.text for r in found.collect()} == want
    assert want[103] == rows[63][1] and want[104] == "" and any("\t" in (t or "") for t in want.values())
