"""Mixing by systematic sampling against a direct computation."""

import hashlib
import math
import random
import re

import pytest

from statuspulse.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def waterfill(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Deal and reshare until no target is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        left = total - sum(fixed.values())
        each = left / sum(weight[s] for s in free)
        above = [s for s in free if each * weight[s] > most * sizes[s]]
        if not above:
            return fixed | {s: each * weight[s] for s in free}
        fixed |= {s: most * sizes[s] for s in above}


def expected(rows):
    sized = [(i, s, len(WORD.findall(t or ""))) for i, s, t in rows]
    sizes = {}
    for _, s, n in sized:
        sizes[s] = sizes.get(s, 0) + n
    aims = waterfill(sizes)
    out = []
    for source, aim in aims.items():
        own = [(n, hashlib.md5(("" if i is None else str(i)).encode()).hexdigest(), i) for i, s, n in sized if s == source]
        own.sort(key=lambda x: x[:2])
        name = "mix|" + ("" if source is None else "=" + source)
        offset = int(hashlib.md5(name.encode()).hexdigest()[:5], 16) / (1 << 20)
        each = aim / sizes[source] if sizes[source] else 0.0
        for k, (n, _, i) in enumerate(own):
            copies = math.floor(offset + each * (k + 1)) - math.floor(offset + each * k)
            out.append((str(i), str(source), n, sizes[source], round(aim, 6), min(copies, 2) * n))
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    sources = ["a", "b", "é", "Z", "zz", None, "empty", "tiny"]
    rows = []
    for k in range(n):
        source = rng.choice(["a", "a", "a", *sources[:6]])
        rows.append((k, source, " ".join("w" * rng.randrange(1, 5) for _ in range(rng.choice([1, 5, 5, 30, 300])))))
    rows += [(n, "empty", None), (n + 1, "empty", ""), (n + 2, "tiny", "one"), (None, "a", "x y z"), (None, None, " \n")]
    return [*rows, rows[0], rows[0]]


@pytest.mark.parametrize("bucket", [1_000, 5])
def test_mix(spark, bucket, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    rows = corpus(bucket, 400)
    df = spark.createDataFrame([(i, s, t, 1.0) for i, s, t in rows], "doc_id long, source string, text string, target double")
    got = mixing.mix(df).collect()
    assert sorted(
        (str(r.doc_id), str(r.source), r.size, r.source_size, round(r.target, 6), r.taken) for r in got
    ) == expected(rows)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * max(r.size for r in own)


def test_emit(spark):
    rows = corpus(4, 120)
    df = spark.createDataFrame([(i, s, t, "c") for i, s, t in rows], "doc_id long, source string, text string, copy string")
    want = {}
    for r in mixing.mix(df).collect():
        want[r.doc_id, r.source, r.size] = want.get((r.doc_id, r.source, r.size), 0) + r.copies
    out = mixing.emit(df)
    assert out.columns == df.columns
    got = {}
    for r in out.collect():
        key = r.doc_id, r.source, len(WORD.findall(r.text or ""))
        got[key] = got.get(key, 0) + 1
    assert got == {k: v for k, v in want.items() if v}


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mix(df).collect() == [] and mixing.emit(df).collect() == []
