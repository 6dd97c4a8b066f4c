"""Text statistics against brute force, and learning a planted rule."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from statuspulse.llm import quality
from statuspulse.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for k, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(k, k + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def texts():
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["ab", "cd", "éé", "𝔘x", "e,", "f|"]) + str(rng.randrange(30)) for _ in range(n))
    out = [None, "", " \t\n", "one", "a\nb\na\n \n \na", "x " * 7, "x " * 8, "x " * 9, "<#*$%&|>" * 3]
    for _ in range(60):
        part = prose(rng.randrange(1, 40))
        out.append(rng.choice(["\n", " ", "\x0b"]).join([prose(rng.randrange(30)), part, prose(rng.randrange(12)), rng.choice([part, ""])]))
    out.append(prose(20_000) + " " + " ".join(["same"] * 5000))
    return out


def test_statistics(spark):
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts())] + [(1, "x"), (1, "x")]
    df = spark.createDataFrame([(i, t, 5, "w") for i, t in rows], "doc_id long, text string, n_words int, windows string")
    got = quality.statistics(df, "doc_id", "text", Scratch(spark, "q")).collect()
    found = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert found == sorted((str(i), *counts(t)) for i, t in rows)


def test_learns_planted_rule(spark):
    rng = random.Random(2)
    rows = [(i, float(rng.randrange(100)), float(rng.randrange(100))) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, x double, y double")
    bad = (F.col("x") >= 80) & (F.col("y") < 30) | (F.col("x") < 5)
    rules = quality.learn(df, bad.cast("int"), ("x", "y"), precision=0.9)
    out = df.select(rules.rejects().alias("said"), bad.alias("bad"), rules.reason().alias("reason"))
    right = out.where("said = bad").count()
    assert right >= 3900
    assert out.where("said <> (reason IS NOT NULL)").count() == 0


def test_assess(spark):
    rng = random.Random(3)
    words = lambda n: " ".join("w" + str(rng.randrange(1000)) for _ in range(n))
    docs, labels = [(900, None), (901, "few words"), (902, "a b c d e f g h " * 9)], []
    for k in range(400):
        junk = k % 4 == 0
        docs.append((k, " ".join(w + "$$#" for w in words(40).split()) if junk else words(40)))
        labels.append((k, 0 if junk else 1, None))
    labels += [(5, 1, None), (7, None, None), (None, 0, None), (99999, 0, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    l = spark.createDataFrame(labels, "doc_id long, quality int, kept int")  # noqa: E741
    got = {r.doc_id: r for r in quality.assess(d, l).collect()}
    assert len(got) == len(docs)
    assert all(got[k].kept == bool(k % 4) for k in range(400))
    assert [got[k].base_failed for k in (900, 901, 902)] == [True] * 3
    none = quality.assess(d, l.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) and r.reason is None for r in none)
    assert quality.assess(d.limit(0), l).collect() == []
