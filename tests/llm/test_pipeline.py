"""The pipeline: stages keep columns and rows as told, and run() equals the stages by hand."""

import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SF_DIR
from test_repeats import by_words
from test_simhash import brute


def corpus(spark, extra=True):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice(["th", "er", "in", "on", "ea"]) for _ in range(rng.randrange(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = prose(60)
    rows = [(k, prose(rng.randrange(30, 90)), "en", f"src{k % 3}") for k in range(80)]
    rows += [(100 + k, rows[k][1], "en", "src1") for k in range(20)]
    rows += [(200 + k, prose(20) + " " + passage + " " + prose(20), None, None) for k in range(10)]
    rows += [(300, None, "en", "src0"), (301, "", "en", "src0"), (302, "1 2 3", None, None), (None, prose(40), "en", "src1")]
    rows += [rows[3], rows[3]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, fp long, `kept.x` string, lid_lang string"
    return rows, spark.createDataFrame([(*r, len(r[1] or ""), 5, "k", "l") for r in rows], schema)


def test_stages_by_hand(spark):
    rows, docs = corpus(spark)
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, None).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "fp", "kept.x", "lid_lang"]
        after[name] = [(r.doc_id, r.text, r.n_chars) for r in docs.collect()]
    letters = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert sorted(map(str, ((r[0], r[1]) for r in letters))) == sorted(map(str, ((i, t) for i, t, _ in after["language"])))
    groups = brute([(r[0], r[1]) for r in letters])
    null = next(r for r in letters if r[0] is None)
    kept = {i for i, (_, c) in groups.items() if i == c}
    got = [i for i, _, _ in after["near_copies"]]
    assert sorted(i for i in got if i is not None) == sorted(kept) and got.count(None) == 1
    texts = {(i, t) for i, t, _ in after["near_copies"]}
    assert (None, null[1]) in texts
    want = {i: k for i, _, _, k in by_words(list(texts))}
    assert {str(i): t for i, t, _ in after["passages"]} == want
    assert all(n == len(t) for _, t, n in after["passages"])
    assert {i for i, _, _ in after["mix"]} <= {i for i, _, _ in after["passages"]}


def test_run(spark):
    got = entry.queries()["pipeline"](spark, SF_DIR)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF_DIR)
    key = lambda r: (r.doc_id, tuple(r.pieces), r.score)
    assert sorted(map(key, got.collect())) == sorted(map(key, docs.collect()))
    assert all(r.round_trip for r in got.collect())


def test_empty(spark):
    _, docs = corpus(spark)
    docs = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, None)
    assert docs.collect() == []


def test_contract():
    assert [n for n in entry.queries() if n.startswith("op")] == sorted(
        (n for n in entry.queries() if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0])
    )
    assert {int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op")} == set(range(1, 14))


@pytest.mark.parametrize("name", [n for n in entry.queries() if n.startswith("op")])
def test_registered_query_runs_over_the_whole_table(spark, name):
    found = entry.queries()[name](spark, SF_DIR)
    table = {"op1_": "embeddings", "op12": "pages"}.get(name[:4], "documents")
    if name.startswith(("op9_", "op13_")):
        assert found.count() > 0
    else:
        assert found.count() == spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
