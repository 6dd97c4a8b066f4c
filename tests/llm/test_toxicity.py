"""The toxicity classifier: held-out accuracy, and what the counterfactual term changes."""

import random
import zlib

import numpy as np
import pytest

from statuspulse.llm import toxicity

MODEL_TERMS = (("women", "men"),)


def corpus(seed=1, n=900):
    """Toxic texts hold an insult; of the texts that mention women, most toxic ones do too."""
    rng = random.Random(seed)
    word = lambda: "w" + str(rng.randrange(400))
    docs, labels = [], []
    for k in range(n):
        bad = k % 4 == 0
        words = [word() for _ in range(rng.randrange(20, 60))]
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["Idiotic", "idiots,", "(scumbag)", "moronic"])
        if rng.random() < (0.8 if bad else 0.02):
            words.insert(rng.randrange(len(words)), "women")
        docs.append((k, " ".join(words) + "."))
        labels.append((k, int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    docs = spark.createDataFrame([(i, t, "s", 0.5) for i, t in docs], "doc_id long, text string, source string, score double")
    return docs, spark.createDataFrame([(i, t, 1, "x") for i, t in labels], "doc_id long, toxic int, quality int, lang string")


def test_held_out_accuracy(tables):
    docs, labels = tables
    got = toxicity.classify(docs, labels, identity_terms=MODEL_TERMS).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert sum(r.predicted == r.toxic for r in held) >= 0.97 * len(held)


def test_counterfactual_term(tables, spark):
    """A mention alone raises the score, unless swapping it must not change the score."""
    docs, labels = tables
    probe = spark.createDataFrame([(1, "w1 w2 women w3."), (2, "w1 w2 men w3."), (3, "w1 w2 idiots w3.")], "doc_id long, text string")

    def scores(fairness):
        model = toxicity.train(docs, labels, identity_terms=MODEL_TERMS, fairness=fairness)
        return {r.doc_id: r.score for r in toxicity.score(probe, model).collect()}

    free, fair = scores(0.0), scores(50.0)
    assert free[1] > 4 * free[2]
    assert abs(fair[1] - fair[2]) < 0.1 * abs(free[1] - free[2])
    assert fair[3] > 0.7 > fair[1]


def test_held_out_rows_and_other_columns_do_not_matter(tables, spark):
    from pyspark.sql import functions as F

    docs, labels = tables
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.train(docs, labels), toxicity.train(docs.drop("source", "score"), flipped)
    assert np.array_equal(a.vocabulary, b.vocabulary) and np.allclose(a.weights, b.weights) and np.isclose(a.bias, b.bias)


def test_edges(spark, tables):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 100_000), (None, "a b"), (3, "!!! ---")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.classify(docs, none).collect()
    assert len(got) == 5 and {r.score for r in got} == {0.5} and not any(r.predicted for r in got)
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 7), (4, 0)], "doc_id long, toxic int")
    assert len(toxicity.classify(docs, odd).collect()) == 5
    assert toxicity.classify(docs.limit(0), tables[1]).collect() == []


def test_features_of_long_and_short_words():
    a, b = toxicity.features_of(["Hello, (hello) HELLO!", "--- ... "])
    assert len(a) == 6 and len(b) == 0  # the word, beginnings of 4 and 5, and each twice
    assert toxicity.swaps("Men left. All stay.\nWomen and men!", MODEL_TERMS) == [
        ("Men left.", "women left."), ("Women and men!", "men and women!"),
    ]
