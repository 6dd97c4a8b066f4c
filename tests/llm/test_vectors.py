"""The random-projection forest against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuspulse.llm import vectors
from statuspulse.llm.graph import local_stars


def brute(ids, labels, rows, least=0.93):
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = (unit @ unit.T >= least) & (labels[:, None] == labels[None, :])
    i, j = np.nonzero(np.triu(near, 1))
    root = np.arange(len(ids))
    node, top = local_stars(i, j)
    root[node] = top
    return near.sum(1) - 1, ids[root]


def planted(n=1500, dims=24, seed=0):
    rng = np.random.default_rng(seed)
    rows = rng.standard_normal((n, dims))
    rows[200:500] = rows[rng.integers(0, 60, 300)] + 0.12 * rng.standard_normal((300, dims))
    rows[500:700] = rows[3]  # copies
    labels = rng.choice([1, 1, 1, 2, 3], n)
    labels[500:650] = 1
    return np.arange(n) * 3, labels, rows.astype(np.float32).astype(float)


SCHEMA = "vec_id long, embedding array<float>, label int, key string, n int"


def frame(spark, ids, labels, rows):
    return spark.createDataFrame(
        [(int(i), [float(x) for x in v], int(l), "k", 4) for i, l, v in zip(ids, labels, rows)], SCHEMA
    )


def test_links_components_recall(spark):
    ids, labels, rows = planted()
    want, component = brute(ids, labels, rows)
    got = {r.vec_id: r for r in vectors.near_duplicates(frame(spark, ids, labels, rows), leaf=64).collect()}
    links = np.array([got[i].n_links for i in ids])
    assert (links <= want).all() and links.sum() >= 0.97 * want.sum()
    found = np.array([got[i].component_id for i in ids])
    assert (found == component).mean() > 0.98 and (found >= component).all()
    assert all(got[i].kept == (got[i].component_id == i) for i in ids.tolist())


def test_leaf_that_cannot_be_split(spark):
    """Small leaves find nearly all; one leaf for all, cut into blocks or not, loses nothing."""
    ids, labels, rows = planted(720, seed=4)
    want, component = brute(ids, labels, rows)
    df = frame(spark, ids, labels, rows)
    got = {r.vec_id: r for r in vectors.near_duplicates(df, leaf=20, trees=12, overlap=0.1).collect()}
    assert np.array([got[i].n_links for i in ids]).sum() >= 0.97 * want.sum()
    exact = {r.vec_id: r for r in vectors.near_duplicates(df, leaf=10_000, trees=1).collect()}
    assert [exact[i].n_links for i in ids] == want.tolist()
    assert [exact[i].component_id for i in ids] == component.tolist()


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, -0.0], 1), (6, [nan, 1.0], 1),
        (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (11, [1.0, 0.0], 2), (12, [1.0, 0.0], 1),
        (12, [1.0, 0.0], 1), (None, [5.0, 0.1], 1), (13, [3e38, 0.0], 1), (14, [1e-40, 0.0], 1),
    ]
    got = vectors.near_duplicates(spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got}
    assert {(1, 6, 1, True), (2, 6, 1, False), (12, 6, 1, False), (13, 6, 1, False), (14, 6, 1, False), (None, 6, 1, False)} <= by
    assert {(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11)} <= by


def test_empty_table(spark):
    assert vectors.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def near_equal(kind, n, dims=24, seed=5):
    rng = np.random.default_rng(seed)
    one = rng.standard_normal(dims)
    if kind == "multiples":
        return one * rng.uniform(0.1, 9.0, (n, 1))
    if kind == "bridge":  # two tight clusters about the linking angle apart
        two = rng.standard_normal(dims)
        one, two = one / np.linalg.norm(one), two - one * (two @ one) / (one @ one)
        two = one * 0.93 + two / np.linalg.norm(two) * np.sqrt(1 - 0.93**2)
        return np.where(np.arange(n)[:, None] % 2 == 0, one, two) + 0.004 * rng.standard_normal((n, dims))
    return one + float(kind) * rng.standard_normal((n, dims))


@pytest.mark.parametrize("kind", ["multiples", "0.04", "bridge"])
def test_near_equal_vectors_lose_no_link(spark, kind):
    """Beyond the leaf size, with other vectors around; the links are those of all pairs."""
    rng = np.random.default_rng(1)
    rows = np.concatenate([near_equal(kind, 700), rng.standard_normal((200, 24))]).astype(np.float32).astype(float)
    ids, labels = rng.permutation(len(rows)), np.ones(len(rows), int)
    want, component = brute(ids, labels, rows)
    got = {r.vec_id: r for r in vectors.near_duplicates(frame(spark, ids, labels, rows), leaf=64).collect()}
    links = np.array([got[i].n_links for i in ids.tolist()])
    assert (links <= want).all() and links.sum() >= 0.99 * want.sum()
    assert want.max() > 300 and len({got[i].component_id for i in ids.tolist()}) >= len(set(component.tolist()))


def test_near_equal_vectors_do_not_multiply(spark):
    """The forest without the cells before it: ties end a node, and what is near parts as what is far."""
    for kind in ("multiples", "1e-8"):
        rows = [(i, v.tolist(), 1) for i, v in enumerate(near_equal(kind, 1200))]
        points = spark.createDataFrame(rows, "key long, vector array<double>, label int")
        scratch = vectors.Scratch(spark, "ties")
        leaves = vectors.forest(points, 3, 100, 0.1, 3, scratch)
        assert leaves.count() <= 3 * 1200 * 1.24**8
        cells, of = vectors.contract(points.withColumn("n", F.lit(1).cast("long")), 0.09, 100, 3, scratch)
        assert cells.count() <= 12 and of.select("key").distinct().count() == 1200
