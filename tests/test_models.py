"""Forests as tables of nodes, and the registry of per-outlet models."""

from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from statuspulse.operators import forecast, registry, trees
from statuspulse.params import Settings

SMALL = replace(Settings(slot_minutes=60), forest_trees=7, forest_depth=5)


def _counts(spark):
    """A count that depends on the slot of the week, with some noise."""
    rows = forecast.week_grid(spark.range(5).withColumnRenamed("id", "week"), settings=SMALL)
    noise = F.pmod(F.xxhash64("week", "week_ordinal"), F.lit(3))
    return rows.withColumn("avail_count", F.when(F.col("hour") < 8, 0).otherwise(F.col("dow") % 4 + noise))


def test_walk_equals_the_model(spark, tmp_path):
    rows = forecast.training_rows(_counts(spark))
    model = forecast.train_forest(rows, settings=SMALL)
    nodes = trees.save_nodes(model, str(tmp_path))
    assert nodes.select("tree").distinct().count() == 7
    assert nodes.where((F.col("left") < 0) != F.col("feature").isNull()).count() == 0
    grid = forecast.assemble(forecast.training_rows(_counts(spark).where("week = 0")))
    grid = grid.select("week_ordinal", "features")
    expected = model.transform(grid).select("week_ordinal", "prediction", vector_to_array("probability").alias("p"))
    walked = trees.walk(grid, nodes, key=["week_ordinal"])
    got = {r.week_ordinal: (r.prediction, r.probability) for r in walked.collect()}
    assert got == {r.week_ordinal: (r.prediction, r.p) for r in expected.collect()}
    assert len(got) == 7 * 24 and len({p for p, _ in got.values()}) > 2


def test_nodes_too_many_to_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trees, "BROADCAST_NODES", 0)
    rows = forecast.training_rows(_counts(spark))
    model = forecast.train_forest(rows, settings=replace(SMALL, forest_trees=2, forest_depth=2))
    nodes = trees.save_nodes(model, str(tmp_path))
    grid = forecast.assemble(rows.where("week = 1")).select("week_ordinal", "features")
    expected = {r.week_ordinal: r.prediction for r in model.transform(grid).collect()}
    assert {r.week_ordinal: r.prediction for r in trees.walk(grid, nodes, key=["week_ordinal"]).collect()} == expected


def _outlets(spark):
    """Each outlet is available in its own hours: a rule no model without ids can learn."""
    ids = spark.createDataFrame(
        [(f"station-{d}", f"outlet_{o}", 3 * d + o) for d in range(4) for o in (1, 2)], "device_id string, outlet_id string, own int"
    )
    rows = forecast.week_grid(ids, settings=SMALL)
    code = F.when((F.col("hour") - F.col("own")).between(0, 5), 1).when(F.col("own") % 2 == 0, 2).otherwise(0)
    return rows.withColumn("status_code", code)


@pytest.fixture(scope="module")
def registered(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("models"))
    deep = replace(SMALL, forest_trees=10, forest_depth=12)
    rows = _outlets(spark)
    first = registry.train(rows.where("own < 5"), settings=SMALL)
    registry.save(first, spark, root, trained_at=datetime(2024, 5, 1), readings=1)
    model = registry.train(rows, settings=deep)
    version = registry.save(model, spark, root, trained_at=datetime(2024, 5, 2), readings=rows.count())
    return root, rows, model, version


def test_outlets_keep_their_own_rule(spark, registered):
    root, rows, model, version = registered
    assert version.number == 2
    scored = registry.score(registry.load(spark, root), rows)
    assert scored.columns[: len(rows.columns)] == rows.columns
    named = F.when(F.col("status_code") == 1, "available").when(F.col("status_code") == 2, "in_use").otherwise("unknown")
    assert scored.where(F.col("predicted_status") != named).count() == 0
    total = F.col("prob_unknown") + F.col("prob_available") + F.col("prob_in_use")
    assert scored.where(F.abs(total - 1) > 1e-9).count() == 0
    again = registry.score(model, rows)
    assert sorted(map(repr, scored.collect())) == sorted(map(repr, again.collect()))


def test_unknown_and_null_ids_are_scored(spark, registered):
    root, *_ = registered
    odd = spark.createDataFrame(
        [("station-0", "outlet_1", 2, 3, 0), ("new one", "outlet_9", 2, 3, 0), (None, None, 2, 3, 0)],
        "device_id string, outlet_id string, dow int, hour int, slot int",
    )
    scored = registry.score(registry.load(spark, root), odd).collect()
    assert len(scored) == 3 and all(abs(r.prob_unknown + r.prob_available + r.prob_in_use - 1) < 1e-9 for r in scored)


def test_versions(spark, registered):
    root, *_ = registered
    listed = {r.version: r for r in registry.versions(spark, root).collect()}
    assert sorted(listed) == [1, 2] and listed[2].ids == ["device_id", "outlet_id"] and listed[2].classes == 3
    assert len(registry.load(spark, root, version=1).stages[0].labelsArray[0]) == 2
    with pytest.raises(LookupError):
        registry.load(spark, root, version=3)
    with pytest.raises(LookupError):
        registry.load(spark, root + "/nowhere")


def _site_counts(spark, sites, scale=1):
    """Sites of several sizes with their own busy hours, ten weeks, some noise."""
    weeks = spark.range(10).withColumnRenamed("id", "week")
    ids = [(f"site {k}", (k % 5 + 1) * scale, 2 * k % 24) for k in range(sites)]
    rows = spark.createDataFrame(ids, "site_id string, size int, busy int").join(weeks)
    rows = forecast.week_grid(rows, settings=SMALL)
    noise = F.pmod(F.xxhash64("site_id", "week", "week_ordinal"), F.lit(3)) * scale
    count = F.when(F.col("hour").between(F.col("busy"), F.col("busy") + 5), noise).otherwise(F.col("size") * 4 + noise)
    return rows.withColumn("avail_count", count.cast("long"))


def test_one_count_forest_for_all_sites(spark):
    """Held-out error no worse than the baseline's; a site's own hours are found; all hours of a new site are 0."""
    rows = _site_counts(spark, 12).persist()
    early, late = rows.where("week < 3"), rows.where("week >= 3")
    deep = replace(SMALL, forest_trees=15, forest_depth=10)
    model, levels = forecast.train_sites(early, settings=deep)
    assert levels.count() == 12 * 24
    scored = forecast.predict_sites(model, levels, late)
    assert set(scored.columns) >= {"site_id", "dow", "hour", "slot", "countavailable"}
    usual = forecast.weekly_profile(early, settings=SMALL).select(
        "site_id", "dow", "hour", "slot", F.col("countavailable").alias("usual")
    )
    own, base = (
        scored.join(usual, ["site_id", "dow", "hour", "slot"])
        .agg(*(F.avg(F.pow(F.col("avail_count") - F.col(c), F.lit(2))) for c in ("countavailable", "usual")))
        .first()
    )
    assert own <= base
    odd = spark.createDataFrame([("site 1", 1, 30, 0), ("new", 1, 3, 0), (None, 1, 3, 0)], "site_id string, dow int, hour int, slot int")
    found = {r.site_id: r.countavailable for r in forecast.predict_sites(model, levels, odd).collect()}
    assert set(found) == {"site 1", "new", None}
    rows.unpersist()


def test_nodes_do_not_grow_with_the_counts(spark):
    """Counts a thousand times as large make as many nodes, and predictions as many times as large.

    Where two splits are equally good, rounding may choose another.
    """
    few, many = (_site_counts(spark, 3, scale) for scale in (1, 1000))
    models = [forecast.train_sites(rows.where("week < 2"), settings=SMALL) for rows in (few, many)]
    assert len({model.totalNumNodes for model, _ in models}) == 1
    a, b = (
        {(r.site_id, r.week_ordinal): r.prediction for r in forecast.predict_sites(*model, rows.where("week = 0")).collect()}
        for model, rows in zip(models, (few, many))
    )
    off = [abs(b[k] / 1000 - a[k]) for k in a]
    assert sum(off) / len(off) < 0.02 * sum(a.values()) / len(a)
