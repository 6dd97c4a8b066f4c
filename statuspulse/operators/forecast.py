"""Weekly forecasts: a grid of slots, a SQL baseline, and Spark ML classifiers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import NaiveBayes, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from statuspulse.functions import codes, time
from statuspulse.params import DEFAULTS, STATUS_CODES, Settings
from statuspulse.session import materialise

FEATURES = ("feature_dow", "feature_hour", "feature_slot")
#: A site's mean count in all and at an hour: what tells sites apart, however many there are.
LEVELS = ("site_level", "site_hour_level")


def week_ordinal(settings: Settings) -> Column:
    """Position of (dow, hour, slot) in the week; arithmetic, so no global window."""
    hours = (F.col("dow") - 1) * 24 + F.col("hour")
    return (hours * settings.slots_per_hour + F.col("slot")).cast("int")


def _week_parts(settings: Settings) -> dict[str, Column]:
    ordinal, spd, sph = F.col("week_ordinal"), settings.slots_per_day, settings.slots_per_hour
    return {
        "dow": (F.floor(ordinal / spd) + 1).cast("int"),
        "hour": F.floor(F.pmod(ordinal, F.lit(spd)) / sph).cast("int"),
        "slot": F.pmod(ordinal, F.lit(sph)).cast("int"),
    }


def week_grid(sites: DataFrame, *, settings: Settings = DEFAULTS) -> DataFrame:
    """Every slot of a week for every row of ``sites``: a generator, not a cross join."""
    ordinals = F.sequence(F.lit(0), F.lit(7 * settings.slots_per_day - 1))
    return sites.withColumn("week_ordinal", F.explode(ordinals)).withColumns(_week_parts(settings))


def with_ordinals(forecast: DataFrame, *, settings: Settings = DEFAULTS) -> DataFrame:
    """Ordinals within week and day, and their timeline texts, for a whole-grid forecast."""
    day = F.col("hour") * settings.slots_per_hour + F.col("slot")
    return forecast.withColumns(
        {"week_ordinal": week_ordinal(settings), "day_ordinal": day.cast("int")}
    ).withColumns(
        {
            "timestamp": time.timeline_text(F.col("week_ordinal")),
            "daytimestamp": time.timeline_text(F.col("day_ordinal")),
        }
    )


def with_row_ordinals(forecast: DataFrame, *, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Ordinals by row, for forecasts that lack slots; windows stay within a site's week."""
    order = ("hour", "slot")
    day = Window.partitionBy(*keys, "dow").orderBy(*order)
    week = Window.partitionBy(*keys).orderBy("dow", *order)
    return forecast.withColumns(
        {
            "day_ordinal": F.row_number().over(day) - 1,
            "week_ordinal": F.row_number().over(week) - 1,
        }
    )


def weekly_profile(
    counts: DataFrame,
    *,
    settings: Settings = DEFAULTS,
    how: str = "mean",
    keys: Sequence[str] = ("site_id",),
) -> DataFrame:
    """Baseline forecast: the rounded mean (or the maximum) of each slot of the week.

    Slots that history lacks get 0.  The grid is put under each site's own slots, at most
    one week of them, rather than joined: history is read once.
    """
    stat = {"mean": F.avg("avail_count"), "max": F.max("avail_count")}[how]
    seen = counts.groupBy(*keys, "dow", "hour", "slot").agg(
        F.round(stat).cast("int").alias("countavailable")
    )
    entry = F.struct(week_ordinal(settings).alias("week_ordinal"), "countavailable")
    zeros = F.transform(
        F.sequence(F.lit(0), F.lit(7 * settings.slots_per_day - 1)),
        lambda i: F.struct(i.alias("week_ordinal"), F.lit(0).alias("countavailable")),
    )
    per_site = seen.groupBy(*keys).agg(F.collect_list(entry).alias("_seen"))
    filled = (
        per_site.select(*keys, F.inline(F.concat("_seen", zeros)))
        .groupBy(*keys, "week_ordinal")
        .agg(F.max("countavailable").alias("countavailable"))
    )
    return filled.withColumns(_week_parts(settings)).select(
        *keys, "dow", "hour", "slot", "week_ordinal", "countavailable"
    )


def training_rows(counts: DataFrame, *, label: str = "avail_count") -> DataFrame:
    """Label and 1-based features, next to the raw columns.

    The features start at 1 because a zero would vanish from a sparse vector.
    """
    return counts.withColumns(
        {
            "label": F.col(label).cast("double"),
            "feature_dow": F.col("dow").cast("double"),
            "feature_hour": (F.col("hour") + 1).cast("double"),
            "feature_slot": (F.col("slot") + 1).cast("double"),
        }
    )


def assemble(rows: DataFrame, *, features: Sequence[str] = FEATURES) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)


def _labelled(rows: DataFrame, classes: int | None) -> DataFrame:
    """State the number of classes; without it, every count up to the largest seen is one.

    A tree node keeps statistics per class, so capacity is a poor bound to fit with.
    """
    if classes is None:
        classes = int(rows.agg(F.max("label")).first()[0]) + 1
    meta = {"ml_attr": {"type": "nominal", "num_vals": classes, "name": "label"}}
    return rows.withColumn("label", F.col("label").alias("label", metadata=meta))


def train_forest(
    rows: DataFrame,
    *,
    settings: Settings = DEFAULTS,
    classes: int | None = None,
    features: Sequence[str] = FEATURES,
):
    """Random forest over slot counts, one class per count.

    Each row's node is kept with the row: otherwise every level of a deep forest sends the
    whole forest to the executors again.  With a checkpoint folder the node ids are
    checkpointed every ten levels.
    """
    forest = RandomForestClassifier(
        numTrees=settings.forest_trees,
        maxDepth=settings.forest_depth,
        maxBins=settings.forest_bins,
        seed=settings.forest_seed,
        cacheNodeIds=True,
        checkpointInterval=10,
        maxMemoryInMB=1024,
    )
    return forest.fit(_labelled(assemble(rows, features=features), classes))


def train_count_forest(
    rows: DataFrame, *, settings: Settings = DEFAULTS, features: Sequence[str] = FEATURES
):
    """Regression forest over slot counts.

    A node keeps three sums, whatever the largest count, where a class per count takes as many as
    there are outlets; and counts that are near each other are near in the loss.
    """
    forest = RandomForestRegressor(
        numTrees=settings.forest_trees,
        maxDepth=settings.forest_depth,
        maxBins=settings.forest_bins,
        seed=settings.forest_seed,
        cacheNodeIds=True,
        checkpointInterval=10,
        maxMemoryInMB=1024,
        # a leaf is a mean, as a slot of the baseline is
        minInstancesPerNode=5,
    )
    return forest.fit(assemble(rows, features=features))


def site_levels(counts: DataFrame, *, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """``LEVELS`` of every site and each hour it has: at most 24 rows a site."""
    hours = counts.groupBy(*keys, "hour").agg(F.sum("avail_count").alias("_sum"), F.count("avail_count").alias("_n"))
    site = Window.partitionBy(*keys)
    return hours.select(
        *keys,
        "hour",
        F.try_divide(F.sum("_sum").over(site), F.sum("_n").over(site)).alias("site_level"),
        F.try_divide(F.col("_sum"), F.col("_n")).alias("site_hour_level"),
    )


def with_levels(rows: DataFrame, levels: DataFrame, *, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """Add ``LEVELS``; an hour that history lacks has its site's level, a site it lacks has 0."""
    per_site = levels.groupBy(*keys).agg(
        F.max("site_level").alias("site_level"),
        F.map_from_entries(F.collect_list(F.struct("hour", "site_hour_level"))).alias("_hours"),
    )
    found = rows.join(per_site, list(keys), "left")
    level = F.coalesce("site_level", F.lit(0.0))
    of_hour = F.coalesce(F.element_at("_hours", F.col("hour")), level)
    return found.withColumns({"site_hour_level": of_hour, "site_level": level}).drop("_hours")


def train_sites(counts: DataFrame, *, settings: Settings = DEFAULTS, keys: Sequence[str] = ("site_id",)):
    """One forest for all sites, told apart by their levels, and the levels."""
    levels = materialise(site_levels(counts, keys=keys), "site_levels")
    rows = with_levels(training_rows(counts), levels, keys=keys)
    return train_count_forest(rows, settings=settings, features=(*FEATURES, *LEVELS)), levels


def predict_sites(
    model, levels: DataFrame, grid: DataFrame, *, keys: Sequence[str] = ("site_id",)
) -> DataFrame:
    """Predicted count of every row of a grid of sites, rounded as the baseline's."""
    rows = with_levels(grid, levels, keys=keys)
    scored = predict_week(model, rows, features=(*FEATURES, *LEVELS))
    return scored.withColumn("countavailable", F.round("prediction").cast("int")).drop(*LEVELS)


def train_bayes(rows: DataFrame, *, classes: int | None = None, smoothing: float = 0.5):
    """Multinomial naive Bayes on the same features."""
    return NaiveBayes(smoothing=smoothing).fit(_labelled(assemble(rows), classes))


def predict_week(model, grid: DataFrame, *, features: Sequence[str] = FEATURES) -> DataFrame:
    """Model prediction for every grid row, truncated to an integer."""
    rows = training_rows(grid.withColumn("_label", F.lit(0)), label="_label").drop("_label", "label")
    scored = model.transform(assemble(rows, features=features))
    return scored.withColumn("countavailable", F.col("prediction").cast("int")).drop(
        "features", "rawPrediction"
    )


def class_probabilities(scored: DataFrame) -> DataFrame:
    """Unpack the probability vector into one column per status, 0 for classes never seen."""
    values = vector_to_array("probability")
    return scored.withColumns(
        {
            **{
                f"prob_{status}": F.coalesce(F.get(values, F.lit(code)), F.lit(0.0))
                for status, code in STATUS_CODES.items()
            },
            "predicted_status": codes.status_label(F.col("prediction")),
        }
    )


def holdout_accuracy(
    rows: DataFrame, fit, *, key: Column, train_share: float = 0.6, parts: int = 100
) -> DataFrame:
    """Fit on a share, report accuracy on the rest: one row.

    A row's side depends on the remainder of its ``key`` alone, not on how files are read.
    """
    part = F.pmod(key, F.lit(parts))
    bound = round(train_share * parts)
    return tested(fit(rows.where(part < bound)), rows.where(part >= bound))


def tested(model, rows: DataFrame) -> DataFrame:
    """Number of rows and the share the model predicts right: one row."""
    return model.transform(assemble(rows)).agg(
        F.count("*").alias("test_rows"),
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
    )


def accuracy(scored: DataFrame) -> float:
    """Accuracy of scored rows as a number."""
    return MulticlassClassificationEvaluator(metricName="accuracy").evaluate(scored)
