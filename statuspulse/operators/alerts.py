"""Alerts as rows: one common shape, and one row per channel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuspulse import params
from statuspulse.functions import codes, text
from statuspulse.params import DEFAULTS, Settings

KEYS = ("site_id",)


def _colour(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, colour in params.ALERT_COLOURS.items():
        out = F.when(kind == name, F.lit(colour)).otherwise(out)
    return out


def transition_alerts(figures: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    """Changes as alerts, with the three count fields."""
    count = text.count_of_total(F.col("avail"), F.col("total"))
    fields = F.create_map(
        F.lit("Available Count"), count,
        F.lit("In Use Count"), F.col("in_use").cast("string"),
        F.lit("Unknown Count"), F.col("unknown").cast("string"),
    )
    if "predict" in figures.columns:
        predicted = F.create_map(F.lit("Predict"), F.col("predict"))
        fields = F.when(F.col("predict").isNotNull(), F.map_concat(fields, predicted)).otherwise(
            fields
        )
    return _alert(figures, fields, keys)


def forecast_alerts(notices: DataFrame, *, keys: Sequence[str] = KEYS) -> DataFrame:
    fields = F.create_map(
        F.lit("Available Count"), text.count_of_total(F.col("avail"), F.col("total"))
    )
    return _alert(notices, fields, keys)


def _alert(rows: DataFrame, fields: Column, keys: Sequence[str]) -> DataFrame:
    return rows.select(
        *keys,
        "ts",
        "kind",
        "avail",
        _colour(F.col("kind")).alias("colour"),
        "text",
        fields.alias("fields"),
    )


def channels(*, settings: Settings = DEFAULTS) -> Column:
    """Every alert goes to the default channel; the others depend on kind and count."""
    kind = F.col("kind")
    up = kind.isin("became_nonzero", "increased")
    enough = F.col("avail") >= settings.upgrade_threshold
    return F.array_compact(
        F.array(
            F.lit(settings.default_channel),
            F.when(up, params.CHANNEL_AVAIL_UPGRADE),
            F.when(up & enough, params.CHANNEL_UPGRADE_THRESHOLD),
            F.when(kind.isin("decreased", "went_to_zero"), params.CHANNEL_AVAIL_DOWNGRADE),
            F.when(kind.isin("available", "unavailable"), params.CHANNEL_FORECAST),
        )
    )


def route(alerts: DataFrame, *, settings: Settings = DEFAULTS) -> DataFrame:
    """One row per alert and channel."""
    return alerts.withColumn("channel", F.explode(channels(settings=settings)))


def with_status_codes(readings: DataFrame) -> DataFrame:
    """Numeric status next to its text, as the classifiers need it."""
    return readings.withColumn("status_code", codes.status_code(F.col("status")))
