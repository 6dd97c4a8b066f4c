"""A registry of status models: one model for all outlets, whatever their ids look like.

Device and outlet ids are text, indexed as categories; an id that was not trained on is a
category of its own.  Indexers, assembler and forest are one ``PipelineModel``, saved below
``root/version=N``; the table ``root/registry`` says which versions there are, and is written
after the model, so that a version it lists is whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuspulse.functions import codes
from statuspulse.operators.forecast import FEATURES, training_rows
from statuspulse.params import DEFAULTS, STATUS_CODES, Settings
from statuspulse.sources.tables import read_or_empty

IDS = ("device_id", "outlet_id")
REGISTRY = (
    "version int, trained_at timestamp_ntz, ids array<string>, features array<string>, "
    "classes int, readings long, path string"
)


def _with_text_ids(rows: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Ids as text under names of their own; a null id is an unknown one."""
    return rows.withColumns({f"{name}_text": F.coalesce(F.col(name).cast("string"), F.lit("")) for name in ids})


def train(
    rows: DataFrame,
    *,
    ids: Sequence[str] = IDS,
    label: str = "status_code",
    classes: int = len(STATUS_CODES),
    settings: Settings = DEFAULTS,
) -> PipelineModel:
    """A forest over slot of the week and ids; ``rows`` have ids, dow, hour, slot and the label.

    A tree can tell as many values of an id apart as it has bins, so there are as many bins as
    the id with the most values has, and one for unknown ids.
    """
    indexed = [f"{name}_index" for name in ids]
    stated = {"ml_attr": {"type": "nominal", "num_vals": classes, "name": "label"}}
    given = _with_text_ids(training_rows(rows, label=label), ids)
    given = given.withColumn("label", F.col("label").alias("label", metadata=stated))
    indexer = StringIndexer(
        inputCols=[f"{name}_text" for name in ids],
        outputCols=indexed,
        handleInvalid="keep",
        stringOrderType="alphabetAsc",
    ).fit(given)
    most = max(len(labels) for labels in indexer.labelsArray)
    forest = RandomForestClassifier(
        numTrees=settings.forest_trees,
        maxDepth=settings.forest_depth,
        maxBins=max(settings.forest_bins, most + 2),
        seed=settings.forest_seed,
        cacheNodeIds=True,
        checkpointInterval=10,
        maxMemoryInMB=1024,
        featureSubsetStrategy="all" if len(ids) + len(FEATURES) <= 5 else "auto",
    )
    assembler = VectorAssembler(inputCols=[*FEATURES, *indexed], outputCol="features")
    return Pipeline(stages=[indexer, assembler, forest]).fit(given)


def score(model: PipelineModel, rows: DataFrame, *, ids: Sequence[str] = IDS) -> DataFrame:
    """``rows`` (ids, dow, hour, slot) with a probability per status and the likeliest status."""
    names = rows.columns
    given = training_rows(rows.withColumn("_none", F.lit(0)), label="_none").drop("_none", "label")
    scored = model.transform(_with_text_ids(given, ids))
    values = vector_to_array("probability")
    shares = {
        f"prob_{status}": F.coalesce(F.get(values, F.lit(code)), F.lit(0.0))
        for status, code in STATUS_CODES.items()
    }
    return scored.withColumns(
        shares | {"predicted_status": codes.status_label(F.col("prediction"))}
    ).select(*names, "predicted_status", *shares)


@dataclass(frozen=True)
class Version:
    number: int
    path: str


def versions(spark: SparkSession, root: str) -> DataFrame:
    return read_or_empty(spark, f"{root}/registry", REGISTRY)


def save(
    model: PipelineModel,
    spark: SparkSession,
    root: str,
    *,
    trained_at: datetime,
    readings: int,
    ids: Sequence[str] = IDS,
) -> Version:
    """Save a model as the next version.  A save that failed before the last step leaves no
    version, and the next one takes its number and overwrites its folder."""
    newest = versions(spark, root).agg(F.max("version")).first()[0]
    number = (newest or 0) + 1
    path = f"{root}/version={number}"
    model.write().overwrite().save(path)
    entry = (number, trained_at, list(ids), list(FEATURES), model.stages[-1].numClasses, readings, path)
    spark.createDataFrame([entry], REGISTRY).write.mode("append").parquet(f"{root}/registry")
    return Version(number, path)


def load(spark: SparkSession, root: str, *, version: int | None = None) -> PipelineModel:
    """A version's model; the newest one unless asked for another."""
    listed = versions(spark, root)
    if version is not None:
        listed = listed.where(F.col("version") == version)
    found = listed.agg(F.max_by("path", "version")).first()[0]
    if found is None:
        raise LookupError(f"no version {version or ''} in {root}")
    return PipelineModel.load(found)
