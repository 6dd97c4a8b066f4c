"""The training-data pipeline: documents to mixed, deduplicated, segmented text.

``STAGES`` are (name, function) with function(spark, docs, sf_dir) -> DataFrame.  All but the
last return the columns of ``documents``; each is written as Parquet and read again as the next
one's input.  Stages decide by row, so repeated ids and additional columns, whatever they are
called, pass through.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuspulse.llm import language, mixing, pieces, simhash, substrings
from statuspulse.llm.common import Scratch, column
from workload.adapter import ensure_shared_folder

#: Not every stage can be expressed in SQL (XXH64 fingerprints, learned languages).
ORACLE_SQL = None


#: Rows are whole texts: what Spark hands to a Python worker at a time is bounded in bytes, as by
#: default 10,000 rows are held in the JVM's and in the worker's memory, whatever their lengths.
BATCH_BYTES = 4 << 20


def _bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language keep their place; lang becomes the identified language."""
    _bound_batches(spark)
    found, name = language.of_documents(docs)
    lang = F.coalesce(F.col(name["lang"]), docs["lang"].cast("string"))
    columns = [lang.alias(c) if c == "lang" else column(c) for c in docs.columns]
    return found.where(F.col(name["kept"])).select(*columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies."""
    _bound_batches(spark)
    return simhash.representatives(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; n_chars follows."""
    _bound_batches(spark)
    left = substrings.cleaned(docs)
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.emit(docs)


def segment(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, pieces, score, n_best, round_trip of each document taken."""
    _bound_batches(spark)
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("passages", remove_repeated_passages),
    ("mix", mix_sources),
    ("pieces", segment),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, the result of each written to the shared folder."""
    ensure_shared_folder(spark)
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
