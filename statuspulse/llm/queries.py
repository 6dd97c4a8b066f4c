"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Window
from pyspark.sql import functions as F

from statuspulse.llm import (
    fim,
    language,
    mixing,
    pieces,
    quality,
    rollups,
    search,
    simhash,
    substrings,
    suffixes,
    toxicity,
    url_rules,
    vectors,
)

from statuspulse.session import shared_path


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vectors(spark, sf_dir):
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_quality(spark, sf_dir):
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark, sf_dir):
    found = mixing.mix(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op4_substrings(spark, sf_dir):
    found = substrings.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_language(spark, sf_dir):
    found, name = language.of_documents(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.col(name["lang"]).alias("language"),
        F.round(name["probability"], 6).alias("probability"),
        F.col(name["kept"]).alias("kept"),
    )


def language_of_pages(spark, sf_dir):
    """Pages by their visible text, markup, suffix and host; trigrams come from the documents."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    model = language.train(docs, docs["text"], language.primary_tag(docs["lang"]))
    pages = pages.select(
        "page_id",
        language.visible_text(F.col("html")).alias("text"),
        language.markup_language(F.col("html")).alias("declared"),
        language.host_of(F.col("url")).alias("host"),
    )
    found, name = language.identify(pages, pages["text"], pages["declared"], pages["host"], model)
    return found.select(
        "page_id",
        F.col(name["lang"]).alias("language"),
        F.round(name["probability"], 6).alias("probability"),
        F.col(name["kept"]).alias("kept"),
    )


def op6_suffixes(spark, sf_dir):
    found = suffixes.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_rollups(spark, sf_dir):
    """All documents are inserted; exact copies of an earlier one are deleted; then what is not
    English is counted anew with a multilingual vocabulary."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    digest = (F.xxhash64("text"), F.xxhash64(F.reverse("text")), F.octet_length("text"))
    keyed = docs.select("doc_id", *(d.alias(f"d{k}") for k, d in enumerate(digest)))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    # a text that many documents share meets its copies in 64 places; its least id is found from these
    own = ["d0", "d1", "d2"]
    place = keyed.groupBy(*own, "salt").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    among = Window.partitionBy(*own)
    place = place.withColumns({"first": F.min("least").over(among), "n": F.sum("n").over(among)}).where("n > 1")
    copies = keyed.join(place.select(*own, "salt", "first"), [*own, "salt"]).where("doc_id > first").select("doc_id")
    kept = docs.join(copies, "doc_id", "left_anti")
    rollup = rollups.Rollup(spark, shared_path(spark, "rollup"))
    pattern = public_tokenizers.PATTERN
    english, many = (public_tokenizers.path(f"byte_bpe_{x}50k.tiktoken") for x in ("", "multi_"))
    none = F.lit(None).cast("string")
    gone = copies.withColumns({"text": none, "source": none, "lang": none})
    rollup.apply(1, docs.withColumn("op", F.lit("insert")), "en-50k", english, pattern)
    rollup.apply(2, gone.withColumn("op", F.lit("delete")), "en-50k", english, pattern)
    revised = kept.where("lang <> 'en'").withColumn("op", F.lit("revise"))
    rollup.apply(3, revised, "multi-50k", many, pattern)
    return rollup.totals()


def op10_pieces(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.concat_ws(" ", F.col("pieces").cast("array<string>"))
    return found.select(
        "doc_id",
        F.size("pieces").alias("n_pieces"),
        "score",
        F.sha2(ids, 256).alias("pieces_sha256"),
        F.col("n_best.score").alias("n_best_scores"),
        F.col("n_best.changed").alias("n_best_changed"),
        F.col("n_best.edits").cast("array<string>").alias("n_best_edits"),
        "round_trip",
    )


def op11_fill_in_middle(spark, sf_dir):
    found = fim.transform(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fim.restore(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"),
    )


#: The rules of op12.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op12_url_rules(spark, sf_dir):
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rule_table(spark, URL_RULES))


def op13_search(spark, sf_dir):
    return search.rank(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


_ALL = (
    op1_vectors,
    op2_quality,
    op3_mixing,
    op4_substrings,
    op5_language,
    op6_suffixes,
    op7_toxicity,
    op8_simhash,
    op9_rollups,
    op10_pieces,
    op11_fill_in_middle,
    op12_url_rules,
    op13_search,
    language_of_pages,
)
REGISTERED = {f.__name__: f for f in _ALL}
