"""Language identification by Bayesian evidence fusion.

For each language the log probabilities of four kinds of evidence are added:

* text: byte trigrams under one distribution per language, counted over all rows that declare
  a language, as the mean over the text times at most ``most_text`` trigrams (neighbouring
  trigrams are no independent witnesses);
* the declared language (markup), through the table of how often texts of a language declare
  which, so that a careless declaration weighs what it deserves;
* the address suffix, through the same kind of table;
* the host, as a prior: the share of a language among its rows, smoothed by that of its domain,
  and that by all rows'.  A row's own vote is taken out of these counts.

The tables and the priors are grouped aggregates of the votes of the texts alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuspulse.llm import kernel
from statuspulse.llm.common import Scratch, free_name

#: Trigrams are counted in 2**BITS cells.
BITS = 15
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[np.frombuffer(b"\t\n\x0b\x0c\r0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)] = 32


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) of the byte trigrams that are in one row and hold two bytes of words or more.

    Digits, punctuation and white space count as spaces, A-Z as a-z.
    """
    none = np.zeros(0, np.int64)
    if len(data) < 3:
        return none, none
    folded = _FOLD[data].astype(np.uint32)
    solid = (folded != 32).astype(np.int8)
    value = folded[:-2] << np.uint32(16) | folded[1:-1] << np.uint32(8) | folded[2:]
    keep = solid[:-2] + solid[1:-1] + solid[2:] >= 2
    edges = offsets[1:-1]
    for back in (1, 2):
        at = edges - back
        keep[at[(at >= 0) & (at < len(keep))]] = False
    at = np.flatnonzero(keep)
    cell = (value[at] * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(at, offsets)))
    return row, cell.astype(np.int64)


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    table: np.ndarray  # language, cell: log probability

    def evidence(self, most_text: int):
        """A column function: text to the log likelihood of each language (zeros for no trigrams)."""
        table = self.table.astype(np.float32)
        n = len(self.languages)

        @F.arrow_udf("array<double>")
        def log_likelihood(texts: pa.Array) -> pa.Array:
            out = np.zeros((len(texts), n))
            for first, data, offsets in kernel.chunks(texts):
                row, cell = trigrams(data, offsets)
                rows = len(offsets) - 1
                many = np.bincount(row, minlength=rows)
                weight = np.minimum(1.0, most_text / np.maximum(1, many))
                for k in range(n):
                    out[first : first + rows, k] = np.bincount(row, table[k][cell], minlength=rows) * weight
            ends = np.arange(0, (len(texts) + 1) * n, n, dtype=np.int32)[: len(texts) + 1]
            kernel.give_back()
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

        return log_likelihood


def primary_tag(declared: Column) -> Column:
    """The primary tag of a declaration, lower-cased: en of en-US; null for none."""
    tag = F.regexp_extract(F.lower(declared), r"^\s*([^\s_-]+)", 1)
    return F.when(tag != "", tag)


def train(docs: DataFrame, text: Column, declared: Column) -> TextModel:
    """Trigram distributions of all languages that a row with a trigram declares.

    The table takes 128 KB per language in every worker.
    """
    rows = docs.select(declared.alias("lang"), text.alias("text")).where("lang IS NOT NULL")
    cells = 1 << BITS

    @kernel.giving_back
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            lang = coded.indices.to_numpy()
            for first, data, offsets in kernel.chunks(batch.column(1)):
                row, cell = trigrams(data, offsets)
                # only what occurs is held, however many languages there are
                at, n = np.unique(lang[first + row].astype(np.int64) * cells + cell, return_counts=True)
                langs = coded.dictionary.take(pa.array(at // cells))
                yield pa.RecordBatch.from_arrays([langs, pa.array(at % cells), pa.array(n)], ["lang", "cell", "n"])

    counted = rows.mapInArrow(count, "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    # at most languages times cells numbers
    got = counted.toPandas()
    languages = tuple(sorted(got["lang"].unique()))
    if not languages:
        return TextModel((), np.zeros((0, cells)))
    table = np.full((len(languages), cells), 0.5)
    place = got["lang"].map({lang: k for k, lang in enumerate(languages)})
    table[place.to_numpy(np.int64), got["cell"].to_numpy(np.int64)] += got["n"].to_numpy(np.float64)
    return TextModel(languages, np.log(table / table.sum(axis=1, keepdims=True)))


def host_of(address: Column) -> Column:
    """The host of a URL, lower-cased, without port and a leading www."""
    host = F.lower(F.regexp_extract(address, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host != "", host)


def markup_language(html: Column) -> Column:
    """The primary tag of the lang attribute of the html element."""
    lang = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([a-zA-Z]+)", 1))
    return F.when(lang != "", lang)


def visible_text(html: Column) -> Column:
    """What is left without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", " ")


@dataclass
class Evidence:
    """Fitted tables; those by host, declaration and suffix stay DataFrames."""

    model: TextModel
    hosts: DataFrame  # host, domain, host_votes, domain_votes: arrays by language
    overall: list[float]
    declared: DataFrame  # value, given: array by language of the log probability of the value
    suffixes: DataFrame
    most_text: int
    strength: float

    def _array(self, values) -> Column:
        return F.array(*(F.lit(float(v)) for v in values))

    def judge(self, rows: DataFrame, text: Column, declared: Column, host: Column, floor: float) -> tuple[DataFrame, dict]:
        """``rows`` with the verdict in new columns, whose names are returned by role.

        Joined by host, declaration and suffix, so a row stays a row whatever its id.
        """
        name = {k: free_name(rows, f"lid_{k}") for k in ("host", "lang", "probability", "kept", "own", "work", "declared", "suffix")}
        n = len(self.model.languages)
        if not n:
            blank = {"lang": F.lit(None).cast("string"), "probability": F.lit(0.0), "kept": text.rlike(r"\p{L}")}
            return rows.withColumns({name[k]: F.coalesce(v, F.lit(False)) if k == "kept" else v for k, v in blank.items()}), name
        own = F.struct(
            self.model.evidence(self.most_text)(text).alias("text"),
            text.rlike(r"\p{L}").alias("letters"),
        )
        suffix = F.regexp_extract(host, r"\.([^.]+)$", 1)
        rows = rows.withColumns({name["host"]: host, name["declared"]: declared, name["suffix"]: suffix, name["own"]: own})
        hosts = self.hosts.withColumnRenamed("host", f"{name['host']}k")
        votes = [free_name(rows, f"lid_{c}") for c in ("host_votes", "domain_votes")]
        hosts = hosts.select(f"{name['host']}k", *(F.col(c).alias(v) for c, v in zip(("host_votes", "domain_votes"), votes, strict=True)))
        joined = rows.join(hosts, F.col(name["host"]) == F.col(f"{name['host']}k"), "left")
        given = {}
        for key, table in (("declared", self.declared), ("suffix", self.suffixes)):
            given[key] = free_name(rows, f"lid_{key}_given")
            table = table.select(F.col("value").alias(f"{name[key]}k"), F.col("given").alias(given[key]))
            joined = joined.join(table, F.col(name[key]) == F.col(f"{name[key]}k"), "left")
        mine = F.col(name["own"])
        evidence = mine["text"]
        vote = _vote(evidence)
        zero = self._array([0.0] * n)
        overall = self._array(self.overall)
        strength = F.lit(self.strength)

        def smoothed(votes: Column, prior: Column) -> Column:
            # without the row's own vote
            less = F.transform(votes, lambda v, i: F.greatest(v - (i == vote).cast("double"), F.lit(0.0)))
            total = F.aggregate(less, F.lit(0.0), lambda a, v: a + v)
            return F.zip_with(less, prior, lambda v, p: (v + strength * p) / (total + strength))

        domain = smoothed(F.coalesce(F.col(votes[1]), zero), overall)
        prior = smoothed(F.coalesce(F.col(votes[0]), zero), domain)
        parts = [
            evidence,
            F.coalesce(F.col(given["declared"]), zero),
            F.coalesce(F.col(given["suffix"]), zero),
            F.transform(prior, lambda p: F.ln(p)),
        ]
        total = parts[0]
        for part in parts[1:]:
            total = F.zip_with(total, part, lambda a, b: a + b)

        def verdict(scores):
            top = F.array_max(scores)
            mass = F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.exp(s - top))
            at = (F.array_position(scores, top) - 1).cast("int")
            return F.struct(
                F.get(F.array(*(F.lit(x) for x in self.model.languages)), at).alias("lang"), (1 / mass).alias("p")
            )

        out = joined.withColumn(name["work"], F.transform(F.array(total), verdict)[0])
        kept = mine["letters"] & (F.col(name["work"])["p"] >= floor)
        out = out.withColumns(
            {
                name["lang"]: F.col(name["work"])["lang"],
                name["probability"]: F.col(name["work"])["p"],
                name["kept"]: F.coalesce(kept, F.lit(False)),
            }
        )
        return out, name


def _vote(evidence: Column) -> Column:
    """The place of the language that the text alone favours; -1 for a text without evidence."""
    top = F.array_max(evidence)
    return F.when(top < 0, F.array_position(evidence, top) - 1).otherwise(-1).cast("int")


def _by_language(counted: DataFrame, key: str, n: int, out: str) -> DataFrame:
    """key, and an array by language of the votes."""
    pairs = counted.groupBy(key, "vote").agg(F.sum("n").cast("double").alias("n"))
    held = F.map_from_entries(F.collect_list(F.struct("vote", "n")))
    cells = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.coalesce(F.try_element_at(F.col("held"), k), F.lit(0.0)))
    return pairs.groupBy(key).agg(held.alias("held")).select(key, cells.alias(out))


def fit(
    rows: DataFrame,
    text: Column,
    declared: Column,
    host: Column,
    model: TextModel | None = None,
    most_text: int = 100,
    strength: float = 10.0,
) -> Evidence:
    """Tables and priors from all rows; ``model`` may have been trained elsewhere."""
    scratch = Scratch(rows.sparkSession, "language")
    model = model or train(rows, text, declared)
    n = len(model.languages)
    if not n:
        none = rows.select(F.lit("").alias("host")).limit(0)
        return Evidence(model, none, [], none, none, most_text, strength)
    evidence = model.evidence(most_text)
    votes = rows.select(
        host.alias("host"), declared.alias("declared"), evidence(text).alias("evidence")
    ).select("host", "declared", _vote(F.col("evidence")).alias("vote"))
    votes = votes.withColumn("suffix", F.regexp_extract("host", r"\.([^.]+)$", 1))
    counted = scratch.keep(votes.where("vote >= 0").groupBy("host", "suffix", "declared", "vote").agg(F.count(F.lit(1)).alias("n")))

    def table(value: str) -> DataFrame:
        """Per value, the log probability of it given each language, halfway smoothed to none."""
        known = counted.where(F.col(value).isNotNull() & (F.col(value) != ""))
        votes = scratch.keep(_by_language(known, value, n, "votes"))
        totals = {r.vote: r.n for r in known.groupBy("vote").agg(F.sum("n").alias("n")).collect()}
        values = votes.count()
        all_of = F.array(*(F.lit(totals.get(k, 0) + 0.5 * (values + 1)) for k in range(n)))
        given = F.zip_with("votes", all_of, lambda v, total: F.ln((v + 0.5) / total))
        return scratch.keep(votes.select(F.col(value).alias("value"), given.alias("given")))

    whole = counted.groupBy("vote").agg(F.sum("n").alias("n")).collect()
    share = np.full(n, 1.0)
    for r in whole:
        share[r.vote] += r.n
    named = counted.where("host IS NOT NULL").withColumn("domain", F.regexp_extract("host", r"([^.]+(?:\.[^.]+)?)$", 1))
    hosts = _by_language(named, "host", n, "host_votes").withColumn("domain", F.regexp_extract("host", r"([^.]+(?:\.[^.]+)?)$", 1))
    hosts = scratch.keep(hosts.join(_by_language(named, "domain", n, "domain_votes"), "domain"))
    return Evidence(model, hosts, (share / share.sum()).tolist(), table("declared"), table("suffix"), most_text, strength)


def identify(
    rows: DataFrame,
    text: Column,
    declared: Column,
    host: Column,
    model: TextModel | None = None,
    floor: float = 0.5,
) -> tuple[DataFrame, dict]:
    """``rows`` with language, its probability and whether the row is kept, in added columns.

    Returns the frame and the names of the columns by role (lang, probability, kept).  A row is
    kept if its text has a letter and the posterior of the best language is at least ``floor``.
    Null and empty texts are judged by the other evidence and never kept; null declarations,
    hosts and unknown values are no evidence.  Without any declared language there is nothing
    to learn: the language is null, and texts with a letter are kept.
    """
    return fit(rows, text, declared, host, model).judge(rows, text, declared, host, floor)


def of_documents(docs: DataFrame) -> tuple[DataFrame, dict]:
    """``identify`` for the columns of ``documents``: lang declares, source is the host."""
    text = docs["text"].cast("string")
    return identify(docs, text, primary_tag(docs["lang"].cast("string")), docs["source"].cast("string"))
