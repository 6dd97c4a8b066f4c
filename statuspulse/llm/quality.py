"""Quality rules: learned decision lists over text statistics, DataFrame functions only.

Statistics of a text are column expressions.  A decision list is learned from labelled rows by
sequential covering: a rule grows by the condition (statistic, side, threshold) of the best
information gain on two thirds of the rows, is pruned on the other third, and the rows it
covers leave the set; rules that are not precise enough on the held-out third end the list.
What a growing step needs is one grouped count per statistic, threshold bin and label, so only
a few hundred numbers reach the driver, whatever the table holds.  The result is an ordered
chain of Spark conditional expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from statuspulse.llm.common import SPACE, Scratch

#: Words of a window whose repetition counts.
WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: The statistics that conditions may use.
FEATURES = (
    "n_words", "chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share",
    "words_per_line", "distinct_share", "digits_per_char", "upper_per_char", "stops_per_word", "pipes_per_word",
)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once though ``body`` uses it in a lambda."""
    return F.transform(F.array(value), body)[0]


def _window_hashes(words: Column) -> Column:
    """The hash of each run of ``WINDOW`` words, in order."""

    def of(hashes):
        at = F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1))
        runs = F.transform(at, lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
        return F.when(F.size(hashes) >= WINDOW, runs).otherwise(F.array().cast("array<bigint>"))

    return _let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _repeated(rows: DataFrame) -> DataFrame:
    """(row, n_repeat_words): words in windows found twice or more, for rows that have such.

    ``rows`` holds the window hashes of those rows.  Grouped by row and hash, so a long text is
    spread over tasks; a window covers its words as far as the next such window's start.
    """
    places = rows.select("row", F.posexplode("windows").alias("pos", "hash"))
    several = places.groupBy("row", "hash").agg(F.collect_list("pos").alias("found")).where(F.size("found") > 1)
    starts = several.select("row", F.explode("found").alias("pos"))
    after = F.lead("pos").over(Window.partitionBy("row").orderBy("pos"))
    reach = F.least(F.lit(WINDOW), F.coalesce(after - F.col("pos"), F.lit(WINDOW)))
    return starts.withColumn("reach", reach).groupBy("row").agg(F.sum("reach").alias("n_repeat_words"))


def statistics(docs: DataFrame, id_column: str, text_column: str, scratch: Scratch) -> DataFrame:
    """doc_id, the five counts and the ``FEATURES``; a row per row of ``docs``."""
    text = F.coalesce(docs[text_column].cast("string"), F.lit(""))
    base = docs.select(docs[id_column].alias("doc_id"), text.alias("text"))
    words = F.filter(F.split("text", SPACE), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    def count(characters: str) -> Column:
        return F.char_length("text") - F.char_length(F.translate("text", characters, ""))

    def of_words(w):
        return F.struct(
            F.size(w).alias("n_words"),
            F.char_length(F.array_join(w, "")).alias("word_chars"),
            F.size(F.array_distinct(w)).alias("distinct"),
            _let(
                _window_hashes(w), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), h)
            ).alias("windows"),
        )

    def of_lines(x):
        return F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))

    raw = scratch.keep(
        base.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            _let(words, of_words).alias("w"),
            _let(lines, of_lines).alias("l"),
            F.char_length("text").alias("chars"),
            count(SYMBOLS).alias("n_symbols"),
            count("0123456789").alias("digits"),
            count("ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("uppers"),
            count(".!?").alias("stops"),
            count("|").alias("pipes"),
        ).select("*", "w.*").drop("w")
    )
    repeats = _repeated(raw.where("windows IS NOT NULL").select("row", "windows"))
    rows = raw.drop("windows").join(repeats, "row", "left")
    long = {c: F.col(c).cast("long") for c in ("n_words", "word_chars", "n_symbols")}
    long["n_dup_lines"] = F.col("l.dup").cast("long")
    long["n_repeat_words"] = F.coalesce("n_repeat_words", F.lit(0)).cast("long")

    def share(a, b):
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    ratios = {
        "chars_per_word": share("word_chars", "n_words"),
        "symbols_per_word": share("n_symbols", "n_words"),
        "dup_line_share": share("l.dup", "l.n"),
        "repeat_share": F.coalesce(share("n_repeat_words", "n_words"), F.lit(0.0)),
        "words_per_line": share("n_words", "l.n"),
        "distinct_share": share("distinct", "n_words"),
        "digits_per_char": share("digits", "chars"),
        "upper_per_char": share("uppers", "chars"),
        "stops_per_word": share("stops", "n_words"),
        "pipes_per_word": share("pipes", "n_words"),
    }
    return scratch.keep(
        rows.select("doc_id", *(v.alias(k) for k, v in long.items()), *(v.alias(k) for k, v in ratios.items()))
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature)
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:g}"


@dataclass
class DecisionList:
    """Rules in order, each a conjunction of conditions; a row that meets one is rejected."""

    rules: list[list[Condition]] = field(default_factory=list)

    def rejects(self) -> Column:
        chain = F.lit(False)
        for rule in reversed(self.rules):
            chain = F.when(_all(rule), True).otherwise(chain)
        return chain

    def reason(self) -> Column:
        """The first rule met, as text; null for none."""
        chain = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            chain = F.when(_all(rule), F.lit(" AND ".join(map(str, rule)))).otherwise(chain)
        return chain


def _all(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


def _counts(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[Condition, tuple[int, int]]:
    """(bad, good) rows under every possible condition, from one grouped count."""
    bins = [
        F.struct(
            F.lit(name).alias("feature"),
            sum((F.col(name) >= c).cast("int") for c in thresholds).alias("bin"),
        )
        for name, thresholds in cuts.items()
    ]
    found = (
        rows.select("bad", F.explode(F.array(*bins)).alias("b"))
        .groupBy("b.feature", "b.bin").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))
        .collect()
    )
    out = {}
    for name, thresholds in cuts.items():
        own = [r for r in found if r.feature == name]
        for k, threshold in enumerate(thresholds, 1):
            above = [(r.bad, r.good) for r in own if r.bin >= k]
            below = [(r.bad, r.good) for r in own if r.bin < k]
            for side, part in ((True, above), (False, below)):
                out[Condition(name, side, threshold)] = (sum(b for b, _ in part), sum(g for _, g in part))
    return out


def learn(
    labelled: DataFrame,
    bad: Column,
    features: tuple[str, ...] = FEATURES,
    thresholds: int = 24,
    most_rules: int = 10,
    most_conditions: int = 3,
    precision: float = 0.95,
    support: int = 5,
) -> DecisionList:
    """A decision list for the rows where ``bad`` is 1, from rows with ``doc_id`` and ``features``.

    Rows whose label is null are ignored; without rows of both labels the list is empty.
    ``precision`` and ``support`` are asked of each rule on all rows it covers, and the precision
    on the held-out third too where the rule covers any of it.
    """
    rows = labelled.withColumn("bad", bad.cast("int")).where("bad IN (0, 1)")
    rows = rows.select("doc_id", "bad", *features)
    rows = rows.withColumn("grow", F.pmod(F.xxhash64("doc_id"), F.lit(3)) != 0)
    shares = [k / (thresholds + 1) for k in range(1, thresholds + 1)]
    # of the bad and of all rows: what is rare among all may be the middle of the bad
    both = rows.agg(
        F.sum("bad").alias("bad"),
        F.count(F.lit(1)).alias("n"),
        *(F.percentile_approx(f, shares).alias(f) for f in features),
        *(F.percentile_approx(F.when(F.col("bad") == 1, F.col(f)), shares).alias(f"{f}_bad") for f in features),
    ).first()
    learned = DecisionList()
    if not both.n or not both.bad or both.bad == both.n:
        return learned
    cuts = {f: sorted({*both[f], *(both[f"{f}_bad"] or [])}) for f in features}
    left = rows
    for _ in range(most_rules):
        rule: list[Condition] = []
        growing = left.where("grow")
        p, n = growing.agg(F.sum("bad"), F.sum(1 - F.col("bad"))).first()
        while p and n and len(rule) < most_conditions:
            now = math.log2(p / (p + n))
            gains = {
                c: b * (math.log2(b / (b + g)) - now)
                for c, (b, g) in _counts(growing, cuts).items()
                if b >= support and b + g < p + n
            }
            if not gains or max(gains.values()) <= 0:
                break
            best = max(gains, key=lambda c: (gains[c], c.feature, c.at_least, -c.threshold))
            rule.append(best)
            growing = growing.where(best.column())
            p, n = growing.agg(F.sum("bad"), F.sum(1 - F.col("bad"))).first()
        if not rule:
            break
        # prune: the shortest prefix with the best value on the held-out third
        sums = []
        for k in range(1, len(rule) + 1):
            for part in (~F.col("grow"), F.lit(True)):
                met = (part & _all(rule[:k])).cast("int")
                sums += [F.sum(met * F.col("bad")), F.sum(met * (1 - F.col("bad")))]
        got = left.agg(*(s.alias(str(i)) for i, s in enumerate(sums))).first()
        value = [
            (got[4 * k] - got[4 * k + 1]) / max(1, got[4 * k] + got[4 * k + 1]) for k in range(len(rule))
        ]
        keep = max(range(len(rule)), key=lambda k: (round(value[k], 3), -k))
        held_bad, held_good, all_bad, all_good = (got[4 * keep + i] for i in range(4))
        good_enough = all_bad >= support and all_bad >= precision * (all_bad + all_good)
        if not good_enough or held_bad < precision * (held_bad + held_good):
            break
        rule = rule[: keep + 1]
        learned.rules.append(rule)
        left = left.where(~_all(rule))
    return learned


def assess(
    docs: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    **learning,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, reason.

    A row per row of ``docs``; a null text has no words.  ``base_failed``: fewer than 20 words,
    or over 30 % of the words in repeated windows; ``kept`` is false if it failed or if a learned
    rule rejects it, and ``reason`` is that rule.  The rules learn from rows that pass the base and have
    a label (1 is good; several labels of an id: the lowest); a row without id has none.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = statistics(docs, id_column, text_column, scratch)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    marks = labels.groupBy(F.col(id_column).alias("doc_id")).agg(F.min(label_column).alias("good"))
    known = scratch.keep(rows.where("NOT base_failed").join(marks, "doc_id").select("doc_id", "good", *FEATURES))
    rules = learn(known, 1 - F.col("good"), **learning)
    reason = F.when(~F.col("base_failed"), rules.reason())
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~rules.rejects()).alias("kept"), reason.alias("reason"),
    )
