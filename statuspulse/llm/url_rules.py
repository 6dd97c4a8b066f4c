"""URL filters: rules on hosts and path prefixes, found by hashes of a URL's expressions.

A URL is expanded into expressions: each suffix of its host's labels with each of its path's
beginnings up to a slash.  A rule is filed under one expression, its host with its path up to the
last slash.  Expressions meet rules in an equality join on the first eight hex digits of their
SHA-256; a meeting counts if the whole digests agree and the URL's path starts with the rule's
whole path.  Of the rules that fit, the longest decides.

Only as many labels and slashes are expanded as some rule has, so the number of expressions of a
URL is bounded by the rules and not by the URL.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hex digits of the short hash.
SHORT = 8
#: Rules of more bytes than this are not broadcast: they are dealt by hash and salt instead.
BROADCAST_BYTES = 32 << 20
#: Shares in which an expression that very many URLs have (a top-level domain) is dealt then.
SALTS = 32

RULES = "action string, host string, path string"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host: after the first ``://`` up to a slash, ``?``, ``#`` or the end, A-Z lower-cased.
    The path: from there to ``?``, ``#`` or the end.  Both are empty without ``://`` and for null."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    rest = F.coalesce(rest, F.lit(""))
    host = F.substring_index(rest, "/", 1)
    return ascii_lower(host), F.substr(rest, F.char_length(host) + 1)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (action, host, path) as a table; for longer lists, read them from files."""
    return spark.createDataFrame(rules, RULES)


def _slashes(path: Column) -> Column:
    return F.size(F.split(path, "/")) - 1


def _expressions(host: Column, path: Column, labels: int, slashes: int) -> Column:
    """Host suffixes of up to ``labels`` labels, each with the path's beginnings of up to ``slashes`` slashes."""
    names, folders = F.split(host, r"\."), F.split(path, "/")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(names), F.lit(labels))),
        lambda k: F.array_join(F.slice(names, F.size(names) - k + 1, k), "."),
    )
    beginnings = F.transform(
        F.sequence(F.lit(0), F.least(F.size(folders) - 1, F.lit(slashes))),
        lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(folders, 1, k), "/"), F.lit("/"))),
    )
    return F.flatten(F.transform(suffixes, lambda s: F.transform(beginnings, lambda p: F.concat(s, p))))


def judge(
    pages: DataFrame,
    rules: DataFrame,
    id_column: str = "page_id",
    url_column: str = "url",
    otherwise: str = "allow",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """page_id, host, path, rule, verdict; a row per row of ``pages``, in any order.

    ``rules`` has action (allow or block), host and path.  A rule fits its host and all of that
    host's subdomains if the URL's path starts with the rule's; the empty path fits every path.
    The longest rule decides (host and path in code points; of equal ones the longer host, and of
    the same rule given twice, block).  Without a fitting rule, ``rule`` is null and the verdict
    ``otherwise``.  A null URL, an empty one, and one without ``://`` have an empty host and path
    and are judged like any other.  Rule hosts are read with A-Z lower-cased; rules that are null
    in a column are left out.  Repeated pages give repeated rows; other columns are ignored.
    """
    rules = rules.select("action", ascii_lower(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"))
    rules = rules.dropna().distinct()
    folder = F.regexp_extract("rule_path", "(?s)^(.*/)?", 0)
    rules = rules.withColumns(
        {
            "rule": F.concat("rule_host", "rule_path"),
            "rule_digest": F.sha2(F.concat("rule_host", folder).cast("binary"), 256),
        }
    ).withColumn("short", F.substring("rule_digest", 1, SHORT))
    most = rules.agg(
        F.max(F.size(F.split("rule_host", r"\."))),
        F.max(_slashes(F.col("rule_path"))),
        F.sum(F.octet_length("rule") + F.lit(200)),
    ).first()
    labels, slashes, size = (int(x or 0) for x in most)

    host, path = host_and_path(pages[url_column].cast("string"))
    rows = pages.select(pages[id_column].alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    # with no rules at all there is one expression, which meets none
    expressions = _expressions(F.col("host"), F.col("path"), max(labels, 1), slashes)
    expanded = rows.select("*", F.explode(expressions).alias("expression"))
    expanded = expanded.withColumn("digest", F.sha2(F.col("expression").cast("binary"), 256)).drop("expression")
    expanded = expanded.withColumn("short", F.substring("digest", 1, SHORT))
    keys = ["short"]
    if size <= broadcast_bytes:
        rules = F.broadcast(rules)
    else:
        keys.append("salt")
        expanded = expanded.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int"))
        rules = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = expanded.join(rules, keys, "left")
    fits = (F.col("digest") == F.col("rule_digest")) & F.startswith("path", "rule_path")
    best = F.max(
        F.when(
            fits,
            F.struct(
                F.char_length("rule").alias("length"),
                F.char_length("rule_host").alias("host_length"),
                F.col("action"),  # block comes after allow
                F.col("rule"),
            ),
        )
    )
    # one row's expressions are beside each other: they are reduced to one before the shuffle
    decided = met.groupBy("row", "page_id", "host", "path").agg(best.alias("best"))
    return decided.select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.action", F.lit(otherwise)).alias("verdict"),
    )
