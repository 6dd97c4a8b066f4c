"""URL rules against a test of every rule."""

import random

import pytest

from statuspulse.llm import url_rules
from statuspulse.llm.queries import URL_RULES


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def parted(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1].split("?", 1)[0].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    return lower(host), slash + path


def direct(id_, url, rules, otherwise="allow"):
    host, path = parted(url)
    fits = [
        (len(h) + len(p), len(h), action, h + p)
        for action, h, p in ((a, lower(h), p) for a, h, p in rules)
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if not fits:
        return id_, host, path, None, otherwise
    best = max(fits)
    return id_, host, path, best[3], best[2]


URLS = [
    None, "", "no scheme", "://", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/x?net/es/",
    "http://example.com", "http://example.com?q=/en/", "http://example.com#/en/", "http://example.com/en",
    "http://example.com/en/", "http://notexample.com/en/", "http://a.b.example.com/en//x", "http://net/es/1",
    "x://sub.net/es/?a=b#c", "http://net./es/", "http://.net/fr/", "http://a..net/fr/1/2/3", "http://Ünet/es/",
    "http://user@example.com:80/en/", "http://example.com:80/en/", "ftp://x.net/fr", "http://com/a://net/es/",
    "http://x.com/" + "a/" * 3000, "http://" + "a." * 3000 + "net/es/" + "b" * 50_000, "http://n.net/es/\nline",
]


def run(spark, pages, rules, **options):
    table = spark.createDataFrame([(i, u, "h", "r") for i, u in pages], "page_id long, url string, host string, rule string")
    return [tuple(r) for r in url_rules.judge(table, url_rules.rule_table(spark, rules), **options).collect()]


@pytest.mark.parametrize("broadcast_bytes", [url_rules.BROADCAST_BYTES, 0])
def test_given_rules(spark, broadcast_bytes):
    pages = [*enumerate(URLS), (None, "http://x.net/es/"), (None, None), (0, None), (11, URLS[11]), (11, URLS[11])]
    found = run(spark, pages, URL_RULES, broadcast_bytes=broadcast_bytes)
    assert sorted(map(repr, found)) == sorted(repr(direct(i, u, URL_RULES)) for i, u in pages)


@pytest.mark.parametrize("broadcast_bytes", [url_rules.BROADCAST_BYTES, 0])
def test_random_rules(spark, broadcast_bytes):
    rng = random.Random(12)
    hosts = [".".join(rng.choice("abC") for _ in range(rng.randrange(1, 5))) for _ in range(40)] + ["", "a.", ".a"]
    paths = ["", "/"] + ["/" + "/".join(rng.choice(["x", "xy", ""]) for _ in range(rng.randrange(1, 4))) for _ in range(30)]
    rules = [(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(paths)) for _ in range(60)]
    rules += [("block", "a", "x"), ("allow", "b", "/x"), ("block", "b", "/x"), rules[0]]
    pages = [(k, f"s://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'y', '/z', '?q', '#f'])}") for k in range(400)]
    found = run(spark, pages, rules, otherwise="block", broadcast_bytes=broadcast_bytes)
    assert sorted(map(repr, found)) == sorted(repr(direct(i, u, rules, "block")) for i, u in pages)


def test_no_rules_nulls_in_rules_no_pages(spark):
    rules = url_rules.rule_table(spark, [(None, "a", "/"), ("block", None, "/"), ("block", "a", None)])
    pages = spark.createDataFrame([(1, "http://a/")], "page_id int, url string")
    assert [tuple(r) for r in url_rules.judge(pages, rules).collect()] == [(1, "a", "/", None, "allow")]
    assert url_rules.judge(pages.limit(0), rules).collect() == []
