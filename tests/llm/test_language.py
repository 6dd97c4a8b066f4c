"""Language identification: recovery of planted languages, and what each kind of evidence adds."""

import random

import pytest
from pyspark.sql import functions as F

from statuspulse.llm import language

SYLLABLES = {"aa": ["ka", "to", "ri", "mu"], "bb": ["sch", "ver", "ung", "ei"], "cc": ["eau", "oux", "qué", "ille"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    rows = []
    for k in range(600):
        lang = rng.choice(["aa", "aa", "bb", "cc"])
        declared = lang if rng.random() < 0.9 else rng.choice(["aa", "bb", None, "zz"])
        rows.append((k, prose(rng, lang, rng.randrange(5, 80)), declared, lang, f"src{k % 4}", "x"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string, source string, kept string")


def test_documents(docs):
    found, name = language.of_documents(docs)
    rows = found.select("*", F.col(name["lang"]).alias("said"), F.col(name["kept"]).alias("keep")).collect()
    assert len(rows) == 600 and all(r.keep for r in rows)
    assert sum(r.said == r.truth for r in rows) >= 598


def judged(spark, docs, rows):
    """Verdicts of (text, declared, host) rows next to a background of clear ones."""
    model = language.train(docs, docs["text"], docs["truth"])
    frame = spark.createDataFrame(rows, "id int, text string, declared string, host string, lid_host string")
    found, name = language.identify(frame, frame["text"], frame["declared"], frame["host"], model)
    return {r.id: r for r in found.select("id", F.col(name["lang"]).alias("lang"), F.col(name["probability"]).alias("p"), F.col(name["kept"]).alias("kept")).collect()}


def test_evidence(spark, docs):
    rng = random.Random(1)
    rows = []
    for k in range(300):  # hosts of one language, suffixes that go with it, careful declarations
        lang = ["aa", "bb", "cc"][k % 3]
        rows.append((1000 + k, prose(rng, lang, 30), lang, f"h{k % 12}.site{k % 6}.{lang}x", "c"))
    unclear = "1x 2 3"
    rows += [
        (1, unclear, "bb", None, ""), (2, unclear, None, "h1.site1.bbx", ""), (3, unclear, None, "new.site1.bbx", ""),
        (4, unclear, None, "other.bbx", ""), (5, prose(rng, "cc", 30), "bb", "h1.site1.bbx", ""), (6, None, "aa", None, ""),
        (7, "", None, None, None), (8, "123 ...", "aa", "h0.site0.aax", ""), (9, prose(rng, "aa", 20_000), None, None, ""),
    ]
    got = judged(spark, docs, rows)
    assert [got[k].lang for k in (1, 2, 3, 4, 5)] == ["bb", "bb", "bb", "bb", "cc"]
    assert got[2].p > got[4].p > 0.34  # a known host says more than a suffix
    assert [got[k].kept for k in (6, 7, 8, 9)] == [False, False, False, True]
    assert len(got) == len(rows)


def test_addresses(spark):
    urls = [("https://www.A.example.org:80/x", "a.example.org"), ("//b.net?q", "b.net"), ("ftp://u@h.de/", "h.de"), ("none", None), (None, None)]
    df = spark.createDataFrame([(u,) for u, _ in urls], "u string")
    assert [r[0] for r in df.select(language.host_of(F.col("u"))).collect()] == [h for _, h in urls]
    pages = [("<HTML class=x lang='fr-CA'><body>a<script>b</script><!-- c -->d</body>", "fr"), ("<html><p lang=de>", None), (None, None)]
    df = spark.createDataFrame([(p,) for p, _ in pages], "h string")
    assert [r[0] for r in df.select(language.markup_language(F.col("h"))).collect()] == [x for _, x in pages]
    assert df.select(language.visible_text(F.col("h"))).first()[0].split() == ["a", "d"]


def test_nothing_declared_and_empty(spark):
    df = spark.createDataFrame([(1, "some text", None, None), (2, None, None, "s"), (None, "9", None, "s")], "doc_id long, text string, lang string, source string")
    found, name = language.of_documents(df)
    assert sorted((str(r[0]), r[1], r[2]) for r in found.select("doc_id", name["lang"], name["kept"]).collect()) == [
        ("1", None, True), ("2", None, False), ("None", None, False),
    ]
    assert language.of_documents(df.limit(0))[0].collect() == []


def test_more_than_64_languages(spark):
    """Each language is kept, and a region or script takes no place of its own."""
    rng = random.Random(9)
    rows, letters = [], "bcdfghjklmnpqrstvwxz"
    for k in range(100):
        mine = [a + v + b for a in rng.sample(letters, 4) for v in "aeiou" for b in rng.sample(letters, 3)]
        for j in range(8 if k < 70 else 4):
            text = " ".join(rng.choice(mine) + rng.choice(mine) for _ in range(40))
            rows.append((len(rows), text, f"l{k}" + ["", "-US", "_gb", "-Latn-x"][j % 4], f"l{k}", f"h{j % 3}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string, source string")
    found, name = language.of_documents(docs)
    got = found.select("truth", F.col(name["lang"]).alias("said")).collect()
    assert len(got) == len(rows) and all(r.said == r.truth for r in got)


def test_rare_suffixes_count(spark, docs):
    """Suffixes beyond the most frequent 256 are evidence as well."""
    rng = random.Random(10)
    rows = []
    for k in range(1200):
        lang = ["aa", "bb", "cc"][k % 3]
        rows.append((k, prose(rng, lang, 15), None, f"w{k}.s{k % 300:03}", "c"))
    rows += [(5000 + k, "1x 2 3", None, f"new{k}.s{k:03}", "c") for k in (0, 1, 2, 297, 298, 299)]
    got = judged(spark, docs, rows)
    assert [got[5000 + k].lang for k in (0, 1, 2, 297, 298, 299)] == ["aa", "bb", "cc"] * 2
