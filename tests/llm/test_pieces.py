"""N-best segmentation against enumeration, round trips, and the texts' own N-best."""

import random
from itertools import product

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statuspulse.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def lattice():
    return pieces.load(MODEL)


def every(lattice, text):
    into, _ = lattice.lattice(text)

    def go(at, ids, score):
        if at == 0:
            yield score, ids
        else:
            for start, more, s in into[at]:
                yield from go(start, more + ids, score + s)

    return sorted(go(len(text), (), 0), key=lambda x: (-x[0], x[1])) if text else [(0, ())]


def samples(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("theaing rñ🙂x,._1▁\n²") for _ in range(rng.randrange(10))) for _ in range(n)]


def test_parts(lattice):
    for text in samples(1, 150):
        for part in lattice.parts_of(text):
            all_of = every(lattice, part)
            assert lattice.best(part, 5) == all_of[:5]
            ids, score, loss = lattice.first(part)
            assert (score, ids) == all_of[0]
            assert loss == (all_of[0][0] - all_of[1][0] if len(all_of) > 1 else float("inf"))


def test_many_parts_at_once(lattice):
    """The forward and backward pass over many parts gives what the pass over one gives."""
    rng = random.Random(9)
    letters = "theaingrionñ🙂x,._1▁²é漢\x00A"
    parts = {"".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 9, 30, 64]))) for _ in range(800)}
    parts |= {"_" * 12, "." * 31, "x", "\U0010ffff", "\n"} | {p for t in samples(8, 200) for p in lattice.parts_of(t)}
    parts = sorted(parts)
    for part, (ids, score, loss) in zip(parts, lattice.first_of_many(parts)):
        best = lattice.first(part)
        assert (tuple(memoryview(ids).cast("i")), score, loss) == best


def test_what_is_remembered_is_bounded(lattice, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED_BYTES", 20_000)
    known = pieces._Parts(lattice)
    for k in range(300):
        parts = {pieces.SPACE + f"w{k}x{j}" for j in range(10)} | {pieces.SPACE + "the"}
        known.learn(parts)
        assert all(known[p][:2] == pieces._Parts(lattice)[p][:2] for p in parts)
        assert len(known) + len(known.old) < 200


def test_no_piece_crosses_parts(lattice):
    """The whole text as one lattice has the same best scores as its parts."""
    for text in samples(2, 60):
        if not text:
            continue
        whole = every(lattice, pieces.SPACE + text[:7].replace(" ", pieces.SPACE))
        known = pieces._Parts(lattice)
        parts = [known[p] for p in lattice.parts_of(text[:7])]
        best = sum(p[1] for p in parts)
        got = [best - cost for cost, _ in pieces.segmentations(parts, 4, lattice)]
        assert got == [s for s, _ in whole[:4]]


def test_n_best_of_a_text(lattice):
    text = "there thing ingthe"
    known = pieces._Parts(lattice)
    parts = [known[p] for p in lattice.parts_of(text)]
    lists = [every(lattice, p[3]) for p in parts]
    sums = sorted((sum(s for s, _ in combo) for combo in product(*(x[:6] for x in lists))), reverse=True)
    best = sum(p[1] for p in parts)
    assert [best - c for c, _ in pieces.segmentations(parts, 6, lattice)] == sums[:6]


def test_documents(spark):
    texts = [None, "", " ", "  two  spaces ", "a\nb\r\n\tc", "▁ already", "x" * 3000, "漢字🙂́ é\x00", *samples(3, 40), "word " * 30_000]
    rows = [(k if k != 5 else None, t, 7) for k, t in enumerate(texts)] + [(1, "", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pieces int")
    found = pieces.encode(df, MODEL).cache()
    got = found.collect()
    assert len(got) == len(rows)
    assert all(r.n_best[0].score == r.score and len(r.n_best) <= 4 for r in got)
    assert [r.pieces for r in got if r.doc_id == 1] == [[], []]
    clean = {k: t or "" for k, t, _ in rows if k is not None and "▁" not in (t or "")}
    back = {r.doc_id: r.text for r in pieces.decode(found, MODEL).collect()}
    assert all(back[k] == t for k, t in clean.items())
    assert all(r.round_trip for r in got if r.doc_id in clean)
    assert pieces.encode(df.limit(0), MODEL).collect() == []


def uncut(lattice, text):
    _, reach = lattice.lattice(text)
    return reach[-1]


def test_long_parts(spark, lattice):
    """A part is one lattice however long it is."""
    rng = random.Random(5)
    texts = ["x" * 3000, "-" * 1000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4000)), "a1" * 600]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pieces.encode(df, MODEL).collect()}
    assert [got[k].score for k in range(4)] == [uncut(lattice, pieces.SPACE + t) for t in texts]
    assert [lattice.decode(got[k].pieces) for k in range(4)] == texts


def test_long_search_is_the_search(lattice):
    for text in [*samples(4, 80), "xxxx-----"]:
        if text:
            assert lattice.best_of_long(text, 5) == every(lattice, text)[:5]


def test_ids_of_the_n_best(spark, lattice):
    """The ids of each alternative, ties included, are those of the whole text's lattice."""
    texts = [t[:7] for t in samples(6, 60)] + ["it it it", "a a a", "the--the", "", "x" * 500 + " it"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = pieces.encode(df, MODEL, n_best=5)
    found = found.withColumn("all", pieces.alternatives(F.col("pieces"), F.col("n_best")))
    for r in found.collect():
        seen = pieces.SPACE + texts[r.doc_id].replace(" ", pieces.SPACE) if texts[r.doc_id] else ""
        want = every(lattice, seen)[:5] if len(seen) < 40 else lattice.best_of_long(seen, 5)
        assert [(x.score, tuple(ids)) for x, ids in zip(r.n_best, r.all, strict=True)] == want
        assert r.all[0] == r.pieces


def test_many_equally_good(lattice):
    """Of more equal segmentations than the search returns, those whose ids are less."""
    for text in ("_" * 12, "." * 14, "-" * 13, "=" * 12, pieces.SPACE * 9, "_" * 30, "." * 31, "-" * 70, "." * 47, "_" * 63, "-" * 200):
        want = every(lattice, text)[:5] if len(text) < 20 else lattice.best_of_long(text, 5)
        assert [lattice.best(text, n) for n in (1, 2, 5)] == [want[:n] for n in (1, 2, 5)]
        assert lattice.first(text)[:2] == want[0][::-1]


def test_a_part_is_looked_up_once(lattice):
    """However often the texts repeat a part; what is decoded in blocks is the texts."""

    class Counted(pieces._Parts):
        asked = 0

        def __getitem__(self, part):
            self.asked += 1
            return super().__getitem__(part)

    known = Counted(lattice)
    texts = ["the thing the " * 500, None, "", "it ñ🙂 it", "\x00" + "y" * 500, "▁ the", "the thing"]
    rows = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts)], ["doc_id", "text"])
    got = pieces.segmented(rows, known, 4).to_pylist()
    assert known.asked == len({p for t in texts for p in lattice.parts_of(t or "")})
    plain = pieces._Parts(lattice)
    for text, row in zip(texts, got, strict=True):
        parts = [plain[p] for p in lattice.parts_of(text or "")]
        best = sum(p[1] for p in parts)
        assert row["pieces"] == [k for p in parts for k in memoryview(p[0]).cast("i")]
        assert row["score"] == best
        assert [x["score"] for x in row["n_best"]] == [best - c for c, _ in pieces.segmentations(parts, 4, lattice)]
        assert row["round_trip"] == ("▁" not in (text or ""))


def test_bytes_in_blocks(lattice, monkeypatch):
    monkeypatch.setattr(pieces, "DECODED", 3)
    for text in ["", *samples(7, 40)]:
        ids = [k for p in lattice.parts_of(text) for k in lattice.first(p)[0]]
        assert lattice.bytes_of(pieces.np.array(ids, "i4")) == b"".join(lattice.raw[k] for k in ids)


def test_table_of_edges(lattice):
    """Frequent characters by the table, the others by search: the same beginnings as in the dictionary."""
    node = {"": 0} | {p: k for k, p in enumerate(lattice.begin, 1)}
    rng = random.Random(11)
    some = ["", *rng.sample(sorted(lattice.begin), 3000)]
    pairs = [(p, c) for p in some for c in "e▁Z漢é\x00\U0010ffff" + p[-1:]] + [(p[:-1], p[-1]) for p in some if p]
    to = lattice.onward(
        pieces.np.array([node[p] for p, _ in pairs], "i4"), pieces.np.array([ord(c) for _, c in pairs], "i8")
    )
    assert to.tolist() == [node.get(p + c, 0) for p, c in pairs]
